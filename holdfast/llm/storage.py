"""Files that tasks write and read themselves, and keys cut into ranges of even weight.

A task writes below a temporary name and renames it when complete. Contents
depend on the input alone, so an attempt that runs twice leaves the same bytes.
Only files that a manifest lists are ever read.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 16384  # cells of a key's range whose sizes are gathered: bounds what the driver sees
TIE_BITS = 56


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder; a plain path is a local one."""
    return arrow_fs.FileSystem.from_uri(uri)


@contextmanager
def committed(folder: str, name: str) -> Iterator:
    """A file to write; it gets its name only when the block ends well."""
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    temporary = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
    with store.open_output_stream(temporary, compression=None) as out:
        yield out
    store.move(temporary, posixpath.join(root, name))


def open_file(folder: str, name: str):
    store, root = open_store(folder)
    return store.open_input_file(posixpath.join(root, name))


@dataclass(frozen=True)
class _Node:
    """A run of whole numbers cut into cells of ``2 ** shift``; ``offset`` is the place of the first among its level's cells."""

    by_tie: bool
    shift: int
    base: int
    cells: int
    offset: int


def _node(by_tie: bool, low: int, high: int, cells: int, offset: int) -> _Node:
    shift = 0
    while (high >> shift) - (low >> shift) >= cells:
        shift += 1
    return _Node(by_tie, shift, low >> shift, (high >> shift) - (low >> shift) + 1, offset)


def _table(values: list, kind: type = np.int32) -> Column:
    return F.lit(np.array(values, dtype=kind))


def _then(value: Column, rule) -> Column:
    """``rule`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def _cell(nodes: list[_Node], at: Column, number: Column, tie: Column) -> Column:
    """Place of a row among the cells of a level; ``at`` is minus the node's place, from -1 on."""
    of = lambda name, kind=np.int64: F.element_at(_table([getattr(n, name) for n in nodes], kind), -at)
    if any(n.by_tie for n in nodes):
        number = F.when(of("by_tie", np.int32) == 1, tie).otherwise(number)
    return (of("offset") + F.call_function("shiftright", number, of("shift", np.int32)) - of("base")).cast("int")


def prefix(data: Column) -> Column:
    """The first seven bytes as a whole number: in the order of the bytes, 0 for null."""
    digits = F.rpad(F.hex(F.substring(data.cast("binary"), 1, TIE_BITS // 8)), TIE_BITS // 4, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0).cast("long"))


def range_shards(df: DataFrame, key: str, weight: Column, target: float, then: Column) -> tuple[Column, int]:
    """Shard of each row by ranges of a whole-number key, of about ``target`` weight each.

    The range of the key is cut into at most ``CELLS`` cells; shards are runs of
    cells. Cells of more than twice ``target`` are cut again between their least
    and greatest key, all of them in one pass, until none is left. Rows of one key
    (or without a key: they come first) are cut by the first bytes of ``then``,
    which is what rows of one key are ordered by. The cut depends on keys, weights
    and those bytes alone. Only rows that agree in all of it stay together.
    """
    number, tie = F.col(key).cast("long"), prefix(then)
    bounds = df.agg(F.min(number).alias("low"), F.max(number).alias("high")).first()
    low, high = (bounds.low, bounds.high) if bounds.low is not None else (0, 0)
    root = _node(False, low, high, CELLS, 1)  # cell 0 is for rows without a key
    levels, tables, sizes = [[root]], [], []
    cell, value = F.coalesce((F.shiftright(number, root.shift) - root.base + 1).cast("int"), F.lit(0)), number
    while levels[-1]:
        rows = df.select(cell.alias("cell"), value.alias("value"), weight.alias("weight"))
        found = rows.filter("cell IS NOT NULL").groupBy("cell").agg(
            F.sum("weight").alias("size"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        found = {r.cell: r for r in found.collect()}
        of_cell = {n.offset + i: n for n in levels[-1] for i in range(n.cells)}
        n_cells = max(of_cell) + 1
        tied = lambda r: r.low is None or r.low == r.high
        whole = lambda r: r.n == 1 or (tied(r) and r.cell in of_cell and of_cell[r.cell].by_tie)
        crowded = sorted(c for c, r in found.items() if (r.size or 0) > 2 * target and not whole(r))
        nodes, offset = [], 0
        for c in crowded:
            r = found[c]
            by_tie = tied(r) or of_cell[c].by_tie
            ends = (0, (1 << TIE_BITS) - 1) if tied(r) else (r.low, r.high)
            nodes.append(_node(by_tie, *ends, max(2, CELLS // len(crowded)), offset))
            offset += nodes[-1].cells
        place = {c: -1 - i for i, c in enumerate(crowded)}
        sizes.append([float(found[c].size or 0) if c in found else 0.0 for c in range(n_cells)])
        tables.append([place.get(c, 0) for c in range(n_cells)])
        levels.append(nodes)
        if nodes:
            at = _descend(levels[:-1], tables, number, tie)
            cell = _then(at, lambda v: F.when(v < 0, _cell(nodes, v, number, tie)))
            value = number
            if any(n.by_tie for n in nodes):
                by_tie = _table([n.by_tie for n in nodes])
                value = _then(at, lambda v: F.when(v < 0, F.when(F.element_at(by_tie, -v) == 1, tie).otherwise(number)))
    shard, filled, todo = 0, 0.0, [(0, c) for c in range(len(tables[0]))][::-1]
    while todo:  # cells in order, those of a crowded one in its place
        level, c = todo.pop()
        if tables[level][c] < 0:
            node = levels[level + 1][-1 - tables[level][c]]
            todo += [(level + 1, node.offset + i) for i in reversed(range(node.cells))]
            continue
        size = sizes[level][c]
        if size and filled and filled + size > target:
            shard, filled = shard + 1, 0.0
        filled += size
        tables[level][c] = shard
    return _descend(levels[:-1], tables, number, tie), shard + 1


def _descend(levels: list[list[_Node]], tables: list[list[int]], number: Column, tie: Column) -> Column:
    """What the tables hold for a row, from the first level down; below zero where the last one leads on."""
    (root,), *deeper = levels
    first = F.coalesce((F.shiftright(number, root.shift) - root.base + 1).cast("int"), F.lit(0))
    at = F.element_at(_table(tables[0]), first + 1)
    for nodes, table in zip(deeper, tables[1:]):
        at = _then(at, lambda v: F.when(v >= 0, v).otherwise(
            F.element_at(_table(table), _cell(nodes, v, number, tie) + 1)))
    return at
