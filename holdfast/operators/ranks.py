"""Exact order statistics per group without gathering a group in one task.

``percentile`` and ``row_number() over (partition by g)`` both bring a whole
group to one task. Here a group is narrowed down instead. Each value has a
coarse monotone key and finer keys below it. A pass counts rows per
(group, key); the counts show which key holds the wanted rank; the next pass
looks only at rows with that key, and so on until few rows are left. Those are
sorted, which makes the result exact whatever the keys were. Counts combine on
the map side, so a shuffle carries at most (tasks x groups x keys) small rows
however large or skewed the groups are.

Like ``DataFrame.approxQuantile`` this runs its jobs when called. What reaches
the driver is one row per (group, rank).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.functions.columns import as_column, is_finite

RankRule = Callable[[Column], Column]
KeyRule = Callable[[int], Column]

FEW_ROWS = 100_000
MAX_LEVELS = 5


@dataclass(frozen=True)
class Ranked:
    """The value found at a rank: ``n`` rows in the group, ``value`` per value column."""

    group: tuple
    tag: str
    n: int
    rank: int
    value: tuple


def numeric_key(value: Column | str) -> KeyRule:
    """Log-spaced cells 3 % wide, 4096 times finer with each level."""
    v = as_column(value)
    scaled = F.signum(v) * F.log1p(F.abs(v) * F.lit(1048576.0)) * F.lit(32.0)
    return lambda level: F.floor(scaled * F.lit(4096.0**level))


def hex_key(digest: Column | str, around: Sequence[float] = (), margin: float = 0.01) -> KeyRule:
    """Prefixes of a fixed-width hex digest: 4096 cells, 4096 times finer with each level.

    A digest is uniform, so a rank at share ``t`` lies near share ``t`` of the
    digest range. With ``around`` the first level tells cells apart only within
    ``margin`` of those shares and lumps the rest, which keeps the counts that
    a task sends per group below a hundred. A small table whose rank falls
    outside is still found: its lump is cut up by the next level.
    """
    h = as_column(digest)
    windows = sorted((max(int((t - margin) * 4096), 0), min(int((t + margin) * 4096) + 1, 4096)) for t in around)

    def first() -> Column:
        if not windows:
            return F.substring(h, 1, 3)
        cell, lump = None, "-"  # sorts before hex digits
        for low, high in windows:
            before = h < F.lit(f"{low:03x}")
            cell = F.when(before, F.lit(lump)) if cell is None else cell.when(before, F.lit(lump))
            if high < 4096:
                cell = cell.when(h < F.lit(f"{high:03x}"), F.substring(h, 1, 3))
                lump = f"{high:03x}"
        return cell.otherwise(F.lit(lump) if windows[-1][1] < 4096 else F.substring(h, 1, 3))

    return lambda level: first() if level == 0 else F.substring(h, 1, 3 * (level + 1))


def select_ranks(
    df: DataFrame,
    groups: Sequence[str],
    value: Sequence[str],
    key: KeyRule,
    ranks: dict[str, RankRule],
    few_rows: int = FEW_ROWS,
) -> list[Ranked]:
    """The row at given 1-based ranks of ``value`` inside each group.

    ``ranks`` maps a tag to a rule from the group's row count to a rank; ranks
    outside 1..n give no entry. ``key(level)`` must not decrease as ``value``
    grows, and level k+1 must refine level k. Groups are study keys (setting,
    seed, column name), so brackets are few and can be broadcast.
    """
    groups, value = list(groups), list(value)
    rows = df.select(*groups, *value)
    by_group = W.partitionBy(*groups)
    running = by_group.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    wanted = F.array(*[F.struct(F.lit(tag).alias("tag"), rule(F.col("n")).cast("bigint").alias("rank"))
                       for tag, rule in ranks.items()])
    counted = rows.withColumn("_cell", key(0)).groupBy(*groups, "_cell").agg(*_cell_counts(value))
    held = (
        counted.withColumn("n", F.sum("_rows").over(by_group))
        .withColumn("_upto", F.sum("_rows").over(running))
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .select(*groups, "n", F.explode(wanted).alias("_w"), "_cell", "_rows", "_many", "_before")
        .select(*groups, "n", "_w.tag", "_w.rank", "_cell", "_rows", "_many", "_before")
        .where("rank > _before AND rank <= _before + _rows")
    )
    found = held.collect()
    level = 0
    while level + 1 < MAX_LEVELS and any(r["_many"] and r["_rows"] > few_rows for r in found):
        finer = rows.withColumn("_cell", key(level))
        found = _narrow(finer, held, found, groups, value, {"_cell": key(level + 1)})
        level += 1
    if not found:
        return []
    last = _narrow(rows.withColumn("_cell", key(level)), held, found, groups, value, {v: F.col(v) for v in value})
    return [Ranked(tuple(r[g] for g in groups), r["tag"], r["n"], r["rank"], tuple(r[v] for v in value)) for r in last]


def _cell_counts(value: Sequence[str]) -> list[Column]:
    """Rows of a cell and whether it may hold several values: one hot value needs no finer cells."""
    many = F.min(value[0]) != F.max(value[0]) if len(value) == 1 else F.lit(True)
    return [F.count(F.lit(1)).alias("_rows"), many.alias("_many")]


def _narrow(rows, like, found, groups, value, lower):
    """Within each found cell, the finer cell (or value) that holds the rank."""
    cells = rows.sparkSession.createDataFrame([tuple(r[c] for c in like.columns) for r in found], like.schema)
    inside = rows.join(F.broadcast(cells.drop("_rows", "_many")), [*groups, "_cell"])
    names = list(lower)
    keep = [*groups, "n", "tag", "rank", "_before"]
    counted = (
        inside.select(*keep, *value, *[c.alias(f"_to_{name}") for name, c in lower.items()])
        .groupBy(*keep, *[f"_to_{name}" for name in names])
        .agg(*_cell_counts(value))
    )
    order = W.partitionBy(*groups, "tag").orderBy(*[f"_to_{name}" for name in names])
    return (
        counted.withColumn("_upto", F.col("_before") + F.sum("_rows").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .where("rank > _before AND rank <= _upto")
        .select(*groups, "n", "tag", "rank", *[F.col(f"_to_{name}").alias(name) for name in names], "_rows", "_many", "_before")
        .collect()
    )


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]
) -> dict[tuple, dict[str, Any]]:
    """Linearly interpolated quantiles of the finite values per group.

    ``{group: {"n": rows, name: quantile, ...}}`` for groups with a finite value.
    """
    rows = df.where(is_finite(value)).select(*groups, F.col(value).cast("double").alias("_v"))

    def position(p: float, n: Column) -> Column:
        return F.lit(float(p)) * (n - 1)

    ranks: dict[str, RankRule] = {}
    for name, p in probs.items():
        ranks[f"{name}/lo"] = lambda n, p=p: F.floor(position(p, n)) + 1
        ranks[f"{name}/hi"] = lambda n, p=p: F.least(F.floor(position(p, n)) + 2, n)
    at: dict[tuple, dict[str, float]] = {}
    sizes: dict[tuple, int] = {}
    for r in select_ranks(rows, groups, ["_v"], numeric_key("_v"), ranks):
        at.setdefault(r.group, {})[r.tag] = r.value[0]
        sizes[r.group] = r.n
    out = {}
    for group, ends in at.items():
        n = sizes[group]
        out[group] = {"n": n}
        for name, p in probs.items():
            share = float(p) * (n - 1) % 1.0
            lo, hi = ends[f"{name}/lo"], ends[f"{name}/hi"]
            out[group][name] = lo + (hi - lo) * share
    return out


def quantile_table(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` as a small table: ``groups, n`` and a column per name."""
    found = exact_quantiles(df, groups, value, probs)
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{g}` {types[g]}" for g in groups], "n bigint", *[f"`{p}` double" for p in probs]])
    rows = [(*group, v["n"], *[v[p] for p in probs]) for group, v in found.items()]
    return df.sparkSession.createDataFrame(rows, schema)
