"""Scoring texts by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, counted over all
training texts (A-Z folded, each text begun by ``ORDER`` marks and closed by one;
the mark 0xFF never occurs in UTF-8). A symbol is predicted by its longest
context; escapes are estimated by the number of distinct symbols a context has
(method C), and symbols that a longer context already offered are excluded from
the shorter ones. Order 0 escapes to equal shares of the bytes left.

A text's code length is the sum over its grams of ``ORDER`` + 1 bytes, so it
needs the trie only at the grams it holds:

1. One scan cuts the rows into chunks of bounded size. A chunk's rows go to a file in
   the shared folder; its distinct grams and words, with their training counts, go
   to ranges of keys, as one compressed list per range.
2. Each range sums its lists to the corpus' counts; gram counts are folded to shorter
   contexts and predictions built up again, order by order. A context has at
   most 256 symbols and a gram at most 256 longer ones, so no key is hot.
3. Each range answers every list with the values of its keys, in their order. The
   answers to a chunk meet its file again, and its texts are scored.

Nothing is broadcast; texts are not shuffled, and a chunk's table is no longer than
the chunk. A file is known by the list rows of the attempt that wrote it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from holdfast.llm.langid import fold
from holdfast.llm.storage import committed, open_file
from holdfast.llm.text import BETWEEN_SPACE, LOWER, SLICE, U64, released, slices, word_hashes
from holdfast.session import drop, land, scratch_path

ORDER = 5  # bytes of context; a gram must fit a long
CHUNK_BYTES = 12 << 20
MARK = 0xFF
_WORD = U64(1 << 63)  # set in the keys of words, not in those of grams
_SPREAD = U64(0x9E3779B97F4A7C15)
_POSITIVE = (1 << 63) - 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every symbol with its context, and the place of each text's first (texts + 1)."""
    sizes = np.diff(offsets)
    rows = len(sizes)
    padded = np.full(len(data) + rows * (ORDER + 1) + 8, MARK, dtype=np.uint8)
    symbol = np.ones(len(padded) - 8, dtype=bool)
    at = 0
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = high - low
        padded[at + ORDER : at + ORDER + n] = LOWER[data[low:high]]
        symbol[at + n + 1 : at + n + 1 + ORDER] = False  # windows that begin with the end or later
        at += n + ORDER + 1
    windows = np.ndarray(at, dtype=">u8", buffer=padded.data, strides=(1,))
    keys = windows.astype(U64)[symbol] >> U64(8 * (7 - ORDER))
    return keys, np.concatenate([[0], np.cumsum(sizes + 1)])


def gram_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``grams``; a long text's symbols come in runs."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE:
        yield grams(data, offsets)
        return
    padded = np.full(len(data) + ORDER + 9, MARK, dtype=np.uint8)
    padded[ORDER : ORDER + len(data)] = LOWER[data]
    for low in range(0, len(data) + 1, SLICE):
        n = min(len(data) + 1 - low, SLICE)
        windows = np.ndarray(n, dtype=">u8", buffer=padded[low:].data, strides=(1,))
        yield windows.astype(U64) >> U64(8 * (7 - ORDER)), np.array([0, n])


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _merge(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(keys) else counts)


class _Tallies:
    """Sorted distinct keys with their numbers; lists of like length are merged as they come."""

    def __init__(self):
        self.lists = [(np.zeros(0, U64), np.zeros(0, np.int64))]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.lists.append((keys, counts))
        while len(self.lists) > 2 and len(self.lists[-2][0]) <= 2 * len(self.lists[-1][0]):
            self.lists.append(_merge([self.lists.pop(), self.lists.pop()]))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return _merge(self.lists)


def _squeeze(values: np.ndarray) -> bytes:
    """64-bit values, compressed byte by byte of all."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _list_of(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=U64(0)))


def _keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(_expand(blob, U64), dtype=U64)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys & U64(_POSITIVE)) % U64(ranges)).astype(np.int64)


def _by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by range, and where each range begins (ranges + 1)."""
    at = _range_of(keys, ranges)
    return np.argsort(at, kind="stable"), np.r_[0, np.cumsum(np.bincount(at, minlength=ranges))]


def _keys_in(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    yield word_hashes(data, offsets, BETWEEN_SPACE)[0] | _WORD
    for keys, _ in gram_runs(data, offsets):
        yield keys


_LISTS = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _lister(folder: str, ranges: int):
    """Writes chunks of rows to files and lists their keys by range, with counts in training texts."""

    def chunk_of(parts: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        name, found = f"chunk-{number:016x}-{uuid.uuid4().hex}.arrow", _Tallies()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with committed(folder, name) as out, pa.ipc.new_stream(out, parts[0].schema, options=options) as rows:
            for part in parts:
                rows.write_batch(part)
                for trains in (True, False):
                    some = part.filter(pc.equal(part.column("held_out"), not trains))
                    for _, _, data, offsets in slices(some.column("text")):
                        for keys in _keys_in(data, offsets):
                            keys, counts = _tally(keys)
                            found.add(keys, counts * trains)
        keys, counts = found.all()
        order, begin = _by_range(keys, ranges)
        for r in np.flatnonzero(np.diff(begin)).tolist():
            at = order[begin[r] : begin[r + 1]]
            row = {"chunk": number, "file": name, "range": r, "keys": _list_of(keys[at]), "counts": _squeeze(counts[at])}
            yield pa.RecordBatch.from_pylist([row], schema=_LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, filled, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high, data, _ in slices(batch.column("text")):
                parts.append(batch.slice(low, high - low))
                filled += len(data)
                if filled > CHUNK_BYTES:
                    yield from chunk_of(parts, number)
                    parts, filled, number = [], 0, number + 1
        if parts:
            yield from chunk_of(parts, number)

    return released(run)


def _sum_lists(lists: pa.Table) -> pa.Table:
    """A range's keys with their counts in the corpus."""
    found = _Tallies()
    for batch in lists.to_batches():
        for keys, counts in zip(batch["keys"], batch["counts"]):
            found.add(_keys_of(keys.as_py()), _expand(counts.as_py(), np.int64))
    keys, counts = found.all()
    return pa.Table.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])


def _answer(lists: pa.Table, known: pa.Table) -> pa.Table:
    """For each list of a range the values of its keys, in its order."""
    key = np.asarray(known["key"].combine_chunks()).view(U64)
    order = np.argsort(key)
    key = key[order]
    value = np.asarray(known["value"].combine_chunks())[order]
    seen = np.asarray(known["seen"].combine_chunks().cast(pa.uint8()))[order]
    values, flags = [], []
    for blob in lists["keys"]:
        at = np.searchsorted(key, _keys_of(blob.as_py()))
        values.append(_squeeze(value[at]))
        flags.append(zstandard.ZstdCompressor(level=1).compress(seen[at].tobytes()))
    arrays = [lists["chunk"], lists["file"], lists["range"], pa.array(values, pa.binary()), pa.array(flags, pa.binary())]
    return pa.Table.from_arrays(arrays, names=["chunk", "file", "range", "values", "seen"])


class _Lookup:
    """Places of known keys in an open-addressed table, by columns."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.place = np.full(1 << bits, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.place[slot] < 0
            self.place[slot[free]] = todo[free]  # of several, the last one stays
            self.keys[slot[free]] = keys[todo[free]]
            left = self.place[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        miss = np.flatnonzero(self.keys[slot] != keys)
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            miss = miss[self.keys[slot[miss]] != keys[miss]]
        return self.place[slot]


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each run; runs may be empty."""
    out = np.zeros(len(begin) - 1, dtype=values.dtype)
    full = np.diff(begin) > 0
    if full.any():
        out[full] = np.add.reduceat(values, begin[:-1][full])
    return out


def _scorer(folder: str, ranges: int):
    """Scores of a chunk's rows from its file and the answers to its lists."""

    def run(answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("range")
        value = np.concatenate([_expand(x.as_py(), np.float64) for x in answers["values"]])
        seen = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8) for x in answers["seen"]])
        seen = seen.astype(np.int64)
        with open_file(folder, answers["file"][0].as_py()) as source:
            batches = pa.ipc.open_stream(source).read_all().to_batches()
        found = _Tallies()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                for keys in _keys_in(data, offsets):
                    found.add(*_tally(keys))
        key = found.all()[0]
        lookup, out = _Lookup(key[_by_range(key, ranges)[0]]), []
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                words, first_word = word_hashes(data, offsets, BETWEEN_SPACE)
                at_words = lookup(words | _WORD)
                total = np.zeros(high - low)
                for symbols, first_symbol in gram_runs(data, offsets):
                    total += _sums(value[lookup(symbols)], first_symbol)
                columns = [
                    batch.column("doc_id").slice(low, high - low),
                    batch.column("held_out").slice(low, high - low),
                    pa.array(np.diff(first_word) + 1),
                    pa.array(_sums(seen[at_words], first_word)),
                    pa.array(_sums(value[at_words], first_word)),
                    pa.array(total),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out)

    return run


def predictions(counts: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(key, value) of every gram of ``counts`` (key, n): log10 of its symbol's probability.

    Grams with n = 0 are predicted too. On level k stand the contexts of k bytes:
    t and d are a context's total and distinct symbols, ``own`` the value by this
    context, ``rest`` that after an escape from it. ``scratch`` gets the paths of
    tables that the result reads.
    """
    levels, scratch = [counts.select("key", "n")], [] if scratch is None else scratch
    for order in range(ORDER - 1, -1, -1):
        mask = F.lit((1 << (8 * (order + 1))) - 1)
        folded = levels[0].groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
        scratch.append(scratch_path(counts.sparkSession, f"order{order}"))
        levels.insert(0, land(folded, scratch[-1]))

    share = lambda x, of: F.log10(x / of)
    seen = F.when(F.col("n") > 0, 1).otherwise(0)
    every = Window.partitionBy(F.shiftright("key", 8))
    level = levels[0].withColumn("t", F.sum("n").over(every)).withColumn("d", F.sum(seen).over(every))
    level = level.withColumn("rest", -F.log10(F.greatest(F.lit(256) - F.col("d"), F.lit(1))))
    own = F.when(F.col("t") == 0, -F.log10(F.lit(256.0))).when(F.col("n") > 0, share(F.col("n"), F.col("t") + F.col("d")))
    level = level.withColumn("own", own.otherwise(share(F.col("d"), F.col("t") + F.col("d")) + F.col("rest")))
    for order in range(1, ORDER + 1):
        mask = F.lit((1 << (8 * order)) - 1)
        shorter = level.select(*[F.col(c).alias(f"{c}_") for c in ("key", "n", "t", "d", "rest", "own")])
        level = levels[order].join(shorter, F.col("key").bitwiseAND(mask) == F.col("key_"))
        level = (
            level.withColumn("t", F.sum("n").over(every))
            .withColumn("d", F.sum(seen).over(every))
            .withColumn("offered", F.sum(F.when(F.col("n") > 0, F.col("n_")).otherwise(0)).over(every))
            # what the shorter context has besides the symbols this one offered
            .withColumn("t_left", F.col("t_") - F.col("offered"))
            .withColumn("d_left", F.col("d_") - F.col("d"))
        )
        left = F.col("t_left") + F.col("d_left")
        escape = F.when(F.col("d_left") > 0, share(F.col("d_left"), left)).otherwise(F.lit(0.0))
        rest = F.when((F.col("n") == 0) & (F.col("n_") > 0), share(F.col("n_"), left)).otherwise(escape + F.col("rest_"))
        own = F.when(F.col("t") == 0, F.col("own_")).when(F.col("n") > 0, share(F.col("n"), F.col("t") + F.col("d")))
        level = level.withColumn("rest", rest)
        level = level.withColumn("own", own.otherwise(share(F.col("d"), F.col("t") + F.col("d")) + F.col("rest")))
        level = level.select("key", "n", "t", "d", "rest", "own")
    return level.select("key", F.col("own").alias("value"))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of every row of (doc_id, text), learning from those not held out.

    doc_id, held_out, n_tokens (words and an end), n_known (seen in training),
    train_tokens, base_score (log10 of the product of the tokens' smoothed
    shares), score (log10 probability of the folded text under the trie).

    Null and empty texts have the end as only token. A null ``held_out`` counts
    as false. Repeated rows are counted and scored each. Without training texts
    every byte has an equal share. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held_out = F.coalesce(held_out, F.lit(False))
    facts = docs.agg(
        F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.when(held_out, 0).otherwise(1)).alias("trains")
    ).first()
    ranges = max((facts.bytes or 0) // CHUNK_BYTES + 1, 2 * spark.sparkContext.defaultParallelism) | 1
    trains = facts.trains or 0

    scratch = [scratch_path(spark, name) for name in ("chunks", "lists", "counts")]
    rows = docs.select("doc_id", held_out.alias("held_out"), text.alias("text"))
    lists = rows.mapInArrow(_lister(scratch[0], ranges), "chunk long, file string, range int, keys binary, counts binary")
    lists = land(lists, scratch[1])
    listed = lists.select("range", "keys", "counts").groupBy("range")
    counts = land(listed.applyInArrow(_sum_lists, "key long, n long"), scratch[2])
    words = counts.filter("key < 0")
    sums = words.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("v")).first()
    total = (sums.n or 0) + trains
    distinct = (sums.v or 0) + (1 if trains else 0)
    base = lambda n: F.log10((n + F.lit(1.0)) / F.lit(float(total + distinct + 1)))
    values = words.select("key", base(F.col("n")).alias("value"), (F.col("n") > 0).alias("seen")).union(
        predictions(counts.filter("key >= 0"), scratch).select("key", "value", F.lit(False))
    )
    values = values.withColumn("range", (F.col("key").bitwiseAND(F.lit(_POSITIVE)) % ranges).cast("int"))
    asked = lists.select("chunk", "file", "range", "keys").groupBy("range")
    answers = asked.cogroup(values.groupBy("range")).applyInArrow(
        _answer, "chunk long, file string, range int, values binary, seen binary"
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = answers.groupBy("chunk").applyInArrow(_scorer(scratch[0], ranges), schema)
    scored = land(scored, scratch_path(spark, "scores"))
    drop(spark, *scratch)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if trains else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + base(F.lit(float(trains)))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 7) == 2)
