"""Quality of documents by histogram gradient-boosted trees over text statistics.

1. One scan turns each whole text into ``FEATURES``: shares of kinds of bytes,
   shapes of words and lines, repetition. Nothing else about a row is looked at.
2. Trees are fitted on a sample of labelled texts of about ``SAMPLE`` rows, drawn by
   hash; equal rows weigh as often as they occur. Features are cut into at most
   ``BINS`` bins at the sample's quantiles; trees grow level by level on histograms
   of gradients and curvatures, the smaller child's by counting, its sibling's by
   subtraction. One task fits, and the driver gets the finished trees alone.
3. The trees are complete ones, flattened into arrays: a node's children stand at
   2 i + 1 and 2 i + 2, so a block of rows goes through all trees with ``DEPTH``
   look-ups, without a branch. All rows are scored so, narrow and in place.

The sample's size bounds the fit and the broadcast; all other work is one scan.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.langid import fold
from holdfast.llm.text import BETWEEN_SPACE, grams, released, slices, span_hashes, starts_of_grams, word_spans
from holdfast.session import land, scratch_path

SAMPLE = 16_384  # labelled rows the trees are fitted on, about
BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.12
L2 = 1.0
LEAST_WEIGHT = 2.0  # sum of curvatures in a leaf is at least this share of a row's 1/4 each
_BLOCK = 8192  # rows that go through the trees at once

_BYTES = np.arange(256)
_KINDS = {  # disjoint kinds of bytes
    "lower": (_BYTES >= 0x61) & (_BYTES <= 0x7A),
    "upper": (_BYTES >= 0x41) & (_BYTES <= 0x5A),
    "digit": (_BYTES >= 0x30) & (_BYTES <= 0x39),
    "blank": np.isin(_BYTES, [0x20, 0x09]),
    "line end": np.isin(_BYTES, range(0x0A, 0x0E)),
    "stop": np.isin(_BYTES, list(b".!?")),
    "comma": np.isin(_BYTES, list(b",;:")),
    "quote": np.isin(_BYTES, list(b"'\"()-")),
    "sign": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    "control": (_BYTES < 0x20) & ~np.isin(_BYTES, range(0x09, 0x0E)) | (_BYTES == 0x7F),
    "beyond": _BYTES >= 0x80,
}
_KIND_OF = np.array(list(_KINDS.values()), dtype=np.float64).T
_LETTER = _KINDS["lower"] | _KINDS["upper"] | _KINDS["beyond"]
_IN_LINE = ~_KINDS["line end"]
FEATURES = [
    "bytes",
    *[f"share {kind}" for kind in _KINDS],
    "entropy",
    "words",
    "word length",
    "word length spread",
    "longest word",
    "words without letters",
    "words in capitals",
    "words capitalised",
    "words ending in a sign",
    "words with signs",
    "distinct words",
    "commonest word",
    "word after itself",
    "distinct pairs",
    "commonest pair",
    "distinct triples",
    "words in fours that recur",
    "lines",
    "line length",
    "distinct lines",
    "bytes in repeated lines",
    "lines ending a sentence",
    "words between stops",
]


def _per_row(values: np.ndarray, begin: np.ndarray, how=np.add) -> np.ndarray:
    """Of each row's run; 0 for an empty one."""
    out = np.zeros(len(begin) - 1)
    full = np.diff(begin) > 0
    if full.any():
        out[full] = how.reduceat(values, begin[:-1][full])
    return out


def _repetition(keys: np.ndarray, row: np.ndarray, rows: int, size: np.ndarray | None = None) -> np.ndarray:
    """Per row: distinct keys, the commonest one's number, and what occurs again (weighed by ``size``)."""
    out = np.zeros((3, rows))
    if not len(keys):
        return out
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(keys)])
    weight = np.ones(len(keys)) if size is None else size[order].astype(float)
    out[0] = np.bincount(row[first], minlength=rows)
    np.maximum.at(out[1], row[first], count)
    out[2] = np.bincount(row, weights=weight * (count[np.cumsum(new) - 1] > 1), minlength=rows)
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``FEATURES`` of each text (texts x features); all are finite, an empty text's are 0."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), sizes)
    histogram = np.bincount(row_of * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(float)
    share = lambda x, of: x / np.maximum(of, 1)
    part = share(histogram, sizes[:, None])
    entropy = -(part * np.log2(np.where(part > 0, part, 1))).sum(axis=1)
    kinds = histogram @ _KIND_OF

    starts, ends = word_spans(data, offsets, BETWEEN_SPACE)
    begin = np.searchsorted(starts, offsets)
    n = np.diff(begin)
    row = np.repeat(np.arange(rows), n)
    length = (ends - starts).astype(float)
    hashes = span_hashes(data, starts, ends)
    within = lambda mask: np.r_[0, np.cumsum(mask[data], dtype=np.int64)]
    count = lambda mask: (lambda c: c[ends] - c[starts])(within(mask))
    letters, capitals, signs = count(_LETTER), count(_KINDS["upper"]), count(_KINDS["sign"])
    small = count(_KINDS["lower"] | _KINDS["beyond"])
    head = _KINDS["upper"][data[starts]] if len(starts) else np.zeros(0, bool)
    tail = ~(_LETTER | _KINDS["digit"])[data[ends - 1]] if len(starts) else np.zeros(0, bool)
    mean = share(_per_row(length, begin), n)
    spread = np.sqrt(np.maximum(share(_per_row(length**2, begin), n) - mean**2, 0))
    of_words = lambda flags: share(_per_row(flags.astype(float), begin), n)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    single = _repetition(hashes, row, rows)
    runs = {}
    for k in (2, 3, 4):
        at = starts_of_grams(begin, k)
        runs[k] = (_repetition(grams(hashes, k)[at], row[at], rows), np.maximum(n - k + 1, 0))

    line_start, line_end = word_spans(data, offsets, _IN_LINE)
    line_begin = np.searchsorted(line_start, offsets)
    n_lines = np.diff(line_begin)
    line_row = np.repeat(np.arange(rows), n_lines)
    line_size = line_end - line_start
    lines = _repetition(span_hashes(data, line_start, line_end), line_row, rows, line_size)
    closed = _KINDS["stop"][data[line_end - 1]] if len(line_end) else np.zeros(0, bool)
    columns = [
        np.log1p(sizes),
        *share(kinds, sizes[:, None]).T,
        entropy,
        np.log1p(n),
        mean,
        spread,
        np.log1p(_per_row(length, begin, np.maximum)),
        of_words(letters == 0),
        of_words((capitals > 1) & (small == 0)),
        of_words(head),
        of_words(tail),
        of_words(signs > 0),
        share(single[0], n),
        share(single[1], n),
        of_words(again),
        share(runs[2][0][0], runs[2][1]),
        share(runs[2][0][1], runs[2][1]),
        share(runs[3][0][0], runs[3][1]),
        share(runs[4][0][2], runs[4][1]),
        np.log1p(n_lines),
        np.log1p(share(_per_row(line_size.astype(float), line_begin), n_lines)),
        share(lines[0], n_lines),
        share(lines[2], _per_row(line_size.astype(float), line_begin)),
        share(_per_row(closed.astype(float), line_begin), n_lines),
        np.log1p(share(n, kinds[:, list(_KINDS).index("stop")] + 1)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """Complete trees as arrays (trees x nodes): a row goes right where its feature is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(self.leaf.shape[1]).bit_length() - 1
        out = np.full(len(x), self.base)
        tree = np.arange(len(self.leaf))[None, :]
        for low in range(0, len(x), _BLOCK):
            block = x[low : low + _BLOCK]
            row = np.arange(len(block))[:, None]
            node = np.zeros((len(block), len(self.leaf)), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (block[row, self.feature[tree, node]] > self.cut[tree, node])
            out[low : low + _BLOCK] += self.leaf[tree, node - (2**depth - 1)].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -700, 700)))


def cuts_of(x: np.ndarray, weight: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values that end its bins: weighted quantiles of the distinct values."""
    out = []
    for column in x.T:
        order = np.argsort(column, kind="stable")
        value, total = column[order], np.cumsum(weight[order])
        last = np.r_[value[1:] != value[:-1], True]
        value, total = value[last], total[last]
        at = np.unique(np.searchsorted(total, np.arange(1, bins) / bins * total[-1])) if len(value) > bins else np.arange(len(value))
        out.append(value[at[at < len(value) - 1]])
    return out


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, *,
    trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = L2, bins: int = BINS,
) -> Forest:
    """Trees for the logistic loss; ``y`` may be a share between 0 and 1. Without rows, no trees and a score of 1/2."""
    nodes, leaves = 2**depth - 1, 2**depth
    if not len(x):
        return Forest(np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.float32), np.zeros((0, leaves)), 0.0)
    cuts = cuts_of(x, weight, bins)
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    n_features = x.shape[1]
    flat = binned + np.arange(n_features) * width
    mean = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(x), base)
    forest = Forest(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf, np.float32), np.zeros((trees, leaves)), base)

    def histogram(rows: np.ndarray, node: np.ndarray, n: int, gh: np.ndarray) -> np.ndarray:
        """(gradient or curvature, node, feature, bin)"""
        at = (node[rows][:, None] * (n_features * width) + flat[rows]).ravel()
        size = n * n_features * width
        sums = [np.bincount(at, weights=np.repeat(v[rows], n_features), minlength=size) for v in gh]
        return np.stack(sums).reshape(2, n, n_features, width)

    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gh = np.stack([weight * (p - y), weight * p * (1 - p)])
        node = np.zeros(len(x), dtype=np.int64)  # place within the level
        table = histogram(np.arange(len(x)), node, 1, gh)
        for level in range(depth):
            n = 2**level
            left = np.cumsum(table, axis=3)
            total = left[:, :, :1, -1:]
            right = total - left
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(left[1] < LEAST_WEIGHT / 4) | (right[1] < LEAST_WEIGHT / 4)] = -np.inf
            best = gain.reshape(n, -1).argmax(axis=1)
            splits = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            feature, code = best // width, best % width
            code = np.where(splits, code, width)  # a node that does not split sends all to its left
            feature = np.where(splits, feature, 0)
            place = 2**level - 1 + np.arange(n)
            forest.feature[tree, place] = feature
            forest.cut[tree, place] = [cuts[f][c] if s else np.inf for f, c, s in zip(feature, code, splits)]
            node = 2 * node + (binned[np.arange(len(x)), feature[node]] > code[node])
            if level + 1 < depth:
                sizes = np.bincount(node, minlength=2 * n).reshape(n, 2)
                small = 2 * np.arange(n) + sizes.argmin(axis=1)
                counted = np.zeros((2, 2 * n, n_features, width))
                rows = np.flatnonzero(np.isin(node, small))
                counted[:, small] = histogram(rows, node, 2 * n, gh)[:, small]
                counted[:, small ^ 1] = table - counted[:, small]
                table = counted
        sums = np.stack([np.bincount(node, weights=v, minlength=leaves) for v in gh])
        forest.leaf[tree] = -rate * sums[0] / (sums[1] + l2)
        margin += forest.leaf[tree][node]
    return forest


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, len(FEATURES))


def _statistics_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            found = statistics(data, offsets).astype("<f4")
            ends = np.arange(high - low + 1, dtype=np.int32) * (4 * len(FEATURES))
            vectors = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends), pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), vectors], names=["doc_id", "vector"])


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, vector): the statistics of every row's text as little-endian 32-bit floats."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(released(_statistics_scan), f"doc_id {kind}, vector binary")


def learn(described: DataFrame, labels: DataFrame, held_out: Column, *, sample: int = SAMPLE, **options) -> Forest:
    """Trees from the rows of ``described`` with a label (doc_id, quality) that are not held out.

    Several labels of one doc_id count as their mean; null labels and ids are left out.
    """
    label = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    label = label.agg(F.avg(F.col("quality").cast("double")).alias("y")).select(F.col("doc_id").alias("label_id"), "y")
    rows = described.filter(~F.coalesce(held_out, F.lit(True))).groupBy("doc_id", "vector").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(label, rows["doc_id"] == label["label_id"]).select("vector", "y", "n", F.xxhash64("doc_id", "vector").alias("draw"))
    rows = land(rows, scratch_path(described.sparkSession, "labelled"))
    share = sample / max(rows.count(), 1)
    drawn = rows.filter(F.shiftrightunsigned("draw", 11) < F.lit(int(min(share, 1.0) * 2**53)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("vector", pa.binary()), ("y", pa.float64()), ("n", pa.int64())])).combine_chunks()
        x = _vectors(table["vector"])
        forest = fit(x, np.asarray(table["y"]), np.asarray(table["n"]).astype(float), **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(forest)], pa.binary())], names=["forest"])

    # one order of rows, so that sums and ties come out alike however the rows were dealt
    ordered = drawn.repartition(1).sortWithinPartitions("draw").select("vector", "y", "n")
    fitted = ordered.mapInArrow(run, "forest binary").collect()
    return pickle.loads(fitted[0].forest) if fitted else fit(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0), **options)


def apply(described: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score, predicted) of every described row."""
    kind = described.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.probability(_vectors(batch.column("vector")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return described.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1; how likely the label 1 is) and predicted, per row of ``docs``.

    Learns from ``labels`` (doc_id, quality) of rows that are not held out. Null and
    empty texts are described by zeros and scored like others. A null doc_id has a
    null ``held_out`` and is not learned from. Repeated rows get equal scores; a label
    belongs to every row of its id. Without labelled rows all scores are 1/2. An empty
    table gives no rows. Other columns of both tables are not looked at.
    """
    described = land(describe(docs), scratch_path(docs.sparkSession, "statistics"))
    forest = learn(described, labels, held_out, **options)
    return apply(described, forest).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return score(docs, labels, fold("doc_id", 3) == 1)
