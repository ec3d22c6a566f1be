"""Benchmark decontamination by winnowing.

Both sides are cut into words and k-grams of words are hashed. Of the k-grams
inside each window of ``window`` words the minimum hash is kept; equal windows
keep equal minima, so every shared run of ``window`` words or more is found.

1. Benchmark: every window with its fingerprint, as a table; its fingerprints
   also as a bit set of fixed size.
2. Documents, one scan: fingerprints that the bit set lets through are extended
   to the windows that selected them; those windows' hashes go on, nothing else.
3. An equi-join on (fingerprint, window) keeps true windows. The benchmark side
   is distinct, so a passage in any number of documents or items yields one row
   per occurrence.
4. Hit words are the union of the windows' spans; items come from the distinct
   lists of items that share a window.

An item shorter than a window is one window of its own length, looked up among
all document grams of that length (at most ``window`` - 1 lengths exist).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from holdfast.llm import bloom
from holdfast.llm.text import ALNUM, grams, slices, starts_of_grams, word_hashes
from holdfast.session import land, scratch_path

_FOUND = "n_words long, start array<int>, length array<int>, fingerprint array<long>, span array<long>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _fingerprints(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    return sliding_min(grams(hashes, k), window - k + 1)


def _spans(hashes, first_word, window, k, short, bits):
    """Places, lengths, fingerprints and hashes of the windows that pass the bit set."""
    found = []
    starts = starts_of_grams(first_word, window)
    if len(starts):
        prints = _fingerprints(hashes, window, k)[starts]
        # neighbouring windows mostly keep the same k-gram: ask once per kept one
        fresh = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        kept = np.repeat(bloom.may_contain(bits, prints[fresh]), np.diff(np.r_[fresh, len(prints)]))
        starts, prints = starts[kept], prints[kept]
        if len(starts):
            found.append((starts, np.full(len(starts), window), prints, grams(hashes, window)[starts]))
    for length in short:
        starts = starts_of_grams(first_word, length)
        spans = grams(hashes, length)[starts]
        kept = bloom.may_contain(bits, spans)
        found.append((starts[kept], np.full(int(kept.sum()), length), spans[kept], spans[kept]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    found = [np.concatenate(x) for x in zip(*found)]
    order = np.argsort(found[0], kind="stable")
    return tuple(x[order] for x in found)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))


def _document_scan(window: int, k: int, short: list[int], shared_bits):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared_bits.value, dtype=np.uint8)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                hashes, first_word = word_hashes(data, offsets, ALNUM)
                place, length, prints, spans = _spans(hashes, first_word, window, k, short, bits)
                cut = np.searchsorted(place, first_word)
                row = np.repeat(np.arange(high - low), np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(low, high - low) for i in range(2)]
                    + [
                        pa.array(np.diff(first_word)),
                        _lists(place - first_word[:-1][row], cut, pa.int32()),
                        _lists(length, cut, pa.int32()),
                        _lists(prints, cut, pa.int64()),
                        _lists(spans, cut, pa.int64()),
                    ],
                    names=["doc_id", "text_hash", "n_words", "start", "length", "fingerprint", "span"],
                )

    return scan


def _item_scan(window: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                hashes, first_word = word_hashes(data, offsets, ALNUM)
                starts = starts_of_grams(first_word, window)
                row = np.searchsorted(first_word, starts, side="right") - 1
                spans = grams(hashes, window)[starts]
                prints = _fingerprints(hashes, window, k)[starts]
                parts = [(row, np.full(len(row), window), prints, spans)]
                sizes = np.diff(first_word)
                for n in np.unique(sizes[(sizes > 0) & (sizes < window)]):
                    row = np.flatnonzero(sizes == n)
                    spans = grams(hashes, int(n))[first_word[row]]
                    parts.append((row, np.full(len(row), n), spans, spans))
                row, length, prints, spans = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(low + row)),
                        pa.array(length).cast(pa.int32()),
                        pa.array(prints.view(np.int64)),
                        pa.array(spans.view(np.int64)),
                    ],
                    names=["item_id", "length", "fingerprint", "span"],
                )

    return scan


def benchmark_windows(items: DataFrame, window: int = 13, k: int = 6) -> DataFrame:
    """(item_id as text, length, fingerprint, span) of every window of every item."""
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _item_scan(window, k), "item_id string, length int, fingerprint long, span long"
    )


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, k: int = 6) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): how much of it occurs in ``items``.

    n_words, n_hit (words inside any occurrence of a window), n_items (items with
    such windows), items_sha256 (of their ids, sorted as text, joined by commas),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words); text_hash tells rows of
    one id apart.

    Null and empty texts have no words and no hits. Repeated rows give repeated
    results. Items without words never match; an item with a null id makes words
    hit but is not counted or listed. Empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    windows = land(benchmark_windows(items, window, k), scratch_path(spark, "windows"))
    short = [r.length for r in windows.filter(F.col("length") < window).select("length").distinct().collect()]
    bits = spark.sparkContext.broadcast(bloom.build(windows.select("fingerprint").distinct(), "fingerprint"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, {_FOUND}"
    text = F.col("text").cast("string")
    found = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        _document_scan(window, k, sorted(short), bits), schema
    )
    found = land(found.withColumn("row", F.monotonically_increasing_id()), scratch_path(spark, "found"))

    # items that share a window, as one list per distinct combination
    per_window = (
        windows.groupBy("fingerprint", "span").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    ).withColumn("list", F.xxhash64("items"))
    per_window = land(per_window, scratch_path(spark, "per-window"))
    lists = per_window.select("list", "items").dropDuplicates(["list"])

    hits = (
        found.filter(F.size("span") > 0)
        .select("row", F.explode(F.arrays_zip("start", "length", "fingerprint", "span")).alias("w"))
        .select("row", "w.*")
        .join(per_window.select("fingerprint", "span", "list"), ["fingerprint", "span"])
        .select("row", "start", (F.col("start") + F.col("length")).alias("stop"), "list")
    )
    hits = land(hits, scratch_path(spark, "hits"))
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    words = hits.select("row", covered.alias("words")).groupBy("row").agg(F.sum("words").alias("n_hit"))
    # documents with the same combination of lists have the same items: these are written out once
    held = hits.groupBy("row").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    held = land(held.withColumn("combination", F.xxhash64("lists")), scratch_path(spark, "held"))
    named = (
        held.select("combination", "lists")
        .distinct()
        .select("combination", "lists", F.explode("lists").alias("list"))
        .join(lists, "list")
        .select("combination", "lists", F.explode("items").alias("item"))
        .groupBy("combination", "lists")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("combination", "lists", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("digest"))
    )
    named = held.join(named, ["combination", "lists"]).select("row", "n", "digest")
    return (
        found.select("row", "doc_id", "text_hash", "n_words")
        .join(words, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        )
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items, **options).filter("contaminated").select("doc_id", "text_hash").distinct()
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash"))
    key = docs["doc_id"].eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_bad_hash"))
    return docs.join(bad, key, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).drop("text_hash")


# windows and words as SQL lists; whole tables, every row
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
         SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
         SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
