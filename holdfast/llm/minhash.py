"""Near-duplicate groups by min-max hashing.

A text's set is its distinct word shingles. Under each permutation both the
smallest and the largest value are kept, so one hash evaluation yields two
signature values; bands of them are the keys of candidate buckets.

1. One scan gives each row its set's size, a 128-bit digest of the set, the band
   keys, and counts of the set's shingles in 256 cells. Rows with equal digests
   are one class; only classes go on.
2. Star rounds compare every class of a bucket with two pivots of the bucket, so
   a group of copies costs two comparisons each. Linked classes are joined to
   components, and buckets that one component holds are done: links inside a
   component decide nothing any more. Later rounds link components, not classes.
3. What is left in different components is compared in full, in tiles of at most
   about 2 x ``TILE`` classes of a bucket. A tile's task holds the cell counts
   alone, whose difference bounds the sets' difference from below: most pairs
   fall there, and no pair that is a link does.
4. Every candidate is confirmed on the full sets, which a second scan builds
   for the classes that need one.

Bands are chosen so that a pair at the threshold is missed with probability
below ``miss``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bloom
from holdfast.llm.components import components
from holdfast.llm.text import BETWEEN_SPACE, U64, grams, mix, released, slices, starts_of_grams, word_hashes
from holdfast.session import drop, land, scratch_path

ROWS = 6  # signature values per band, two from each permutation
STARS = 2  # rounds that compare with ``PIVOTS`` classes per bucket before all remaining pairs
PIVOTS = 2
CELLS = 256
TILE = 256


def agreement(similarity: float, least: int = 1000) -> float:
    """How likely two linked but different sets share both ends of a permutation, at worst.

    Of u shingles, i in common: i (i - 1) / (u (u - 1)), a little below the square of
    i / u; lowest for small sets that just reach the threshold. A single common
    shingle is never both ends, so thresholds of a half or less leave such pairs out.
    """
    worst = similarity**2
    for u in range(2, least):
        i = math.ceil(similarity * u - 1e-9)
        if 1 < i < u:
            worst = min(worst, i * (i - 1) / (u * (u - 1)))
    return worst


def n_bands(similarity: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(agreement(similarity) ** (rows // 2))))


def shingle_sets(hashes: np.ndarray, first_word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all rows, and where each row's begin (rows + 1).

    A row with fewer words than a shingle has its whole sequence as the only one.
    """
    rows = len(first_word) - 1
    sizes = np.diff(first_word)
    starts = starts_of_grams(first_word, words)
    values = grams(hashes, words)[starts]
    cut = np.searchsorted(starts, first_word)
    out = [np.zeros(0, U64)] * rows
    for row in np.flatnonzero(sizes >= words):
        part = np.sort(values[cut[row] : cut[row + 1]])
        out[row] = part[np.r_[True, part[1:] != part[:-1]]]
    for n in range(1, words):
        short = np.flatnonzero(sizes == n)
        if len(short):
            whole = grams(hashes, n)[first_word[short]]
            for row, value in zip(short, whole):
                out[row] = np.array([value], dtype=U64)
    begin = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum([len(x) for x in out], out=begin[1:])
    return (np.concatenate(out) if out else np.zeros(0, U64)), begin


def band_keys(values: np.ndarray, begin: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Keys (sets x bands) from the least and greatest value under each permutation."""
    per_band = rows // 2
    multipliers = mix(np.arange(1, bands * per_band + 1, dtype=U64)) | U64(1)
    keys = np.zeros((len(begin) - 1, bands), dtype=U64)
    scratch = np.empty_like(values)
    for i, m in enumerate(multipliers):
        np.multiply(values, m, out=scratch)
        band = keys[:, i // per_band]
        for extreme in (np.minimum, np.maximum):
            band *= U64(0x9E3779B97F4A7C15)
            band += mix(extreme.reduceat(scratch, begin[:-1]))
    return mix(keys + np.arange(bands, dtype=U64))


def cell_counts(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Shingles of each set in each cell (sets x CELLS), at most 255."""
    rows = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = rows * CELLS + (mix(values ^ U64(0xD1342543DE82EF95)) & U64(CELLS - 1)).astype(np.int64)
    counts = np.bincount(at, minlength=(len(begin) - 1) * CELLS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, CELLS)


def _sketch_scan(words: int, bands: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text"), 1 << 20):
                hashes, first_word = word_hashes(data, offsets, BETWEEN_SPACE)
                values, begin = shingle_sets(hashes, first_word, words)
                sizes = np.diff(begin)
                full = sizes > 0
                digests = np.zeros((2, high - low), dtype=U64)
                keys, cells = np.zeros((0, bands), dtype=U64), b""
                if full.any():
                    at = begin[:-1][full]
                    digests[0][full] = np.add.reduceat(mix(values + U64(1)), at)
                    digests[1][full] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), at)
                    keys = band_keys(values, np.r_[at, begin[-1]], bands)
                    cells = cell_counts(values, np.r_[at, begin[-1]]).tobytes()
                before = np.r_[0, np.cumsum(full)].astype(np.int32)  # non-empty sets before each row
                cell_ends = pa.py_buffer((before * CELLS).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        batch.column("text_hash").slice(low, high - low),
                        pa.array(sizes),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(before * bands), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), high - low, [None, cell_ends, pa.py_buffer(cells)]),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "cells"],
                )

    return released(scan)


def _set_scan(words: int, shared_bits):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared_bits.value, dtype=np.uint8)
        for batch in batches:
            keys = np.asarray(batch.column("row_key")).view(U64)
            batch = batch.filter(pa.array(bloom.may_contain(bits, keys)))
            for low, high, data, offsets in slices(batch.column("text")):
                values, begin = shingle_sets(*word_hashes(data, offsets, BETWEEN_SPACE), words)
                raw = pa.py_buffer(values.astype("<u8").tobytes())
                ends = pa.py_buffer((begin * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_key").slice(low, high - low),
                        pa.Array.from_buffers(pa.binary(), high - low, [None, ends, raw]),
                    ],
                    names=["row_key", "shingles"],
                )

    return released(scan)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                [np.frombuffer(x.as_buffer(), dtype="<u8") for x in batch.column(name)]
                for name in ("shingles_a", "shingles_b")
            ]
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(*sides)):
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("la", "lb")], names=["a", "b"])

    return released(run)


def _tile_pairs(percent: int):
    """Pairs of a tile's two sides that can be links, as far as sizes and cells tell."""

    def compare(tile: pa.Table) -> pa.RecordBatch:
        tile = tile.combine_chunks()
        number, label, size = (np.asarray(tile[c]) for c in ("class", "label", "n"))
        cells = np.frombuffer(b"".join(tile["cells"].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
        left = np.asarray(tile["left"])
        right = np.flatnonzero(np.asarray(tile["right"]))
        found = []
        for i in np.flatnonzero(left):
            apart = np.abs(cells[right] - cells[i]).sum(axis=1)
            # common / (n + m - common) >= percent / 100, with common = (n + m - apart) / 2
            most = (size[right] + size[i] - apart) / 2
            near = 100 * most >= percent * (size[right] + size[i] - most)
            near &= label[right] != label[i]
            ends = ((i, j) if number[i] < number[j] else (j, i) for j in right[near])
            found += [(number[i], number[j], label[i], label[j]) for i, j in ends]
        columns = [np.array(x, dtype=np.int64) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "la", "lb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:  # rows come sorted by tile
            tiles = np.asarray(batch.column("tile"))
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                if waiting and part.num_rows and waiting[0].column("tile")[0].as_py() != tiles[low]:
                    yield compare(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(part)
        if waiting:
            yield compare(pa.Table.from_batches(waiting))

    return released(run)


class _Run:
    """Scratch tables of one run, and the steps over them."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.spark = docs.sparkSession
        self.words, self.percent = words, percent
        self.bands = n_bands(percent / 100)
        text = F.col("text").cast("string")
        self.docs = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        self.paths: dict[int, str] = {}

    def land(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        out = land(df, path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        drop(self.spark, *(self.paths.pop(id(t)) for t in tables))

    def sketch(self) -> DataFrame:
        """One row per document."""
        schema = f"doc_id {self.id_type}, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, cells binary"
        return self.land(self.docs.mapInArrow(_sketch_scan(self.words, self.bands), schema), "sketch")

    def classes(self, rows: DataFrame) -> DataFrame:
        """One row per distinct set: number, least id, first row, size, band keys, cells."""
        per_set = (
            rows.filter("n_shingles > 0")
            .groupBy("set_a", "set_b", "n_shingles")
            .agg(
                F.min("doc_id").alias("least_id"),
                F.min(F.struct("doc_id", "text_hash")).alias("first"),
                F.first("bands").alias("bands"),
                F.first("cells").alias("cells"),
            )
        )
        numbered = per_set.withColumn("class", F.monotonically_increasing_id())
        row_key = F.xxhash64("first.doc_id", "first.text_hash")
        return self.land(numbered.withColumn("row_key", row_key).drop("first"), "classes")

    def members(self, classes: DataFrame) -> DataFrame:
        """(band, key, class, n, label) of every class that shares a bucket with another."""
        every = classes.select("class", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
        shared = every.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = self.land(shared.select("band", "key"), "shared")
        out = self.land(every.join(shared, ["band", "key"]).withColumn("label", F.col("class")), "members")
        self.drop(shared)
        return out

    def star(self, members: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of members with pivots of their bucket, and their components' labels (la, lb), where these differ."""
        lead = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "class") if i else F.lit(0).cast("long"), "class", "n", "label"))
        leads = [lead(turn * PIVOTS + i).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = members.groupBy("band", "key").agg(*leads, F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        plain = [F.struct(f"p{i}.class", f"p{i}.n", f"p{i}.label") for i in range(PIVOTS)]
        pivots = pivots.select("band", "key", F.explode(F.array_distinct(F.array(*plain))).alias("p"))
        pivots = pivots.select("band", "key", "p.class", "p.n", "p.label").toDF("band", "key", "c", "m", "l")
        alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent
        pairs = members.join(pivots, ["band", "key"]).filter((F.col("label") != F.col("l")) & alike)
        first = F.col("class") < F.col("c")
        ends = [F.when(first, x).otherwise(y) for x, y in ((F.col("class"), F.col("c")), (F.col("c"), F.col("class")), (F.col("label"), F.col("l")), (F.col("l"), F.col("label")))]
        return pairs.select(*[e.alias(n) for e, n in zip(ends, ("a", "b", "la", "lb"))]).distinct()

    def merged(self, members: DataFrame, joined: DataFrame) -> DataFrame:
        """Members with the labels of what their components were joined to."""
        joined = joined.select(F.col("id").alias("label"), F.col("label").alias("joined"))
        out = members.join(joined, "label", "left").select("band", "key", "class", "n", F.coalesce("joined", "label").alias("label"))
        out = self.land(out, "members")
        self.drop(members)
        return out

    def tiles(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs across components that the cells do not rule out, from all of every bucket.

        The largest component of a bucket is not compared with itself; the other
        members are, and with it.
        """
        per_label = members.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("size"))
        shape = per_label.groupBy("band", "key").agg(
            F.max(F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels")
        ).filter("labels > 1")
        pieces = lambda size: F.ceil(size / F.lit(TILE)).cast("int")
        shape = shape.select(
            "band",
            "key",
            F.col("main.label").alias("main"),
            pieces(F.col("main.size")).alias("mains"),
            pieces(F.col("size") - F.col("main.size")).alias("others"),
        )
        shape = self.land(shape, "shape")
        is_main = F.col("label") == F.col("main")
        chunk = F.pmod(F.xxhash64("class"), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        tile = lambda kind, i, j, left, right: F.struct(
            F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), left.alias("left"), right.alias("right")
        )
        yes, no, c = F.lit(True), F.lit(False), F.col("chunk")
        of_main = F.transform(upto(F.col("others")), lambda i: tile(0, i, c, no, yes))
        of_other = F.concat(
            F.transform(upto(F.col("mains")), lambda j: tile(0, c, j, yes, no)),
            F.transform(upto(F.col("others")), lambda j: tile(1, F.least(c, j), F.greatest(c, j), c <= j, c >= j)),
        )
        spread = (
            members.join(shape, ["band", "key"])
            .withColumn("chunk", chunk)
            .select("band", "key", "class", "n", "label", F.explode(F.when(is_main, of_main).otherwise(of_other)).alias("t"))
            .select("class", "n", "label", "t.left", "t.right", F.xxhash64("band", "key", "t.kind", "t.i", "t.j").alias("tile"))
        )
        with_cells = spread.join(classes.select("class", "cells"), "class")
        dealt = with_cells.repartition("tile").sortWithinPartitions("tile")
        return dealt.mapInArrow(_tile_pairs(self.percent), "a long, b long, la long, lb long").distinct()

    def sets(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(class, shingles) of the classes in pairs, from a scan of the texts."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        wanted = self.land(needed.join(classes, "class").select("class", "row_key"), "wanted")
        bits = self.spark.sparkContext.broadcast(bloom.build(wanted, "row_key"))
        keyed = self.docs.select(F.xxhash64("doc_id", "text_hash").alias("row_key"), "text")
        found = keyed.mapInArrow(_set_scan(self.words, bits), "row_key long, shingles binary")
        found = self.land(found.join(wanted, "row_key").dropDuplicates(["class"]).select("class", "shingles"), "sets")
        self.drop(wanted)
        return found

    def links(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Components (a, b) with a pair that is similar enough, confirmed on the full sets."""
        sets = self.sets(pairs, classes)
        both = (
            pairs.join(sets.withColumnsRenamed({"class": "b", "shingles": "shingles_b"}), "b")
            .join(sets.withColumnsRenamed({"class": "a", "shingles": "shingles_a"}), "a")
            .select("la", "lb", "shingles_a", "shingles_b")
        )
        found = both.mapInArrow(_confirm(self.percent), "a long, b long")
        out = self.land(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        self.drop(sets, pairs)
        return out


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its set's size and its group.

    Texts are linked if their sets' intersection is at least ``percent`` % of the
    union; component_id is the least doc_id reachable over links, kept whether
    it is the row's own. n_shingles counts the set; text_hash tells rows of one
    id apart.

    A text of fewer words than a shingle has its whole sequence as its only
    shingle. Null texts and texts without words are linked with nothing and are
    components of their own. Null ids count last: a group of them alone has a
    null component_id and keeps all. Repeated rows are one class and get equal
    results. An empty table gives no rows.
    """
    run = _Run(docs, words, percent)
    rows = run.sketch()
    classes = run.classes(rows)
    members = run.members(classes)
    # a class' label, as far as its components were joined in each turn
    group = classes.select("set_a", "set_b", F.col("n_shingles").alias("n"), "least_id", F.col("class").alias("label"))
    for turn in range(STARS + 1):
        if turn == 0 and members.isEmpty():
            break
        pairs = run.land(run.star(members, turn) if turn < STARS else run.tiles(members, classes), "pairs")
        if pairs.isEmpty():
            continue
        links = run.links(pairs, classes)
        if links.isEmpty():
            continue
        joined = run.land(components(links), "joined")
        now = joined.select(F.col("id").alias("label"), F.col("label").alias("joined"))
        group = group.join(now, "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined")
        if turn < STARS:
            members = run.merged(members, joined)
    least = group.groupBy("label").agg(F.min("least_id").alias("component_id"))
    group = run.land(group.join(least, "label").select("set_a", "set_b", "n", "component_id"), "groups")
    same = (rows["set_a"] == group["set_a"]) & (rows["set_b"] == group["set_b"]) & (rows["n_shingles"] == group["n"])
    alone = F.col("n_shingles") == 0
    out = rows.join(group, same, "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    found = land(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), scratch_path(run.spark, "near-duplicates"))
    drop(run.spark, *run.paths.values())
    return found


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each group, with all its columns; texts without words all stay.

    Rows that agree in doc_id and text are one row.
    """
    found = near_duplicates(docs, **options).filter("kept").select("doc_id", "text_hash", "n_shingles")
    kept = found.groupBy("doc_id", "text_hash").agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    kept = land(kept, scratch_path(docs.sparkSession, "kept"))

    def rows_of(keys: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == keys["text_hash"])
        return docs.join(keys, same, "left_semi")

    repeated = kept.filter("copies > 1 AND n > 0")
    if repeated.isEmpty():
        return rows_of(kept)
    return rows_of(kept.filter("copies = 1 OR n = 0")).union(rows_of(repeated).dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=85).drop("text_hash")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE
        WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
