"""Alignment of two tokenizers over whole texts, by inverted pair bitmaps.

Tokenizer A is a byte-level BPE file that encodes blank + text, B a sentencepiece
model that adds the blank itself. Their tokens cover the same bytes, so byte
offsets where both end cut a text into groups, and two tokens whose byte ranges
overlap are a link. Between two neighbouring ends of either kind lies exactly one
link: links are found by marking ends along the bytes.

1. One scan encodes the texts and numbers them in chunks of bounded size. For each
   id pair a chunk writes a posting: the compressed bitmap of the documents that
   hold it linked, and planes with the binary digits of how often.
2. Chunks share no document, so OR-ing a pair's bitmaps sets them side by side and
   their popcounts add up to the pair's document count; planes add up to its links.
   A map-side sum, so no pair is hot. An id's best pairs have its highest count.
3. Each posting gets its pair's count and returns it to its documents: bits times
   planes, summed chunk by chunk. A chunk's group is no longer than its texts.

Nothing but the tokenizers' own tables is held by every task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.text import released, slices
from holdfast.llm.tokens import _AS_CHARACTERS, _PRINTABLE, Encoder
from holdfast.session import land, scratch_path

CHUNK_BYTES = 12 << 20  # of text whose postings a worker gathers
CHUNK_DOCS = 1 << 16  # places in a bitmap
SLICE_BYTES = 1 << 19
_BLOCK = "▁"  # fixed: the piece file's blank


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All entries' bytes in one array, and where each begins (entries + 1)."""
    begin = np.zeros(len(entries) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in entries], out=begin[1:])
    return np.frombuffer(b"".join(entries), dtype=np.uint8), begin


def byte_level_entries(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    as_byte = {chr(b): b for b in _PRINTABLE} | {chr(c): b for b, c in _AS_CHARACTERS.items()}
    vocabulary = dict(spec["model"]["vocab"])
    plain = {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
    out = [b""] * (max([*vocabulary.values(), *plain]) + 1)
    for entry, number in vocabulary.items():
        out[number] = plain.get(number) or bytes(as_byte[c] for c in entry)
    return out


def piece_entries(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of every id of a sentencepiece model."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace(_BLOCK, " ").encode()
        for i in range(model.vocab_size())
    ]


@dataclass
class Side:
    """Ids of a run of texts by one tokenizer, and how many bytes each covers."""

    ids: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray


def _reproduces(side: Side, entries: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: whether its tokens' bytes, joined, are the wanted ones."""
    token_end = np.cumsum(side.counts)
    size = np.diff(np.r_[0, np.cumsum(side.sizes)][np.r_[0, token_end]])
    good = size == np.diff(offsets)
    if not good.any():
        return good
    keep = np.repeat(good, side.counts)
    ids, sizes = side.ids[keep], side.sizes[keep]
    starts = np.cumsum(sizes) - sizes
    source = np.repeat(entries[1][ids] - starts, sizes) + np.arange(int(sizes.sum()))
    there = wanted[np.repeat(good, np.diff(offsets))]
    wrong = np.r_[0, np.cumsum(entries[0][source] != there)]
    ends = np.r_[0, np.cumsum(np.diff(offsets)[good])]
    good[np.flatnonzero(good)[wrong[ends[1:]] > wrong[ends[:-1]]]] = False
    return good


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n - 1, left-aligned with room for a separator, and their number."""
    texts = [str(i).encode() for i in range(n)]
    width = len(texts[-1]) + 1
    return np.array([list(t.ljust(width)) for t in texts], dtype=np.uint8), np.array([len(t) for t in texts])


class Aligner:
    """Both tokenizers with their tables; aligns runs of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.encoder = Encoder(path_a)
        # strings of special tokens inside a text are ordinary text
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.added = []
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.entries_a, self.entries_b = _table(byte_level_entries(path_a)), _table(piece_entries(self.model))
        self.sizes_a, self.sizes_b = np.diff(self.entries_a[1]), np.diff(self.entries_b[1])
        self.digits, self.n_digits = _digits(max(len(self.sizes_a), len(self.sizes_b)))

    def _sides(self, texts: list[str]) -> tuple[Side, Side]:
        ids, counts = self.encoder([" " + t for t in texts])
        inside = np.ones(len(ids), dtype=bool)
        inside[np.cumsum(counts) - 1] = False  # the encoder's end id
        ids = ids[inside].astype(np.int64)
        found = self.model.encode(texts, num_threads=1)
        flat = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        counts_b = np.array([len(row) for row in found], dtype=np.int64)
        return Side(ids, counts - 1, self.sizes_a[ids]), Side(flat, counts_b, self.sizes_b[flat])

    def __call__(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Of texts that are not empty, and their bytes: which align, per aligned text
        n_a, n_b, n_groups, n_links and the digest, and all links as (row, a, b) by place."""
        n = len(texts)
        begin = offsets + np.arange(n + 1)
        wanted = np.full(len(data) + n, 0x20, dtype=np.uint8)
        after = np.ones(len(wanted), dtype=bool)
        after[begin[:-1]] = False
        wanted[after] = data
        a, b = self._sides(texts)
        good = _reproduces(a, self.entries_a, wanted, begin) & _reproduces(b, self.entries_b, wanted, begin)
        a, b = (
            Side(s.ids[keep], s.counts[good], s.sizes[keep]) for s in (a, b) for keep in [np.repeat(good, s.counts)]
        )
        ends_a, ends_b = np.cumsum(a.sizes), np.cumsum(b.sizes)
        total = int(ends_a[-1]) if len(ends_a) else 0
        mark_a, mark_b = (np.zeros(total + 1, dtype=bool) for _ in range(2))
        mark_a[ends_a] = mark_b[ends_b] = True
        # tokens that end before, at each end of either kind: the place of the one that covers it
        at = np.flatnonzero(mark_a | mark_b)
        till_a, till_b = np.cumsum(mark_a), np.cumsum(mark_b)
        both = np.flatnonzero(mark_a & mark_b)
        text_end = np.cumsum(np.diff(begin)[good])
        n_groups = np.diff(np.r_[0, np.searchsorted(both, text_end, side="right")])
        n_links = a.counts + b.counts - n_groups
        return {
            "good": good,
            "n_a": a.counts,
            "n_b": b.counts,
            "n_groups": n_groups,
            "n_links": n_links,
            "digest": self._digests(a, b, ends_a, ends_b, both, till_a, till_b),
            "row": np.repeat(np.flatnonzero(good), n_links),
            "a": a.ids[till_a[at] - mark_a[at]],
            "b": b.ids[till_b[at] - mark_b[at]],
        }

    def _digests(self, a: Side, b: Side, ends_a, ends_b, both, till_a, till_b) -> np.ndarray:
        """SHA-256 of each text's groups written out: A ids, a bar, B ids, groups split by semicolons."""
        last_a, last_b = till_a[both], till_b[both]  # tokens up to each group's end
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        place_a = np.arange(len(a.ids)) + np.r_[0, last_b][group_a]
        place_b = np.arange(len(b.ids)) + last_a[group_b]
        ids = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        sign = np.full(len(ids), ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = a.ids, b.ids
        sign[place_a[last_a - 1]] = ord("|")
        sign[place_b[last_b - 1]] = ord(";")
        written, size = self.digits[ids], self.n_digits[ids]
        written[np.arange(len(ids)), size] = sign
        out = written[np.arange(written.shape[1]) <= size[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(size + 1)][np.r_[0, np.cumsum(a.counts + b.counts)]].tolist()
        view = memoryview(out)
        return np.array([hashlib.sha256(view[x : y - 1]).hexdigest() for x, y in zip(ends, ends[1:])], dtype=object)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def pack(pair: np.ndarray, place: np.ndarray, times: np.ndarray) -> dict[str, object]:
    """Postings of sorted (pair, place) with the number of links of each.

    ``docs`` holds the places as 16-bit numbers, or as a bitmap up to the last one
    where that is shorter. ``planes`` holds, if any document has the pair more
    than once, one bit row per binary digit of the numbers, a bit for each document.
    """
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    count = np.diff(np.r_[first, len(pair)])
    last = place[first + count - 1]
    row = np.repeat(np.arange(len(first)), count)
    dense = (last >> 3) + 1 < 2 * count
    size = np.where(dense, (last >> 3) + 1, 2 * count)
    ends = _offsets(size)
    docs = np.zeros(int(ends[-1]), dtype=np.uint8)
    listed = ~dense[row]
    rank = np.arange(len(pair)) - first[row]
    at = (ends[row] + 2 * rank)[listed]
    docs[at], docs[at + 1] = place[listed] & 0xFF, place[listed] >> 8
    if dense.any():
        bits = np.zeros(len(docs) * 8, dtype=np.uint8)
        bits[(ends[row] * 8 + place)[~listed]] = 1
        docs |= np.packbits(bits)
    most = np.maximum.reduceat(times, first) if len(first) else first
    n_planes = np.where(most > 1, np.ceil(np.log2(most + 1.0)).astype(np.int64), 0)
    width = (count + 7) >> 3
    plane_ends = _offsets(n_planes * width)
    bits = np.zeros(int(plane_ends[-1]) * 8, dtype=np.uint8)
    for k in range(int(n_planes.max(initial=0))):
        has = n_planes[row] > k
        spot = (plane_ends[row] + k * width[row]) * 8 + rank
        bits[spot[has]] = (times[has] >> k) & 1
    return {
        "pair": pair[first],
        "n_docs": count,
        "n_links": np.add.reduceat(times, first) if len(first) else first,
        "docs": _binary(docs, ends),
        "planes": _binary(np.packbits(bits), plane_ends),
    }


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def unpack(count: np.ndarray, docs: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, times) of every bit of postings."""
    data, begin = _buffer(docs)
    size = np.diff(begin)
    row = np.repeat(np.arange(len(count)), count)
    rank = np.arange(len(row)) - np.repeat(_offsets(count)[:-1], count)
    place = np.zeros(len(row), dtype=np.int64)
    dense = size < 2 * count
    listed = ~dense[row]
    at = (begin[row] + 2 * rank)[listed]
    place[listed] = data[at] + (data[at + 1].astype(np.int64) << 8)
    starts = _offsets(count)
    for i in np.flatnonzero(dense):
        place[starts[i] : starts[i + 1]] = np.flatnonzero(np.unpackbits(data[begin[i] : begin[i + 1]]))
    data, begin = _buffer(planes)
    width = (count + 7) >> 3
    n_planes = np.diff(begin) // np.maximum(width, 1)
    times = (n_planes[row] == 0).astype(np.int64)
    for k in range(int(n_planes.max(initial=0))):
        has = np.flatnonzero(n_planes[row] > k)
        spot = (begin[row[has]] + k * width[row[has]]) * 8 + rank[has]
        times[has] |= ((data[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1).astype(np.int64) << k
    return row, place, times


_POSTING = ["a int", "b int", "n_docs long", "n_links long", "docs binary", "planes binary"]
_DOC = ["place int", "n_a long", "n_b long", "n_groups long", "links long", "groups_sha256 string"]


def _scan(path_a: str, path_b: str, id_type: pa.DataType):
    """Rows of documents and, with an a, postings; ``chunk`` numbers both."""
    docs_schema = [("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("links", pa.int64()), ("groups_sha256", pa.string())]
    posting_schema = [("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64()), ("n_links", pa.int64()), ("docs", pa.binary()), ("planes", pa.binary())]
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", id_type), *docs_schema, *posting_schema])

    def batch_of(chunk: int, rows: int, columns: dict) -> pa.RecordBatch:
        columns["chunk"] = pa.array(np.full(rows, chunk, dtype=np.int64))
        arrays = [
            columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type)
            for f in schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        n_b = len(aligner.sizes_b)
        chunk, place, filled, gathered = TaskContext.get().partitionId() << 32, 0, 0, []

        def postings() -> Iterator[pa.RecordBatch]:
            keys, times = (np.concatenate(x) for x in zip(*gathered)) if gathered else (np.zeros(0, np.int64),) * 2
            if len(keys):  # one document's keys come from one slice: merging the sorted runs is the OR of their bitmaps
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order]
                packed = pack(keys >> 16, keys & 0xFFFF, times)
                pair = packed.pop("pair")
                yield batch_of(chunk, len(pair), packed | {"a": pair // n_b, "b": pair % n_b})

        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text"), SLICE_BYTES):
                for start in range(low, high, CHUNK_DOCS):
                    stop = min(high, start + CHUNK_DOCS)
                    ends = offsets[start - low : stop - low + 1]
                    if place and (filled + int(ends[-1] - ends[0]) > CHUNK_BYTES or place + stop - start > CHUNK_DOCS):
                        yield from postings()
                        chunk, place, filled, gathered = chunk + 1, 0, 0, []
                    full = np.flatnonzero(np.diff(ends))
                    out = {name: np.zeros(stop - start, dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
                    digests = np.full(stop - start, "", dtype=object)
                    if len(full):
                        texts = batch.column("text").slice(start, stop - start).take(pa.array(full)).to_pylist()
                        found = aligner(texts, data[ends[0] : ends[-1]], _offsets(np.diff(ends)[full]))
                        good = full[found["good"]]
                        for name, column in out.items():
                            column[good] = found[name]
                        digests[good] = found["digest"]
                        keys = ((found["a"] * n_b + found["b"]) << 16) | (full[found["row"]] + place)
                        gathered.append(np.unique(keys, return_counts=True))
                    out["links"] = out.pop("n_links")
                    yield batch_of(
                        chunk,
                        stop - start,
                        out
                        | {
                            "doc_id": batch.column("doc_id").slice(start, stop - start),
                            "place": np.arange(place, place + stop - start),
                            "groups_sha256": digests,
                        },
                    )
                    place, filled = place + stop - start, filled + int(ends[-1] - ends[0])
        yield from postings()

    return released(run)


def _scores(_key, docs: pa.Table, postings: pa.Table) -> pa.Table:
    """A chunk's documents with what its postings return to them."""
    docs = docs.combine_chunks()
    sums = {name: np.zeros(docs.num_rows, dtype=np.int64) for name in ("n_best", "count_sum")}
    row_of = np.zeros(int(pc.max(docs["place"]).as_py()) + 1 if docs.num_rows else 0, dtype=np.int64)
    row_of[np.asarray(docs["place"])] = np.arange(docs.num_rows)
    for batch in postings.to_batches():
        if not batch.num_rows:
            continue
        row, place, times = unpack(np.asarray(batch["n_docs"]), batch["docs"], batch["planes"])
        np.add.at(sums["n_best"], row_of[place], times * np.asarray(batch["best"].cast(pa.int64()))[row])
        np.add.at(sums["count_sum"], row_of[place], times * np.asarray(batch["count"])[row])
    out = docs.drop_columns(["chunk", "place"])
    return out.append_column("n_best", pa.array(sums["n_best"])).append_column("count_sum", pa.array(sums["count_sum"]))


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, count, n_links, best): documents that hold a pair linked, its links in
    all, and whether no pair of its A id has a higher count."""
    counts = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("count"), F.sum("n_links").alias("n_links"))
    counts = land(counts, scratch_path(postings.sparkSession, "pairs"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").withColumn("best", F.col("count") == F.col("most")).drop("most")


def align(docs: DataFrame, *, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Alignment per row of ``docs`` (doc_id, text), and the table of pairs.

    Rows: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links of a best
    pair), count_sum (over links, of their pairs' document counts) and
    groups_sha256 over ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that a tokenizer does not give back byte for
    byte, have no tokens: zeros, an empty digest, no share in any count. Repeated
    rows and null ids are documents like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path_a = path_a or str(public_tokenizers.path("byte_bpe_50k.json"))
    path_b = path_b or str(public_tokenizers.path("piece_bpe_32k.model"))
    kind = docs.schema["doc_id"].dataType
    arrow_kind = spark.createDataFrame([], docs.select("doc_id").schema).toArrow().schema.field(0).type
    schema = ", ".join(["chunk long", f"doc_id {kind.simpleString()}", *_DOC, *_POSTING])
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = land(text.mapInArrow(_scan(path_a, path_b, arrow_kind), schema), scratch_path(spark, "postings"))
    postings = found.filter("a IS NOT NULL").select("chunk", *[c.split()[0] for c in _POSTING])
    pairs = land(pair_counts(postings), scratch_path(spark, "counts"))
    # a merge at any size: what a broadcast saves on a small table is no measure of a large one
    valued = postings.drop("n_links").join(pairs.drop("n_links").hint("merge"), ["a", "b"])
    valued = valued.select("chunk", "n_docs", "docs", "planes", "count", "best")
    names = ["chunk", "doc_id", *[c.split()[0] for c in _DOC]]
    rows = found.filter("a IS NULL").select(names).toDF(*names)  # columns of its own, not the postings'
    out = ", ".join([f"doc_id {kind.simpleString()}", *_DOC[1:], "n_best long", "count_sum long"])
    scored = rows.groupBy("chunk").cogroup(valued.groupBy("chunk")).applyInArrow(_scores, out)
    return scored.withColumnRenamed("links", "n_links"), pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
