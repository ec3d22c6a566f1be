"""Token ids of whole texts in word-aligned binary files.

Documents go to shards by ranges of doc_id, are sorted there, encoded and
written as one file per shard. A file is a run of frames, each self-contained:

    magic, then seven little-endian 64-bit counts: documents, ids, words,
    escapes, blocks, and two reserved; then doc_ids (int64), whether each is
    present (uint8), ids of each document (int64), block offsets (int64),
    escaped values (uint64), words (uint64)

The manifest is a table with one row per file; files it does not list are never
read. A text's ids do not depend on its neighbours, and words between white
space are encoded one by one by the pre-tokenizer, so each worker encodes a
repeated piece once.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer

from holdfast.llm import simple8b
from holdfast.llm.storage import committed, open_file, range_shards
from holdfast.llm.text import released, worker_cache
from holdfast.session import land, scratch_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
MAGIC = b"S8BTOK01"
SHARD_BYTES = 24 << 20
FRAME_BYTES = 2 << 20
PIECES = 1_000_000  # distinct pieces a worker remembers at a time
END = 2
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed: Unicode white space
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"  # letters beyond doubt; what follows them begins anew
_PIECE = re.compile(
    f" ?[{_LATIN}]+(?=[{_BLANKS}.,;:!?]|\\Z)| ?[^{_BLANKS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
_LETTERS = re.compile(f" ?[{_LATIN}]+").fullmatch
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that stand for themselves
_AS_CHARACTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_BLANK = chr(_AS_CHARACTERS[ord(" ")])
_encoders: dict[tuple[str, int], Encoder] = worker_cache("encoders")


class _Places(dict):
    """Numbers pieces as they come, and lists the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.fresh.append(piece)
        return place


class Encoder:
    """Ids of texts, with a bounded memory of the pieces seen."""

    def __init__(self, path: str, end: int = END):
        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = self._splits_at_blanks(spec)
        # these are cut out before words are: blanks next to them end a run, so such a text is one piece
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self._forget()

    @staticmethod
    def _splits_at_blanks(spec: dict) -> bool:
        """Whether no token can reach across the pieces: byte-level words, nothing before them."""
        words = spec.get("pre_tokenizer") or {}
        plain = words.get("type") == "ByteLevel" and not words.get("add_prefix_space") and words.get("use_regex", True)
        added = spec.get("added_tokens") or []
        blank = re.compile(f"[{_BLANKS}]")
        odd = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or blank.search(t["content"]) for t in added)
        return plain and spec.get("normalizer") is None and not odd

    def _forget(self) -> None:
        self.places = _Places()
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. A piece of letters is one word, which the library's model takes as it is."""
        tokenize, rest = self.tokenizer.model.tokenize, []
        out: list = [None] * len(pieces)
        for i, piece in enumerate(pieces):
            if _LETTERS(piece):
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1").translate(_AS_CHARACTERS)
                out[i] = [t.id for t in tokenize(piece.replace(" ", _BLANK))]
            else:
                rest.append(i)
        if rest:
            found = self.tokenizer.encode([pieces[i] for i in rest], is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(rest))).tolist()
            ids, low = found.ids, 0
            for i, high in zip(rest, ends):
                out[i], low = ids[low:high], high
        return out

    def _place(self, pieces: list[str]) -> np.ndarray:
        """Place of each piece in the memory; new pieces are encoded."""
        if len(self.places) > PIECES:
            self._forget()
        out = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        fresh, self.places.fresh = self.places.fresh, []
        if fresh:
            ids = self._encode(fresh)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, an end id after each text, and the number per text."""
        if not self.by_piece:
            whole = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            per_text = [np.array([*e.ids, self.end], dtype=np.uint32) for e in whole]
            return np.concatenate(per_text), np.array([len(x) for x in per_text])
        split = [[t] if any(a in t for a in self.added) else _PIECE.findall(t) for t in texts]
        pieces = [p for row in split for p in row]
        place = self._place(pieces)
        sizes = self.begin[place + 1] - self.begin[place]
        n_pieces = np.array([len(row) for row in split], dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])
        text_end = before[np.cumsum(n_pieces)]
        counts = np.diff(np.r_[0, text_end]) + 1
        # every id's place in the memory: where its piece begins, plus its place in the piece
        source = np.repeat(self.begin[place] - before[:-1], sizes) + np.arange(before[-1])
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        ends = np.cumsum(counts) - 1
        inside = np.ones(len(out), dtype=bool)
        inside[ends] = False
        out[inside], out[ends] = self.flat[source], self.end
        return out, counts


def frame(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> bytes:
    words, escapes, blocks = simple8b.encode(ids)
    head = struct.pack("<8s7q", MAGIC, len(counts), len(ids), len(words), len(escapes), len(blocks), 0, 0)
    present = np.asarray(doc_ids.is_valid()).astype(np.uint8)
    numbers = np.asarray(doc_ids.cast(pa.int64()).fill_null(0)).astype("<i8")
    parts = [numbers, present, counts.astype("<i8"), blocks.astype("<i8"), escapes.astype("<u8"), words.astype("<u8")]
    return head + b"".join(p.tobytes() for p in parts)


def frames(source) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, present, ids of each, all ids) of every frame of an open file."""
    size = struct.calcsize("<8s7q")
    while head := source.read(size):
        magic, docs, n, n_words, n_escapes, n_blocks, _, _ = struct.unpack("<8s7q", head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        parts = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", n_blocks), ("<u8", n_escapes), ("<u8", n_words)):
            parts.append(np.frombuffer(source.read(count * np.dtype(kind).itemsize), dtype=kind))
        numbers, present, counts, blocks, escapes, words = parts
        yield numbers, present.astype(bool), counts, simple8b.decode(words, escapes, blocks, 0, n)


def _by_size(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), limit, side="right")) + low)
        yield low, min(high, len(sizes))
        low = high


def _writer(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end) not in _encoders:  # a worker that is used again keeps its pieces
            _encoders[path, end] = Encoder(path, end)
        encoder = _encoders[path, end]
        todo = (
            (int(shard), part)
            for batch in batches
            for shard in np.unique(np.asarray(batch.column("shard")))
            for part in [batch.filter(pc.equal(batch.column("shard"), int(shard)))]
        )
        current = next(todo, None)
        while current:  # rows come sorted by shard
            shard, docs, total = current[0], 0, 0
            name = f"shard-{shard:06d}.s8b"
            with committed(folder, name) as out:
                while current and current[0] == shard:
                    part = current[1]
                    for low, high in _by_size(part.column("text"), FRAME_BYTES):
                        rows = part.slice(low, high - low)
                        ids, counts = encoder([x or "" for x in rows.column("text").to_pylist()])
                        out.write(frame(rows.column("doc_id"), ids, counts))
                        docs, total = docs + len(counts), total + len(ids)
                    current = next(todo, None)
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": name, "n_docs": docs, "n_tokens": total}],
                schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    return released(run, keep="encoders")


def write(docs: DataFrame, folder: str, *, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the token files of (doc_id, text); returns the manifest, landed beside them.

    Documents are in ascending doc_id order over all files, null ids first, ties
    by text. Null texts count as empty: their only id is the end id. Repeated
    rows are all written. An empty table has no files.
    """
    text = F.col("text").cast("string")
    plain = docs.select("doc_id", text.alias("text"))
    shard, shards = range_shards(plain, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 8, shard_bytes, F.col("text"))
    placed = (
        plain.withColumn("shard", shard)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "doc_id", "text")
    )
    manifest = placed.mapInArrow(
        _writer(folder, tokenizer, end), "shard int, file string, n_docs long, n_tokens long"
    )
    return land(manifest, f"{folder}/manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["before"]
                with open_file(folder, row["file"]) as source:
                    for numbers, present, counts, ids in frames(source):
                        starts = start + np.cumsum(counts) - counts
                        raw = ids.astype("<u4").tobytes()
                        ends = np.cumsum(counts) * 4
                        crcs = [zlib.crc32(raw[e - 4 * c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(numbers, mask=~present), pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        start += int(counts.sum())

    return run


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = manifest.withColumn(
        "before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    n = max(1, manifest.count())
    spread = files.repartition(n, "shard").select("file", "before")
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, *, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Write a table's token files to the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    tokenizer = tokenizer or str(public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(write(docs, folder, tokenizer=tokenizer, end=end), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
