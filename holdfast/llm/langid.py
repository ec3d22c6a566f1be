"""Language identification by compression.

Each language gets a raw-content zstandard dictionary of labelled text. A text's
language is the one whose dictionary, with the cost of naming the language,
encodes it in the fewest bytes. Texts are encoded as lower-case runs of letters,
so markup, digits and punctuation decide nothing.

The dictionaries are the only thing learned: pieces of ``PIECE`` characters from
at most ``SAMPLES`` labelled documents per language, picked by hash. That bounds
the sample and the broadcast (``MAX_LANGUAGES`` times about 200 KB). More languages
are learned and scored block by block from files in the shared folder, a block in
memory at a time; every text is compared with every language, however many.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from holdfast.llm.storage import committed, open_file
from holdfast.llm.text import released
from holdfast.session import scratch_path

SAMPLES = 512
PIECE = 400
MAX_LANGUAGES = 64
LEVEL = 5
SCORES = 1 << 22  # texts times languages whose sizes are held at once
CHUNK = 4096  # bytes encoded at once: the dictionary must not be outgrown by the text itself
NARROW = 0.01  # the least relative lead over the second language
UNDETERMINED = "und"
_RUNS = re.compile(r"[^\W\d_]+")  # letters, and fractions, superscripts and number letters among them


def normalise(text: str) -> str:
    """Lower-case words of letters, one blank between them and around them."""
    runs = _RUNS.findall(text.lower())
    if not all(map(str.isalpha, runs)):
        runs = "".join(c if c.isalpha() else " " for run in runs for c in f"{run} ").split()
    return f" {' '.join(runs)} "


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary bytes and the bytes that naming the language costs, by language."""

    content: dict[str, bytes]
    cost: dict[str, float]

    def encoders(self) -> list[tuple[str, float, zstandard.ZstdCompressor]]:
        out = []
        for lang, content in sorted(self.content.items()):
            content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            encoder = zstandard.ZstdCompressor(
                dict_data=content, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            out.append((lang, self.cost[lang], encoder))
        return out


@dataclass(frozen=True)
class LanguageBlocks:
    """Models of ``MAX_LANGUAGES`` languages at most in a file each, in the order of names."""

    folder: str
    files: tuple[str, ...]
    languages: int

    def encoders(self) -> Iterator[list[tuple[str, float, zstandard.ZstdCompressor]]]:
        for name in self.files:
            with open_file(self.folder, name) as source:
                content, cost = json.loads(source.read())
            yield LanguageModel({lang: x.encode() for lang, x in content.items()}, cost).encoders()


def _usable(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"), "lang"
    ).filter("lang IS NOT NULL AND text IS NOT NULL")


def _counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def fit(labelled: DataFrame) -> LanguageModel:
    """Learn one block from (doc_id, text, lang); rows without text or language teach nothing.

    More than ``MAX_LANGUAGES`` languages are an error here; ``learn`` takes any number.
    """
    labelled = _usable(labelled)
    counts = {r.lang: r.n for r in _counts(labelled).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the labels")
    return _fit(labelled, counts, sum(counts.values()))


def learn(labelled: DataFrame) -> LanguageModel | LanguageBlocks:
    """As ``fit``, of any number of languages: in blocks, one scan of the labelled texts each, where one does not do."""
    spark, labelled = labelled.sparkSession, _usable(labelled)
    counts = {r.lang: r.n for r in _counts(labelled).collect()}
    total, names = sum(counts.values()), sorted(counts)
    if len(counts) <= MAX_LANGUAGES:
        return _fit(labelled, counts, total)
    folder, files = scratch_path(spark, "languages"), []
    for i in range(0, len(names), MAX_LANGUAGES):
        block = {lang: counts[lang] for lang in names[i : i + MAX_LANGUAGES]}
        model = _fit(labelled.filter(F.col("lang").isin(list(block))), block, total)
        files.append(f"block-{len(files):06d}.json")
        with committed(folder, files[-1]) as out:
            out.write(json.dumps([{lang: x.decode() for lang, x in model.content.items()}, model.cost]).encode())
    return LanguageBlocks(folder, tuple(files), len(names))


def _fit(labelled: DataFrame, counts: dict[str, int], total: int) -> LanguageModel:
    if not counts:
        return LanguageModel({}, {})
    # thin by hash first, so that no task ranks a whole language
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 8.0 * SAMPLES / n)]), F.col("lang"))
    thinned = labelled.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1
    order = Window.partitionBy("lang").orderBy("h", "piece")
    picked = (
        thinned.select("lang", "h", F.substring("text", place, F.lit(PIECE)).alias("piece"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= SAMPLES)
        .orderBy("lang", "rank")
        .collect()
    )
    content: dict[str, list[str]] = {lang: [] for lang in counts}
    for row in picked:
        content[row.lang].append(normalise(row.piece))
    return LanguageModel(
        {lang: ("".join(parts) or " ").encode() for lang, parts in content.items()},
        {lang: -math.log2(n / total) / 8 for lang, n in counts.items()},
    )


def _sizes(text: str, encoders) -> np.ndarray:
    data = normalise(text).encode()
    parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    return np.array([cost + sum(len(e.compress(p)) for p in parts) for _, cost, e in encoders])


def _has_letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _classify(text: str | None, encoders) -> tuple[str, float, bool]:
    if not encoders or not _has_letters(text):
        return UNDETERMINED, 0.0, False
    return _shortest(_sizes(text, encoders), [lang for lang, _, _ in encoders])


def _classify_by_blocks(texts: pa.Array, model: LanguageBlocks) -> list[tuple[str, float, bool]]:
    """As ``_classify``, a block of encoders at a time over as many texts as their sizes may be held of."""
    rows, out = max(1, SCORES // model.languages), []
    for low in range(0, len(texts), rows):
        part = texts.slice(low, rows)
        names, sizes = [], [[] for _ in part]
        spoken = [_has_letters(x.as_py()) for x in part]
        for encoders in model.encoders():
            names += [lang for lang, _, _ in encoders]
            for i, x in enumerate(part):
                if spoken[i]:
                    sizes[i].append(_sizes(x.as_py(), encoders))
        out += [_shortest(np.concatenate(x), names) if x else (UNDETERMINED, 0.0, False) for x in sizes]
    return out


def _shortest(sizes: np.ndarray, names: list[str]) -> tuple[str, float, bool]:
    best = int(np.argmin(sizes))
    # a byte is worth the less the longer the text
    weights = np.exp((sizes[best] - sizes) / (1 + 0.02 * sizes[best]))
    lead = 1.0 if len(sizes) == 1 else float(np.partition(sizes, 1)[1] / sizes[best] - 1)
    return names[best], float(1 / weights.sum()), lead >= NARROW


def _scan(shared_model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        blocked = isinstance(model, LanguageBlocks)
        encoders = None if blocked else model.encoders()
        for batch in batches:
            whole_row = "row" in batch.schema.names  # then the text is taken from it
            texts = pc.struct_field(batch.column("row"), "text") if whole_row else batch.column("text")
            # one text at a time: a batch may hold very long ones
            found = _classify_by_blocks(texts, model) if blocked else [_classify(x.as_py(), encoders) for x in texts]
            lang, score, accepted = zip(*found) if found else ((), (), ())
            others = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in others]
                + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=[batch.schema.names[i] for i in others] + ["lang_pred", "score", "accepted"],
            )

    return released(scan)


def _decide(rows: DataFrame, model: LanguageModel | LanguageBlocks) -> DataFrame:
    found = StructType().add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    schema = StructType([f for f in rows.schema if f.name != "text"] + found.fields)
    return rows.mapInArrow(_scan(rows.sparkSession.sparkContext.broadcast(model)), schema)


def identify(docs: DataFrame, model: LanguageModel | LanguageBlocks, *keep: Column) -> DataFrame:
    """``keep``, lang_pred, score (0 to 1) and accepted of every row, from its text alone.

    Null texts and texts without a letter are ``und`` with score 0, not accepted;
    so is every text when nothing was learned. Any other text gets the language
    of the shortest code, ties go to the first name; it is accepted if the second
    code is longer by at least ``NARROW``. Repeated rows get equal results.
    """
    return _decide(docs.select(*keep, F.col("text").cast("string").alias("text")), model)


def fold(doc_id: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is told with a clear lead, with their columns.

    Learns from the table's own labels. The decision is taken in one scan that
    carries the row along.
    """
    model = learn(docs.select("doc_id", "text", "lang"))
    return _decide(docs.select(F.struct("*").alias("row")), model).filter("accepted").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = learn(docs.filter(~held_out))
    return identify(docs, model, F.col("doc_id"), held_out.alias("held_out"))
