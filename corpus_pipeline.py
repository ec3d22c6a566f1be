"""From raw documents to token files: each stage's table is the next one's input.

The stages, each a call of one operator of ``holdfast.llm``: texts in no clear
language go, one document of each near-duplicate group stays, contaminated ones
go, sources are drawn to tempered weights, token files are written and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import langid, minhash, mixing, tokens, winnow
from holdfast.session import land, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear lead; learns from the table's own labels.

    Null texts, texts without a letter and close calls go; ties go to the first name and are
    close calls. Repeated rows stay or go together. Without labels, or rows, nothing stays.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies; rows equal in doc_id and text are one.

    Null texts and texts without words are near nothing and all stay; null ids come last. An
    empty table stays empty.
    """
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of ``benchmark``.

    Null and empty texts have no words and stay, repeated rows stay or go together. An empty
    benchmark takes nothing away.
    """
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources more often, towards tempered weights.

    Null sources are one source; null texts count as one token. Repeated rows are drawn
    together. An empty table stays empty.
    """
    return mixing.resample(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in doc_id order, and what they read back: a row per document.

    A null or empty text is its end id alone; null ids come first; rows of one id go by text.
    An empty table writes no file and gives no rows.
    """
    return tokens.encode(docs)


STAGES = [
    ("language id", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_tokens),
]
ORACLE_SQL = None  # compressed sizes, hashed permutations and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = land(docs, scratch_path(spark, f"stage{i}"))
    return docs
