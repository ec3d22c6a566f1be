"""Mixing sources to target weights by temperature.

Source token shares p are turned into weights proportional to p ** a. The
exponent a in [0, 1] is found by bisection: the largest one (closest to the
sources' own shares) whose weights have at least ``entropy`` times the greatest
possible entropy, then raised as far as needed for no source to be repeated more
than ``repeats`` times. Weights and the token budget give each source a quota.

Quotas are met by block permutations. Every pass over a source is a new seeded
permutation: documents fall into blocks of about ``BLOCK_TOKENS`` by a hash of
(seed, pass, document), blocks follow each other, and inside a block documents
go by their hash. Only the last pass over a source is cut. Block sums tell in
which block, and that block alone is summed by document. The cut is one row per
source and pass, so drawing documents is a scan and a filter: texts never move,
and no source is ever ordered as a whole.

Up to ``MAX_SOURCES`` sources the plan is made by source and broadcast. Beyond, it
is made by their sizes (the distinct token totals, which are few: the square root
of all tokens bounds them) and joined as a table; then only sources too small to
crowd a task are joined by a shuffle, and their texts move.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from holdfast.session import land, scratch_path

ENTROPY = 0.9
REPEATS = 4.0
BLOCK_TOKENS = 1 << 16
MAX_SOURCES = 100_000
STEPS = 50
_PASSES = "source string, pass int, blocks long, quota long, whole boolean"


def weights_at(tokens: dict, exponent: float, times: dict | None = None) -> dict:
    """Normalised weights of sources with tokens; ``times`` is how many sources an entry stands for."""
    times = times or dict.fromkeys(tokens, 1)
    total = sum(n * times[s] for s, n in tokens.items())
    powers = {s: (n / total) ** exponent for s, n in tokens.items() if n}
    whole = math.fsum(p * times[s] for s, p in powers.items())
    return {s: p / whole for s, p in powers.items()}


def entropy_share(weights: dict, times: dict | None = None) -> float:
    """Entropy relative to equal weights; 1 for a single source."""
    times = times or dict.fromkeys(weights, 1)
    n = sum(times[s] for s in weights)
    if n < 2:
        return 1.0
    return -math.fsum(times[s] * w * math.log(w) for s, w in weights.items() if w) / math.log(n)


def most_repeats(tokens: dict, weights: dict, budget: int) -> float:
    return max((w * budget / tokens[s] for s, w in weights.items()), default=0.0)


def _bisect(good_low: bool, ok) -> float:
    """The edge of ``ok`` in [0, 1], on the side where it holds."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        if ok(middle) == good_low:
            low = middle
        else:
            high = middle
    return low if good_low else high


@dataclass(frozen=True)
class Mix:
    exponent: float
    weights: dict
    quotas: dict  # tokens to take from each source
    by_size: bool = False  # weights and quotas go by a source's tokens: the same for all sources of that size


def full_use(tokens: dict, weights: dict) -> int:
    """The least budget at which every source is drawn in full at least once."""
    return math.ceil(max((tokens[s] / w for s, w in weights.items()), default=0) - 1e-6)


def solve(
    tokens: dict, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, times: dict | None = None
) -> Mix:
    """Exponent, weights and quotas; the repetition limit goes before the entropy.

    Flatter weights have more entropy, and repeat small sources more often. With
    a budget above ``repeats`` times all tokens the limit cannot hold: exponent 1.
    Without a budget it is the one of ``full_use``: no document is left out.
    """
    tokens = {s: n for s, n in tokens.items() if n}
    if not tokens:
        return Mix(1.0, {}, {})
    flat_enough = lambda a: entropy_share(weights_at(tokens, a, times), times) >= entropy
    exponent = 1.0 if flat_enough(1.0) else _bisect(True, flat_enough)

    def seldom(a: float) -> bool:
        weights = weights_at(tokens, a, times)
        return most_repeats(tokens, weights, budget or full_use(tokens, weights)) <= repeats + 1e-6

    if not seldom(exponent):
        exponent = _bisect(False, lambda a: a >= exponent and seldom(a)) if seldom(1.0) else 1.0
    weights = weights_at(tokens, exponent, times)
    budget = budget or full_use(tokens, weights)
    return Mix(exponent, weights, {s: round(w * budget) for s, w in weights.items()}, times is not None)


def words(text: str = "text") -> Column:
    """A document's tokens for the mix: pieces between blanks, and its end."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.length(text) - F.length(F.translate(text, " \t\r\n", "")) + F.when(text == "", 1).otherwise(2)


def _order(seed: int, number: Column, row_key: Column) -> Column:
    return F.xxhash64(F.lit(seed), number, row_key)


def _block(order: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(order, 1), blocks)


def _passes(spark: SparkSession, plan: Mix, tokens: dict, block_tokens: int) -> DataFrame:
    """(source, pass, blocks, quota, whole) of every pass."""
    rows = [
        (s, i, max(1, -(-tokens[s] // block_tokens)), quota - i * tokens[s], (i + 1) * tokens[s] <= quota)
        for s, quota in plan.quotas.items()
        for i in range(-(-quota // tokens[s]))
    ]
    return spark.createDataFrame(rows, _PASSES)


def _passes_by_size(totals: DataFrame, plan: Mix, block_tokens: int) -> DataFrame:
    """As ``_passes``, of a table (source, n)."""
    of_size = _passes(totals.sparkSession, plan, {n: n for n in plan.quotas}, block_tokens)
    return totals.join(of_size.withColumnRenamed("source", "_n"), F.col("n") == F.col("_n").cast("long")).select(
        "source", "pass", "blocks", "quota", "whole"
    )


def _by_source(rows: DataFrame, table: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Rows with what ``table`` has for their source: by broadcast, or that for the ``heavy`` sources and a shuffle for the rest."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    if heavy is None:
        return rows.join(F.broadcast(table), same)
    few = F.broadcast(heavy.select(F.col("source").alias("_heavy")))
    hot = table.join(few, F.col("_source").eqNullSafe(F.col("_heavy")), "left_semi")
    cold = rows.join(few, F.col("source").eqNullSafe(F.col("_heavy")), "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(cold.join(table, same))


def _cuts(sized: DataFrame, passes: DataFrame, heavy: DataFrame | None, seed: int) -> DataFrame:
    """(source, pass, blocks, cut_block, cut_order) of every pass; whole passes have no cut."""
    spark = sized.sparkSession
    part = passes.filter("NOT whole").withColumnRenamed("source", "_source")  # a row per source at most
    order = _order(seed, F.col("pass"), F.col("row_key"))
    placed = (
        _by_source(sized, part, heavy)
        .select("source", "pass", "blocks", "quota", "tokens", order.alias("order"))
        .withColumn("block", _block(F.col("order"), F.col("blocks")))
    )
    sums = placed.groupBy("source", "pass", "quota", "block").agg(F.sum("tokens").alias("filled"))
    so_far = F.sum("filled").over(Window.partitionBy("source", "pass").orderBy("block")) - F.col("filled")
    last = sums.withColumn("before", so_far).filter("before < quota AND before + filled >= quota")
    last = last.select(F.col("source").alias("_source"), F.col("block").alias("cut_block"), "before")
    # rows that tie in the order stand or fall together
    inside = (
        placed.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("cut_block")))
        .groupBy("source", "cut_block", "before", "quota", "order")
        .agg(F.sum("tokens").alias("tokens"))
    )
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("order")) - F.col("tokens")
    cut = inside.withColumn("start", F.col("before") + upto).filter("start < quota")
    cut = cut.groupBy("source", "cut_block").agg(F.max("order").alias("cut_order"))
    cut = land(cut.withColumnRenamed("source", "_source"), scratch_path(spark, "cuts"))
    partial = passes.filter("NOT whole").join(cut, F.col("source").eqNullSafe(F.col("_source")))
    none = F.lit(None).cast("long")
    whole = passes.filter("whole").select("source", "pass", "blocks", none.alias("cut_block"), none.alias("cut_order"))
    return whole.union(partial.select("source", "pass", "blocks", "cut_block", "cut_order"))


def mix(
    docs: DataFrame,
    *,
    budget: int | None = None,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    seed: int = 7,
    block_tokens: int = BLOCK_TOKENS,
) -> tuple[DataFrame, Mix]:
    """Every document drawn as (row, tokens, pass, block, order), and the mix.

    ``row`` holds the document's columns, once per pass that draws it. A source
    is drawn until its quota is reached; the document that crosses it is the
    last, so a source exceeds its quota by less than a document. Null sources
    are one source. Null and empty texts have one token. Repeated rows stand or
    fall together. An empty table gives no rows.
    """
    spark = docs.sparkSession
    row_key = F.xxhash64("doc_id", F.col("text").cast("string"))
    source = F.col("source").cast("string")
    path = scratch_path(spark, "sized")
    sized = land(docs.select(row_key.alias("row_key"), source.alias("source"), words().alias("tokens")), path)
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    heavy = None
    if len(totals) <= MAX_SOURCES:
        tokens = {r.source: r.n for r in totals}
        plan = solve(tokens, budget, entropy, repeats)
        passes = _passes(spark, plan, tokens, block_tokens)
    else:
        totals = land(sized.groupBy("source").agg(F.sum("tokens").alias("n")), scratch_path(spark, "totals"))
        times = {r.n: r.times for r in totals.groupBy("n").agg(F.count(F.lit(1)).alias("times")).collect()}
        plan = solve({n: n for n in times}, budget, entropy, repeats, times)
        passes = land(_passes_by_size(totals, plan, block_tokens), scratch_path(spark, "passes"))
        heavy = totals.filter(F.col("n") * MAX_SOURCES >= sum(n * m for n, m in times.items()))  # MAX_SOURCES at most
    cuts = _cuts(sized, passes, heavy, seed).withColumnRenamed("source", "_source")
    if heavy is not None:
        cuts = land(cuts, scratch_path(spark, "plan"))
    texts = docs.select(F.struct("*").alias("row"), source.alias("source"), row_key.alias("_key"), words().alias("tokens"))
    drawn = (
        _by_source(texts, cuts, heavy)
        .withColumn("order", _order(seed, F.col("pass"), F.col("_key")))
        .withColumn("block", _block(F.col("order"), F.col("blocks")))
        .filter("cut_block IS NULL OR block < cut_block OR (block = cut_block AND order <= cut_order)")
    )
    return drawn.select("row", "tokens", "pass", "block", "order"), plan


def resample(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with their columns, as often as they are drawn."""
    return mix(docs, **options)[0].select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per draw: where the document stands in its source's permutations."""
    drawn, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    place = Window.partitionBy("source", "pass", "block").orderBy("order", "doc_id")
    return drawn.select("row.doc_id", "row.source", "tokens", "pass", "block", "order").withColumn(
        "place", F.row_number().over(place) - 1
    )
