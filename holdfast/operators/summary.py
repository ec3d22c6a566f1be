"""Summaries over runs: one input row per (setting, mode, seed).

These tables hold a handful of rows per seed, bounded by the study's own seed
list, so exact ``percentile`` is safe here (unlike over samples).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("r2", "rmse", "mae")


def _stats(c: str, prefix: str, *, std_of_one: float | None = None, extremes: bool = True) -> list[Column]:
    std = F.stddev_samp(c)
    if std_of_one is not None:
        std = F.coalesce(std, F.lit(std_of_one))
    out = [
        F.avg(c).alias(f"{prefix}mean"),
        std.alias(f"{prefix}std"),
        F.percentile(c, F.lit(0.5)).alias(f"{prefix}median"),
        F.percentile(c, F.lit(0.25)).alias(f"{prefix}q1"),
        F.percentile(c, F.lit(0.75)).alias(f"{prefix}q3"),
    ]
    if extremes:
        out += [F.min(c).alias(f"{prefix}min"), F.max(c).alias(f"{prefix}max")]
    return out


def population_summary(metrics: DataFrame, n_samples: Column, groups: Sequence[str] = ("setting",)) -> DataFrame:
    """Mean and population standard deviation of each metric, and the sample count."""
    aggs = [f(m).alias(f"{m}_{s}") for m in METRICS for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return metrics.groupBy(*groups).agg(*aggs).withColumn("n_samples", n_samples)


def sample_summary(
    df: DataFrame, groups: Sequence[str], value: str, *, std_of_one: float | None = None, extremes: bool = True
) -> DataFrame:
    """n, mean, sample std, median, quartiles and (``extremes``) min, max.

    ``std_of_one`` is the std of a single value: None for missing, 0.0.
    """
    return df.groupBy(*groups).agg(
        F.count(value).alias("n"), *_stats(value, "", std_of_one=std_of_one, extremes=extremes)
    )


def ablation_summary(metrics: DataFrame, *, std_of_one: float | None = None) -> DataFrame:
    """One sorted row per (setting, mode): all statistics of all metrics."""
    aggs = [a for m in METRICS for a in _stats(m, f"{m}_", std_of_one=std_of_one)]
    return (
        metrics.groupBy("setting", "mode")
        .agg(*aggs, F.count(F.lit(1)).alias("n_repeats"))
        .orderBy("setting", "mode")
    )


def _pick(column: str, key: str, value: str = "r2") -> Column:
    return F.max(F.when(F.col(column) == key, F.col(value)))


def delta_between_settings(metrics: DataFrame, base: str = "NoRes", full: str = "Full") -> DataFrame:
    """Per seed: R2 of two settings side by side and their difference."""
    wide = metrics.groupBy("seed").agg(_pick("setting", base).alias("r2_base"), _pick("setting", full).alias("r2_full"))
    return wide.withColumn("delta_r2", F.col("r2_full") - F.col("r2_base")).orderBy("seed")


def delta_between_modes(metrics: DataFrame, base: str = "base", full: str = "full") -> DataFrame:
    """Per (seed, setting): R2 of two modes side by side and their difference."""
    wide = metrics.groupBy("seed", "setting").agg(_pick("mode", base).alias("r2_base"), _pick("mode", full).alias("r2_full"))
    return wide.withColumn("delta_r2", F.col("r2_full") - F.col("r2_base")).orderBy("seed", "setting")


def best_of_best(deltas: DataFrame, setting_order: Sequence[str]) -> DataFrame:
    """Per seed, the best setting of each mode independently; earlier setting wins ties.

    ``deltas`` is ``delta_between_modes``. Seeds without a valid R2 give no row.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in setting_order]), F.col("setting"))

    def best(r2: str) -> Column:
        return F.min_by("setting", F.when(F.col(r2).isNotNull(), F.struct(-F.col(r2), place)))

    return (
        deltas.where("r2_base IS NOT NULL AND r2_full IS NOT NULL")
        .groupBy("seed")
        .agg(
            best("r2_base").alias("best_setting_base"),
            best("r2_full").alias("best_setting_full"),
            F.max("r2_base").alias("r2_base"),
            F.max("r2_full").alias("r2_full"),
        )
        .withColumn("delta_r2", F.col("r2_full") - F.col("r2_base"))
        .orderBy("seed")
    )


def first_min(value: str, key: Column, order: str = "seed") -> Column:
    """``value`` of the row with the smallest key; the first by ``order`` on ties."""
    return F.min_by(value, F.struct(key, F.col(order)))


def seed_picks(deltas: DataFrame) -> DataFrame:
    """Best, worst and median seed by delta: rows ``tag, seed``.

    Keys are compared to 12 digits: sums over partitions differ in the last bits
    from run to run, and with an even number of seeds two are equally central.
    """
    # a few hundred seeds: the window holds the study's seed list
    with_median = deltas.withColumn("_median", F.percentile("delta_r2", F.lit(0.5)).over(W.partitionBy(F.lit(0))))
    d = F.col("delta_r2")
    wide = with_median.where(d.isNotNull()).agg(
        first_min("seed", F.round(-d, 12)).alias("best"),
        first_min("seed", F.round(d, 12)).alias("worst"),
        first_min("seed", F.round(F.abs(d - F.col("_median")), 12)).alias("median"),
    )
    return wide.unpivot([], ["best", "worst", "median"], "tag", "seed")


def setting_difference(metrics: DataFrame, base: str = "NoRes", full: str = "Full") -> DataFrame:
    """Mean R2 of each setting and their difference."""

    def mean(s: str) -> Column:
        return F.avg(F.when(F.col("setting") == s, F.col("r2")))

    return metrics.agg(mean(full).alias("r2_full"), mean(base).alias("r2_base")).withColumn(
        "r2_diff", F.col("r2_full") - F.col("r2_base")
    )


def digest(best: DataFrame) -> DataFrame:
    """Statistics of the base, full and delta distributions of ``best_of_best``."""
    long = best.select(
        F.col("r2_base").alias("base"), F.col("r2_full").alias("full"), F.col("delta_r2").alias("delta")
    ).unpivot([], ["base", "full", "delta"], "series", "value")
    return sample_summary(long, ["series"], "value", std_of_one=0.0, extremes=False)


def best_seed(metrics: DataFrame, groups: Sequence[str] = ("setting",)) -> DataFrame:
    """Per setting the seed with the highest R2; the first on ties."""
    scored = metrics.where("r2 IS NOT NULL")
    return scored.groupBy(*groups).agg(
        first_min("seed", -F.col("r2")).alias("seed"), F.max("r2").alias("r2")
    )


def rows_of_picks(predictions: DataFrame, picks: DataFrame) -> DataFrame:
    """Predictions of the picked seeds only: prunes partitions before any join of predictions."""
    return predictions.join(F.broadcast(picks.select("seed").distinct()), "seed", "left_semi")


def diagnostic_rows(pairs: DataFrame, picks: DataFrame) -> DataFrame:
    """The joined predictions of the picked seeds, tagged. ``picks`` has at most three rows."""
    return pairs.join(F.broadcast(picks), "seed").select("tag", "seed", "sample_id", "y_true", "y_base", "y_full")
