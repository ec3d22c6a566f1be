"""R2, RMSE, MAE per run, loss values, residual histograms, prediction joins.

All of these are partial hash aggregations keyed by run; the error sums of all
modes come out of one pass over the wide prediction table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import as_column

RUN = ("setting", "seed")


def r2(y: Column, p: Column) -> Column:
    """1 - SSres/SStot; constant truth gives 1.0 if exact else 0.0; below two rows NULL."""
    rows = F.count(y)
    res = F.sum((y - p) * (y - p))
    tot = F.var_pop(y) * rows
    constant = F.min(y) == F.max(y)
    return F.when(rows >= 2, F.when(constant, F.when(res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
                  .otherwise(F.lit(1.0) - F.try_divide(res, tot)))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def metrics(
    predictions: DataFrame,
    groups: Sequence[str] = RUN,
    y: str = "y_true",
    modes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Long metrics ``groups, mode, n, r2, rmse, mae`` from one aggregation.

    ``modes`` maps a mode to its prediction column. The explode works on the
    aggregated runs, not on the predictions.
    """
    modes = modes or {"base": "y_base", "full": "y_full"}
    yc = as_column(y)
    per_mode = [
        F.struct(
            F.lit(mode).alias("mode"),
            F.count(yc).alias("n"),
            r2(yc, F.col(p)).alias("r2"),
            rmse(yc, F.col(p)).alias("rmse"),
            mae(yc, F.col(p)).alias("mae"),
        ).alias(f"_m{i}")
        for i, (mode, p) in enumerate(modes.items())
    ]
    wide = predictions.groupBy(*groups).agg(*per_mode)
    long = wide.select(*groups, F.explode(F.array(*[f"_m{i}" for i in range(len(modes))])).alias("_m"))
    return long.select(*groups, "_m.*")


def loss_terms(
    predictions: DataFrame,
    groups: Sequence[str],
    y: str,
    pred: str,
    cap: str,
    line: Column | None = None,
    lambda_range: float = 0.2,
    lambda_lin: float = 0.2,
) -> DataFrame:
    """Values of the network's loss terms: squared error, range hinge, line consistency."""
    yc, p = F.col(y), F.col(pred)
    over = F.greatest(p - F.col(cap), F.lit(0.0))
    under = F.greatest(-p, F.lit(0.0))
    line_term = F.avg((p - line) * (p - line)) if line is not None else F.lit(0.0)
    return predictions.groupBy(*groups).agg(
        F.avg((p - yc) * (p - yc)).alias("loss_mse"),
        (F.avg(over) + F.avg(under)).alias("loss_range"),
        line_term.alias("loss_line"),
    ).withColumn(
        "loss_total",
        F.col("loss_mse") + F.lit(lambda_range) * F.col("loss_range") + F.lit(lambda_lin) * F.col("loss_line"),
    )


def residual_histogram(
    predictions: DataFrame,
    groups: Sequence[str] = ("setting",),
    y: str = "y_true",
    pred: str = "y_pred",
    bins: int = 20,
) -> DataFrame:
    """Counts of ``y - pred`` in equal-width bins over [min, max] per group.

    Reads its input twice (range, then counts): give it a stored table. Also
    ``bin_low, bin_high``. The largest residual belongs to the last bin; a
    group with one distinct residual gets the unit-wide range around it.
    """
    groups = list(groups)
    rows = predictions.select(*groups, (F.col(y) - F.col(pred)).alias("_r")).where("_r IS NOT NULL")
    spans = rows.groupBy(*groups).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    spans = spans.select(
        *groups,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        rows.join(spans, groups)
        .withColumn("bin", F.least(F.width_bucket("_r", "_lo", "_hi", F.lit(bins)), F.lit(bins).cast("bigint")))
        .groupBy(*groups, "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(*groups, "bin", (F.col("_lo") + width * (F.col("bin") - 1)).alias("bin_low"),
                (F.col("_lo") + width * F.col("bin")).alias("bin_high"), "rows")
    )


def scatter_envelope(
    predictions: DataFrame, groups: Sequence[str] = RUN, y: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Ends of the 1:1 line and the metric labels of a truth-prediction scatter."""
    yc, p = F.col(y), F.col(pred)
    return predictions.groupBy(*groups).agg(
        F.least(F.min(yc), F.min(p)).alias("line_min"),
        F.greatest(F.max(yc), F.max(p)).alias("line_max"),
        F.round(r2(yc, p), 2).alias("r2_label"),
        F.round(rmse(yc, p), 2).alias("rmse_label"),
        F.round(mae(yc, p), 2).alias("mae_label"),
    )


def join_predictions(
    base: DataFrame, full: DataFrame, keys: Sequence[str] = ("seed", "sample_id"), pred: str = "y_pred"
) -> DataFrame:
    """Two settings' predictions of the same rows side by side; truth from the left."""
    keys = list(keys)
    left = base.select(*keys, "y_true", F.col(pred).alias("y_base"))
    return left.join(full.select(*keys, F.col(pred).alias("y_full")), keys)


def pair_settings(
    rows: DataFrame,
    base: str,
    full: str,
    keys: Sequence[str] = ("seed", "sample_id"),
    pred: str = "y_pred",
    setting: str = "setting",
) -> DataFrame:
    """``join_predictions`` of two settings that stand in one table: one scan, one shuffle.

    A row's key must be unique within a setting.
    """
    of = lambda name, column: F.max(F.when(F.col(setting) == name, F.col(column)))
    there = lambda name: F.count_if(F.col(setting) == name) > 0
    paired = rows.where(F.col(setting).isin(base, full)).groupBy(*keys).agg(
        of(base, "y_true").alias("y_true"), of(base, pred).alias("y_base"), of(full, pred).alias("y_full"),
        (there(base) & there(full)).alias("_both"),
    )
    return paired.where("_both").drop("_both")


def accept_if_better(
    rows: DataFrame,
    val_metrics: DataFrame,
    groups: Sequence[str] = RUN,
    *,
    base_mode: str = "base",
    refined_mode: str = "refined",
    base: str = "y_base",
    refined: str = "y_refined",
    out: str = "y_full",
) -> DataFrame:
    """Per run, the refined prediction if its R2 is not below the base's, else the base.

    ``val_metrics`` is the long metric table of the rows that decide (VAL or TEST).
    """
    groups = list(groups)
    scores = val_metrics.groupBy(*groups).agg(
        F.max(F.when(F.col("mode") == base_mode, F.col("r2"))).alias("_r2_base"),
        F.max(F.when(F.col("mode") == refined_mode, F.col("r2"))).alias("_r2_refined"),
    )
    # one row per run
    joined = rows.join(F.broadcast(scores), groups, "left")
    accept = (F.col("_r2_refined") >= F.col("_r2_base")) & F.col(refined).isNotNull()
    return joined.withColumn(out, F.when(accept, F.col(refined)).otherwise(F.col(base))).withColumn(
        "refined_accepted", F.coalesce(accept, F.lit(False))
    ).drop("_r2_base", "_r2_refined")
