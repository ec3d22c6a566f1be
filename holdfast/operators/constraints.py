"""Domain constraints: fitted on TRAIN rows, applied to predictions.

A fit is a set of aggregates over (setting, seed); all fits of a study share one
hash aggregation: TRAIN rows combine on the map side and one small row per run
comes out. Applying a fit is a broadcast
join of those rows and column arithmetic.

The least-squares line of a constant x has no slope; the minimum-norm solution
``a = c*mean/(c^2+1), b = mean/(c^2+1)`` is used there, as an SVD solver would.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import as_column, clip, finite_or_null, floor_at_zero, is_finite
from holdfast.operators.features import hydrogen_index
from holdfast.operators.ranks import quantile_table

# Fallbacks and limits of the four fits.
CAP_MARGIN = 1.1
CAP_FLOOR = 1.0
CAP_WITHOUT_ROWS = 30.0
FEW_PAIRS = 10
HI_MIN_FALLBACK = 0.0
HI_MAX_FALLBACK = 1e9
MODES = ("base", "nn", "s2", "full")


@dataclass(frozen=True)
class LineConstraint:
    """Soft line ``y = a*S2 + b`` and a cap on y."""

    lambda_s2: float = 0.15
    eps: float = 1e-6


@dataclass(frozen=True)
class BandConstraint:
    """Quantile band on the S2/y ratio and a soft inverse line ``S2 = a*y + b``."""

    lambda_s2: float = 0.05
    eps: float = 1e-8
    q_low: float = 0.01
    q_high: float = 0.99


@dataclass(frozen=True)
class Fit:
    """Aggregates over TRAIN rows and the parameters computed from them.

    Several fits can share one aggregation (``fit_together``). ``few`` marks a
    value whose median is wanted in runs with fewer than ten of them.
    """

    aggs: Sequence[Column]
    params: Mapping[str, Column]
    few: Column | None = None


def fit_together(train: DataFrame, groups: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    """All fits' parameters per run from one pass over the TRAIN rows.

    Medians of tiny runs take a second look, limited to those runs. Runs may be
    as many as the data has groups, so the planner picks the joins; where there
    is no tiny run the adaptive planner drops that branch.
    """
    groups = list(groups)
    stats = train.groupBy(*groups).agg(*[a for fit in fits for a in fit.aggs])
    few = next((fit.few for fit in fits if fit.few is not None), None)
    if few is not None:
        tiny = stats.where((F.col("cap_n") > 0) & (F.col("cap_n") < FEW_PAIRS)).select(*groups)
        values = train.select(*groups, few.alias("_few")).where("_few IS NOT NULL")
        medians = values.join(tiny, groups).groupBy(*groups).agg(F.percentile("_few", F.lit(0.5)).alias("cap_median"))
        stats = stats.join(medians, groups, "left")
    return stats.select(*groups, *[c.alias(name) for fit in fits for name, c in fit.params.items()])


def _line_aggs(name: str, y: Column, x: Column, use: Column) -> list[Column]:
    y, x = F.when(use, y), F.when(use, x)
    return [
        F.count(y).alias(f"{name}_n"),
        F.regr_slope(y, x).alias(f"{name}_slope"),
        F.avg(y).alias(f"{name}_y"),
        F.avg(x).alias(f"{name}_x"),
        F.min(x).alias(f"{name}_x_min"),
        F.max(x).alias(f"{name}_x_max"),
    ]


def _line(name: str) -> tuple[Column, Column]:
    c, mean = F.col(f"{name}_x_min"), F.col(f"{name}_y")
    constant = c == F.col(f"{name}_x_max")
    norm = c * c + F.lit(1.0)
    slope = F.col(f"{name}_slope")
    a = F.when(constant, mean * c / norm).otherwise(slope)
    b = F.when(constant, mean / norm).otherwise(mean - slope * F.col(f"{name}_x"))
    return a, b


def line_and_cap(y: str, s2: str, cfg: LineConstraint = LineConstraint()) -> Fit:
    """``a, b, toc_max, lambda_s2, eps`` from pairs with both values finite.

    Fewer than ten pairs: a = 0 and b = median(y) (0 without pairs). A negative
    slope becomes 0 and b stays as fitted.
    """
    both = is_finite(y) & is_finite(s2)
    yy = F.when(both, F.col(y))
    a, b = _line("cap")
    few = F.col("cap_n") < FEW_PAIRS
    cap = F.coalesce(F.col("cap_top") * CAP_MARGIN, F.lit(CAP_WITHOUT_ROWS))
    return Fit(
        [*_line_aggs("cap", F.col(y), F.col(s2), both), F.max(yy).alias("cap_top")],
        {
            "a": F.when(few | a.isNull() | F.isnan(a) | (a < 0), F.lit(0.0)).otherwise(a),
            "b": F.when(few, F.coalesce(F.col("cap_median"), F.lit(0.0))).otherwise(b),
            "toc_max": F.greatest(cap, F.lit(CAP_FLOOR)),
            "lambda_s2": F.lit(cfg.lambda_s2),
            "eps": F.lit(cfg.eps),
            "n_pairs": F.col("cap_n"),
            "fit_status": F.when(F.col("cap_n") == 0, "no_pairs").when(few, "median_of_few").when(a < 0, "slope_raised_to_0").otherwise("fitted"),
        },
        few=yy,
    )


def inverse_line(y: str, s2: str) -> Fit:
    """``S2 = a_s2*y + b_s2``; (1, 0) below five pairs, 1 / 0 where not finite."""
    a, b = _line("inv")
    few = F.col("inv_n") < 5
    return Fit(
        _line_aggs("inv", F.col(s2), F.col(y), is_finite(y) & is_finite(s2)),
        {
            "a_s2": F.when(few, F.lit(1.0)).otherwise(F.coalesce(finite_or_null(a), F.lit(1.0))),
            "b_s2": F.when(few, F.lit(0.0)).otherwise(F.coalesce(finite_or_null(b), F.lit(0.0))),
        },
    )


def refine_line(y: str, s2: str) -> Fit:
    """Line ``y = a_lin*S2 + b_lin`` for the network's loss; (0.1, 0) when unusable."""
    a, b = _line("ref")
    bad = (F.col("ref_n") < FEW_PAIRS) | ~is_finite(a) | (a < 0)
    return Fit(
        _line_aggs("ref", F.col(y), F.col(s2), is_finite(y) & is_finite(s2)),
        {"a_lin": F.when(bad, F.lit(0.1)).otherwise(a), "b_lin": F.when(bad, F.lit(0.0)).otherwise(b)},
    )


def refine_inverse_line(y: str, s2: str) -> Fit:
    """Line ``S2 = a_lin*y + b_lin`` from rows with y > 1e-6; (1, 0) when unusable."""
    a, b = _line("rin")
    bad = (F.col("rin_n") < FEW_PAIRS) | ~is_finite(a) | (a < 1e-6)
    return Fit(
        _line_aggs("rin", F.col(s2), F.col(y), is_finite(y) & is_finite(s2) & (F.col(y) > 1e-6)),
        {"a_lin": F.when(bad, F.lit(1.0)).otherwise(a), "b_lin": F.when(bad, F.lit(0.0)).otherwise(b)},
    )


def refine_cap(y: str, rule: str = "raise_small", name: str = "toc_max") -> Fit:
    """Upper end of the range loss.

    ``raise_small``: max(1.1 max y, 1), 15 if that is below 5. ``floor_25``:
    max(1.1 max y, 25). ``plain``: max(1.1 max y, 1), the line constraint's cap.
    """
    top = F.col("range_top") * CAP_MARGIN
    at_least_one = F.greatest(top, F.lit(CAP_FLOOR))
    rules = {
        "raise_small": F.when(at_least_one < 5.0, F.lit(15.0)).otherwise(at_least_one),
        "floor_25": F.greatest(top, F.lit(25.0)),
        "plain": at_least_one,
    }
    if rule not in rules:
        raise ValueError(f"unknown cap rule: {rule}")
    return Fit([F.max(y).alias("range_top")], {name: rules[rule]})


def baseline(y: str, x: str, name: str = "line") -> Fit:
    """Closed-form predictor ``y = a*x + b``, for checks without trees."""
    slope = F.regr_slope(F.col(y), F.col(x))
    return Fit(
        [slope.alias(f"{name}_slope"), F.regr_intercept(F.col(y), F.col(x)).alias(f"{name}_intercept")],
        {f"{name}_a": F.col(f"{name}_slope"), f"{name}_b": F.col(f"{name}_intercept")},
    )


def fit_ratio_band(
    train: DataFrame, groups: Sequence[str], ratio: str, cfg: BandConstraint = BandConstraint()
) -> DataFrame:
    """``hi_min, hi_max`` per run: quantiles of the ratio, exact by rank selection (runs at once).

    Runs without a finite ratio, or with an empty band, get [0, 1e9].
    """
    bands = quantile_table(train, groups, ratio, {"_lo": cfg.q_low, "_hi": cfg.q_high})
    open_band = F.col("_lo").isNull() | F.col("_hi").isNull() | (F.col("_hi") <= F.col("_lo"))
    return bands.select(
        *groups,
        F.when(open_band, F.lit(HI_MIN_FALLBACK)).otherwise(F.col("_lo")).alias("hi_min"),
        F.when(open_band, F.lit(HI_MAX_FALLBACK)).otherwise(F.col("_hi")).alias("hi_max"),
    )


def fit_band_and_line(
    train: DataFrame,
    groups: Sequence[str],
    y: str,
    s2: str,
    ratio: str | None = None,
    cfg: BandConstraint = BandConstraint(),
    also: Sequence[Fit] = (),
) -> DataFrame:
    """Inverse line and ratio band per run; the ratio is 100*S2/y if no column is given.

    ``also`` are fits to take from the same pass as the line.
    """
    groups = list(groups)
    line = fit_together(train, groups, [inverse_line(y, s2), *also])
    rows = train.select(*groups, (F.col(ratio) if ratio else hydrogen_index(s2, y)).alias("_ratio"))
    band = fit_ratio_band(rows, groups, "_ratio", cfg)
    # both sides have one row per run
    return (
        line.join(F.broadcast(band), groups, "left")
        .withColumn("hi_min", F.coalesce("hi_min", F.lit(HI_MIN_FALLBACK)))
        .withColumn("hi_max", F.coalesce("hi_max", F.lit(HI_MAX_FALLBACK)))
        .withColumn("eps", F.lit(cfg.eps))
        .withColumn("lambda_s2", F.lit(cfg.lambda_s2))
    )


def attach_fit(rows: DataFrame, fits: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each row with its run's fit. ``fits`` has one row per (setting, seed) of the study."""
    return rows.join(F.broadcast(fits), list(groups))


def clip_range(y: Column | str, cap: Column | str) -> Column:
    """[0, cap]; a missing or NaN prediction stays as it is."""
    return clip(y, F.lit(0.0), as_column(cap))


def soft_line(y: Column | str, s2: Column | str, a: Column, b: Column, lam: Column) -> Column:
    """``(1-lam)*y + lam*(a*S2+b)``"""
    return (F.lit(1.0) - lam) * as_column(y) + lam * (a * as_column(s2) + b)


def band_clip(y: Column | str, s2: Column | str, hi_min: Column, hi_max: Column, eps: Column) -> Column:
    """Where S2 is finite: y in [100*S2/hi_max, 100*S2/hi_min], unbounded above if hi_min <= 0."""
    y, s2 = as_column(y), as_column(s2)
    low = F.lit(100.0) * s2 / F.greatest(hi_max, eps)
    high = F.when(hi_min > 0, F.lit(100.0) * s2 / F.greatest(hi_min, eps))
    return F.when(is_finite(s2), clip(y, low, high)).otherwise(y)


def soft_inverse_line(y: Column | str, s2: Column | str, a: Column, b: Column, lam: Column, eps: Column) -> Column:
    """Where S2 is finite and |a| > eps: pull y towards (S2-b)/a, then keep it >= 0."""
    y, s2 = as_column(y), as_column(s2)
    pulled = floor_at_zero((F.lit(1.0) - lam) * y + lam * F.try_divide(s2 - b, a))
    return F.when(is_finite(s2) & is_finite(a) & (F.abs(a) > eps), pulled).otherwise(y)


def constrained(y: Column | str, s2: Column | str | None, mode: str, *, fitted: bool = True) -> Column:
    """One mode of the line constraint over the columns ``a, b, toc_max, lambda_s2``.

    base = nn: clip to the TRAIN range. s2 = full: pull to the line, then clip.
    Without S2 every mode is base; without a fit only y >= 0 holds.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    positive = floor_at_zero(y)
    if not fitted:
        return positive
    cap = F.col("toc_max")
    if mode in ("base", "nn") or s2 is None:
        return clip_range(positive, cap)
    pulled = soft_line(positive, s2, F.col("a"), F.col("b"), F.col("lambda_s2"))
    return floor_at_zero(clip_range(pulled, cap))


def ablation_modes(rows: DataFrame, y: str, s2: str | None, modes: Sequence[str] = MODES, prefix: str = "y_") -> DataFrame:
    """A column per mode (``y_base, y_full, ...``) next to the attached fit's columns."""
    return rows.withColumns({f"{prefix}{m}": constrained(y, s2, m) for m in modes})


def composite(y: Column | str, s2: Column | str | None, *, with_band: bool = True) -> Column:
    """Non-negativity, ratio band, soft inverse line, in that order.

    Uses the columns of ``fit_band_and_line``.
    """
    out = floor_at_zero(y)
    if s2 is None:
        return out
    if with_band:
        out = band_clip(out, s2, F.col("hi_min"), F.col("hi_max"), F.col("eps"))
    return soft_inverse_line(out, s2, F.col("a_s2"), F.col("b_s2"), F.col("lambda_s2"), F.col("eps"))

