"""Registered queries, each next to the SQL that must give the same table.

Every query runs library operators over the whole sample table. Where a model
is needed and the result must be checkable in SQL, a closed-form line stands in
for the trees. Values are rounded once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import log_pyrolysis, multi_basin, pyrolysis_hi
from holdfast.functions import columns as X
from holdfast.operators import boosting as B
from holdfast.operators import clean as C
from holdfast.operators import constraints as K
from holdfast.operators import features as D
from holdfast.operators import metrics as A
from holdfast.operators import models as M
from holdfast.operators import ranks as Q
from holdfast.operators import refine as N
from holdfast.operators import roles as R
from holdfast.operators import splits as P
from holdfast.operators import summary as S
from holdfast.plans.prepare import prepare_log_pyrolysis, prepare_multi_basin, prepare_pyrolysis_hi, standard_names
from holdfast.plans.study import run_ablation
from holdfast.session import land, scratch_path
from holdfast.sources import sinks as W
from holdfast.sources.readers import find_dataset, read_csv, read_csv_any_encoding, read_predictions, trim_headers
from holdfast.sources.samples import LOG_ROLES
from holdfast.sources.samples import samples as scan_samples

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The sample table, kept for the session: dozens of queries here scan it."""
    return scan_samples(spark, sf, cache=True)


SEEDS = P.seed_schedule(10)
TEST_SIZE, VAL_SIZE = 0.2, 0.15


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles to six digits, or to the number given by column name."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits.get(c, 6)).alias(c) if c in doubles else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ SQL pieces

SAMPLES = """samples AS (
 SELECT o_orderkey AS sample_id,
  round(sum(l_extendedprice)/50000,6) AS toc, round(sum(l_quantity)/10,6) AS s2,
  round(avg(l_tax)*100,6) AS s1, round(avg(l_discount)*100,6) AS s3,
  CAST(425+max(l_linenumber) AS DOUBLE) AS tmax, CAST(count(*)*100 AS DOUBLE) AS depth,
  sum(l_quantity) AS rd, max(l_quantity) AS rs, round(avg(l_discount)*10,6) AS k,
  round(sum(l_tax)*10,6) AS th, round(min(l_quantity)/10,6) AS u,
  round(avg(l_quantity),6) AS gr, round(o_totalprice/1000,6) AS ac
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice)"""

DIRTY = SAMPLES + """, dirty AS (
 SELECT sample_id, CAST(NULL AS VARCHAR) AS blank,
  CASE WHEN sample_id % 17 = 0 THEN NULL WHEN sample_id % 13 = 0 THEN 'n/a' WHEN sample_id % 11 = 0 THEN '1d'
   WHEN sample_id % 7 = 0 THEN ' 1.5 ' WHEN sample_id % 5 = 0 THEN '1,234' ELSE CAST(toc AS VARCHAR) END AS toc_text,
  CAST(tmax AS VARCHAR) AS tmax_text, concat(CAST(sample_id AS VARCHAR), ' ft') AS depth_text,
  CASE WHEN sample_id % 19 = 0 THEN NULL ELSE toc END AS toc,
  CASE WHEN sample_id % 17 = 0 THEN NULL WHEN sample_id % 23 = 0 THEN CAST('infinity' AS DOUBLE)
   WHEN sample_id % 29 = 0 THEN CAST('nan' AS DOUBLE) ELSE s2 END AS s2,
  CASE WHEN sample_id % 31 = 0 THEN NULL ELSE s1 END AS s1, s3, tmax, depth,
  CASE WHEN sample_id % 37 = 0 THEN CAST(-1 AS DOUBLE) ELSE rd END AS rd, rs, k,
  CASE WHEN sample_id % 41 = 0 THEN CAST(-0.000001 AS DOUBLE) ELSE th END AS th, u, gr, ac
 FROM samples)"""

NUMBER = r"'[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)'"

_RANKED = """, fan AS (SELECT *, CAST(unnest(range(0,10)) AS INTEGER) AS seed FROM {rows}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY
   md5(concat_ws(':',CAST(seed AS VARCHAR),CAST(sample_id AS VARCHAR))), sample_id) AS rk,
   count(*) OVER (PARTITION BY {by}) AS n FROM fan)"""
_TWO = """, split AS (SELECT *, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE)*n) THEN 'test' ELSE 'train' END AS split FROM ranked)"""
SPLIT2 = SAMPLES + _RANKED.format(rows="samples", by="seed") + _TWO
SPLIT3 = SAMPLES + _RANKED.format(rows="samples", by="seed") + """, split AS (
 SELECT *, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE)*n) THEN 'test'
  WHEN rk <= ceil(CAST(0.2 AS DOUBLE)*n) + ceil(CAST(0.15 AS DOUBLE)/(CAST(1 AS DOUBLE)-CAST(0.2 AS DOUBLE))*(n-ceil(CAST(0.2 AS DOUBLE)*n)))
  THEN 'val' ELSE 'train' END AS split FROM ranked)"""

PRED = SPLIT2 + """, fit AS (
 SELECT seed, regr_slope(toc,depth) AS da, regr_intercept(toc,depth) AS db, regr_slope(toc,ac) AS ca, regr_intercept(toc,ac) AS cb,
  greatest(regr_slope(toc,s2),0) AS a, regr_intercept(toc,s2) AS b, greatest(max(toc)*1.1,1) AS toc_max
 FROM split WHERE split='train' GROUP BY seed),
 raw AS (SELECT 'NoRes' AS setting, split.*, da*depth+db AS p, a, b, toc_max FROM split JOIN fit USING (seed) WHERE split='test'
  UNION ALL SELECT 'Full' AS setting, split.*, ca*ac+cb AS p, a, b, toc_max FROM split JOIN fit USING (seed) WHERE split='test'),
 pred AS (SELECT setting, seed, sample_id, toc AS y_true, s2, p, a, b, toc_max, least(greatest(p,0),toc_max) AS y_base,
  least(greatest(CAST(0.85 AS DOUBLE)*greatest(p,0)+CAST(0.15 AS DOUBLE)*(a*s2+b),0),toc_max) AS y_full FROM raw)"""

_METRIC = """count(*) AS n, 1-sum((y-p)*(y-p))/(var_pop(y)*count(*)) AS r2, sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae"""
METRICS = PRED + f""", met AS (SELECT setting, mode, seed, {_METRIC} FROM (
  SELECT setting, seed, 'base' AS mode, y_true AS y, y_base AS p FROM pred
  UNION ALL SELECT setting, seed, 'full' AS mode, y_true AS y, y_full AS p FROM pred) GROUP BY setting, mode, seed),
 delta AS (SELECT seed, setting, max(CASE WHEN mode='base' THEN r2 END) AS r2_base, max(CASE WHEN mode='full' THEN r2 END) AS r2_full
  FROM met GROUP BY seed, setting),
 delta_s AS (SELECT seed, max(CASE WHEN setting='NoRes' THEN r2 END) AS r2_base, max(CASE WHEN setting='Full' THEN r2 END) AS r2_full,
  max(CASE WHEN setting='Full' THEN r2 END)-max(CASE WHEN setting='NoRes' THEN r2 END) AS delta_r2 FROM met WHERE mode='full' GROUP BY seed)"""

BAND = SPLIT2 + """, fit AS (
 SELECT seed, regr_slope(s2,toc) AS a_s2, regr_intercept(s2,toc) AS b_s2,
  quantile_cont(100*s2/greatest(toc,CAST(0.000001 AS DOUBLE)),CAST(0.01 AS DOUBLE)) AS hi_min,
  quantile_cont(100*s2/greatest(toc,CAST(0.000001 AS DOUBLE)),CAST(0.99 AS DOUBLE)) AS hi_max,
  regr_slope(toc,depth) AS da, regr_intercept(toc,depth) AS db
 FROM split WHERE split='train' GROUP BY seed),
 t AS (SELECT seed, sample_id, toc, CASE WHEN sample_id % 17 = 0 THEN NULL ELSE s2 END AS s2, da*depth+db AS p, a_s2, b_s2, hi_min, hi_max
  FROM split JOIN fit USING (seed) WHERE split='test'),
 banded AS (SELECT *, CASE WHEN s2 IS NULL THEN greatest(p,0) ELSE least(greatest(greatest(p,0), 100*s2/hi_max), 100*s2/hi_min) END AS y_band FROM t)"""


def stats_sql(c: str, p: str) -> str:
    q = "quantile_cont({c},CAST({at} AS DOUBLE))"
    return (f"round(avg({c}),6) AS {p}mean, round(stddev_samp({c}),6) AS {p}std, "
            f"round({q.format(c=c, at=0.5)},6) AS {p}median, round({q.format(c=c, at=0.25)},6) AS {p}q1, "
            f"round({q.format(c=c, at=0.75)},6) AS {p}q3, round(min({c}),6) AS {p}min, round(max({c}),6) AS {p}max")


# ---------------------------------------------------------------- Spark pieces


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """The sample table with missing, text, infinite and NaN values put in."""

    def every(n: int) -> Column:
        return F.col("sample_id") % n == 0

    null = F.lit(None)
    return samples(spark, sf).select(
        "sample_id",
        null.cast("string").alias("blank"),
        F.when(every(17), null).when(every(13), "n/a").when(every(11), "1d").when(every(7), " 1.5 ")
        .when(every(5), "1,234").otherwise(F.col("toc").cast("string")).alias("toc_text"),
        F.col("tmax").cast("string").alias("tmax_text"),
        F.concat(F.col("sample_id").cast("string"), F.lit(" ft")).alias("depth_text"),
        F.when(~every(19), F.col("toc")).alias("toc"),
        F.when(every(17), null).when(every(23), F.lit(X.INFINITY)).when(every(29), F.lit(float("nan")))
        .otherwise(F.col("s2")).alias("s2"),
        F.when(~every(31), F.col("s1")).alias("s1"),
        "s3", "tmax", "depth",
        F.when(every(37), F.lit(-1.0)).otherwise(F.col("rd")).alias("rd"),
        "rs", "k",
        F.when(every(41), F.lit(-1e-6)).otherwise(F.col("th")).alias("th"),
        "u", "gr", "ac",
    )


def two_way(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return P.repeated_split(samples(spark, sf).select("sample_id", *cols), SEEDS, TEST_SIZE)


def train_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split") == P.TRAIN)


def test_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split") == P.TEST)


def line_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """TEST rows of two settings with raw and constrained predictions."""
    rows = two_way(spark, sf, "toc", "s2", "depth", "ac")
    train = train_of(rows)
    fits = K.fit_together(train, ["seed"], [
        K.line_and_cap("toc", "s2"), K.baseline("toc", "depth", "depth"), K.baseline("toc", "ac", "ac")])
    test = K.attach_fit(test_of(rows), fits, ["seed"])
    both = F.array(*[
        F.struct(F.lit(s).alias("setting"), (F.col(f"{x}_a") * F.col(x) + F.col(f"{x}_b")).alias("p"))
        for s, x in (("NoRes", "depth"), ("Full", "ac"))
    ])
    long = test.withColumn("_s", F.explode(both)).select("_s.*", "seed", "sample_id", F.col("toc").alias("y_true"), "s2", "a", "b", "toc_max", "lambda_s2")
    return K.ablation_modes(long, "p", "s2", ("base", "full"))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.metrics(line_predictions(spark, sf))


def band_rows(spark: SparkSession, sf: str) -> DataFrame:
    """TEST rows with the band fit and a raw prediction; S2 missing on some rows."""
    rows = two_way(spark, sf, "toc", "s2", "depth")
    train = train_of(rows)
    fits = K.fit_band_and_line(train, ["seed"], "toc", "s2", also=[K.baseline("toc", "depth")])
    test = K.attach_fit(test_of(rows), fits, ["seed"])
    return test.withColumn("s2", F.when(F.col("sample_id") % 17 != 0, F.col("s2"))).withColumn("p", F.col("line_a") * F.col("depth") + F.col("line_b"))


# -------------------------------------------------------------------- flagship


@query(f"WITH {METRICS} SELECT setting, mode, {stats_sql('r2', 'r2_')}, {stats_sql('rmse', 'rmse_')}, "
       f"{stats_sql('mae', 'mae_')}, count(*) AS n_repeats FROM met GROUP BY setting, mode")
def ablation_summary(spark, sf):
    return rounded(S.ablation_summary(run_metrics(spark, sf)))


# -------------------------------------------------------------------- cleaning


@query(f"""WITH {DIRTY} SELECT sample_id, CASE WHEN regexp_full_match(lower(trim(toc_text)), {NUMBER}) THEN TRY_CAST(trim(toc_text) AS DOUBLE) END AS toc,
 CASE WHEN NOT isnan(s2) THEN s2 END AS s2 FROM dirty""")
def clean_coerce(spark, sf):
    df = dirty(spark, sf).select("sample_id", F.col("toc_text").alias("toc"), "s2")
    return C.coerce_numeric(df, ["toc", "s2"])


@query(f"""WITH {DIRTY} SELECT sample_id, CAST(tmax_text AS DOUBLE) AS tmax_text, depth_text FROM dirty""")
def clean_all_or_nothing(spark, sf):
    return C.coerce_if_all_numeric(dirty(spark, sf).select("sample_id", "tmax_text", "depth_text"))


@query(f"""WITH {DIRTY} SELECT sample_id, toc, s2, s1 FROM dirty WHERE toc IS NOT NULL AND s2 IS NOT NULL AND NOT isnan(s2) AND s1 IS NOT NULL""")
def clean_dropna(spark, sf):
    df = dirty(spark, sf).select("sample_id", "toc", "s2", "s1")
    return C.drop_missing(C.coerce_numeric(df, ["toc", "s2", "s1"]), ["toc", "s2", "s1"])


@query(f"""WITH {DIRTY} SELECT sample_id, toc FROM dirty WHERE toc IS NOT NULL""")
def clean_drop_missing_target(spark, sf):
    return C.drop_missing(dirty(spark, sf).select("sample_id", "toc"), ["toc"])


@query(f"""WITH {DIRTY} SELECT sample_id, toc, s2 FROM dirty WHERE isfinite(toc) AND isfinite(s2)""")
def clean_finite(spark, sf):
    return C.keep_finite(dirty(spark, sf).select("sample_id", "toc", "s2"), ["toc", "s2"])


@query(f"""WITH {DIRTY} SELECT 'RockEval' AS setting, sample_id FROM dirty WHERE isfinite(toc) AND isfinite(s1) AND isfinite(s2)
 UNION ALL SELECT 'Logs' AS setting, sample_id FROM dirty WHERE isfinite(toc) AND isfinite(gr) AND isfinite(rd)""")
def valid_mask(spark, sf):
    df = dirty(spark, sf)
    settings = C.usable_settings(df, "toc", {"RockEval": ["s1", "s2"], "Logs": ["gr", "rd"], "Single": ["gr"]})
    return C.rows_by_setting(df, "toc", settings).select("setting", "sample_id")


@query(f"""WITH {DIRTY} SELECT sample_id, toc, s1 FROM dirty""")
def drop_empty_cols(spark, sf):
    return C.drop_empty_columns(dirty(spark, sf).select("sample_id", "blank", "toc", "s1"))


@query(f"""WITH {SAMPLES} SELECT sample_id AS sample_id, ac AS "AC", gr AS "GR", k AS "K", th AS "TH", u AS "U", rd AS "RD", rs AS "RS", toc AS "TOC" FROM samples""")
def column_pruning(spark, sf):
    df = samples(spark, sf)
    return C.prune(df, R.resolve_fuzzy([c for c in df.columns if c in LOG_ROLES.values()]), keep=["sample_id"])


@query(f"""WITH {SAMPLES} SELECT sample_id, toc FROM samples ORDER BY sample_id LIMIT 1000""")
def row_cap(spark, sf):
    return C.cap_rows(samples(spark, sf).select("sample_id", "toc"), 1000)


@query(f"""WITH {DIRTY} SELECT count(*) AS rows_before, count(CASE WHEN toc IS NOT NULL AND s1 IS NOT NULL THEN 1 END) AS rows_after,
 count(*)-count(CASE WHEN toc IS NOT NULL AND s1 IS NOT NULL THEN 1 END) AS rows_dropped FROM dirty""")
def clean_report(spark, sf):
    """Counted while the cleaned table is landed."""
    return C.clean_with_report(dirty(spark, sf).select("sample_id", "toc", "s1"), ["s1"], "toc", scratch_path(spark, "cleaned"))[1]


@query(f"""WITH {DIRTY} SELECT sample_id, regexp_replace(lower(trim(toc_text)), '[^a-z0-9]+', '_', 'g') AS normalised FROM dirty""")
def normalise_names(spark, sf):
    return dirty(spark, sf).select("sample_id", R.normalise_column("toc_text").alias("normalised"))


# -------------------------------------------------------------------- features


@query(f"""WITH {DIRTY}, l AS (SELECT sample_id, CASE WHEN rd > -1 THEN ln(1+rd) END AS a, ln(1+rs) AS b FROM dirty)
 SELECT sample_id, round(a,6) AS "log_RD", round(b,6) AS "log_RS", round(a-b,6) AS "dlogR", round(a+b,6) AS "sumlogR" FROM l""")
def feat_log(spark, sf):
    df = D.add_log_features(dirty(spark, sf), "rd", "rs")
    return rounded(df.select("sample_id", "log_RD", "log_RS", "dlogR", "sumlogR"))


_RATIOS = """, r AS (SELECT sample_id, u/nullif(th+CAST(0.000001 AS DOUBLE),0) AS a, u/nullif(k+CAST(0.000001 AS DOUBLE),0) AS b,
 th/nullif(k+CAST(0.000001 AS DOUBLE),0) AS c FROM dirty)"""


@query(f"""WITH {DIRTY} {_RATIOS} SELECT sample_id, round(a,6) AS "U_TH", round(b,6) AS "U_K", round(c,6) AS "TH_K" FROM r""")
def feat_ratio(spark, sf):
    df = D.add_ratio_features(dirty(spark, sf), "u", "th", "k")
    return rounded(df.select("sample_id", *D.RATIOS))


@query(f"""WITH {DIRTY} {_RATIOS}, m AS (SELECT quantile_cont(a,CAST(0.5 AS DOUBLE)) AS ma, quantile_cont(b,CAST(0.5 AS DOUBLE)) AS mb,
 quantile_cont(c,CAST(0.5 AS DOUBLE)) AS mc FROM r)
 SELECT sample_id, round(coalesce(a,ma),6) AS "U_TH", round(coalesce(b,mb),6) AS "U_K", round(coalesce(c,mc),6) AS "TH_K" FROM r, m""")
def feat_median_repair(spark, sf):
    df = D.add_ratio_features(dirty(spark, sf), "u", "th", "k").select("sample_id", *D.RATIOS)
    return rounded(D.repair_nonfinite(df))


@query(f"""WITH {SAMPLES} SELECT sample_id, round(ln(1+greatest(toc-3,0)),6) AS y_log, round(greatest(exp(ln(1+greatest(toc-3,0)))-1,0),6) AS y_back FROM samples""")
def target_log(spark, sf):
    df = samples(spark, sf).select("sample_id", (F.col("toc") - 3).alias("y")).withColumn("y_log", X.log_target("y"))
    return rounded(df.select("sample_id", "y_log", X.unlog_target("y_log").alias("y_back")))


@query(f"""WITH {SAMPLES} SELECT sample_id, round(100*s2/greatest(toc,CAST(0.000001 AS DOUBLE)),6) AS hi FROM samples""")
def hi_derived(spark, sf):
    return rounded(samples(spark, sf).select("sample_id", D.hydrogen_index("s2", "toc").alias("hi")))


@query(f"""WITH {DIRTY} SELECT sample_id, CASE WHEN isfinite(s2) THEN s2 ELSE CAST(-1000000000 AS DOUBLE) END AS s2_filled,
 CASE WHEN isfinite(s1) THEN s1 ELSE CAST(-1000000000 AS DOUBLE) END AS s1_filled,
 CASE WHEN isfinite(s2) THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS s2_is_missing,
 CASE WHEN isfinite(s1) THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS s1_is_missing FROM dirty""")
def missing_encode(spark, sf):
    df, names = D.encode_missing(dirty(spark, sf), ["s2", "s1"])
    return df.select("sample_id", *names)


@query(f"""WITH {SAMPLES}, l AS (SELECT 'toc' AS col, toc AS v FROM samples UNION ALL SELECT 'ac' AS col, ac AS v FROM samples UNION ALL SELECT 'th' AS col, th AS v FROM samples)
 SELECT col, count(*) AS n, round(quantile_cont(v,CAST(0.01 AS DOUBLE)),6) AS q01, round(quantile_cont(v,CAST(0.5 AS DOUBLE)),6) AS q50,
 round(quantile_cont(v,CAST(0.99 AS DOUBLE)),6) AS q99 FROM l GROUP BY col""")
def column_quantiles(spark, sf):
    long = samples(spark, sf).select("toc", "ac", "th").unpivot([], ["toc", "ac", "th"], "col", "v")
    return rounded(Q.quantile_table(long, ["col"], "v", {"q01": 0.01, "q50": 0.5, "q99": 0.99}))


# ---------------------------------------------------------------------- splits


@query(f"WITH {SPLIT2} SELECT sample_id, seed, split FROM split")
def split2(spark, sf):
    return two_way(spark, sf)


@query(f"WITH {SPLIT3} SELECT sample_id, seed, split FROM split")
def split3(spark, sf):
    return P.repeated_split(samples(spark, sf).select("sample_id"), SEEDS, TEST_SIZE, VAL_SIZE)


_MASKED = """, masked AS (SELECT 'RockEval' AS setting, sample_id FROM dirty WHERE isfinite(toc) AND isfinite(s1) AND isfinite(s2)
 UNION ALL SELECT 'Logs' AS setting, sample_id FROM dirty WHERE isfinite(toc) AND isfinite(gr) AND isfinite(rd))"""


@query(f"WITH {DIRTY} {_MASKED} {_RANKED.format(rows='masked', by='setting, seed')} {_TWO} SELECT setting, sample_id, seed, split FROM split")
def split_within_setting(spark, sf):
    rows = C.rows_by_setting(dirty(spark, sf), "toc", {"RockEval": ["s1", "s2"], "Logs": ["gr", "rd"]})
    return P.repeated_split(rows.select("setting", "sample_id"), SEEDS, TEST_SIZE, within="setting")


@query(f"""WITH {SPLIT3} SELECT seed, count(CASE WHEN split='train' THEN 1 END) AS n_train, count(CASE WHEN split='val' THEN 1 END) AS n_val,
 count(CASE WHEN split='test' THEN 1 END) AS n_test FROM split GROUP BY seed""")
def split_sizes(spark, sf):
    return P.split_sizes(split3(spark, sf))


@query(f"""WITH {SAMPLES}, fan AS (SELECT sample_id, CAST(unnest(range(0,10)) AS INTEGER) AS seed FROM samples)
 SELECT sample_id, seed, CASE WHEN substr(md5(concat_ws(':',CAST(seed AS VARCHAR),CAST(sample_id AS VARCHAR))),1,8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM fan""")
def split_hash(spark, sf):
    return P.bernoulli_split(samples(spark, sf).select("sample_id"), SEEDS, TEST_SIZE)


@query(f"""WITH {SAMPLES}, fan AS (SELECT sample_id, CAST(unnest(range(100,180,20)) AS INTEGER) AS seed FROM samples) SELECT seed, count(*) AS n FROM fan GROUP BY seed""")
def seed_fan_out(spark, sf):
    seeds = P.seed_schedule(offset=100, stop=180, step=20)
    return P.fan_out(samples(spark, sf).select("sample_id"), seeds).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- constraints


@query(f"""WITH {SPLIT2} SELECT seed, round(greatest(regr_slope(toc,s2),0),6) AS a, round(regr_intercept(toc,s2),6) AS b,
 round(greatest(max(toc)*1.1,1),8) AS toc_max, CAST(0.15 AS DOUBLE) AS lambda_s2, count(*) AS n_pairs FROM split WHERE split='train' GROUP BY seed""")
def constraint_linear_fit(spark, sf):
    train = train_of(two_way(spark, sf, "toc", "s2"))
    return rounded(K.fit_together(train, ["seed"], [K.line_and_cap("toc", "s2")]).drop("eps", "fit_status"), toc_max=8)


@query(f"""WITH {SAMPLES}, g AS (SELECT CAST(floor(ac*10) AS BIGINT) AS cell, count(*) AS n, quantile_cont(toc,CAST(0.5 AS DOUBLE)) AS med,
 regr_slope(toc,s2) AS s, regr_intercept(toc,s2) AS i, max(toc) AS top FROM samples GROUP BY cell)
 SELECT cell, round(CASE WHEN n < 10 OR s < 0 THEN 0 ELSE s END,6) AS a, round(2*CASE WHEN n < 10 THEN med ELSE i END,6) AS b_twice,
 round(greatest(top*1.1,1),8) AS toc_max, n AS n_pairs FROM g""")
def constraint_small_groups(spark, sf):
    rows = samples(spark, sf).select(F.floor(F.col("ac") * 10).alias("cell"), "toc", "s2")
    fits = K.fit_together(rows, ["cell"], [K.line_and_cap("toc", "s2")])
    # medians of two values end in a rounding tie; twice the value does not
    return rounded(fits.select("cell", "a", (F.col("b") * 2).alias("b_twice"), "toc_max", "n_pairs"), toc_max=8)


@query(f"""WITH {BAND} SELECT seed, round(a_s2,6) AS a_s2, round(b_s2,6) AS b_s2, round(hi_min,6) AS hi_min, round(hi_max,6) AS hi_max FROM fit""")
def constraint_hi_fit(spark, sf):
    train = train_of(two_way(spark, sf, "toc", "s2"))
    return rounded(K.fit_band_and_line(train, ["seed"], "toc", "s2").drop("eps", "lambda_s2"))


@query(f"""WITH {SPLIT2} SELECT seed, round(CASE WHEN regr_slope(toc,s2) < 0 THEN 0.1 ELSE regr_slope(toc,s2) END,6) AS a_lin,
 round(CASE WHEN regr_slope(toc,s2) < 0 THEN 0 ELSE regr_intercept(toc,s2) END,6) AS b_lin FROM split WHERE split='train' GROUP BY seed""")
def refine_line_a(spark, sf):
    return rounded(K.fit_together(train_of(two_way(spark, sf, "toc", "s2")), ["seed"], [K.refine_line("toc", "s2")]))


@query(f"""WITH {SPLIT2} SELECT seed, round(regr_slope(s2,toc),6) AS a_lin, round(regr_intercept(s2,toc),6) AS b_lin
 FROM split WHERE split='train' AND toc > 0.000001 GROUP BY seed""")
def refine_line_b(spark, sf):
    return rounded(K.fit_together(train_of(two_way(spark, sf, "toc", "s2")), ["seed"], [K.refine_inverse_line("toc", "s2")]))


@query(f"""WITH {SPLIT2}, c AS (SELECT seed, greatest(max(toc)*1.1,1) AS c1, greatest(max(toc)*1.1,25) AS c25 FROM split WHERE split='train' GROUP BY seed)
 SELECT seed, round(CASE WHEN c1 < 5 THEN 15 ELSE c1 END,8) AS raise_small, round(c25,8) AS floor_25, round(c1,8) AS plain FROM c""")
def refine_cap(spark, sf):
    train = train_of(two_way(spark, sf, "toc"))
    caps = [K.refine_cap("toc", rule, name=rule) for rule in ("raise_small", "floor_25", "plain")]
    shared = K.Fit(caps[0].aggs, {rule: c.params[rule] for c in caps for rule in c.params})
    return rounded(K.fit_together(train, ["seed"], [shared]), raise_small=8, floor_25=8, plain=8)


@query(f"WITH {PRED} SELECT setting, seed, sample_id, round(least(greatest(p-2,0),toc_max),6) AS y FROM pred")
def apply_range(spark, sf):
    rows = line_predictions(spark, sf)
    return rounded(rows.select("setting", "seed", "sample_id", K.clip_range(F.col("p") - 2, "toc_max").alias("y")))


@query(f"WITH {PRED} SELECT setting, seed, sample_id, round(CAST(0.85 AS DOUBLE)*p+CAST(0.15 AS DOUBLE)*(a*s2+b),6) AS y FROM pred")
def apply_soft_linear(spark, sf):
    y = K.soft_line("p", "s2", F.col("a"), F.col("b"), F.col("lambda_s2"))
    return rounded(line_predictions(spark, sf).select("setting", "seed", "sample_id", y.alias("y")))


@query(f"WITH {BAND} SELECT seed, sample_id, round(y_band,6) AS y FROM banded")
def apply_hi_band(spark, sf):
    y = K.band_clip(X.floor_at_zero("p"), "s2", F.col("hi_min"), F.col("hi_max"), F.col("eps"))
    return rounded(band_rows(spark, sf).select("seed", "sample_id", y.alias("y")))


@query(f"""WITH {BAND} SELECT seed, sample_id, round(CASE WHEN s2 IS NULL THEN p ELSE
 greatest(CAST(0.95 AS DOUBLE)*p+CAST(0.05 AS DOUBLE)*((s2-b_s2)/a_s2),0) END,6) AS y FROM t""")
def apply_inverse_linear(spark, sf):
    y = K.soft_inverse_line("p", "s2", F.col("a_s2"), F.col("b_s2"), F.col("lambda_s2"), F.col("eps"))
    return rounded(band_rows(spark, sf).select("seed", "sample_id", y.alias("y")))


@query(f"""WITH {BAND} SELECT seed, sample_id, round(CASE WHEN s2 IS NULL THEN y_band ELSE
 greatest(CAST(0.95 AS DOUBLE)*y_band+CAST(0.05 AS DOUBLE)*((s2-b_s2)/a_s2),0) END,6) AS y FROM banded""")
def full_composite(spark, sf):
    return rounded(band_rows(spark, sf).select("seed", "sample_id", K.composite("p", "s2").alias("y")))


@query(f"""WITH {PRED} SELECT setting, seed, sample_id, round(y_base,6) AS y_base, round(y_base,6) AS y_nn, round(y_full,6) AS y_s2, round(y_full,6) AS y_full FROM pred""")
def ablation_modes(spark, sf):
    rows = K.ablation_modes(line_predictions(spark, sf), "p", "s2")
    return rounded(rows.select("setting", "seed", "sample_id", "y_base", "y_nn", "y_s2", "y_full"))


# --------------------------------------------------------- metrics and summary


@query(f"WITH {METRICS} SELECT setting, mode, seed, n, round(r2,6) AS r2, round(rmse,6) AS rmse, round(mae,6) AS mae FROM met")
def metrics_by_seed(spark, sf):
    return rounded(run_metrics(spark, sf))


@query(f"""WITH {PRED}, e AS (SELECT setting, seed, avg((p-y_true)*(p-y_true)) AS m, avg(greatest(p-toc_max,0))+avg(greatest(-p,0)) AS r,
 avg((p-(a*s2+b))*(p-(a*s2+b))) AS l FROM pred GROUP BY setting, seed)
 SELECT setting, seed, round(m,6) AS loss_mse, round(r,6) AS loss_range, round(l,6) AS loss_line,
 round(m+CAST(0.2 AS DOUBLE)*r+CAST(0.2 AS DOUBLE)*l,6) AS loss_total FROM e""")
def loss_terms(spark, sf):
    line = F.col("a") * F.col("s2") + F.col("b")
    return rounded(A.loss_terms(line_predictions(spark, sf), A.RUN, "y_true", "p", "toc_max", line))


@query(f"""WITH {METRICS} SELECT setting, round(avg(r2),6) AS r2_mean, round(stddev_pop(r2),6) AS r2_std, round(avg(rmse),6) AS rmse_mean,
 round(stddev_pop(rmse),6) AS rmse_std, round(avg(mae),6) AS mae_mean, round(stddev_pop(mae),6) AS mae_std,
 (SELECT count(*) FROM samples) AS n_samples FROM met WHERE mode='full' GROUP BY setting""")
def summary_pop(spark, sf):
    full = run_metrics(spark, sf).where(F.col("mode") == "full")
    n = samples(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rounded(S.population_summary(full, n))


@query(f"WITH {METRICS} SELECT setting, mode, count(r2) AS n, {stats_sql('r2', '')} FROM met GROUP BY setting, mode")
def summary_sample(spark, sf):
    return rounded(S.sample_summary(run_metrics(spark, sf), ["setting", "mode"], "r2"))


@query(f"WITH {METRICS} SELECT seed, round(r2_base,6) AS r2_base, round(r2_full,6) AS r2_full, round(delta_r2,6) AS delta_r2 FROM delta_s")
def delta_wide(spark, sf):
    full = run_metrics(spark, sf).where(F.col("mode") == "full")
    return rounded(S.delta_between_settings(full))


@query(f"WITH {METRICS} SELECT seed, setting, round(r2_base,6) AS r2_base, round(r2_full,6) AS r2_full, round(r2_full-r2_base,6) AS delta_r2 FROM delta")
def delta_long(spark, sf):
    return rounded(S.delta_between_modes(run_metrics(spark, sf)))


_BEST = """, best AS (SELECT seed, arg_max(setting, r2_base) AS best_setting_base, arg_max(setting, r2_full) AS best_setting_full,
 max(r2_base) AS r2_base, max(r2_full) AS r2_full, max(r2_full)-max(r2_base) AS delta_r2 FROM delta GROUP BY seed)"""


@query(f"WITH {METRICS} {_BEST} SELECT seed, best_setting_base, best_setting_full, round(r2_base,6) AS r2_base, round(r2_full,6) AS r2_full, round(delta_r2,6) AS delta_r2 FROM best")
def best_of_best(spark, sf):
    return rounded(S.best_of_best(S.delta_between_modes(run_metrics(spark, sf)), ["NoRes", "Full"]))


@query(f"""WITH {METRICS} {_BEST}, l AS (SELECT 'base' AS series, r2_base AS v FROM best UNION ALL SELECT 'full' AS series, r2_full AS v FROM best
 UNION ALL SELECT 'delta' AS series, delta_r2 AS v FROM best)
 SELECT series, count(v) AS n, round(avg(v),6) AS mean, round(coalesce(stddev_samp(v),0),6) AS std, round(quantile_cont(v,CAST(0.5 AS DOUBLE)),6) AS median,
 round(quantile_cont(v,CAST(0.25 AS DOUBLE)),6) AS q1, round(quantile_cont(v,CAST(0.75 AS DOUBLE)),6) AS q3 FROM l GROUP BY series""")
def digest(spark, sf):
    return rounded(S.digest(S.best_of_best(S.delta_between_modes(run_metrics(spark, sf)), ["NoRes", "Full"])))


_PICKS = """, med AS (SELECT quantile_cont(delta_r2,CAST(0.5 AS DOUBLE)) AS m FROM delta_s),
 picks AS (SELECT 'best' AS tag, arg_max(seed, delta_r2) AS seed FROM delta_s UNION ALL SELECT 'worst' AS tag, arg_min(seed, delta_r2) AS seed FROM delta_s
 UNION ALL SELECT 'median' AS tag, (SELECT seed FROM delta_s, med ORDER BY round(abs(delta_r2-m),12), seed LIMIT 1) AS seed)"""


@query(f"WITH {METRICS} {_PICKS} SELECT tag, seed FROM picks")
def seed_picks(spark, sf):
    full = run_metrics(spark, sf).where(F.col("mode") == "full")
    return S.seed_picks(S.delta_between_settings(full))


@query(f"""WITH {METRICS} SELECT round(avg(CASE WHEN setting='Full' THEN r2 END),6) AS r2_full, round(avg(CASE WHEN setting='NoRes' THEN r2 END),6) AS r2_base,
 round(avg(CASE WHEN setting='Full' THEN r2 END)-avg(CASE WHEN setting='NoRes' THEN r2 END),6) AS r2_diff FROM met WHERE mode='full'""")
def setting_diff(spark, sf):
    return rounded(S.setting_difference(run_metrics(spark, sf).where(F.col("mode") == "full")))


@query(f"""WITH {PRED}, e AS (SELECT setting, y_true-y_full AS r FROM pred), m AS (SELECT setting, min(r) AS lo, max(r) AS hi FROM e GROUP BY setting)
 SELECT setting, CAST(least(floor((r-lo)/(hi-lo)*20)+1,20) AS BIGINT) AS bin, round(lo+(hi-lo)/20*(least(floor((r-lo)/(hi-lo)*20)+1,20)-1),6) AS bin_low,
 round(lo+(hi-lo)/20*least(floor((r-lo)/(hi-lo)*20)+1,20),6) AS bin_high, count(*) AS rows FROM e JOIN m USING (setting) GROUP BY setting, bin, bin_low, bin_high""")
def residual_hist(spark, sf):
    """Over stored predictions: the operator reads them twice."""
    stored = land(line_predictions(spark, sf).select("setting", "y_true", "y_full"), scratch_path(spark, "residuals"))
    return rounded(A.residual_histogram(stored, ["setting"], "y_true", "y_full"))


@query(f"""WITH {PRED} SELECT setting, seed, round(least(min(y_true),min(y_full)),6) AS line_min, round(greatest(max(y_true),max(y_full)),6) AS line_max,
 round(1-sum((y_true-y_full)*(y_true-y_full))/(var_pop(y_true)*count(*)),2) AS r2_label, round(sqrt(avg((y_true-y_full)*(y_true-y_full))),2) AS rmse_label,
 round(avg(abs(y_true-y_full)),2) AS mae_label FROM pred GROUP BY setting, seed""")
def scatter_envelope(spark, sf):
    return rounded(A.scatter_envelope(line_predictions(spark, sf), pred="y_full"))


@query(f"""WITH {METRICS} SELECT setting, arg_max(seed, r2) AS seed, round(max(r2),6) AS r2 FROM met WHERE mode='full' GROUP BY setting""")
def best_model_seed(spark, sf):
    return rounded(S.best_seed(run_metrics(spark, sf).where(F.col("mode") == "full")))


# ------------------------------------------------------------- joins and gates


_PAIRS = """, pairs AS (SELECT a.seed, a.sample_id, a.y_true, a.y_full AS y_base, b.y_full AS y_full FROM pred a JOIN pred b
 ON a.seed=b.seed AND a.sample_id=b.sample_id WHERE a.setting='NoRes' AND b.setting='Full')"""


def pairs(rows: DataFrame) -> DataFrame:
    return A.pair_settings(rows, "NoRes", "Full", pred="y_full")


@query(f"WITH {PRED} {_PAIRS} SELECT seed, sample_id, y_true, round(y_base,6) AS y_base, round(y_full,6) AS y_full FROM pairs")
def join_predictions(spark, sf):
    return rounded(pairs(line_predictions(spark, sf)))


@query(f"WITH {METRICS} {_PICKS} {_PAIRS} SELECT tag, seed, sample_id, y_true, round(y_base,6) AS y_base, round(y_full,6) AS y_full FROM pairs JOIN picks USING (seed)")
def diag_bundle(spark, sf):
    rows = line_predictions(spark, sf)
    picks = S.seed_picks(S.delta_between_settings(A.metrics(rows).where(F.col("mode") == "full")))
    return rounded(S.diagnostic_rows(pairs(S.rows_of_picks(rows, picks)), picks))


@query(f"""WITH {METRICS} SELECT setting, seed, sample_id, round(CASE WHEN delta.r2_full >= delta.r2_base THEN y_full ELSE y_base END,6) AS y_kept,
 delta.r2_full >= delta.r2_base AS refined_accepted FROM pred JOIN delta USING (setting, seed)""")
def accept_gate(spark, sf):
    rows = line_predictions(spark, sf)
    kept = A.accept_if_better(rows, A.metrics(rows), refined_mode="full", refined="y_full", out="y_kept")
    return rounded(kept.select("setting", "seed", "sample_id", "y_kept", "refined_accepted"))


# ------------------------------------------------------------- stored outputs


@query(f"WITH {PRED} SELECT setting, seed, sample_id, y_true, round(y_base,6) AS y_base, round(y_full,6) AS y_full FROM pred WHERE seed IN (2, 5)")
def reread_predictions(spark, sf):
    """Written partitioned by (setting, seed), read back by partition."""
    path = scratch_path(spark, "predictions")
    rows = line_predictions(spark, sf).withColumn("refined_accepted", F.lit(False))
    W.write_predictions(rows.select("sample_id", "y_true", "y_base", "y_full", "refined_accepted", "setting", "seed"), path)
    return rounded(read_predictions(spark, path, seeds=[2, 5]).drop("refined_accepted"))


@query(f"""WITH {DIRTY}, c AS (SELECT sample_id, toc, s1, CASE WHEN rd > -1 THEN ln(1+rd) END AS a, ln(1+rs) AS b FROM dirty WHERE toc IS NOT NULL AND s1 IS NOT NULL)
 SELECT sample_id, toc, s1, round(a,6) AS "log_RD", round(b,6) AS "log_RS", round(a-b,6) AS "dlogR", round(a+b,6) AS "sumlogR" FROM c""")
def clean_table_landed(spark, sf):
    """Cleaned and derived columns, landed as Parquet and scanned back."""
    df = C.drop_missing(dirty(spark, sf).select("sample_id", "toc", "s1", "rd", "rs"), ["toc", "s1"])
    df = D.add_log_features(df, "rd", "rs").drop("rd", "rs")
    return rounded(land(df, scratch_path(spark, "clean")))


@query(f"""WITH {METRICS} SELECT setting, seed, round(max(CASE WHEN mode='base' THEN r2 END),6) AS r2_base, round(max(CASE WHEN mode='full' THEN rmse END),6) AS rmse_full,
 count(*) AS modes FROM met GROUP BY setting, seed""")
def run_log(spark, sf):
    """Nested run log rows (metrics by mode), read out of their structs."""
    m = run_metrics(spark, sf)
    sizes = m.groupBy("setting", "seed").agg(F.count(F.lit(1)).alias("modes"))
    info = {s: {"features": [x], "model_cfg": {"kind": "line"}} for s, x in (("NoRes", "depth"), ("Full", "ac"))}
    log = W.run_log(m, sizes, info)
    return rounded(log.select("setting", "seed", F.col("metrics.base.r2_test").alias("r2_base"),
                              F.col("metrics.full.rmse_test").alias("rmse_full"), "modes"))


@query(f"""WITH {METRICS} SELECT m.setting, m.seed, round(max(CASE WHEN mode='full' THEN r2 END),6) AS r2_full, round(any_value(f.a),6) AS a,
 round(any_value(f.b),6) AS b, round(any_value(f.toc_max),8) AS toc_max, 'line' AS kind, 'train_only' AS constraint_fitted_on
 FROM met m JOIN fit f USING (seed) GROUP BY m.setting, m.seed""")
def run_log_constraints(spark, sf):
    """The nested run log with the constraint that was fitted for each run."""
    train = train_of(two_way(spark, sf, "toc", "s2"))
    fits = land(K.fit_together(train, ["seed"], [K.line_and_cap("toc", "s2")]), scratch_path(spark, "fits"))
    m = run_metrics(spark, sf)
    info = {s: {"features": [x], "constraint_cfg": {"kind": "line"}} for s, x in (("NoRes", "depth"), ("Full", "ac"))}
    log = W.run_log(m, m.groupBy("setting", "seed").agg(F.count(F.lit(1)).alias("modes")), info, fits)
    return rounded(log.select("setting", "seed", F.col("metrics.full.r2_test").alias("r2_full"), "constraint_params.a", "constraint_params.b",
                              "constraint_params.toc_max", F.col("constraint_cfg")["kind"].alias("kind"), "constraint_fitted_on"), toc_max=8)


@query(f"WITH {SAMPLES} SELECT sample_id, round(toc,6) AS toc FROM samples WHERE sample_id % 3 > 0")
def dataset_discovery(spark, sf):
    """Of several files below a folder, each written in parts, the one most like a dataset by name, then by size."""
    folder = scratch_path(spark, "discovery")
    rows = samples(spark, sf).select("sample_id", "toc").where("sample_id % 3 > 0")
    for name, table in (("notes", samples(spark, sf)), ("old_dataset_toc", rows.where("sample_id % 2 = 0")), ("dataset_toc", rows)):
        table.write.option("header", True).csv(f"{folder}/{name}.csv")  # in parts: no task reads or writes a whole table
    found = read_csv(spark, find_dataset(spark, folder))
    return rounded(found.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.col("toc").cast("double").alias("toc")))


@query(f"""WITH {METRICS} {_PICKS} SELECT len(list(seed)) AS seeds, round(sum(delta_r2),6) AS delta_sum,
 (SELECT seed FROM picks WHERE tag='best') AS best_seed, (SELECT seed FROM picks WHERE tag='worst') AS worst_seed,
 (SELECT seed FROM picks WHERE tag='median') AS median_seed FROM delta_s""")
def plot_bundle(spark, sf):
    """The per-seed arrays of a study in one row."""
    deltas = S.delta_between_settings(run_metrics(spark, sf).where(F.col("mode") == "full"))
    bundle = W.plot_bundle(deltas, S.seed_picks(deltas), key="samples", label="samples", source=sf)
    return rounded(bundle.select(
        F.size("seeds").cast("bigint").alias("seeds"),
        F.aggregate("delta_r2", F.lit(0.0), lambda a, b: a + b).alias("delta_sum"), "best_seed", "worst_seed", "median_seed"))


# ------------------------------------------------- trees and networks, no SQL


def sized_booster(booster: M.Booster, trees: int | None) -> M.Booster:
    return replace(booster, max_iter=trees or booster.max_iter)


LOG_FEATURES = ["ac", "gr", "k", "th", "u", "rd", "rs"]
PYROLYSIS = ["s1", "s2", "s3", "tmax"]


def held_out_by(spark, sf, booster: M.Booster, features, table: DataFrame | None = None, seed: int = 0):
    """Fit on one seed's TRAIN rows; TEST rows with the prediction, and the trees."""
    df = (samples(spark, sf) if table is None else table).select("sample_id", "toc", *features)
    cut = P.find_cuts(df, [seed], TEST_SIZE)[None, seed]
    held = M.in_validation(seed, F.col("sample_id"), booster.validation_fraction) if booster.stopping != "none" else F.lit(False)
    train = P.part_of(cut, seed, "sample_id") == P.TRAIN
    job = B.Job("study", seed, tuple(features), F.when(train & held, B.HELD).when(train, B.FIT).otherwise(B.OUT))
    forests = B.fit_many(df, [job], X.log_target("toc") if booster.log_target else F.col("toc"), booster)
    scores = forests.scores().select(F.col("id").alias("sample_id"), F.col("scores")[0].alias("s")).where(F.col("s.part") == B.OUT)
    margin = F.col("s.margin")
    pred = X.unlog_target(margin) if booster.log_target else X.floor_at_zero(margin)
    rows = df.join(scores, "sample_id").select(F.lit(seed).alias("seed"), "sample_id", F.col("toc").alias("y_true"), pred.alias("y_pred"))
    return rows, forests


@query()
def gbt_log(spark, sf, trees=None):
    """Log-target trees on the well-log features: metrics on TEST."""
    rows, _ = held_out_by(spark, sf, sized_booster(M.LOG_BOOSTER, trees), LOG_FEATURES)
    return A.metrics(rows, ["seed"], "y_true", {"base": "y_pred"})


@query()
def gbt_raw(spark, sf, trees=None):
    """Raw-target trees: TEST predictions."""
    rows, _ = held_out_by(spark, sf, sized_booster(M.RAW_BOOSTER, trees), PYROLYSIS)
    return rows


@query()
def gbt_earlystop(spark, sf, trees=None):
    """Trees with missing values and a patience rule: metrics on TEST."""
    table = C.keep_finite(dirty(spark, sf), ["toc"])
    rows, _ = held_out_by(spark, sf, sized_booster(M.EARLY_STOP_BOOSTER, trees), PYROLYSIS, table)
    return A.metrics(rows, ["seed"], "y_true", {"base": "y_pred"})


@query()
def gbt_subsampled(spark, sf, trees=None):
    """Row and column subsampling: TEST predictions."""
    rows, _ = held_out_by(spark, sf, sized_booster(M.SUBSAMPLED_BOOSTER, trees), LOG_FEATURES)
    return rows


@query()
def gbt_importance(spark, sf, trees=None):
    """Feature importance of a fitted run, largest first."""
    _, forests = held_out_by(spark, sf, sized_booster(M.LOG_BOOSTER, trees), LOG_FEATURES)
    return B.importances(forests.trees)


@query()
def gbt_predict(spark, sf, trees=None):
    """Predictions of stored trees of two runs for all samples, in one pass."""
    df = samples(spark, sf).select("sample_id", "toc", *LOG_FEATURES)
    cuts = P.find_cuts(df, SEEDS[:2], TEST_SIZE)
    jobs = [B.Job("study", seed, tuple(LOG_FEATURES), F.when(P.part_of(cut, seed, "sample_id") == P.TRAIN, B.FIT)) for (_, seed), cut in cuts.items()]
    stored = land(B.fit_many(df, jobs, X.log_target("toc"), sized_booster(M.LOG_BOOSTER, trees)).trees, scratch_path(spark, "trees"))
    margins = F.posexplode("margins").alias("run", "margin")
    return B.score(df, stored, [0, 1]).select("sample_id", margins).select("sample_id", "run", X.unlog_target(F.col("margin")).alias("y_pred"))


HOLES = "CASE WHEN sample_id % 5 = 0 THEN NULL ELSE rs END"


@query(f"""WITH {SPLIT2}, t AS (SELECT seed, toc, {HOLES} AS rs, u, depth FROM split WHERE split = 'train'),
 mean AS (SELECT seed, avg(toc) AS base, count(*) AS n FROM t GROUP BY seed),
 long AS (SELECT seed, toc - base AS g, n, unnest([1, 2, 3]) AS f, unnest([rs, u, depth]) AS x FROM t JOIN mean USING (seed)),
 miss AS (SELECT seed, f, n, coalesce(sum(g) FILTER (x IS NULL), 0) AS gm, count(*) FILTER (x IS NULL) AS nm FROM long GROUP BY ALL),
 hist AS (SELECT seed, f, x, sum(g) AS g, count(*) AS k FROM long WHERE x IS NOT NULL GROUP BY ALL),
 cum AS (SELECT seed, f, x, sum(g) OVER w AS gl, sum(k) OVER w AS nl FROM hist WINDOW w AS (PARTITION BY seed, f ORDER BY x)),
 side AS (SELECT c.seed, f, x, n, unnest([0, 1]) AS m, unnest([gl, gl + gm]) AS gl, unnest([nl, nl + nm]) AS nl FROM cum c JOIN miss USING (seed, f)),
 best AS (SELECT *, gl*gl/(nl+1) + gl*gl/(n-nl+1) AS gain FROM side WHERE nl >= 20 AND n - nl >= 20
  QUALIFY row_number() OVER (PARTITION BY seed ORDER BY gain DESC, f, m, x) = 1), whole AS (SELECT seed, base FROM mean)
 SELECT seed, ['rs','u','depth'][f] AS feature, x AS cut, m = 1 AS missing_left, round(gain,4) AS gain,
  round(0.1*gl/(nl+1),6) AS leaf_left, round(-0.1*gl/(n-nl+1),6) AS leaf_right, round(base,6) AS base FROM best JOIN whole USING (seed)""")
def gbt_one_round(spark, sf):
    """One split for each of ten seeds, fitted together: L2 term, least leaf, learned side of missing values."""
    df = samples(spark, sf).select("sample_id", "toc", F.expr(HOLES).alias("rs"), "u", "depth")
    cuts = P.find_cuts(df, SEEDS, TEST_SIZE)
    jobs = [B.Job("study", seed, ("rs", "u", "depth"), F.when(P.part_of(cut, seed, "sample_id") == P.TRAIN, B.FIT)) for (_, seed), cut in cuts.items()]
    booster = M.Booster(max_depth=1, max_iter=1, min_rows=20, step_size=0.1, log_target=False, l2=1.0, max_bins=254)
    trees = B.fit_many(df, jobs, F.col("toc"), booster).trees
    first = lambda c: F.col(c)[0].alias(c)
    out = trees.select("seed", first("feature"), first("cut"), first("missing_left"), first("gain"),
                       F.col("leaf")[0].alias("leaf_left"), F.col("leaf")[1].alias("leaf_right"), "base")
    return rounded(out, gain=4)


def trained_networks(spark, sf, epochs=None):
    """TEST rows (one per sample, seeds as arrays) and a network per seed; the base is a line."""
    table = samples(spark, sf).select("sample_id", "toc", "s2", "s1", "depth")
    cuts = P.find_cuts(table, SEEDS, TEST_SIZE)
    fits = K.fit_together(train_of(P.assign_splits(table, cuts)), ["seed"], [
        K.baseline("toc", "depth"), K.refine_line("toc", "s2"), K.refine_cap("toc", "plain")]).collect()  # one row per seed
    terms = {r["seed"]: N.RunTerms(r["toc_max"], r["a_lin"], r["b_lin"]) for r in fits}
    lines = {r["seed"]: (r["line_a"], r["line_b"]) for r in fits}

    def part(name: str) -> DataFrame:
        """A row's runs are found in generated code, digests once: no function over an array of cuts, no filter on the result."""

        def entry(seed: int, cut: P.Cut) -> Column:
            a, b = (F.lit(v).cast("double") for v in lines.get(seed, (None, None)))
            base = X.floor_at_zero(a * F.col("depth") + b)
            return F.when(P.part_of(cut, seed) == name, F.struct(F.lit(seed).alias("seed"), base.alias("base")))

        entries = F.array(*[entry(seed, cut) for (_, seed), cut in cuts.items()])
        kept = table.withColumn("_in", F.filter(entries, lambda e: e.isNotNull()))
        return kept.select(
            "sample_id", F.array(F.col("s2") / 10, F.col("s1") / 10).alias("x"), F.col("toc").alias("y"), "s2",
            F.col("_in.seed").alias("runs"), F.col("_in.base").alias("y_bases"))

    weights, _ = N.train_networks(part(P.TRAIN), 2, {s: s for s in terms}, terms, N.RefineConfig(epochs=epochs or N.RefineConfig().epochs))
    return part(P.TEST), weights


@query()
def refine_predict(spark, sf, epochs=None):
    """Networks of ten seeds trained together: TEST predictions."""
    test, weights = trained_networks(spark, sf, epochs)
    each = F.explode(F.arrays_zip("runs", "y_bases", "y_refineds")).alias("e")
    return N.predict_networks(test, weights).select("sample_id", F.col("y").alias("y_true"), each).select(
        F.col("e.runs").alias("seed"), "sample_id", "y_true", F.col("e.y_bases").alias("y_base"), F.col("e.y_refineds").alias("y_refined"))


@query()
def monotone_violation(spark, sf, epochs=None):
    """How far each network breaks the rising relation to its features."""
    test, weights = trained_networks(spark, sf, epochs)
    return N.monotone_violation(test, weights, [(0, 1), (1, 1)])


def sized(cfg, trees=None, epochs=None):
    """A study's preset with other numbers of trees and epochs, where given."""
    refine = cfg.refine and replace(cfg.refine, epochs=epochs or cfg.refine.epochs)
    return cfg.but(booster=sized_booster(cfg.booster, trees), refine=refine)


@query()
def study_multi_basin(spark, sf, seeds=300, trees=None, epochs=None):
    """A whole study: Full against NoRes, network gated on VAL."""
    p = prepare_multi_basin(samples(spark, sf).select("sample_id", *LOG_FEATURES, "toc"))
    cfg = multi_basin(p.settings, n_repeats=seeds, target=p.target, use_external_booster=False)
    cfg = sized(cfg, trees, epochs)
    return run_ablation(p.table, cfg).summary


@query()
def study_log_pyrolysis(spark, sf, seeds=500, trees=None, epochs=None):
    """A whole study: soft line and cap on the RockEval setting."""
    raw = samples(spark, sf).select("sample_id", F.col("toc").alias("TOC"), *[F.col(c).alias(c.capitalize()) for c in PYROLYSIS])
    p = prepare_log_pyrolysis(raw)
    cfg = log_pyrolysis(p.settings, n_repeats=seeds, target=p.target, s2_col=p.roles["S2"])
    cfg = sized(cfg, trees, epochs)
    return run_ablation(p.table, cfg).summary


@query()
def study_pyrolysis_hi(spark, sf, seeds=200, trees=None, epochs=None):
    """A whole study: ratio band and inverse line, best setting per seed."""
    raw = samples(spark, sf).select(
        "sample_id", F.col("toc").alias("TOC (wt%)"), F.col("s2").alias("S2 (mg HC/g)"), F.col("s1").alias("S1"),
        F.col("tmax").alias("Tmax"), F.col("depth").alias("Depth"), D.hydrogen_index("s2", "toc").alias("HI"))
    p = standard_names(prepare_pyrolysis_hi(raw))
    cfg = pyrolysis_hi(p.settings, seeds_step=20, seeds_max=20 * seeds, target=p.target, s2_col=p.roles["S2"], hi_col=p.roles["HI"])
    cfg = sized(cfg, trees, epochs)
    return run_ablation(p.table, cfg).best_of_best


@query()
def study_missing_features(spark, sf, seeds=300, trees=None, epochs=None):
    """The multi-basin study over a table whose logs are partly missing or infinite after log1p."""
    raw = dirty(spark, sf).select("sample_id", *LOG_FEATURES, "toc")
    raw = raw.withColumn("rs", F.when(F.col("sample_id") % 43 == 0, F.lit(float("inf"))).otherwise(F.col("rs")))
    p = prepare_multi_basin(raw)
    cfg = multi_basin(p.settings, n_repeats=seeds, target=p.target, use_refinement=False)
    return run_ablation(p.table, sized(cfg, trees, epochs)).summary


# ----------------------------------------------- scans, roles and written files

FUZZY = {"u": "U (ppm)", "ac": "Sonic DT", "gr": "Gamma Ray", "k": "Potassium", "th": "Thorium", "rd": "ResDeep",
         "rs": "ResShallow", "toc": "TOC (%)"}


def renamed(spark: SparkSession, sf: str, names: dict[str, str]) -> DataFrame:
    return samples(spark, sf).select("sample_id", *[F.col(c).alias(n) for c, n in names.items()])


@query(f"WITH {SAMPLES} SELECT sample_id, round(toc,6) AS toc, round(s2,6) AS s2 FROM samples")
def csv_scan(spark, sf):
    """Written with blanks around the headers, scanned back as text, trimmed and parsed."""
    path = scratch_path(spark, "csv")
    renamed(spark, sf, {"toc": " toc ", "s2": "s2 "}).write.option("header", True).csv(path)
    back = trim_headers(read_csv(spark, path))
    back = C.coerce_numeric(back, ["toc", "s2"]).withColumn("sample_id", F.col("sample_id").cast("bigint"))
    return rounded(back)


@query(f"WITH {SAMPLES} SELECT sample_id, concat('TOC \u2013 ', CAST(CAST(tmax AS BIGINT) AS VARCHAR), ' \u20ac \u00b0') AS note FROM samples")
def csv_encoding_fallback(spark, sf):
    """A cp1252 export: dash, euro and degree signs survive the scan."""
    path = scratch_path(spark, "cp1252")
    # as bytes: 0x96 and 0x80, which ISO-8859-1 has as control characters
    note = F.concat(F.lit("TOC \u0096 "), F.col("tmax").cast("bigint").cast("string"), F.lit(" \u0080 \u00b0"))
    samples(spark, sf).select("sample_id", note.alias("note")).write.options(header=True, encoding="iso-8859-1").csv(path)
    back = read_csv_any_encoding(spark, path)
    return back.select(F.col("sample_id").cast("bigint").alias("sample_id"), "note")


@query(f"""WITH {SAMPLES} SELECT sample_id, ac AS "AC", gr AS "GR", k AS "K", th AS "TH", u AS "U", rd AS "RD", rs AS "RS", toc AS "TOC" FROM samples""")
def roles_fuzzy(spark, sf):
    """Headers that hold an alias: the resolved columns under their roles' names."""
    df = renamed(spark, sf, FUZZY)
    return C.prune(df, R.resolve_fuzzy([c for c in df.columns if c != "sample_id"]), keep=["sample_id"])


@query(f"""WITH {SAMPLES} SELECT sample_id, toc AS "TOC", s2 AS "S2", s1 AS "HI" FROM samples""")
def roles_normalised(spark, sf):
    """Headers equal to an alias but for case and punctuation; of two the last is meant."""
    df = samples(spark, sf).select("sample_id", F.col("s3").alias("s2-MGHC/gRock"), F.col("s2").alias("S2_mgHC_gRock"),
                                   F.col("toc").alias("toc wt pct"), F.col("s1").alias("Hydrogen-Index"))
    return C.prune(df, R.resolve_normalised(df.columns), keep=["sample_id"])


@query(f"""WITH {SAMPLES} SELECT sample_id, toc AS "TOC", s1 AS "S1", s2 AS "S2", tmax AS "TMAX", depth AS "DEPTH" FROM samples""")
def roles_literal(spark, sf):
    """Headers that must stand as listed; earlier names win, absent roles are left out."""
    df = renamed(spark, sf, {"toc": "TOC (wt%)", "s1": "S1 (mgHC/gRock)", "s2": "S2 (mg HC/g)", "s3": "S2", "tmax": "TMAX (°C)", "depth": "Depth (m)"})
    return C.prune(df, R.resolve_literal(df.columns), keep=["sample_id"])


def sums_of(df: DataFrame, settings: dict[str, list[str]]) -> DataFrame:
    """Each setting's features added up per sample: which columns a setting holds, over the data."""
    total = lambda cols: sum((C.quoted(c) for c in cols), F.lit(0.0))
    entries = [F.struct(F.lit(s).alias("setting"), F.lit(len(c)).cast("bigint").alias("features"), total(c).alias("total")) for s, c in settings.items()]
    return rounded(df.select("sample_id", F.explode(F.array(*entries)).alias("e")).select("sample_id", "e.*"))


@query(f"""WITH {SAMPLES}, f AS (SELECT sample_id, s1+s2+s3+tmax AS rock, gr+rd+rs+ac AS logs FROM samples)
 SELECT sample_id, 'RockEval' AS setting, CAST(4 AS BIGINT) AS features, round(rock,6) AS total FROM f
 UNION ALL SELECT sample_id, 'Logs', CAST(4 AS BIGINT), round(logs,6) FROM f
 UNION ALL SELECT sample_id, 'Fusion', CAST(8 AS BIGINT), round(rock+logs,6) FROM f""")
def settings_log_pyrolysis(spark, sf):
    """Feature sets by candidates, without columns that leak the target (HI, depth per TOC)."""
    names = {"toc": "TOC", "s1": "S1", "s2": "S2", "s3": "S3", "tmax": "TMAX", "gr": "GR", "rd": "RD", "rs": "RS", "ac": "AC", "k": "HI", "depth": "per_toc"}
    df = renamed(spark, sf, names)
    return sums_of(df, R.log_pyrolysis_settings(df, "TOC", id_col="sample_id"))


@query(f"""WITH {SAMPLES} SELECT sample_id, 'P_RockEval' AS setting, CAST(4 AS BIGINT) AS features, round(s1+s2+tmax+depth,6) AS total FROM samples
 UNION ALL SELECT sample_id, 'P_GeoFusion', CAST(6 AS BIGINT), round(s1+s2+tmax+depth+k+u,6) FROM samples""")
def settings_pyrolysis_hi(spark, sf):
    """Feature sets by roles, with the two ratios added in the wider one."""
    df = renamed(spark, sf, {"toc": "TOC", "s1": "S1", "s2": "S2", "tmax": "Tmax", "depth": "Depth", "k": "HI", "u": "OI", "gr": "GR"})
    return sums_of(df, R.pyrolysis_hi_settings(df, R.resolve_literal(df.columns), prefix="P_", id_col="sample_id"))


@query(f"""WITH {SAMPLES} SELECT sample_id, 'RockEval' AS setting, CAST(3 AS BIGINT) AS features, round(s1+s3+tmax,6) AS total FROM samples
 UNION ALL SELECT sample_id, 'GeoFusion', CAST(5 AS BIGINT), round(s1+s3+tmax+depth+k,6) FROM samples""")
def settings_stand_ins(spark, sf):
    """Without the roles, the first numeric columns stand in, up to two stated widths."""
    df = renamed(spark, sf, {"s1": "a", "s3": "b", "tmax": "c", "depth": "d", "k": "e", "u": "f", "toc": "TOC"})
    roles = {"TOC": "TOC"}
    wide = R.pyrolysis_hi_settings(df, roles, id_col="sample_id", rock_stand_ins=3, fusion_stand_ins=5)
    return sums_of(df, wide)


@query(f"""WITH {SAMPLES}, d AS (SELECT sample_id, gr, u, ln(1+rd) AS a, ln(1+rs) AS b, u/(th+CAST(0.000001 AS DOUBLE)) AS q FROM samples)
 SELECT sample_id, 'Full' AS setting, CAST(5 AS BIGINT) AS features, round(gr+u+a+b+q,6) AS total FROM d
 UNION ALL SELECT sample_id, 'NoRes', CAST(3 AS BIGINT), round(gr+u+q,6) FROM d""")
def settings_rising(spark, sf):
    """The features of the two fixed settings that the target should rise with."""
    df = samples(spark, sf).select("sample_id", *[F.col(c).alias(c.upper()) for c in LOG_FEATURES])
    df = D.add_ratio_features(D.add_log_features(df))
    settings = R.restrict_settings(R.log_study_settings(), ["Full", "NoRes"])
    return sums_of(df, {s: [cols[i] for i, _ in R.rising_features(cols)] for s, cols in settings.items()})


@query(f"WITH {METRICS} SELECT setting, seed, round(r2_base,6) AS r2_base, round(r2_full,6) AS r2_full FROM delta")
def report_files(spark, sf):
    """The per-seed report as written, read back from its file."""
    path = scratch_path(spark, "report")
    W.write_report(S.delta_between_modes(run_metrics(spark, sf)).select("setting", "seed", "r2_base", "r2_full"), path)
    back = spark.read.option("header", True).schema("setting string, seed int, r2_base double, r2_full double").csv(path)
    return rounded(back)


@query(f"WITH {PRED} SELECT setting, seed, count(*) AS n FROM pred WHERE seed = 3 GROUP BY setting, seed")
def stale_outputs(spark, sf):
    """A clean write drops the runs of an earlier one."""
    path = scratch_path(spark, "stale")
    rows = line_predictions(spark, sf).withColumn("refined_accepted", F.lit(False))
    rows = rows.select("sample_id", "y_true", "y_base", "y_full", "refined_accepted", "setting", "seed")
    W.write_predictions(rows, path)
    W.write_predictions(rows.where("seed = 3"), path, clean=True)
    return read_predictions(spark, path).groupBy("setting", "seed").agg(F.count(F.lit(1)).alias("n"))
