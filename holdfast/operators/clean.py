"""Cleaning: coercion, missing values, validity masks, row caps.

The all-or-nothing and drop-empty operators must know the data before they
know the schema, so each runs one aggregation over the table and returns a
lazy projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.columns import is_finite, nan_to_null, parse_number
from holdfast.operators.ranks import numeric_key, select_ranks
from holdfast.session import land

MIN_FEATURES = 2
MIN_ROWS = 25


def quoted(name: str) -> Column:
    """A column by its literal name: raw headers hold dots, spaces and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def to_double(df: DataFrame, name: str) -> Column:
    if is_numeric(df, name):
        return nan_to_null(quoted(name).cast("double"))
    return parse_number(quoted(name).cast("string"))


def prune(df: DataFrame, roles: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Only the resolved columns, under their standard names."""
    return df.select(*[quoted(k) for k in keep], *[quoted(raw).alias(role) for role, raw in roles.items()])


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Bad values become missing."""
    return df.withColumns({c: to_double(df, c) for c in cols})


def coerce_if_all_numeric(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """Convert a text column only if every value in it parses."""
    skip = set(skip)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not text:
        return df
    # 'nan' parses to missing, so it must not count as a value that failed
    tests = [
        F.count_if(
            quoted(c).isNotNull()
            & parse_number(quoted(c)).isNull()
            & ~F.lower(F.trim(quoted(c))).isin("nan", "+nan", "-nan", "")
        ).alias(str(i))
        for i, c in enumerate(text)
    ]
    failed = df.agg(*tests).first()
    return coerce_numeric(df, [c for i, c in enumerate(text) if failed[i] == 0])


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


def all_finite(cols: Iterable[str]) -> Column:
    return reduce(Column.__and__, [is_finite(quoted(c)) for c in cols])


def keep_finite(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.where(all_finite(cols))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all (NaN counts as none)."""
    seen = df.agg(
        *[
            F.count(nan_to_null(quoted(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else quoted(f.name)).alias(str(i))
            for i, f in enumerate(df.schema.fields)
        ]
    ).first()
    return df.select(*[quoted(c) for i, c in enumerate(df.columns) if seen[i] > 0])


def valid_mask(target: str, features: Iterable[str]) -> Column:
    return all_finite([target, *features])


def usable_settings(
    df: DataFrame,
    target: str,
    settings: Mapping[str, Sequence[str]],
    min_features: int = MIN_FEATURES,
    min_rows: int = MIN_ROWS,
) -> dict[str, list[str]]:
    """Settings with enough present features and enough valid rows (one pass)."""
    return split_settings(df, target, settings, min_features, min_rows)[0]


def split_settings(
    df: DataFrame,
    target: str,
    settings: Mapping[str, Sequence[str]],
    min_features: int = MIN_FEATURES,
    min_rows: int = MIN_ROWS,
) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Usable settings, and the others with the reason."""
    present = {s: [c for c in cols if c in df.columns] for s, cols in settings.items()}
    skipped = {s: f"{len(cols)} of {min_features} features" for s, cols in present.items() if len(cols) < min_features}
    present = {s: cols for s, cols in present.items() if s not in skipped}
    if not present:
        return {}, skipped
    counts = df.agg(
        *[F.count_if(valid_mask(target, cols)).alias(str(i)) for i, cols in enumerate(present.values())]
    ).first()
    skipped |= {s: f"{counts[i]} of {min_rows} rows" for i, s in enumerate(present) if counts[i] < min_rows}
    return {s: cols for s, cols in present.items() if s not in skipped}, skipped


def rows_by_setting(df: DataFrame, target: str, settings: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each row once per setting it is valid for; one scan for all settings."""
    tags = F.array(*[F.when(valid_mask(target, cols), F.lit(s)) for s, cols in settings.items()])
    return df.withColumn("setting", F.explode(F.array_compact(tags)))


def cap_rows(df: DataFrame, max_rows: int, id_col: str = "sample_id") -> DataFrame:
    """The first ``max_rows`` rows by id, or all rows when ``max_rows`` is 0.

    The id at the cap is found by rank selection and applied as a filter, so no
    task sorts or holds the kept rows. Ids must be unique.
    """
    if max_rows <= 0:
        return df
    rows = df.select(F.lit(0).alias("_all"), F.col(id_col).alias("_id"))
    last = select_ranks(rows, ["_all"], ["_id"], numeric_key("_id"), {"cap": lambda n: F.least(F.lit(max_rows), n)})
    return df.where(F.col(id_col) <= last[0].value[0]) if last else df


def cleaning_report(before: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows before, rows with every value present, rows dropped: one aggregation."""
    complete = reduce(Column.__and__, [quoted(c).isNotNull() for c in [*features, target]])
    return before.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        F.count_if(~complete).alias("rows_dropped"),
    )


def clean_with_report(before: DataFrame, features: Sequence[str], target: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows with every value present, landed at ``path``, and the report on them, counted by the same scan."""
    complete = reduce(Column.__and__, [quoted(c).isNotNull() for c in [*features, target]])
    seen = Observation("cleaning")
    counts = [F.count(F.lit(1)).alias("rows_before"), F.count_if(complete).alias("rows_after")]
    table = land(before.observe(seen, *counts).where(complete), path)
    n, kept = seen.get["rows_before"], seen.get["rows_after"]
    report = before.sparkSession.createDataFrame([(n, kept, n - kept)], "rows_before bigint, rows_after bigint, rows_dropped bigint")
    return table, report
