"""Stand-in sample table over the star-schema test tables: one sample per order.

The reference workflows ship no data. This view gives each order the columns of
a rock sample (TOC, pyrolysis, logs), with a real relation between toc and s2.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_ROLES = {"AC": "ac", "GR": "gr", "K": "k", "TH": "th", "U": "u", "RD": "rd", "RS": "rs", "TOC": "toc"}


def samples(spark: SparkSession, sf_dir: str, *, cache: bool = False) -> DataFrame:
    """``cache`` keeps it in memory and on disk for a caller that scans it often and
    releases it (``unpersist``); a lost block is recomputed from the tables."""
    # known schemas: no job to infer them, and scans read these columns only
    orders = spark.read.schema("o_orderkey bigint, o_totalprice double").parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.schema(
        "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    ).parquet(f"{sf_dir}/lineitem.parquet")
    # Aggregate the lines first: a single order may hold any share of them, and
    # partial sums keep such an order from reaching the join row by row.
    per_order = lines.groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice") / 50000, 6).alias("toc"),
        F.round(F.sum("l_quantity") / 10, 6).alias("s2"),
        F.round(F.avg("l_tax") * 100, 6).alias("s1"),
        F.round(F.avg("l_discount") * 100, 6).alias("s3"),
        (F.lit(425) + F.max("l_linenumber")).cast("double").alias("tmax"),
        (F.count(F.lit(1)) * 100).cast("double").alias("depth"),
        F.sum("l_quantity").alias("rd"),
        F.max("l_quantity").alias("rs"),
        F.round(F.avg("l_discount") * 10, 6).alias("k"),
        F.round(F.sum("l_tax") * 10, 6).alias("th"),
        F.round(F.min("l_quantity") / 10, 6).alias("u"),
        F.round(F.avg("l_quantity"), 6).alias("gr"),
    )
    df = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("sample_id"),
        *[c for c in per_order.columns if c != "l_orderkey"],
        F.round(F.col("o_totalprice") / 1000, 6).alias("ac"),
    )
    if cache and not df.storageLevel.useMemory:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df
