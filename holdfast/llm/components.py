"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import drop, land, scratch_path

SALTS = 8


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of the links (a, b); label: the smallest id reachable.

    Each round takes the smallest label among a node's neighbours, then follows
    labels of labels, so chains shrink by halves. Labels are landed each round
    with whether they changed.
    """
    spark = links.sparkSession
    ways_path, path = scratch_path(spark, "ways"), scratch_path(spark, "labels")
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("w"))
    ways = land(both.select("w.*").distinct(), ways_path)
    labels = land(ways.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("label"), F.lit(True).alias("changed")), path)
    while True:
        other = labels.select(F.col("id").alias("other"), F.col("label").alias("theirs"))
        least = ways.join(other, "other").groupBy("id").agg(F.min("theirs").alias("least"))
        # a label is itself a node: tell it of smaller labels its members have heard of
        heard = labels.join(least, "id").select("id", "label", "least")
        told = heard.groupBy(F.col("label").alias("id")).agg(F.min("least").alias("told"))
        near = heard.join(told, "id", "left")
        near = near.select("id", F.col("label").alias("old"), F.least("label", "least", F.coalesce("told", "label")).alias("near"))
        # a label may be shared by any part of the nodes: its look-up is spread over salts
        salted = near.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        far = near.filter("near < id").select(F.col("id").alias("near"), F.col("near").alias("far"))
        far = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        label = F.least("near", F.coalesce("far", "near"))
        after = salted.join(far, ["near", "salt"], "left").select("id", label.alias("label"), (label != F.col("old")).alias("changed"))
        next_path = scratch_path(spark, "labels")
        after = land(after, next_path)
        drop(spark, path)
        labels, path = after, next_path
        if after.filter("changed").isEmpty():
            drop(spark, ways_path)
            return labels.drop("changed")
