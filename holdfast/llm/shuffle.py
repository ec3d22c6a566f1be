"""Two-pass external shuffle of a table into even shards, by DataFrame operations alone.

Pass one scatters the records into memory-sized buckets by a seeded hash. Pass
two permutes each bucket on its own (Spark's ``shuffle`` is a Fisher-Yates) and
writes it. What is permuted are the places of the sorted records: the records
themselves stream through Spark's sort, and no bucket is ever one value in memory.
Buckets in order, each in its permuted order, are one uniform
permutation of the table; shard s holds its positions from ceil(s * n / shards)
on, so shards' row counts differ by one at most and nothing is sorted by shard.

Records equal in all columns would share a bucket. Where there are more than
``COPIES`` with one id and text, equal ones are counted and each copy gets a number
that goes into its hash, so they spread over the buckets like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from holdfast.session import drop, land, scratch_path

SHARDS = 24
BUCKET_BYTES = 8 << 20
COPIES = 1024  # records of one id and text that may share a bucket
_GROUP = 1024  # buckets summed together before their sums are added up


def _before(counts: DataFrame) -> DataFrame:
    """(bucket, before): rows in all earlier buckets, in two levels of running sums."""
    group = F.expr(f"bucket div {_GROUP}")
    counts = counts.withColumn("part", group)
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("run", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return running.join(parts, "part").select("bucket", (F.col("base") + F.col("run")).alias("before"))


def _numbered(keyed: DataFrame, path: str, seed: int) -> DataFrame:
    """``keyed`` with copies beyond number told apart; as it is where there are none."""
    many = keyed.groupBy(F.col("record.h").alias("many")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COPIES).select("many")
    many = land(many, path)
    if many.isEmpty():
        return keyed
    same = F.col("record.h") == F.col("many")
    counted = keyed.join(many, same, "left_semi").groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    # in two steps, so that no task writes out a large group alone
    runs = counted.select("record", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("low"))
    runs = runs.repartition(F.col("record.h"), "low")
    copies = runs.select("record", F.explode(F.sequence("low", F.least(F.col("low") + COPIES, "n") - 1)).alias("copy"))
    told = copies.select(F.struct(F.xxhash64(F.lit(seed), "record.h", "copy").alias("h"), F.col("record.row").alias("row")).alias("record"))
    return keyed.join(many, same, "left_anti").union(told)


def shuffle_to_shards(
    docs: DataFrame, folder: str, *, shards: int = SHARDS, seed: int = 11, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Write all rows of ``docs`` (doc_id, text, ...) to ``folder``, by shard; returns them.

    Added columns: shard, slot (place in the shard, without gaps from 0), in place
    of columns of these names. The place of a record depends on the seed, its
    bucket's contents and nothing else; rows equal in all columns take each
    other's places. Null texts and ids are kept as they are. More shards than rows
    leave the last ones empty; an empty table writes none. Columns must be
    comparable where more than ``COPIES`` rows have one id and text.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    total = docs.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    buckets = int(total // bucket_bytes) + 1
    keyed = docs.select(
        F.struct(F.xxhash64(F.lit(seed), "doc_id", text).alias("h"), F.struct("*").alias("row")).alias("record")
    )
    path, copies_path = scratch_path(spark, "buckets"), scratch_path(spark, "copies")
    keyed = _numbered(keyed, copies_path, seed).withColumn("bucket", F.pmod("record.h", F.lit(buckets)))
    counts = land(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), path)
    rows = counts.agg(F.sum("n")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("record"))
    ranked = keyed.repartition(buckets, "bucket").withColumn("rank", rank)
    # the generator of ``shuffle`` starts anew in each partition: with a fixed number of
    # partitions, and buckets in order, a bucket is always permuted alike
    drawn = counts.join(_before(counts), "bucket").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    drawn = drawn.withColumn("drawn", F.shuffle(F.sequence(F.lit(1).cast("long"), "n"), seed))
    places = F.sort_array(F.transform("drawn", lambda rank, place: F.struct(rank.alias("rank"), place.alias("place"))))
    drawn = drawn.select("bucket", "before", places["place"].alias("places"))  # by rank
    # by merging, since both sides lie by bucket already
    permuted = ranked.join(drawn.hint("merge"), "bucket").select("before", F.element_at("places", F.col("rank")).alias("place"), "record")
    position = F.col("before") + F.col("place")
    shard = F.expr(f"CAST((_position * {shards}L) div {max(rows, 1)}L AS INT)")
    first = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    placed = (
        permuted.select(position.alias("_position"), "record.row.*")
        .withColumn("shard", shard)
        .withColumn("slot", F.col("_position") - first)
        .drop("_position")
    )
    placed.write.partitionBy("shard").parquet(f"{folder}/shards")
    drop(spark, path, copies_path)
    return spark.read.schema(placed.schema).parquet(f"{folder}/shards")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = docs.select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = shuffle_to_shards(digest, scratch_path(spark, "shuffled"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
