"""What jobs of several rounds share: cut lineage, lookups with hot keys, and windows, ranks and searches that no single task carries."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that hold more than one in so many rows are broadcast with what belongs to them; there are fewer than that many.
HOT_SHARE, HOT_LEAST = 400, 1000
#: Positions of one value of position // WIDTH are ordered together.
WIDTH = 1 << 16


def settle(df: DataFrame) -> DataFrame:
    """The same rows and partitions with the lineage cut, in the folder of spark.checkpoint.dir; a local session without it gets a folder of its own."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """A settled table without Spark's guess of its size, which outlives checkpoints.

    A join's is the product of its sides', so in rounds of joins the guess's digits double each time, and soon the driver multiplies them for minutes.
    """
    spark = df.sparkSession
    return type(df)(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Inner join of about n rows to the one row of table that has their key.

    Rows of hot keys stay where they are and meet a broadcast of at most HOT_SHARE rows of table; all others are shuffled.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("m")).where(F.col("m") > max(n // HOT_SHARE, HOT_LEAST)).select(*keys)
    names = hot.collect()  # fewer than HOT_SHARE
    if not names:
        return rows.join(table, keys)
    hot = rows.sparkSession.createDataFrame(names, hot.schema)
    known = table.join(F.broadcast(hot), keys)
    return rows.join(F.broadcast(known), keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))


def last_before(rows: DataFrame, keys: list[str], at: str, ties: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the last value that isn't null among the rows before each, in the order of `at` (a long) and ties, for equal keys.

    Windows run inside buckets of `width` positions; what comes from earlier buckets is one row for each bucket. So a key's rows are spread
    over many tasks. A row's own value doesn't count.
    """
    cut = rows.select("*", F.floor(F.col(at) / width).cast("long").alias("_bucket"), value.alias("_value"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(at, *ties).rowsBetween(W.unboundedPreceding, -1)
    tails = cut.where("_value is not null").groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct(at, *ties)).alias("_tail"))
    every = cut.select(*keys, "_bucket").distinct().join(tails, [*keys, "_bucket"], "left")
    carried = every.withColumn("_carried", F.last("_tail", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_tail")
    met = cut.withColumn("_mine", F.last("_value", ignorenulls=True).over(inside)).join(carried, [*keys, "_bucket"])
    return met.select(*rows.columns, F.coalesce("_mine", "_carried").alias(name))


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank", summed: str | None = None) -> DataFrame:
    """rows with their gapless place from 0 among equal keys, in the given order; and `{name}_sum`, the running sum of a column up to the row.

    Rows are sorted over all partitions by range, so one key may fill any number of them; a place is the number of the key's rows in
    earlier partitions, from one count for each key and partition, plus the place inside. Rows with equal order share
    a partition and are numbered in any order.
    """
    placed = settle(rows.repartitionByRange(*keys, *order).select("*", F.spark_partition_id().alias("_part")))
    size = F.coalesce(F.col(summed), F.lit(0)).cast("long") if summed else F.lit(0)
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_m"), F.sum(size).alias("_s"))
    ahead = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    skips = counts.select(*keys, "_part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_skip") for c in ("_m", "_s")])
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    rows_to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    both = placed.withColumns({"_n": F.row_number().over(inside), "_sum": F.sum(size).over(rows_to_here)}).join(skips, [*keys, "_part"])
    sums = [(F.col("_sum") + F.col("_s_skip")).alias(f"{name}_sum")] if summed else []
    return both.select(*rows.columns, (F.col("_n") - 1 + F.col("_m_skip")).alias(name), *sums)
