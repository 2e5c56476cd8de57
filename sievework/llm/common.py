"""What several operators share: the checkpoint folder, table reads, text rules and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows (some 100 bytes each) up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine where that is missing and Spark runs in this process alone.

    On a cluster a missing setting is an error: executors would not see a folder of this machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint where a count shows that it has few narrow rows; else Spark shuffles it like any other."""
    return F.broadcast(small) if small.count() <= rows else small


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter stays."""
    return F.translate(text, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """Columns node and component (its smallest reachable node) for edges with long columns a and b.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which need a logarithmic number of
    rounds. Every round is two aggregations and two joins of narrow rows; nothing is collected but a count and a
    checksum. Nodes that are the smallest of their component have no row: callers fill those in with a left join.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    star = settle(edges.where("a <> b").select(high.alias("hi"), low.alias("lo")).distinct())
    before = None
    while True:
        mark = star.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return star.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = mark
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")
        )
        star = settle(small.select("e.hi", "e.lo").where("hi <> lo").distinct())


def in_groups(rows: DataFrame, key: str, block: int, compare: Callable[[dict[str, np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """compare() over whole groups of rows (node and others) with equal key.

    A group of more than about `block` rows is cut into blocks by a hash, and each pair of blocks is a group of its own,
    so no task gets a large group whole and no pair leaves its group. Only such large groups are counted out.
    """
    large = settle(rows.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") > block).select(F.col(key).alias("large"), F.ceil(F.col("m") / block).alias("blocks")))
    cut = rows.join(broadcast_if(large), F.col(key) == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cut = cut.select(*rows.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    by = [key, "i", "j"]
    cut = cut.repartition(*by).sortWithinPartitions(*by)

    def whole(held: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        return compare({"group": group} | {c: held[c].to_numpy() for c in held.columns})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            group = np.cumsum((held[by] != held[by].shift()).any(axis=1).to_numpy())
            last = int(np.searchsorted(group, group[-1])) if len(held) else 0
            if last:
                yield whole(held.iloc[:last], group[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield whole(held, np.cumsum((held[by] != held[by].shift()).any(axis=1).to_numpy()))

    return cut.mapInPandas(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table written once to the shared folder: nothing above it is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def turn_digest(role: Column, text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of role and text, told apart by the role's length: equal for equal turns only."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, 16)
