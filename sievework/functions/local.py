"""Small fixed tables, made in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The rows as literals of one expression; unlike createDataFrame this starts no Python workers."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    each = [F.struct(*[F.lit(x).cast(k).alias(n) for x, n, k in zip(r, names, kinds)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*each)).alias("r")).select("r.*")
