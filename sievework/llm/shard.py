"""Contiguous shards of near-equal size by global prefix sums, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import settle

#: How far, as a part of its size, a group of equal texts may push a shard off balance by staying whole.
TOLERANCE = 1 / 50
CELL_ROWS = 100_000
LEAST_CELLS = 64


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs.

    Reads doc_id and text; the text is left behind after one scan. The global order is that of a hash of the text, then
    doc_id, so equal texts are neighbours. That order is dealt into cells (ranges of the hash, uniform), one prefix sum
    over the cells' totals gives each cell its first byte and row, and a window within the cell does the rest. The
    shard is that of a group's middle byte, so a group adds at most half its size to what a shard should have. A group of
    equal texts stays in one shard unless it is larger than the tolerance; only groups that the balance can't bear are
    cut, row by row, in cells of their own, so that no task gets a large group whole. There are at most shards /
    tolerance of them. No shard is off its equal share by more than the tolerance and one document.

    size is the text's UTF-8 bytes plus 1. A null text has size 1 and the empty text's checksum, and is of its group.
    Rows with equal doc_id and text are interchangeable; a null doc_id comes first among equal texts. A text is read
    whole and left behind; one that is larger than a shard has that shard for itself. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settle(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells = max(LEAST_CELLS, math.ceil(n / cell_rows))
    groups = rows.groupBy("th").agg(F.sum("size").alias("gb"), F.count("*").alias("gn"))
    large = groups.where((F.col("gn") > 1) & (F.col("gb") > tolerance * total / shards)).select("th", F.ceil(F.col("gn") / cell_rows).alias("subs"))
    rows = rows.join(F.broadcast(large), "th", "left").select(
        "*",
        F.floor((F.col("th").cast("double") / 2.0**64 + 0.5) * cells).alias("cell"),
        F.when(F.col("subs").isNotNull(), F.col("th")).alias("own"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("subs")), F.lit(0)).alias("sub"),
    )
    key = ["cell", "own", "sub"]
    in_order = W.partitionBy().orderBy("cell", F.col("own").asc_nulls_first(), "sub").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.sum("size").alias("cb"), F.count("*").alias("cn"))
    starts = starts.select(
        *[F.col(k).alias(f"s_{k}") for k in key],
        F.coalesce(F.sum("cb").over(in_order), F.lit(0)).alias("from_byte"),
        F.coalesce(F.sum("cn").over(in_order), F.lit(0)).alias("from_row"),
    )
    rows = rows.join(starts, (F.col("cell") == F.col("s_cell")) & F.col("own").eqNullSafe(F.col("s_own")) & (F.col("sub") == F.col("s_sub")))
    cell = W.partitionBy(*key)
    by_row = cell.orderBy("th", "doc_id")
    upto_row = F.sum("size").over(by_row.rowsBetween(W.unboundedPreceding, 0))
    upto_group = F.sum("size").over(cell.orderBy("th").rangeBetween(W.unboundedPreceding, 0))
    group = F.sum("size").over(W.partitionBy(*key, "th"))
    twice_middle = 2 * F.col("from_byte") + F.when(F.col("own").isNull(), 2 * upto_group - group).otherwise(2 * upto_row - F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(twice_middle * shards / F.lit(2 * max(total, 1)))).cast("int")
    rows = settle(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("from_row") + F.row_number().over(by_row)).alias("rank")))
    first = rows.groupBy(F.col("shard").alias("s")).agg(F.min("rank").alias("first"))
    return rows.join(F.broadcast(first), F.col("shard") == F.col("s")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
