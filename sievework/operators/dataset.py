"""Splits without leaks, their statistics, budgets of nodes and losses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.cluster import WIDTH, last_before, lookup, ranked, settle


def share_split(rank: Column, n: Column) -> Column:
    """train, val or test of the rank-th (from 1) of n by 70, 15 and 15 %, whole numbers down, the rest to test."""
    train, val = F.floor(n * 0.7), F.floor(n * 0.15)
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def campaign_split(items: DataFrame, seed: str = "42") -> DataFrame:
    """item_id, label, campaign and split; items of one campaign are in one split.

    Malicious items are split by campaign, the others one by one, both in the order of an MD5 of their name and the
    seed. Ranks come from bucket counts and a window inside a bucket, so no task sorts all groups.
    """
    unit = F.when(F.col("label") == 1, F.concat(F.lit("c:"), "campaign")).otherwise(F.concat(F.lit("i:"), F.col("item_id").cast("string")))
    rows = items.select("item_id", "label", "campaign", unit.alias("unit"))
    key = F.md5(F.concat("unit", F.lit(":" + seed)).cast("binary"))
    units = rows.select("label", "unit").distinct().withColumn("key", key).withColumn("bucket", F.substring("key", 1, 2))
    sizes = units.groupBy("label", "bucket").agg(F.count("*").alias("m"))
    by_label = W.partitionBy("label")
    sizes = sizes.select("label", "bucket", F.sum("m").over(by_label).alias("n"), (F.sum("m").over(by_label.orderBy("bucket")) - F.col("m")).alias("skip"))
    inside = F.row_number().over(W.partitionBy("label", "bucket").orderBy("key"))
    ranked = units.withColumn("r", inside).join(F.broadcast(sizes), ["label", "bucket"])  # 256 buckets for each label
    split = ranked.select("unit", share_split(F.col("skip") + F.col("r"), F.col("n")).alias("split"))
    return rows.join(split, "unit").select("item_id", "label", "campaign", "split")


def split_stats(splits: DataFrame) -> DataFrame:
    mal, ben = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    counted = splits.groupBy("split").agg(F.count("*").alias("n"), mal.alias("malicious"), ben.alias("benign"))
    ratio = F.greatest("malicious", "benign") / F.greatest(F.least("malicious", "benign"), F.lit(1))
    return counted.select("*", F.round(ratio, 6).alias("ratio"), (ratio > 3).alias("imbalanced"))


def split_shape(splits: DataFrame, graphs: DataFrame) -> DataFrame:
    """split, n and the mean nodes and edges of its graphs (item_id, nodes, edges)."""
    both = splits.select("item_id", "split").join(graphs.select("item_id", "nodes", "edges"), "item_id")
    return both.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("nodes"), 6).alias("nodes"), F.round(F.avg("edges"), 6).alias("edges"))


def failure_taxonomy(failed: DataFrame) -> DataFrame:
    """error_class, step and n of failed builds (error_message, frames), most frequent first by n."""
    rows = failed.select(T.build_error(F.col("error_message")).alias("error_class"), T.failed_step(F.col("frames")).alias("step"))
    return rows.groupBy("error_class", "step").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_class", "step")


def leaks(splits: DataFrame) -> DataFrame:
    """Campaigns of malicious items in more than one split."""
    return splits.where("label = 1").groupBy("campaign").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def graph_filter(graphs: DataFrame, least: int = 2, most: int = 50_000) -> DataFrame:
    """n, kept and a fingerprint of the kept graphs (graph_id, nodes, label) that does not depend on their order."""
    kept = F.col("nodes").between(least, most)
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", "graph_id", "nodes", "label").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return graphs.agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, mark)), F.lit(0)).cast("string").alias("fingerprint"))


def split_summary(graphs: DataFrame, least: int = 2, most: int = 50_000) -> DataFrame:
    """A row for each split of graph files (split, graph_id, name, size, mtime, nodes, label): raw_files, total (kept), skipped, malicious, benign, avg_nodes, max_nodes and fingerprint.

    A file is kept with `least` to `most` nodes. The fingerprint is a SHA-256 of kept files in the order of graph_id: their name, size, time, nodes and label
    are joined for each WIDTH files in a row and hashed, and those hashes in order are hashed again, so no task reads a whole split. A null counts as an
    empty text. Without a kept file it is that of an empty text, avg_nodes and max_nodes are 0.
    """
    kept = F.coalesce(F.col("nodes").between(least, most), F.lit(False))
    n = F.when(kept, F.col("nodes"))
    counts = graphs.groupBy("split").agg(
        F.count("*").alias("raw_files"), F.count_if(kept).alias("total"), F.count_if(~kept).alias("skipped"), F.count_if(kept & (F.col("label") == 1)).alias("malicious"),
        F.coalesce(F.round(F.avg(n), 6), F.lit(0.0)).alias("avg_nodes"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_nodes"),
    )
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "size", "mtime", "nodes", "label")])
    rows = ranked(graphs.where(kept).select("split", "graph_id", said.alias("said")), ["split"], ["graph_id", "said"], "i")
    digest = lambda parts: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda x: x["said"]), "\n").cast("binary"), 256)
    blocks = rows.groupBy("split", F.floor(F.col("i") / WIDTH).alias("block")).agg(digest(F.struct("i", "said")).alias("said"))
    marks = blocks.groupBy("split").agg(digest(F.struct("block", "said")).alias("mark"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return counts.join(marks, "split", "left").select("*", (F.col("total") - F.col("malicious")).alias("benign"), F.coalesce("mark", none).alias("fingerprint")).drop("mark")


def budget_batches(graphs: DataFrame, budget: int = 30_000) -> DataFrame:
    """graph_id, nodes and batch: graphs in order of graph_id fill a batch until the next would exceed the budget; one above it is alone.

    This is the sequential packing, without a sequential pass over all. From the running sums each graph looks up where the batch that began with
    it would end (a search among sums, spread over many tasks). These pointers are followed to the end of each block of WIDTH graphs, block by block
    at once; from block to block they are doubled, so the starts that the first graph leads to are known in few rounds. nodes are 0 or more, null
    counts as 0; graphs with equal ids go by nodes.
    """
    rows = settle(ranked(graphs.select("graph_id", "nodes"), [], ["graph_id", "nodes"], "i", "nodes"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.max("i_sum"), F.lit(0))).first()
    size = F.coalesce("nodes", F.lit(0))
    sums = rows.select("i", (-F.col("i_sum")).alias("at"), F.lit(1).alias("kind"), (-F.col("i")).alias("tie"))
    limits = rows.select("i", (size - F.col("i_sum") - budget).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"))
    met = last_before(sums.unionByName(limits), [], "at", ["kind", "tie"], F.when(F.col("kind") == 1, F.col("i")), "over", max(1, total * WIDTH // max(n, 1)))
    jump = F.greatest("over", F.col("i") + 1)
    block = F.floor(F.col("i") / WIDTH).alias("block")
    jumps = settle(met.where("kind = 0").select("i", F.when(F.col("over").isNotNull() & (jump < n), jump).otherwise(-1).cast("long").alias("jump"), block))
    leaps = settle(jumps.groupBy("block").applyInPandas(block_exits, "i long, jump long, hops long").where("jump >= 0"))
    entries = rows.where("i = 0").select("i", F.lit(0).cast("long").alias("batch"))
    while True:
        more = settle(entries.join(leaps, "i").select(F.col("jump").alias("i"), (F.col("batch") + F.col("hops")).alias("batch")))
        if more.isEmpty():
            break
        entries = settle(entries.unionByName(more))
        farther = leaps.select(F.col("i").alias("jump"), F.col("jump").alias("next"), F.col("hops").alias("then"))
        leaps = settle(lookup(leaps, farther, ["jump"], n).select("i", F.col("next").alias("jump"), (F.col("hops") + F.col("then")).alias("hops")))
    starts = jumps.join(entries, "i", "left").groupBy("block").applyInPandas(block_starts, "i long, batch long")
    known = last_before(rows.join(starts, "i", "left"), [], "i", [], F.col("batch"), "before")
    return known.select("graph_id", "nodes", F.coalesce("batch", "before").alias("batch"))


def block_exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each row of a block the first place outside that its pointers lead to (-1: none), and after how many hops."""
    rows = rows.sort_values("i")
    i, jump = rows["i"].to_numpy(), rows["jump"].to_numpy().copy()
    hops = np.ones(len(i), dtype=np.int64)
    for k in range(len(i) - 1, -1, -1):
        if 0 <= jump[k] <= i[-1]:
            there = jump[k] - i[0]
            jump[k], hops[k] = jump[there], hops[there] + 1
    return pd.DataFrame({"i": i, "jump": jump, "hops": hops})


def block_starts(rows: pd.DataFrame) -> pd.DataFrame:
    """The starts of batches in a block: those that the pointers lead to from its entry, the one row that knows its batch."""
    rows = rows.sort_values("i")
    i, jump, known = rows["i"].to_numpy(), rows["jump"].to_numpy(), np.flatnonzero(rows["batch"].notna())
    found = []
    if len(known):
        at, batch = int(i[known[0]]), int(rows["batch"].iloc[known[0]])
        while 0 <= at <= i[-1]:
            found.append((at, batch))
            at, batch = int(jump[at - i[0]]), batch + 1
    return pd.DataFrame(found, columns=["i", "batch"], dtype="int64")


def focal_loss(rows: DataFrame, gamma: float = 2.0, smoothing: float = 0.05) -> DataFrame:
    """Mean focal loss of probabilities p against labels y, with smoothed labels and the positives' weight n0 / n1."""
    counts = rows.agg(F.sum(F.lit(1) - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    t = F.col("y") * (1 - smoothing) + smoothing / 2
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    bce = -(t * F.log(p) * F.col("n0") / F.greatest("n1", F.lit(1)) + (1 - t) * F.log(1 - p))
    pt = F.when(F.col("y") == 1, p).otherwise(1 - p)
    return rows.crossJoin(F.broadcast(counts)).agg(F.round(F.avg(F.pow(1 - pt, F.lit(gamma)) * bce), 6).alias("loss"), F.round(F.first(F.col("n0") / F.greatest("n1", F.lit(1))), 6).alias("pos_weight"))  # counts is one row
