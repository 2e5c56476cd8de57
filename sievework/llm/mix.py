"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import broadcast_if, settle

WORD = r"[^\x20\x09-\x0D]+"
TRIALS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, trial: Column) -> Column:
    """A number in [0, 1) from the id's MD5, eight hex digits for each trial."""
    digits = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.shiftright(trial, 2).cast("string")).cast("binary"))
    return F.conv(F.substr(digits, trial % 4 * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(sized: DataFrame, most: int = 3, trials: int = TRIALS) -> DataFrame:
    """One row for each source: source, source_size, target, rate and trial, from doc_id, source and size.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Their targets share the total size by weight, but
    none is above `most` times its source's size: with caps sorted by cap over weight, a source is capped exactly if
    its cap is no more than its share of what the sources before it leave, which is where resharing the excess ends.
    rate is target over size. Of `trials` independent draws the one whose total is nearest the target is kept, the
    lowest of equals. With it a document's chance of its last copy is not exactly the fraction: draws whose total is far
    off are not used, so the copies of one source's documents depend on one another a little, the more the fewer they are.
    Each of the draws has exactly that chance.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy()
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    ordered = sizes.select("*", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    up = every.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    filled = ordered.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)).alias("after_w"),
    ).withColumn("capped", F.col("cap") * F.col("after_w") <= (F.col("total") - F.col("before")) * F.col("w"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left.cast("double") * F.col("w") / free)
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    goals = settle(filled.select("source", "source_size", target.alias("target")).withColumn("rate", rate))

    tried = sized.join(broadcast_if(goals), sized["source"].eqNullSafe(goals["source"])).select(sized["source"], "doc_id", "size", "target", "rate")
    sums = [F.sum(F.col("size") * copies(F.col("doc_id"), F.col("rate"), F.lit(k))).alias(f"t{k}") for k in range(trials)]
    tried = tried.groupBy("source").agg(F.first("target").alias("target"), *sums)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("trial")) for k in range(trials)]))
    tried = tried.select(F.col("source").alias("s"), best["trial"].alias("trial"))
    return goals.join(tried, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def copies(doc_id: Column, rate: Column, trial: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(draw(doc_id, trial) < rate - whole, 1).otherwise(0)


def plan_mix(docs: DataFrame, trials: int = TRIALS) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): doc_id, source, size and copies of every row, and the rate of every source.

    Reads doc_id, source and text once, whole texts; only their sizes are kept. Rows with equal doc_id, null among them,
    draw alike. A null text has no words, a null source is a source of its own, a source without words is not taken; no
    rows give no rows.
    """
    sized = settle(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    return sized, settle(rates(sized, trials=trials))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (doc_id, source and others) with copies, source_size and target.

    The plan has a row for each source. It is counted, and broadcast unless there are very many sources, so that texts
    don't move to their source.
    """
    p = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "rate", "trial")
    joined = rows.join(broadcast_if(p), rows["source"].eqNullSafe(p["plan_source"]))
    return joined.withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("trial"))).drop("plan_source", "rate", "trial")


def mix(docs: DataFrame) -> DataFrame:
    """Every row of docs as often as its source's rate says; columns as in docs.

    floor(rate) copies, and one more where the id's draw is below the rate's fraction. Nulls, ties and repeated rows as in
    plan_mix(); empty texts are copied like any others, long ones are counted whole; no rows give no rows.
    """
    _, plan = plan_mix(docs)
    mixed = with_copies(docs.select("doc_id", "source", F.struct(*docs.columns).alias("row")), plan)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs; nulls and the rest as in plan_mix()."""
    sized, plan = plan_mix(docs)
    return with_copies(sized, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
