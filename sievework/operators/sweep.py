"""Policy and threshold sweeps.

A policy blocks where the score reaches one threshold, or the score and a rule score reach two. So records are counted
by the places of their values among the grid's thresholds, these counts are summed up to cumulative ones (some thousand
numbers, whatever the number of records), and each policy is a sum of seven of them by inclusion and exclusion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.operators.catalog import SWEEP
from sievework.operators.decide import replay_verdict
from sievework.operators.evaluate import rates


def grid(spark, axes: dict[str, list[float]] = SWEEP) -> DataFrame:
    """Every combination of the axes with a config_id from 0, the last axis fastest; the fixed axes give 33,264 rows."""
    arrays = reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), axes.items(), spark.range(1))
    at = F.lit(0)
    for k, v in axes.items():
        at = at * len(v) + F.array_position(F.array(*map(F.lit, v)), F.col(k)) - 1
    return arrays.select(at.cast("int").alias("config_id"), *axes)


def place(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value >= c))


def cumulative(records: DataFrame, scores: list[float], weights: list[float], hards: list[float]) -> DataFrame:
    """x, y, z, pos, neg: malicious and other records that reach at least the x-th score, y-th weight and z-th hard score.

    Place 0 of the rule scores asks for nothing; every record counts at all places up to its own.
    """
    at = [place(F.col("gnn_score"), scores).alias("x"), place(F.col("weighted"), weights).alias("y"), place(F.col("hard_score"), hards).alias("z")]
    cells = records.select(*at, "true_label").groupBy("x", "y", "z").agg(F.count_if(F.col("true_label") == 1).alias("pos"), F.count_if(F.col("true_label") == 0).alias("neg"))
    upto = cells.where("x > 0")
    for k, first in (("x", 1), ("y", 0), ("z", 0)):
        upto = upto.withColumn(k, F.explode(F.sequence(F.lit(first), F.col(k))))
    return upto.groupBy("x", "y", "z").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sweep(records: DataFrame, axes: dict[str, list[float]] = SWEEP) -> DataFrame:
    """config_id, the axes and the metrics of each policy over records (gnn_score, weighted, hard_score, true_label)."""
    scores = sorted({*axes["direct"], *axes["confirm"], *axes["hard_min_gnn"]})
    configs = grid(records.sparkSession, axes).select("config_id", *[F.col(k).alias(f"{k}_from") for k in axes])
    d, c, m = (place(F.col(f"{k}_from"), scores) for k in ("direct", "confirm", "hard_min_gnn"))
    w, h = place(F.col("weighted_from"), sorted(axes["weighted"])), place(F.col("hard_from"), sorted(axes["hard"]))
    none = F.lit(0)
    parts = [(d, none, none, 1), (c, w, none, 1), (m, none, h, 1), (F.greatest(d, c), w, none, -1), (F.greatest(d, m), none, h, -1), (F.greatest(c, m), w, h, -1), (F.greatest(d, c, m), w, h, 1)]
    each = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.lit(sign).alias("sign")) for x, y, z, sign in parts])).alias("p")
    counts = F.broadcast(cumulative(records, scores, sorted(axes["weighted"]), sorted(axes["hard"])))  # no more rows than the grid has places
    keys = ["config_id", *[f"{k}_from" for k in axes]]
    met = configs.select(*keys, each).select(*keys, "p.*").join(counts, ["x", "y", "z"], "left")
    reached = lambda n: F.coalesce(F.sum(F.col("sign") * F.col(n)), F.lit(0)).cast("long")
    blocked = met.groupBy(*keys).agg(reached("pos").alias("tp"), reached("neg").alias("fp"))
    total = records.agg(F.count_if(F.col("true_label") == 1).alias("all_pos"), F.count_if(F.col("true_label") == 0).alias("all_neg"))
    every = blocked.crossJoin(F.broadcast(total))  # one row
    return rates(every.select(*keys, "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn")))


def best(swept: DataFrame, goal: str, floors: list[float], order: list[Column], k: int = 10) -> DataFrame:
    """The k best configurations for each floor that `goal` must reach."""
    fit = swept.withColumn("floor", F.explode(F.filter(F.array(*map(F.lit, floors)), lambda f: F.col(goal) >= f)))
    place = F.row_number().over(W.partitionBy("floor").orderBy(*order, "config_id"))
    return fit.withColumn("place", place).where(F.col("place") <= k)


def best_recall(swept: DataFrame, floors: list[float] = (0.96, 0.97, 0.98, 0.99)) -> DataFrame:
    return best(swept, "precision", list(floors), [F.desc("recall"), F.desc("f1"), F.desc("precision"), F.asc("fp")])


def best_precision(swept: DataFrame, floors: list[float] = (0.88, 0.89, 0.90, 0.92)) -> DataFrame:
    return best(swept, "recall", list(floors), [F.desc("precision"), F.desc("f1"), F.asc("fp")])


def best_f1(swept: DataFrame, k: int = 10) -> DataFrame:
    return swept.orderBy(F.desc("f1"), F.desc("precision"), "config_id").limit(k)


def reachable(swept: DataFrame, goals: list[tuple[float, float]] = ((0.96, 0.88), (0.97, 0.88), (0.98, 0.88), (0.99, 0.88))) -> DataFrame:
    """Whether some policy reaches each pair of precision and recall."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in goals]))
    got = swept.select("precision", "recall", pairs.alias("g"))
    return got.groupBy(F.col("g.p").alias("min_precision"), F.col("g.r").alias("min_recall")).agg(F.bool_or((F.col("precision") >= F.col("g.p")) & (F.col("recall") >= F.col("g.r"))).alias("reached"))


def threshold_sweep(records: DataFrame, first: int = 30, last: int = 95, step: int = 5, scale: float = 100.0) -> DataFrame:
    """Metrics at each threshold first/scale, ...; records without a score are never positive."""
    counts = records.groupBy("gnn_score", "true_label").agg(F.count("*").alias("n"))
    t = F.col("k") / scale
    met = counts.select("*", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("k"))
    guess = ((F.col("gnn_score") >= 0) & (F.col("gnn_score") >= t)).cast("int")
    cell = lambda y, g: F.coalesce(F.sum(F.when((F.col("true_label") == y) & (guess == g), F.col("n"))), F.lit(0)).cast("long")
    counted = met.groupBy(t.alias("threshold")).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    return rates(counted)


def best_threshold(swept: DataFrame, min_precision: float = 0.0) -> DataFrame:
    """The threshold with the best recall (then F1) among those precise enough; 0.5 if there is none."""
    found = swept.where(F.col("precision") >= min_precision).agg(F.max_by("threshold", F.struct("recall", "f1", -F.col("threshold"))).alias("threshold"))
    return found.select(F.lit(min_precision).alias("min_precision"), F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def curve(records: DataFrame, cells: int = 1024) -> DataFrame:
    """Cumulative tp and fp at each distinct score, from high to low, over records with a score.

    Scores are dealt into cells; the cells' totals are summed up once, and a window inside each cell does the rest, so
    that no task gets all distinct scores.
    """
    rows = records.where("gnn_score >= 0").select("gnn_score", "true_label")
    by_score = rows.groupBy("gnn_score").agg(F.sum("true_label").alias("p"), F.count_if(F.col("true_label") == 0).alias("q"))
    by_score = by_score.withColumn("cell", F.least(F.floor(F.col("gnn_score") * cells), F.lit(cells)))
    above = W.partitionBy().orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)  # a row for each cell
    totals = by_score.groupBy("cell").agg(F.sum("p").alias("cp"), F.sum("q").alias("cq"))
    zero = F.lit(0)
    totals = totals.select("cell", F.coalesce(F.sum("cp").over(above), zero).alias("up"), F.coalesce(F.sum("cq").over(above), zero).alias("uq"))
    down = W.partitionBy("cell").orderBy(F.desc("gnn_score")).rowsBetween(W.unboundedPreceding, 0)
    tp, fp = F.col("up") + F.sum("p").over(down), F.col("uq") + F.sum("q").over(down)
    return by_score.join(F.broadcast(totals), "cell").select("gnn_score", "p", "q", tp.alias("tp"), fp.alias("fp"))


def ranking_metrics(records: DataFrame) -> DataFrame:
    """One row: roc_auc, average_precision, false positive rate at 95 % recall, recall where false positives reach 1 %, recall
    at 99 and 99.9 % precision, and the score of the last (1 if no score is that precise)."""
    total = records.where("gnn_score >= 0").agg(F.sum("true_label").alias("np"), F.count_if(F.col("true_label") == 0).alias("nq"))
    c = curve(records).crossJoin(F.broadcast(total))  # one row
    recall, precision, wrong = F.col("tp") / F.col("np"), F.col("tp") / (F.col("tp") + F.col("fp")), F.col("fp") / F.col("nq")
    best = lambda at, x: F.round(F.coalesce(F.max(F.when(at, x)), F.lit(0.0)), 6)
    area = F.col("q") * (F.col("tp") - F.col("p") + F.col("p") / 2)
    found = c.agg(
        F.round(F.sum(area) / F.first(F.col("np") * F.col("nq")), 6).alias("roc_auc"),
        F.round(F.sum(F.col("p") / F.col("np") * precision), 6).alias("average_precision"),
        F.round(F.coalesce(F.min(F.when(recall >= 0.95, wrong)), F.lit(1.0)), 6).alias("fpr_at_95r"),
        F.round(F.coalesce(recall_at_rate(0.01), F.lit(1.0)), 6).alias("recall_at_1fpr"),
        best(precision >= 0.99, recall).alias("recall_at_99p"),
        best(precision >= 0.999, recall).alias("recall_at_999p"),
        F.coalesce(F.min(F.when(precision >= 0.999, F.col("gnn_score"))), F.lit(1.0)).alias("threshold_at_999p"),
    )
    return found.fillna(0.0)


def recall_at_rate(rate: float) -> Column:
    """Of a curve: the recall at the first score, from high to low, where false positives reach this rate."""
    return F.min(F.when(F.col("fp") / F.col("nq") >= rate, F.col("tp") / F.col("np")))


#: Strategy: what is ranked, what must reach which floor, and whether the grid is the fine one.
STRATEGIES = {"f1": ("f1", "f1", 0.0, False), "recall95": ("precision", "recall", 0.95, False), "precision99": ("recall", "precision", 0.99, True), "precision999": ("recall", "precision", 0.999, True)}


def find_thresholds(records: DataFrame) -> DataFrame:
    """strategy and threshold for all strategies: the best on a grid of hundredths below 0.95, or thousandths below 1, among
    those that reach the floor; the lowest of equals, 0.5 if there is none."""
    coarse, fine = threshold_sweep(records, 10, 94, 1), threshold_sweep(records, 100, 999, 1, 1000.0)
    every = coarse.withColumn("fine", F.lit(False)).unionByName(fine.withColumn("fine", F.lit(True)))
    best = [
        F.coalesce(F.max_by("threshold", F.when((F.col("fine") == grid) & (F.col(floor) >= least), F.struct(F.col(rank), -F.col("threshold")))), F.lit(0.5)).alias(name)
        for name, (rank, floor, least, grid) in STRATEGIES.items()
    ]
    found = every.agg(*best)
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("threshold")) for n in STRATEGIES])).alias("s")).select("s.*")


def best_config(swept: DataFrame, precision: float) -> DataFrame:
    """The first configuration of best_recall() for one precision; an error if none reaches it."""
    found = best_recall(swept, [precision]).where("place = 1")
    if found.isEmpty():
        raise ValueError(f"no policy reaches a precision of {precision}")
    return found


def compact(records: DataFrame, policy: dict[str, float], k: int = 25) -> DataFrame:
    """kind, place, package_name and gnn_score of a policy's first k false positives and negatives by name."""
    t = {n: F.lit(v) for n, v in policy.items()} | {"clean": F.lit(0.35)}
    said = replay_verdict(F.col("gnn_score"), F.col("weighted"), F.col("hard_score"), t) == "malicious"
    kind = F.when((F.col("true_label") == 0) & said, "fp").when((F.col("true_label") == 1) & ~said, "fn")
    wrong = records.select(kind.alias("kind"), "package_name", "gnn_score").where("kind is not null")
    return wrong.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy("package_name"))).where(F.col("place") <= k)
