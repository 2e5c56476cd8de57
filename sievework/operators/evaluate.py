"""Evaluation over records: confusion, coverage, calibration, rule effects, errors, run comparison and diagnostics.

records has package_name, true_label (0/1), gnn_score (-1: none), rules_verdict, rules_score, hybrid_verdict,
decision_bucket, rules_matched (array), cpg_status, gnn_error_type and metadata_risk. Results are small aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.cluster import ranked
from sievework.functions.local import fixed_table
from sievework.functions.text import score_band
from sievework.operators.catalog import IDEAS, LIVE, NOISY, RELIABLE
from sievework.operators.decide import phase_label


def predicted(verdict: Column) -> Column:
    return (verdict == "malicious").cast("int")


def cells(label: Column, guess: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & (guess == 1)).alias("tp"),
        F.count_if((label == 0) & (guess == 1)).alias("fp"),
        F.count_if((label == 1) & (guess == 0)).alias("fn"),
        F.count_if((label == 0) & (guess == 0)).alias("tn"),
    ]


def rates(df: DataFrame, *more: str) -> DataFrame:
    """df with tp, fp, fn and tn, and precision, recall and f1 from them."""
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return df.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 6).alias("f1"))


def systems(records: DataFrame, *more: str) -> DataFrame:
    """A row for each record and system: gnn (score at least 0.5), rules, hybrid; with further columns of the record."""
    each = F.array(
        F.struct(F.lit("gnn").alias("system"), (F.col("gnn_score") >= 0.5).cast("int").alias("guess")),
        F.struct(F.lit("rules").alias("system"), predicted(F.col("rules_verdict")).alias("guess")),
        F.struct(F.lit("hybrid").alias("system"), predicted(F.col("hybrid_verdict")).alias("guess")),
    )
    return records.select(*more, "true_label", F.explode(each).alias("s")).select(*more, "true_label", "s.system", "s.guess")


def confusion(records: DataFrame) -> DataFrame:
    return rates(systems(records).groupBy("system").agg(*cells(F.col("true_label"), F.col("guess"))))


def coverage(records: DataFrame) -> DataFrame:
    """Counts of one kind in each row: available or not, error types, graph status."""
    reason = F.when(F.col("gnn_score") < 0, F.coalesce(F.nullif("gnn_error_type", F.lit("")), F.lit("UNKNOWN")))
    kinds = F.array(
        F.struct(F.lit("gnn").alias("kind"), F.when(F.col("gnn_score") >= 0, "available").otherwise("unavailable").alias("value")),
        F.struct(F.lit("error").alias("kind"), reason.alias("value")),
        F.struct(F.lit("cpg").alias("kind"), F.col("cpg_status").alias("value")),
    )
    each = records.select(F.explode(kinds).alias("k")).where("k.value is not null")
    counted = each.groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))
    return counted.select("kind", "value", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("kind")), 6).alias("share"))


def bucket_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("decision_bucket").agg(F.count("*").alias("n"))


def rule_effects(records: DataFrame) -> DataFrame:
    """For each rule what the hybrid verdict saved or hurt against the model alone; rules with neither have no row."""
    gnn, hybrid = (F.col("gnn_score") >= 0.5).cast("int"), predicted(F.col("hybrid_verdict"))
    label = F.col("true_label")
    saved = (label == 1) & (gnn == 0) & (hybrid == 1)
    hurt = (label == 0) & (gnn == 0) & (hybrid == 1)
    each = records.where(saved | hurt).select(F.explode("rules_matched").alias("rule_id"), saved.alias("s"), hurt.alias("h"))
    return each.groupBy("rule_id").agg(F.count_if("s").alias("saved"), F.count_if("h").alias("hurt"))


def bounds(spark) -> DataFrame:
    return fixed_table(spark, [(i, i / 10, (i + 1) / 10) for i in range(10)], "bucket int, low double, high double")


def calibration(records: DataFrame) -> DataFrame:
    """Ten score buckets, also empty ones; the last is closed and negative scores are in none."""
    high = F.when(F.col("bucket") == 9, F.col("gnn_score") <= F.col("high")).otherwise(F.col("gnn_score") < F.col("high"))
    buckets = bounds(records.sparkSession)
    inside = records.join(F.broadcast(buckets), (F.col("gnn_score") >= F.col("low")) & high).groupBy("bucket").agg(F.count("*").alias("total"), F.sum("true_label").alias("malicious"))
    rate = F.col("malicious") / F.greatest("total", F.lit(1))
    return buckets.join(inside, "bucket", "left").select("bucket", "low", "high", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("malicious", F.lit(0)).cast("long").alias("malicious"), F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("rate"))


def profile(rules: Column) -> Column:
    some = lambda names: F.exists(rules, lambda r: r.isin(names))
    return (
        F.when(F.size(rules) == 0, "no_rules").when(some(RELIABLE) & ~some(NOISY), "high_reliability_rules_only").when(some(RELIABLE), "mixed_reliability_rules").when(some(NOISY), "noisy_rules_only").otherwise("unknown_rules")
    )


def error_category(kind: Column, score: Column, rules: Column, bucket: Column) -> Column:
    p = profile(rules)
    none = p == "no_rules"
    fp = (
        F.when((score >= 0.90) & none, "fp_gnn_very_high_without_rules").when((score >= 0.80) & none, "fp_gnn_high_without_rules").when(p == "noisy_rules_only", "fp_noisy_rule_confirmation")
        .when(p == "mixed_reliability_rules", "fp_mixed_rule_confirmation").when(p == "high_reliability_rules_only", "fp_high_reliability_rule_collision").otherwise("fp_other")
    )
    fn = (
        F.when((score < 0.35) & none, "fn_low_gnn_no_rules").when(score < 0.35, "fn_low_gnn_weak_rules").when((score < 0.75) & none, "fn_mid_gnn_no_rules").when(score < 0.75, "fn_mid_gnn_weak_rules")
        .when((score >= 0.80) & none, "fn_high_gnn_no_rules").when((score >= 0.80) & F.contains(bucket, F.lit("review")), "fn_high_gnn_review_policy")
        .when(p.isin("noisy_rules_only", "mixed_reliability_rules"), "fn_rule_signal_too_noisy").otherwise("fn_other")
    )
    return F.when(kind == "fp", fp).otherwise(fn)


def errors(records: DataFrame, *more: str) -> DataFrame:
    """False positives and negatives of the hybrid verdict with category, band and profile, and further columns of records."""
    guess = predicted(F.col("hybrid_verdict"))
    kind = F.when((F.col("true_label") == 0) & (guess == 1), "fp").when((F.col("true_label") == 1) & (guess == 0), "fn")
    score, rules = F.col("gnn_score"), F.col("rules_matched")
    wrong = records.withColumn("kind", kind).where("kind is not null")
    return wrong.select("package_name", "kind", "gnn_score", "rules_matched", error_category(F.col("kind"), score, rules, F.col("decision_bucket")).alias("category"), score_band(score).alias("band"), profile(rules).alias("profile"), *more)


def error_summary(records: DataFrame) -> DataFrame:
    found = errors(records)
    each = found.select("kind", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("category", "band", "profile")])).alias("d"))
    return each.groupBy("kind", "d.dimension", "d.value").agg(F.count("*").alias("n"))


def top_rules(records: DataFrame, k: int = 20) -> DataFrame:
    """The k rules most often among errors of each kind, ties by name."""
    counted = errors(records).select("kind", F.explode("rules_matched").alias("rule_id")).groupBy("kind", "rule_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "rule_id"))
    return counted.withColumn("place", place).where(F.col("place") <= k)


def improvement_candidates(records: DataFrame, ideas: list[tuple[str, str, list[str]]] = IDEAS) -> DataFrame:
    """idea, area and n: the ideas one of whose error categories occurs, with how many such errors there are."""
    each = [(idea, area, c) for idea, area, cats in ideas for c in cats]
    dim = fixed_table(records.sparkSession, each, "idea string, area string, category string")
    found = errors(records).groupBy("category").agg(F.count("*").alias("n"))
    return dim.join(found, "category").groupBy("idea", "area").agg(F.sum("n").alias("n"))


def manifest_shape(rows: DataFrame) -> DataFrame:
    """rows with what the manifest in raw (null: there is none) says, also of those that can't be parsed."""
    raw = F.col("raw")
    fine = F.try_parse_json(raw).isNotNull()
    text = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit(""))
    keys = T.json_keys(raw, "$.scripts")
    hooks = F.filter(F.array(*map(F.lit, ["preinstall", "install", "postinstall", "prepare"])), lambda h: F.array_contains(keys, h))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "has_package_json": raw.isNotNull(), "package_json_error": raw.isNotNull() & ~F.coalesce(fine, F.lit(False)), "script_hooks": F.when(fine, hooks).otherwise(none),
        "dependency_count": F.when(fine, F.size(T.json_keys(raw, "$.dependencies"))).otherwise(0), "has_repository": F.coalesce(fine & ~text("repository").isin("", "{}"), F.lit(False)),
        "has_license": F.coalesce(fine & (text("license") != ""), F.lit(False)), "description_length": F.when(fine, F.length(text("description"))).otherwise(0),
    })


def summary(records: DataFrame) -> DataFrame:
    """section, name and value: counts, metrics of the three systems, coverage, buckets, rule effects and score buckets in one long table."""
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    long = lambda df, *parts: df.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    total = records.agg(F.count("*").alias("total"), F.coalesce(F.sum("true_label"), F.lit(0)).alias("malicious"))
    counts = long(total, row("counts", F.lit("total_packages"), F.col("total")), row("counts", F.lit("malicious_packages"), F.col("malicious")), row("counts", F.lit("benign_packages"), F.col("total") - F.col("malicious")))
    metrics = long(confusion(records), *[row("metrics", F.concat_ws(".", "system", F.lit(m)), F.col(m)) for m in ("precision", "recall", "f1", "tp", "fp", "fn", "tn")])
    covered = long(coverage(records), row("coverage", F.concat_ws(".", "kind", "value"), F.col("n")))
    buckets = long(bucket_counts(records), row("decision_buckets", F.col("decision_bucket"), F.col("n")))
    effects = long(rule_effects(records), row("saved", F.col("rule_id"), F.col("saved")), row("hurt", F.col("rule_id"), F.col("hurt")))
    scores = long(calibration(records), row("score_buckets.total", F.col("bucket").cast("string"), F.col("total")), row("score_buckets.malicious", F.col("bucket").cast("string"), F.col("malicious")), row("score_buckets.rate", F.col("bucket").cast("string"), F.col("rate")))
    return counts.unionByName(metrics).unionByName(covered).unionByName(buckets).unionByName(effects).unionByName(scores)


def report(records: DataFrame) -> DataFrame:
    """section, name and line of a Markdown report: a table row for each system, a list item for each count."""
    n = lambda c: F.format_string("%.4f", c)
    systems_ = confusion(records).select(F.lit("metrics").alias("section"), F.col("system").alias("name"), F.concat(F.lit("| "), F.array_join(F.array("system", n("precision"), n("recall"), n("f1"), *[F.col(c).cast("string") for c in ("tp", "fp", "fn", "tn")]), " | "), F.lit(" |")).alias("line"))
    item = lambda section, name, value: [F.lit(section).alias("section"), name.alias("name"), F.concat(F.lit("- "), name, F.lit(": "), value.cast("string")).alias("line")]
    covered = coverage(records).select(*item("coverage", F.concat_ws(" ", "kind", "value"), F.col("n")))
    buckets = bucket_counts(records).select(*item("decision_buckets", F.col("decision_bucket"), F.col("n")))
    effects = rule_effects(records).select(F.lit("rules").alias("section"), F.col("rule_id").alias("name"), F.concat(F.lit("| "), F.array_join(F.array("rule_id", F.col("saved").cast("string"), F.col("hurt").cast("string")), " | "), F.lit(" |")).alias("line"))
    return systems_.unionByName(covered).unionByName(buckets).unionByName(effects)


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every metric of every system in two runs (flagged: how many it calls malicious), and their difference."""
    names = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "flagged"]
    long = lambda df, n: confusion(df).withColumn("flagged", F.col("tp") + F.col("fp")).select("system", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("m")).select("system", "m.metric", F.col("m.v").alias(n))
    return long(before, "before").join(long(after, "after"), ["system", "metric"]).select("*", F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def bucket_shift(before: DataFrame, after: DataFrame, notable: int = 5) -> DataFrame:
    a, b = bucket_counts(before).withColumnRenamed("n", "a"), bucket_counts(after).withColumnRenamed("n", "b")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return a.join(b, "decision_bucket", "full_outer").select("decision_bucket", n("a").alias("before"), n("b").alias("after"), (n("b") - n("a")).alias("delta"), (F.abs(n("b") - n("a")) > notable).alias("notable"))


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Packages of both runs whose verdict changed: fixed, broken or moved; a suspicious verdict is never right."""
    last = lambda df, n: df.groupBy("package_name").agg(F.max_by(F.struct("hybrid_verdict", "true_label"), "seq").alias(n))
    right = lambda v, y: ((v == "malicious") & (y == 1)) | ((v == "clean") & (y == 0))
    both = last(before, "a").join(last(after, "b"), "package_name").where("a.hybrid_verdict <> b.hybrid_verdict")
    was, now = right(F.col("a.hybrid_verdict"), F.col("a.true_label")), right(F.col("b.hybrid_verdict"), F.col("b.true_label"))
    change = F.when(~was & now, "fixed").when(was & ~now, "broken").otherwise("moved")
    return both.select("package_name", F.col("a.hybrid_verdict").alias("before"), F.col("b.hybrid_verdict").alias("after"), change.alias("change"))


def missed_bands(records: DataFrame) -> DataFrame:
    """Missed malicious packages by band of their rules' score, with the mean score of the suspicious ones."""
    s = F.col("rules_score")
    band = F.when(s == 0, "0").when(s <= 5, "(0,5]").when(s <= 10, "(5,10]").when(s < 15, "(10,15)").otherwise(">=15")
    missed = records.where((F.col("true_label") == 1) & (F.col("hybrid_verdict") != "malicious"))
    mean = F.round(F.avg(F.when(F.col("hybrid_verdict") == "suspicious", F.col("gnn_score"))), 6)
    return missed.groupBy(band.alias("band")).agg(F.count("*").alias("n"), mean.alias("suspicious_mean"))


def class_stats(records: DataFrame) -> DataFrame:
    """Mean, population deviation and counts of available scores by class."""
    s = F.col("gnn_score")
    return records.where(s >= 0).groupBy("true_label").agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("deviation"), F.count_if(s >= 0.5).alias("above"))


def class_bins(records: DataFrame) -> DataFrame:
    """Counts by class and tenth of the score (1 in the last), and of missing scores."""
    s = F.col("gnn_score")
    return records.groupBy("true_label", F.when(s < 0, -1).otherwise(F.least(F.floor(s * 10), F.lit(9))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def class_cube(records: DataFrame) -> DataFrame:
    """class_bins by verdict with all their totals, from one pass: true_label, bin and hybrid_verdict (null where summed over), level, n and wrong.

    level is grouping_id(): 0 for a class, bin and verdict, 1 for a class and bin, 3 for a class, 5 for a bin and 7 for all, so a null that
    stands for a total is told from any other.
    """
    s = F.col("gnn_score")
    rows = records.select("true_label", F.when(s < 0, -1).otherwise(F.least(F.floor(s * 10), F.lit(9))).cast("int").alias("bin"), "hybrid_verdict")
    label, tenth, verdict = F.col("true_label"), F.col("bin"), F.col("hybrid_verdict")
    wrong = F.count_if(predicted(verdict) != label)
    sets = [[label, tenth, verdict], [label, tenth], [label], [tenth], []]
    return rows.groupingSets(sets, label, tenth, verdict).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), wrong.alias("wrong"))


def metric_table(records: DataFrame) -> DataFrame:
    """run, metric and a column for each system: the metrics of both runs (column run) side by side, from one pass over the records."""
    each = rates(systems(records, "run").groupBy("run", "system").agg(*cells(F.col("true_label"), F.col("guess"))))
    names = ["tp", "fp", "fn", "tn", "precision", "recall", "f1"]
    long = each.select("run", "system", *[F.col(m).cast("double").alias(m) for m in names]).unpivot(["run", "system"], names, "metric", "value")
    return long.groupBy("run", "metric").pivot("system", ["gnn", "rules", "hybrid"]).agg(F.first("value"))


def run_metadata(records: DataFrame) -> DataFrame:
    """name and value: what an evaluation's own pass over the records saw (packages, malicious, failures, covered, verdicts), and its metrics.

    The counts are observed by the job that computes the metrics, so they cost no other pass and are of the very rows that were evaluated.
    """
    seen, s = Observation("evaluation"), F.col("gnn_score")
    counts = {"packages": F.count(F.lit(1)), "malicious": F.count_if(F.col("true_label") == 1), "failures": F.count_if(s < 0), "covered": F.count_if(s >= 0)}
    counts |= {f"{v}_verdicts": F.count_if(F.col("hybrid_verdict") == v) for v in ("clean", "suspicious", "malicious")}
    watched = records.observe(seen, *[c.alias(k) for k, c in counts.items()])
    metrics = {f"{r['system']}.{m}": r[m] for r in confusion(watched).collect() for m in ("precision", "recall", "f1")}  # three rows
    told = {k: float(seen.get[k]) for k in counts} | metrics
    return fixed_table(records.sparkSession, list(told.items()), "name string, value double")


def histogram(records: DataFrame, bins: int = 50) -> DataFrame:
    s = F.col("gnn_score")
    return records.where(s >= 0).groupBy("true_label", F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def missed_rules(records: DataFrame, k: int = 5) -> DataFrame:
    """The k rules seen most among missed malicious packages that are suspicious, ties by name."""
    missed = records.where((F.col("true_label") == 1) & (F.col("hybrid_verdict") == "suspicious"))
    return missed.select(F.explode("rules_matched").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(k)


def separation(records: DataFrame, block: float = LIVE["direct"]) -> DataFrame:
    """One row: means and deviations of both classes' scores (deviation 0 for one score, mean null for none), the distance
    of the means, and how many packages of each class reach the threshold."""
    s, y = F.col("gnn_score"), F.col("true_label")
    of = lambda c: F.when((s >= 0) & (y == c), s)
    found = records.agg(
        *[F.round(F.avg(of(c)), 6).alias(f"{n}_mean") for c, n in ((1, "malicious"), (0, "benign"))],
        *[F.round(F.coalesce(F.stddev_pop(of(c)), F.lit(0.0)), 6).alias(f"{n}_deviation") for c, n in ((1, "malicious"), (0, "benign"))],
        F.round(F.avg(of(1)) - F.avg(of(0)), 6).alias("distance"),
        *[F.count_if(of(c) >= block).alias(f"{n}_above") for c, n in ((1, "malicious"), (0, "benign"))],
        *[F.count_if(y == c).alias(n) for c, n in ((1, "malicious"), (0, "benign"))],
    )
    return found


def diagnostic_records(records: DataFrame) -> DataFrame:
    """The columns that a diagnosis keeps, with the older label of the decision; records need decision_path."""
    phase = phase_label(F.col("hybrid_verdict"), F.col("decision_path"), F.col("gnn_score"))
    keep = ["package_name", "true_label", "gnn_score", "rules_score", "rules_matched", "hybrid_verdict", "decision_bucket", "decision_path"]
    return records.select(*keep, phase.alias("phase_label"))


def unite_targets(sources: list[DataFrame], seed: int = 42, most: int = 0) -> DataFrame:
    """Targets (path, label, kind) of several lists, each once, from the first list that has it, with their place in a seeded
    shuffle; at most `most` of each label, if that is above 0."""
    every = None
    for i, df in enumerate(sources):
        one = df.select("path", "label", "kind", F.lit(i).alias("source"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("path", "label", "kind").agg(F.min("source").alias("source"))
    mixed = F.md5(F.concat_ws(":", "path", F.col("label").cast("string"), "kind", F.lit(str(seed))).cast("binary"))
    placed = ranked(first.withColumn("shuffle", mixed), ["label"], ["shuffle"], "place").withColumn("place", F.col("place") + 1)
    return placed.where(F.col("place") <= most) if most > 0 else placed
