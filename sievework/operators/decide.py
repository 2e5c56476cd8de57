"""Verdicts from a model's score, weighted rule hits and metadata risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.local import fixed_table
from sievework.operators.catalog import DECISION_LABELS, HARD, LIVE, LIVE_WEIGHT, REPLAY, REPLAY_HARD, REPLAY_WEIGHT, UNKNOWN_WEIGHT


def weight_dim(spark, weights: dict[str, float] = LIVE_WEIGHT, hard: list[str] = HARD) -> DataFrame:
    return fixed_table(spark, [(r, weights.get(r), r in hard) for r in sorted({*weights, *hard})], "rule_id string, weight double, hard boolean")


def rule_scores(hits: DataFrame, weights: dict[str, float] = LIVE_WEIGHT, hard: list[str] = HARD) -> DataFrame:
    """package_id, weighted, hard, total and hook of hits with rule_id and score."""
    dim = F.broadcast(weight_dim(hits.sparkSession, weights, hard))  # a row for each rule in the catalog
    part = F.col("score") * F.coalesce("weight", F.lit(UNKNOWN_WEIGHT))
    return hits.join(dim, "rule_id", "left").groupBy("package_id").agg(
        F.round(F.sum(part), 6).alias("weighted"),
        F.round(F.sum(F.when(F.coalesce("hard", F.lit(False)), part).otherwise(0.0)), 6).alias("hard"),
        F.round(F.sum("score"), 6).alias("total"),
        F.bool_or(F.col("rule_id") == "MED_INSTALL_HOOK_EXISTS").alias("hook"),
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def live_decision(gnn: Column, weighted: Column, hard: Column, total: Column, risk: Column, hook: Column, t: dict[str, float] = LIVE) -> Column:
    """struct(verdict, path, confidence); a null gnn means that no model score exists. First case that holds."""
    case = lambda v, p, c: F.struct(F.lit(v).alias("verdict"), F.lit(p).alias("path"), F.round(c, 6).alias("confidence"))
    mid = clamp(gnn, 0.50, 0.75)
    return (
        F.when(gnn >= t["direct"], case("malicious", "gnn_direct", clamp(gnn, 0.90, 0.97)))
        .when((gnn >= t["hook_low"]) & (gnn < t["direct"]) & hook, case("malicious", "install_hook", clamp(gnn + 0.10, 0.82, 0.95)))
        .when((gnn >= t["confirm"]) & (weighted >= t["weighted"]), case("malicious", "weighted_rules", clamp(gnn + 0.10, 0.80, 0.95)))
        .when((gnn >= t["hard_min_gnn"]) & (hard >= t["hard"]), case("malicious", "hard_rules", clamp(gnn + 0.08, 0.82, 0.95)))
        .when(gnn.isNull() & (hard >= t["hard"]), case("malicious", "rules_only_block", F.lit(0.85)))
        .when(gnn.isNull() & ((weighted > 0) | (total > 0) | (risk > 0.5)), case("suspicious", "rules_only_review", F.lit(0.65)))
        .when(gnn.isNull(), case("clean", "rules_only_clean", F.lit(0.50)))
        .when((gnn < t["clean"]) & (weighted <= 0), case("clean", "clean_pass", F.least(F.lit(0.95), 1 - gnn)))
        .when(gnn < t["clean"], case("suspicious", "low_gnn_review", F.lit(0.65)))
        .when((weighted > 0) | (hard > 0), case("suspicious", "static_review", mid))
        .otherwise(case("suspicious", "gnn_review", mid))
    )


def replay_verdict(gnn: Column, weighted: Column, hard: Column, t: dict[str, float] | None = None) -> Column:
    """Verdict of the replay policy; a negative gnn (no score) is always suspicious. Thresholds are numbers or columns."""
    t = t or {k: F.lit(v) for k, v in REPLAY.items()}
    block = (gnn >= t["direct"]) | ((gnn >= t["confirm"]) & (weighted >= t["weighted"])) | ((gnn >= t["hard_min_gnn"]) & (hard >= t["hard"]))
    return F.when(gnn < 0, "suspicious").when(block, "malicious").when((gnn < t["clean"]) & (weighted <= 0), "clean").otherwise("suspicious")


def replay_path(gnn: Column, weighted: Column, hard: Column) -> Column:
    """The decision bucket of the replay policy."""
    r = REPLAY
    return (
        F.when(gnn < 0, F.when((weighted > 0) | (hard > 0), "v2_static_review").otherwise("v2_gnn_review"))
        .when(gnn >= r["direct"], "v2_gnn_direct_block")
        .when((gnn >= r["confirm"]) & (weighted >= r["weighted"]), "v2_gnn_weighted_rules_block")
        .when((gnn >= r["hard_min_gnn"]) & (hard >= r["hard"]), "v2_hard_rules_block")
        .when((gnn < r["clean"]) & (weighted <= 0), "clean_pass")
        .when(gnn < r["clean"], "v2_low_gnn_review")
        .when((weighted > 0) | (hard > 0), "v2_static_review")
        .otherwise("v2_gnn_review")
    )


def weighted_of(rules: Column, scores: dict[str, float], hard_only: bool = False, weights: dict[str, float] = REPLAY_WEIGHT, hard: list[str] = REPLAY_HARD) -> Column:
    """Weighted score of an array of rule ids, from a literal map of the catalog's rules."""
    names = [r for r in scores if not hard_only or r in hard]
    table = F.create_map(*[F.lit(x) for r in names for x in (r, scores[r] * weights.get(r, UNKNOWN_WEIGHT))])
    return F.round(F.aggregate(rules, F.lit(0.0), lambda s, r: s + F.coalesce(F.try_element_at(table, r), F.lit(0.0))), 6)


def rules_only_verdict(critical: Column, total: Column) -> Column:
    return F.when(critical | (total >= 15), "malicious").when(total > 0, "suspicious").otherwise("clean")


def decide(gnn: DataFrame, hits: DataFrame, risk: DataFrame) -> DataFrame:
    """package_id, verdict, path and confidence of every package in gnn (package_id, gnn)."""
    rows = gnn.join(rule_scores(hits), "package_id", "left").join(risk, "package_id", "left")
    zero, no = F.lit(0.0), F.lit(False)
    d = live_decision(F.col("gnn"), F.coalesce("weighted", zero), F.coalesce("hard", zero), F.coalesce("total", zero), F.coalesce("risk", zero), F.coalesce("hook", no))
    return rows.select("package_id", d.alias("d")).select("package_id", "d.verdict", "d.path", "d.confidence")


def evidence(hits: DataFrame, decided: DataFrame) -> DataFrame:
    """package_id, line and text: the model's line, then one for each hit; numbers stay unrendered."""
    lines = hits.select("package_id", F.concat_ws(" ", F.lit("rule"), "rule_id", F.concat(F.lit("["), "severity", F.lit("]")), "file_path").alias("text"))
    return decided.select("package_id", F.concat_ws(" ", F.lit("verdict"), "verdict", "path").alias("text")).unionByName(lines)


def decision_label(verdict: Column, path: Column) -> Column:
    """The reporting label of a verdict and the text of its decision path."""
    low, out = F.lower(F.coalesce(path, F.lit(""))), F.lit(None).cast("string")
    for said, words, label in reversed(DECISION_LABELS):
        mine = verdict == said if said else ~verdict.isin("clean", "malicious") | verdict.isNull()
        out = F.when(mine & F.contains(low, F.lit(words)), label).otherwise(out)
    return out


def phase_label(verdict: Column, path: Column, gnn: Column, clean: float = LIVE["clean"]) -> Column:
    """The older labels of the recall diagnosis."""
    low = F.lower(F.coalesce(path, F.lit("")))
    says = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    passed = (gnn >= 0) & (gnn < clean)
    blocked = F.when(says("critical behavioral rule"), "critical_override").when(says("very high confidence"), "auto_block").when(says("confirming rules", "moderate malicious"), "uncertain_rules_block").otherwise("auto_block")
    review = F.when(says("review-only critical", "critical rule matched"), "critical_override_review").when(passed, "auto_pass_review").otherwise("uncertain_suspicious")
    return F.when(verdict == "malicious", blocked).when(verdict == "clean", F.when(passed, "auto_pass").otherwise("uncertain_clean")).otherwise(review)


def replayed(records: DataFrame) -> DataFrame:
    """records (gnn_score, weighted, hard_score) with the replay policy's verdict, confidence, bucket, path and scores in place of theirs."""
    g, w, h = F.col("gnn_score"), F.col("weighted"), F.col("hard_score")
    bucket = replay_path(g, w, h)
    mid = clamp(g, 0.50, 0.75)
    sure = (
        F.when(bucket == "v2_gnn_direct_block", clamp(g, 0.90, 0.97)).when(bucket == "v2_gnn_weighted_rules_block", clamp(g + 0.10, 0.80, 0.95)).when(bucket == "v2_hard_rules_block", clamp(g + 0.08, 0.82, 0.95))
        .when(bucket == "clean_pass", F.least(F.lit(0.95), 1 - g)).when(bucket == "v2_low_gnn_review", F.lit(0.65)).otherwise(mid)
    )
    return records.withColumns({
        "hybrid_verdict": replay_verdict(g, w, h), "confidence": F.round(sure, 6), "decision_path": F.regexp_replace(F.regexp_replace(bucket, "^v2_", ""), "_", " "), "decision_bucket": bucket,
        "v2_weighted_rule_score": w, "v2_hard_rule_score": h,
    })
