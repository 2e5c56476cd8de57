"""Manifest and lifecycle traits, candidate signals and what-if audits of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.local import fixed_table
from sievework.operators.catalog import BUILD_TERMS, NETWORK_TERMS, NOISY, OBFUSCATION_TERMS, RELIABLE, SECRET_TERMS, SHELL_TERMS
from sievework.operators.evaluate import cells, predicted, profile, rates

HOOKS = ["install", "postinstall", "preinstall", "prepare"]


def manifest_context(manifests: DataFrame) -> DataFrame:
    """package_id and the manifest's traits that signals use."""
    raw = F.col("raw")
    text = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit(""))
    return manifests.select(
        "package_id",
        F.filter(F.array(*map(F.lit, HOOKS)), lambda h: F.array_contains(T.json_keys(raw, "$.scripts"), h)).alias("hooks"),
        T.truthy(raw, "$.license").alias("has_license"),
        T.truthy(raw, "$.repository").alias("has_repository"),
        F.length(F.when(T.truthy(raw, "$.description"), text("description")).otherwise("")).alias("description_length"),
        T.dependency_count(raw).alias("dependencies"),
        F.size(T.json_keys(raw, "$.scripts")).alias("scripts"),
    )


def manifest_traits(manifests: DataFrame) -> DataFrame:
    """manifests with `traits`: what package_context() needs of the manifest in raw."""
    raw = F.col("raw")
    text = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit(""))
    keys, said = T.json_keys(raw, "$.scripts"), F.when(T.truthy(raw, "$.description"), text("description")).otherwise("")
    traits = {
        "name": F.nullif(text("name"), F.lit("")), "keys": F.coalesce(F.size(F.json_object_keys(raw)), F.lit(0)), "repository": T.truthy(raw, "$.repository"), "license": T.truthy(raw, "$.license"), "described": F.trim(said) != "", "description_length": F.length(said),
        "scripts": F.size(keys), "hooks": F.filter(F.array(*map(F.lit, HOOKS)), lambda h: F.array_contains(keys, h)), "dependencies": F.size(T.json_keys(raw, "$.dependencies")), "dev_dependencies": F.size(T.json_keys(raw, "$.devDependencies")),
    }
    return manifests.withColumn("traits", F.struct(*[c.alias(k) for k, c in traits.items()]))


def package_context(records: DataFrame) -> DataFrame:
    """The 28 traits of a record and its manifest, which context signals choose from.

    records have manifest_traits()'s traits (null: there is no manifest), or else raw (null too). JSON is what costs here, so where records
    share manifests, join them to their traits.
    """
    if "traits" not in records.columns:
        records = manifest_traits(records)
    rules = F.coalesce("rules_matched", F.array().cast("array<string>"))
    of = lambda k, none: F.coalesce(F.col(f"traits.{k}"), none if isinstance(none, Column) else F.lit(none))
    name, hooks = of("name", F.col("package_name")), of("hooks", F.array().cast("array<string>"))
    count = lambda names: F.size(F.filter(rules, lambda r: r.isin(names)))
    noisy, good, n = count(NOISY), count(RELIABLE), F.size(rules)
    traits = {
        "has_package_json": of("keys", 0) > 0, "scoped": F.startswith(name, F.lit("@")), "has_repository": of("repository", False), "has_license": of("license", False),
        "has_description": of("described", False), "description_length": of("description_length", 0), "scripts_count": of("scripts", 0), "lifecycle_hooks": hooks, "has_lifecycle_hook": F.size(hooks) > 0,
        "dependency_count": of("dependencies", 0), "dev_dependency_count": of("dev_dependencies", 0),
        "gnn_score": F.coalesce("gnn_score", F.lit(-1.0)), "metadata_risk": F.coalesce("metadata_risk", F.lit(0.0)), "num_js_files": F.coalesce("num_js_files", F.lit(0)), "num_nodes": F.coalesce("num_nodes", F.lit(0)), "num_edges": F.coalesce("num_edges", F.lit(0)),
        "rule_ids": rules, "rules_count": n, "has_rules": n > 0, "noisy_rule_count": noisy, "high_reliability_rule_count": good, "rules_noisy_only": (n > 0) & (noisy == n) & (good == 0), "rules_none": n == 0,
        "has_med_install_hook_rule": F.array_contains(rules, "MED_INSTALL_HOOK_EXISTS"), "has_structural_rule": F.array_contains(rules, "MED_SUSPICIOUS_PACKAGE_STRUCTURE"),
        "has_manifest_hook_only_rule": F.array_contains(rules, "MED_MANIFEST_INSTALL_HOOK_ONLY"), "has_critical_rule": F.exists(rules, lambda r: F.startswith(r, F.lit("CRIT_"))),
    }
    return records.select(F.col("package_name").alias("record"), name.alias("package_name"), *[c.alias(k) for k, c in traits.items()])


def lifecycle_context(files: DataFrame, manifests: DataFrame, most: int = 5, cut: int = 131_072) -> DataFrame:
    """package_id, targets, found, five traits of hook commands and their files, and risk_score (0 to 4).

    At most `most` files that hooks name are read, each up to `cut` characters; this is the feature's own limit.
    """
    each = F.array(*[T.script(F.col("raw"), h) for h in HOOKS])
    hooks = manifests.select("package_id", F.array_compact(each).alias("commands")).where(F.size("commands") > 0)
    hooks = hooks.withColumn("targets", F.slice(F.flatten(F.transform("commands", T.hook_targets)), 1, most))
    wanted = hooks.select("package_id", F.explode(F.array_distinct(F.transform("targets", T.normal_path))).alias("path")).join(files.select("package_id", "path", "code"), ["package_id", "path"])
    found = wanted.groupBy("package_id").agg(F.count("*").alias("found"), F.array_join(F.array_sort(F.collect_list(F.left("code", F.lit(cut)))), "\n").alias("code"))
    rows = hooks.join(found, "package_id", "left")
    both = F.concat_ws("\n", F.array_join("commands", "\n"), "code")
    has = {n: T.contains_any(both, terms) for n, terms in (("network", NETWORK_TERMS), ("shell", SHELL_TERMS), ("secrets", SECRET_TERMS), ("obfuscation", OBFUSCATION_TERMS), ("build", BUILD_TERMS))}
    rows = rows.select("package_id", F.size("targets").alias("targets"), F.coalesce("found", F.lit(0)).alias("found"), *[c.alias(n) for n, c in has.items()])
    return rows.withColumn("risk_score", sum((F.col(n).cast("int") for n in ("network", "shell", "secrets", "obfuscation")), F.lit(0)))


def context_signals() -> list[tuple[str, str, Column]]:
    """(name, kind, predicate) over records with gnn_score, rules_matched, metadata_risk, hook, license, repository, description_length, num_nodes and num_js_files."""
    g, r, h = F.col("gnn_score"), F.col("metadata_risk"), F.col("hook")
    p, rules = profile(F.col("rules_matched")), F.col("rules_matched")
    mid = (g >= 0.35) & (g < 0.80)
    has = lambda *ids: F.exists(rules, lambda x: x.isin(*ids))
    return [
        ("high_gnn_clean_manifest", "suppressor", (g >= 0.80) & (p == "no_rules") & ~h & (r <= 0.15) & F.col("license") & (F.col("description_length") >= 20)),
        ("noisy_only_documented", "suppressor", (p == "noisy_rules_only") & ~h & (r <= 0.15) & (F.col("license") | F.col("repository")) & (F.col("description_length") >= 20)),
        ("tiny_graph_no_hook", "suppressor", (F.col("num_nodes") <= 1) & ~h & (r <= 0.15)),
        ("large_package_noisy_only", "suppressor", ((F.col("num_js_files") >= 20) | (F.col("num_nodes") >= 30000)) & ~h & (p == "noisy_rules_only") & (r <= 0.15)),
        ("high_metadata_risk", "confirmer", r >= 0.40),
        ("structure_rule", "confirmer", has("MED_SUSPICIOUS_PACKAGE_STRUCTURE", "MED_MANIFEST_INSTALL_HOOK_ONLY")),
        ("mid_gnn_hook_rule", "confirmer", mid & h & has("MED_INSTALL_HOOK_EXISTS")),
        ("mid_gnn_hook_risk", "confirmer", mid & h & (r >= 0.20)),
        ("upper_mid_bare_manifest", "confirmer", (g >= 0.55) & (g < 0.80) & (p == "no_rules") & ~F.col("repository") & ~F.col("license") & (F.col("description_length") < 20)),
    ]


def lifecycle_signals() -> list[tuple[str, str, Column]]:
    """(name, kind, predicate) over records with gnn_score, hook, metadata_risk and lifecycle_context()'s traits."""
    mid = (F.col("gnn_score") >= 0.35) & (F.col("gnn_score") < 0.80) & F.col("hook")
    return [
        ("network_or_shell", "confirmer", mid & (F.col("network") | F.col("shell"))),
        ("secrets", "confirmer", mid & F.col("secrets")),
        ("obfuscation", "confirmer", mid & F.col("obfuscation")),
        ("risk_2", "confirmer", mid & (F.col("risk_score") >= 2)),
        ("risk_1_no_build", "confirmer", mid & (F.col("risk_score") >= 1) & ~F.col("build")),
        ("build_hook", "suppressor", F.col("hook") & F.col("build") & (F.col("metadata_risk") <= 0.15)),
    ]


def fired(records: DataFrame, signals: list[tuple[str, str, Column]]) -> DataFrame:
    """A row for each record and signal that matches: true_label, guess, signal, kind, package_name."""
    each = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(n).alias("signal"), F.lit(k).alias("kind"), F.lit(i).alias("at"))) for i, (n, k, p) in enumerate(signals)]))
    return records.select("package_name", "true_label", predicted(F.col("hybrid_verdict")).alias("guess"), F.explode(each).alias("s")).select("package_name", "true_label", "guess", "s.*")


def impact(records: DataFrame, signals: list[tuple[str, str, Column]]) -> DataFrame:
    """For each signal the cells that it matches, and the metrics after it flips them; signals without a match too."""
    spark = records.sparkSession
    names = fixed_table(spark, [(n, k) for n, k, _ in signals], "signal string, kind string")
    matched = fired(records, signals).groupBy("signal").agg(*[c.alias(f"m_{n}") for n, c in zip(("tp", "fp", "fn", "tn"), cells(F.col("true_label"), F.col("guess")))])
    base = records.agg(*cells(F.col("true_label"), predicted(F.col("hybrid_verdict"))))
    rows = names.join(matched, "signal", "left").fillna(0).crossJoin(F.broadcast(base))  # one row
    off, on = (F.col("kind") == "suppressor").cast("int"), (F.col("kind") == "confirmer").cast("int")
    m = {n: F.col(f"m_{n}") for n in ("tp", "fp", "fn", "tn")}
    after = rows.select(
        "signal", "kind", *[F.col(f"m_{n}").cast("long").alias(f"m_{n}") for n in m],
        (F.col("tp") - off * m["tp"] + on * m["fn"]).cast("long").alias("tp"), (F.col("fp") - off * m["fp"] + on * m["tn"]).cast("long").alias("fp"),
        (F.col("fn") + off * m["tp"] - on * m["fn"]).cast("long").alias("fn"), (F.col("tn") + off * m["fp"] - on * m["tn"]).cast("long").alias("tn"),
    )
    return rates(after)


def harmless(records: DataFrame, signals: list[tuple[str, str, Column]]) -> DataFrame:
    """Signals that help and hurt nothing: suppressors without a tp, confirmers without a tn."""
    hurt = F.when(F.col("kind") == "suppressor", F.col("m_tp")).otherwise(F.col("m_tn"))
    gain = F.when(F.col("kind") == "suppressor", F.col("m_fp")).otherwise(F.col("m_fn"))
    return impact(records, signals).where((hurt == 0) & (gain > 0)).select("signal", "kind", gain.alias("gain"))


def combined(records: DataFrame, signals: list[tuple[str, str, Column]]) -> DataFrame:
    """Metrics with all harmless signals applied; the last signal that changes a prediction wins."""
    chosen = harmless(records, signals).select("signal")
    flips = fired(records, signals).join(F.broadcast(chosen), "signal")  # a row for each signal at most
    acts = ((F.col("kind") == "suppressor") & (F.col("guess") == 1)) | ((F.col("kind") == "confirmer") & (F.col("guess") == 0))
    new = flips.where(acts).groupBy("package_name").agg(F.max_by(F.when(F.col("kind") == "suppressor", 0).otherwise(1), "at").alias("new"))
    rows = records.select("package_name", "true_label", predicted(F.col("hybrid_verdict")).alias("guess")).join(new, "package_name", "left")
    return rates(rows.agg(*cells(F.col("true_label"), F.coalesce("new", "guess"))))


def mid_slice(records: DataFrame) -> DataFrame:
    """Metrics of packages with a hook and a score from 0.35 to 0.80."""
    rows = records.where("gnn_score >= 0.35 and gnn_score < 0.80 and hook")
    return rates(rows.agg(*cells(F.col("true_label"), predicted(F.col("hybrid_verdict")))))


def hard_examples(records: DataFrame, k: int = 50) -> DataFrame:
    """The k worst false positives (highest score) and false negatives (lowest), ties by name."""
    guess = predicted(F.col("hybrid_verdict"))
    kind = F.when((F.col("true_label") == 0) & (guess == 1), "fp").when((F.col("true_label") == 1) & (guess == 0), "fn")
    order = F.when(F.col("kind") == "fp", -F.col("gnn_score")).otherwise(F.col("gnn_score"))
    ranked = records.withColumn("kind", kind).where("kind is not null").withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(order, "package_name")))
    return ranked.where(F.col("place") <= k).select("kind", "place", "package_name", "gnn_score")


def mid_slice_errors(records: DataFrame, k: int = 50) -> DataFrame:
    """The first k (by name) missed and rightly passed packages of the slice of mid_slice()."""
    rows = records.where("gnn_score >= 0.35 and gnn_score < 0.80 and hook").where(F.col("hybrid_verdict") != "malicious")
    kind = F.when(F.col("true_label") == 1, "fn").otherwise("tn")
    ranked = rows.select(kind.alias("kind"), "package_name", "gnn_score").withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy("package_name")))
    return ranked.where(F.col("place") <= k)


def verdict_on_signals(records: DataFrame, signals: list[tuple[str, str, Column]], precision: float = 0.96, recall: float = 0.88) -> DataFrame:
    """Whether the harmless signals together reach the goal, improve both metrics, or are not enough."""
    base = rates(records.agg(*cells(F.col("true_label"), predicted(F.col("hybrid_verdict"))))).select(F.col("precision").alias("p"), F.col("recall").alias("r"))
    both = combined(records, signals).crossJoin(F.broadcast(base))  # one row each
    said = F.when((F.col("precision") >= precision) & (F.col("recall") >= recall), "goal_reached").when((F.col("recall") > F.col("r")) & (F.col("precision") >= F.col("p")), "improved").otherwise("not_enough")
    return both.select("precision", "recall", F.col("p").alias("base_precision"), F.col("r").alias("base_recall"), said.alias("outcome"))
