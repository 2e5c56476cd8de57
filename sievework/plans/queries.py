"""Every query over the derived views, with the operator that answers it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import calibrate, dataset, decide, evaluate, flow, graph, network, rules, serve, signals, sweep
from sievework.operators.catalog import LIVE_WEIGHT, REPLAY_HARD, REPLAY_WEIGHT
from sievework.plans.testbed import records, view
from sievework.sources import packages

#: Floors that policies over the given tables reach, beside those of production.
PRECISIONS, RECALLS = [0.25, 0.30, 0.33, 0.96, 0.97, 0.98, 0.99], [0.2, 0.4, 0.6, 0.88, 0.89, 0.90, 0.92]
GOALS = [(0.3, 0.2), (0.34, 0.2), (0.96, 0.88), (0.97, 0.88), (0.98, 0.88), (0.99, 0.88)]
#: Records are dealt as many manifests.
MANIFESTS = 2111
#: Texts of decision paths, dealt to records by number.
PHRASES = [
    "GNN unavailable; rules clean", "Confident clean", "v2 install-hook recall block", "V2 direct GNN block", "v2 GNN + weighted rules block", "v2 high-reliability rules block", "critical behavioral rule matched", "very high confidence",
    "confirming rules", "without strong static confirmation", "v2 review: low GNN", "v2 review: evidence below block thresholds", "v2 review: GNN-only uncertainty", "review-only critical", "Static evidence", "one rule", "nothing of the kind",
]
#: Messages and stacks of failed builds, dealt to records by number.
MESSAGES = ["No JS files", "Syntax error near {", "tree_sitter gave up", "0 nodes left", "Empty", "disk full", "no javascript and a parse error"]
STACKS = ["main extract_ast", "main _walk_tree", "build extract_cfg", "build extract_dfg x", "get_node_features", "_build_metadata_tensor", "_build_cpg_impl", "main"]


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rule_hits(view(spark, sf, "files"), view(spark, sf, "manifests"))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return decide.decide(view(spark, sf, "scores"), hits(spark, sf), rules.metadata_risk(view(spark, sf, "manifests")))


def static_only(spark: SparkSession, sf: str) -> DataFrame:
    none = view(spark, sf, "scores").select("package_id", F.lit(None).cast("double").alias("gnn"))
    return decide.decide(none, hits(spark, sf), rules.metadata_risk(view(spark, sf, "manifests")))


def swept(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.sweep(records(spark, sf))


def runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, sf)
    return rows.where("run = 0"), rows.where("run = 1")


def shifted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One run, and the same packages with a lower score."""
    rows = records(spark, sf).drop("package_name").withColumnRenamed("short_name", "package_name")
    low = F.when(F.col("gnn_score") >= 0, F.col("gnn_score") * 0.5).otherwise(F.col("gnn_score"))
    again = decide.replay_verdict(low, F.col("weighted"), F.col("hard_score"))
    return rows, rows.withColumn("hybrid_verdict", again)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select(F.col("label").cast("long").alias("package_id"), F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("h"))


def inner_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose ends are nodes, whatever their packages, in one package."""
    return view(spark, sf, "edges").drop("package_id").withColumn("package_id", F.lit(0).cast("long"))


def one_package(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).withColumn("package_id", F.lit(0).cast("long"))


def proxy_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "requests")
    return rows.withColumn("action", serve.action(F.col("kind"), F.col("verdict"), F.col("size"), 150_000))


def of_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def file_facts(spark: SparkSession, sf: str) -> DataFrame:
    code = F.col("code")
    return view(spark, sf, "files").select(
        "package_id", "path", T.lines(code).cast("long").alias("n_lines"), F.octet_length(code).cast("long").alias("n_bytes"), F.coalesce(T.line_of(code, "net_send"), F.lit(0)).cast("long").alias("net_line"),
        F.size(rules.distinct_credentials(code)).cast("long").alias("credentials"), F.size(T.local_requires(code)).cast("long").alias("requires"), T.entropy(code).alias("entropy"),
    )


def spec_table(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "@scope/").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")))
    rows = part.select("p_partkey", name.alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")).alias("version"))
    url = T.tarball_url(F.lit("https://registry.example/"), F.col("name"), F.col("version"))
    rows = rows.withColumn("url", url).withColumn("parsed", T.parse_tarball_path(F.regexp_replace("url", "^https://registry.example", "")))
    return rows.withColumn("spec", T.parse_spec(F.concat("name", F.lit("@"), "version"))).select("p_partkey", "url", F.col("parsed.name").alias("name"), F.col("parsed.version").alias("version"), F.col("spec.name").alias("spec_name"), F.col("spec.version").alias("spec_version"))


def near_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names within two edits of another name."""
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("name"))
    return rules.near(names, names)


def risk_of_near_names(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests named like parts, some misspelt or with a scope, against the list of every second part's name."""
    k, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("-"))
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", name.alias("name"))
    listed = packages.popular_names(part.where(k % 2 == 0).select("name", k.alias("position")))
    wrong = F.when(k % 5 == 0, F.concat(F.lit("@s/"), "name")).when(k % 5 == 1, F.concat("name", F.lit("s"))).when(k % 5 == 2, F.substr("name", F.lit(3))).otherwise(F.col("name"))
    return rules.metadata_risk(part.select(k.alias("package_id"), F.concat(F.lit('{"name":"'), wrong, F.lit('","license":"MIT"}')).alias("raw")), listed)


#: Width and layers of the network that queries run, with weights by rule: no trained ones are published.
NETWORK_WIDTH, NETWORK_LAYERS = 8, 4


def network_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors by label as packages of nodes, and edges inside and across them."""
    return nodes(spark, sf).withColumnRenamed("h", "features"), view(spark, sf, "edges").select("package_id", "src", "dst", F.col("edge_type").cast("long").alias("edge_type"))


def graph_vectors(spark: SparkSession, sf: str) -> DataFrame:
    found = network.graph_vectors(*network_input(spark, sf), network.ruled_weights(64, NETWORK_WIDTH, NETWORK_LAYERS), NETWORK_LAYERS)
    return found.select("package_id", F.posexplode("vector").alias("k", "x")).select("package_id", F.col("k").cast("long").alias("k"), (F.round("x", 4) + F.lit(0.0)).alias("x"))


def network_scores(spark: SparkSession, sf: str) -> DataFrame:
    weights = network.ruled_weights(64, NETWORK_WIDTH, NETWORK_LAYERS)
    vectors_ = network.graph_vectors(*network_input(spark, sf), weights, NETWORK_LAYERS)
    metadata = nodes(spark, sf).groupBy("package_id").agg(F.array(*[F.avg(F.col("node_id") % (k + 2)) for k in range(8)]).alias("metadata"))
    return network.network_scores(vectors_, metadata, weights)


def lockfile_results(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of packages, of which some failed, for the lockfiles that ask for them."""
    known = view(spark, sf, "part_verdicts")
    failed = F.when(F.substr("name", F.lit(4)).cast("long") % 7 == 0, F.lit("timeout"))
    return serve.lockfile_results(view(spark, sf, "dependencies"), known.withColumn("error_msg", failed))


def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs of the items, as files of three splits."""
    split = F.element_at(F.array(*map(F.lit, ["train", "val", "test"])), (F.col("item_id") % 3 + 1).cast("int"))
    size, at = F.col("nodes") * 8 + 100, F.lit(1_700_000_000) + F.col("item_id")
    return view(spark, sf, "items").select(split.alias("split"), F.col("item_id").alias("graph_id"), "nodes", "label", F.concat(F.col("item_id").cast("string"), F.lit(".pt")).alias("name"), size.alias("size"), at.alias("mtime"))


def dealt(text: list[str], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, text)), (F.pmod(F.col(by), F.lit(len(text))) + 1).cast("int"))


def given_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """m, cut and raw: the manifests that records are dealt (their numbers are below MANIFESTS), each whole and cut off."""
    found = view(spark, sf, "manifests").select(F.col("package_id").alias("m"), "raw").where((F.col("m") >= 0) & (F.col("m") < MANIFESTS))
    return found.withColumn("cut", F.lit(False)).unionByName(found.select("m", F.left("raw", F.lit(12)).alias("raw"), F.lit(True).alias("cut")))


def with_manifest(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Records with the manifest of a package, some without, some cut off, and with the text of a decision path; given: other columns by m and cut in place of raw."""
    given = given_manifests(spark, sf) if given is None else given
    rows = records(spark, sf).withColumns({"m": F.pmod("seq", F.lit(MANIFESTS)), "cut": F.coalesce(F.col("seq") % 17 == 0, F.lit(False))}).join(F.broadcast(given), ["m", "cut"], "left")
    return rows.withColumns({"decision_path": dealt(PHRASES, "seq"), "num_edges": F.col("num_nodes") * 2})


def builds(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    return rows.select(F.col("package_name").alias("package_path"), F.col("cpg_status").alias("status"), F.coalesce("gnn_error_type", F.lit("")).alias("error_type"), dealt(MESSAGES, "seq").alias("error_message"), dealt(STACKS, "seq").alias("frames"), "num_js_files")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    error = F.when(F.col("package_id") % 13 == 0, "timeout")
    return serve.scan_payload(decided(spark, sf).join(view(spark, sf, "scores"), "package_id").withColumn("error", error))


def blocked(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "manifests").select("package_id", F.get_json_object("raw", "$.name").alias("name"), F.get_json_object("raw", "$.version").alias("version"))
    why = hits(spark, sf).groupBy("package_id").agg(F.array_sort(F.collect_set("rule_id")).alias("evidence"))
    rows = decided(spark, sf).where("verdict = 'malicious'").join(raw, "package_id").join(why, "package_id", "left")
    body = serve.block_body(rows.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))))
    return body.withColumn("evidence", F.array_join("evidence", ";"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Four lists of labelled targets that overlap."""
    read = lambda t, key, label, kind: spark.read.parquet(f"{sf}/{t}.parquet").select(F.concat(F.lit("t"), F.col(key).cast("string")).alias("path"), (F.col(key) % label).cast("int").alias("label"), F.lit(kind).alias("kind"))
    lists = [read("supplier", "s_suppkey", 2, "dir"), read("customer", "c_custkey", 2, "tarball"), read("part", "p_partkey", 2, "dir"), read("part", "p_partkey", 3, "dir").where("label < 2")]
    return dataset_targets(lists)


def dataset_targets(lists: list[DataFrame]) -> DataFrame:
    return evaluate.unite_targets(lists, most=300).select("path", "label", "kind", F.col("source").cast("long").alias("source"), F.col("place").cast("long").alias("place"))


def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A node for each line of a file, of three types by its number."""
    lines = view(spark, sf, "files").select("package_id", "path", F.posexplode(F.split("code", "\n")).alias("n", "text"))
    kind = F.element_at(F.array(*map(F.lit, ["call_expression", "string", "identifier"])), (F.col("n") % 3 + 1).cast("int"))
    return lines.select("package_id", F.concat_ws(":", "path", F.col("n").cast("string")).alias("node_id"), kind.alias("type"), "text", F.col("n").alias("start_line"), (F.col("n") + F.when(F.col("n") % 2 == 0, 0).otherwise(1)).alias("end_line"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    calls = view(spark, sf, "files").select("package_id", F.xxhash64("path").alias("node_id"), F.lit("call_expression").alias("type"), F.col("code").alias("text"))
    return graph.package_vector(view(spark, sf, "files"), view(spark, sf, "manifests"), graph.taint_flags(calls))


def graph_states(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as packages: statements are their nodes, some fail, some have nodes of one role only, some no manifest."""
    s = view(spark, sf, "statements")
    packages_ = s.select("package_id").distinct().withColumn("raw", F.when(F.col("package_id") % 5 != 0, "{}"))
    kept = s.where("package_id % 4 <> 0")
    failed = packages_.where("package_id % 7 = 0").select("package_id", dealt(STACKS, "package_id").alias("frames"), F.lit("ValueError").alias("error"))
    return graph.graph_status(packages_, kept, graph.sequential_flow(kept), failed)


def archive_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Sample paths made of parts, of several ecosystems and depths."""
    k = F.col("p_partkey")
    eco = F.when(k % 4 == 0, "pypi").otherwise("npm")
    plain = F.concat(F.when(k % 5 == 0, "@a:").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("?")), F.when(k % 7 == 0, ". ").otherwise(""))
    path = F.when(k % 11 == 0, F.concat_ws("/", eco, F.lit("mal"), plain)).otherwise(F.concat_ws("/", eco, F.lit("mal"), plain, F.concat(F.lit("1."), F.col("p_size").cast("string")), F.lit("x.zip")))
    return packages.malware_samples(spark.read.parquet(f"{sf}/part.parquet").select(path.alias("path"), "p_partkey")).distinct()


def found_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Names on pages of orders, without those of known parts."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("pkg"), (F.col("o_custkey") % 997).cast("string")).alias("name"), F.floor(F.col("o_orderkey") / 250).alias("page"), (F.col("o_orderkey") % 250).alias("position"))
    known = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("pkg"), (F.col("s_suppkey") * 3).cast("string")).alias("name"))
    return packages.search_results(o, known, 200).withColumn("place", F.col("place").cast("long"))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled parts that exist, without those already built, the first five of each label."""
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") % 2).cast("int").alias("label"))
    there, done = rows.where("length(path) > 2"), rows.where("cast(substr(path, 2) as bigint) % 3 = 0")
    return packages.build_queue(packages.existing(rows, there), done, 5)


def odd_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """What manifests with values of unexpected types say to context, rules and risk."""
    raw = view(spark, sf, "odd_manifests")
    seen = signals.manifest_context(raw).select("package_id", "has_license", "has_repository", F.col("description_length").cast("long").alias("description_length"))
    hook = raw.select("package_id", rules.install_hook(F.col("raw")).alias("install_hook"))
    return seen.join(hook, "package_id").join(rules.metadata_risk(raw), "package_id")


def temperature(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose labels depend on their scores, less than the scores say."""
    rows = records(spark, sf).where("gnn_score >= 0")
    label = ((F.col("seq") % 97) / 97 < F.lit(0.25) + F.col("gnn_score") / 2).cast("int")
    found = calibrate.temperature(rows.select(calibrate.logit(F.col("gnn_score")).alias("z"), label.alias("y")))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("temperature", "loss_before", "loss_after")], (F.abs("gradient") < 1e-9).alias("settled"))


def lockfiles(spark: SparkSession, sf: str) -> DataFrame:
    """Lockfiles of version 1 or 2 as JSON, one for each of the orders' customers, read back."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", F.concat(F.lit("pkg"), (F.col("o_orderkey") % 50).cast("string")).alias("k")).distinct()
    entry = lambda before: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(F.lit(f'"{before}'), k, F.lit('":{"version":"1.0"}'))), ","), F.lit("}"))
    made = o.groupBy(F.col("o_custkey")).agg(entry("").alias("a"), entry("node_modules/x/node_modules/").alias("b"))
    raw = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"dependencies":'), "a", F.lit("}"))).otherwise(F.concat(F.lit('{"packages":'), "b", F.lit("}")))
    return packages.lockfile_dependencies(made.select(F.col("o_custkey").alias("lockfile_id"), raw.alias("raw")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "verdict_mix": lambda s, d: decided(s, d).groupBy("verdict", "path").agg(F.count("*").alias("n")),
    "verdict_hybrid": decided,
    "verdict_static_only": static_only,
    "rule_hits_by_rule": lambda s, d: hits(s, d).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("score").alias("score")),
    "rule_hits_by_severity": lambda s, d: hits(s, d).groupBy("severity", "origin").agg(F.count("*").alias("n")),
    "pkg_scores": lambda s, d: decide.rule_scores(hits(s, d)),
    "pkg_scores_replay": lambda s, d: decide.rule_scores(hits(s, d), REPLAY_WEIGHT, REPLAY_HARD),
    "file_rule_hits": lambda s, d: rules.file_hits(view(s, d, "files")).select("package_id", "rule_id", "file_path"),
    "package_facts": lambda s, d: rules.package_facts(view(s, d, "files"), view(s, d, "manifests")).select("package_id", "n_js", "n_lines", "reads", "sends"),
    "file_facts": file_facts,
    "typosquat_theta": lambda s, d: rules.typosquats(view(s, d, "manifests")),
    "near_names": near_names,
    "hook_relation": lambda s, d: rules.hook_relation(view(s, d, "files"), view(s, d, "manifests")).select("package_id", "hook", "command", F.size("sources").cast("long").alias("n_sources"), F.length(F.array_join("sources", "")).cast("long").alias("n_chars")),
    "manifest_hits": lambda s, d: rules.manifest_hits(view(s, d, "files"), view(s, d, "manifests")).select("package_id", "rule_id", F.col("file_path").alias("hook")),
    "metadata_risk": lambda s, d: rules.metadata_risk(view(s, d, "manifests")),
    "metadata_risk_popular": risk_of_near_names,
    "manifest_snippets": lambda s, d: rules.manifest_hits(view(s, d, "files"), view(s, d, "manifests")).where("snippet is not null").select("package_id", "rule_id", F.col("file_path").alias("hook"), "snippet"),
    "manifest_context": lambda s, d: signals.manifest_context(view(s, d, "manifests")).select("package_id", F.array_join("hooks", ",").alias("hooks"), "has_license", "has_repository", F.col("description_length").cast("long").alias("description_length"), F.col("dependencies").cast("long").alias("dependencies"), F.col("scripts").cast("long").alias("scripts")),
    "lifecycle_context": lambda s, d: signals.lifecycle_context(view(s, d, "files"), view(s, d, "manifests")),
    "evidence_lines": lambda s, d: decide.evidence(hits(s, d), decided(s, d)).groupBy("text").agg(F.count("*").alias("n")),
    "payload_json": lambda s, d: packages.payload(decided(s, d)),
    "confusion_3_systems": lambda s, d: evaluate.confusion(records(s, d)),
    "coverage": lambda s, d: evaluate.coverage(records(s, d)),
    "decision_buckets": lambda s, d: evaluate.bucket_counts(records(s, d)),
    "rule_saved_hurt": lambda s, d: evaluate.rule_effects(records(s, d)),
    "score_calibration": lambda s, d: evaluate.calibration(records(s, d)),
    "error_records": lambda s, d: evaluate.errors(records(s, d)).select("package_name", "kind", "category", "band", "profile"),
    "error_summary": lambda s, d: evaluate.error_summary(records(s, d)),
    "top_rules": lambda s, d: evaluate.top_rules(records(s, d)),
    "improvement_candidates": lambda s, d: evaluate.improvement_candidates(records(s, d)),
    "policy_sweep": swept,
    "policy_sweep_full": lambda s, d: sweep.sweep(records(s, d)).select("config_id", "tp", "fp", "fn", "tn"),
    "best_recall_at_precision": lambda s, d: sweep.best_recall(swept(s, d), PRECISIONS),
    "best_precision_at_recall": lambda s, d: sweep.best_precision(swept(s, d), RECALLS),
    "best_f1": lambda s, d: sweep.best_f1(swept(s, d)),
    "reachable_goals": lambda s, d: sweep.reachable(swept(s, d), GOALS),
    "threshold_sweep": lambda s, d: sweep.threshold_sweep(records(s, d)),
    "pr_curve_86": lambda s, d: sweep.threshold_sweep(records(s, d), 10, 95, 1).select("threshold", "precision", "recall"),
    "best_threshold": lambda s, d: sweep.best_threshold(sweep.threshold_sweep(records(s, d), 10, 95, 1), 0.3).unionByName(sweep.best_threshold(sweep.threshold_sweep(records(s, d), 10, 95, 1), 0.99)),
    "score_curve": lambda s, d: sweep.curve(records(s, d)).select("gnn_score", "tp", "fp"),
    "ranking_metrics": lambda s, d: sweep.ranking_metrics(records(s, d)),
    "score_histogram": lambda s, d: evaluate.histogram(records(s, d)),
    "class_bins": lambda s, d: evaluate.class_bins(records(s, d)),
    "class_cube": lambda s, d: evaluate.class_cube(records(s, d)),
    "metric_table": lambda s, d: evaluate.metric_table(records(s, d)),
    "run_metadata": lambda s, d: evaluate.run_metadata(records(s, d)),
    "temperature": temperature,
    "class_score_stats": lambda s, d: evaluate.class_stats(records(s, d)),
    "fn_bands": lambda s, d: evaluate.missed_bands(records(s, d)),
    "signal_impact": lambda s, d: signals.impact(records(s, d), signals.context_signals()),
    "lifecycle_impact": lambda s, d: signals.impact(records(s, d), signals.lifecycle_signals()),
    "harmless_signals": lambda s, d: signals.harmless(records(s, d), signals.context_signals()),
    "combined_signals": lambda s, d: signals.combined(records(s, d), signals.context_signals() + signals.lifecycle_signals()),
    "mid_gnn_hook_slice": lambda s, d: signals.mid_slice(records(s, d)),
    "hard_examples": lambda s, d: signals.hard_examples(records(s, d)),
    "run_diff_metrics": lambda s, d: evaluate.metric_deltas(*runs(s, d)),
    "run_diff_buckets": lambda s, d: evaluate.bucket_shift(*runs(s, d)),
    "verdict_changes": lambda s, d: evaluate.verdict_changes(*shifted(s, d)).groupBy("before", "after", "change").agg(F.count("*").alias("n")),
    "campaign_split": lambda s, d: dataset.campaign_split(view(s, d, "items")),
    "split_stats": lambda s, d: dataset.split_stats(dataset.campaign_split(view(s, d, "items"))),
    "split_leaks": lambda s, d: dataset.leaks(dataset.campaign_split(view(s, d, "items"))),
    "naive_split_leaks": lambda s, d: dataset.leaks(view(s, d, "items").withColumn("split", F.col("item_id") % 3)),
    "split_summary": lambda s, d: dataset.split_summary(graph_files(s, d)),
    "graph_filter_summary": lambda s, d: dataset.graph_filter(view(s, d, "items").select(F.col("item_id").alias("graph_id"), "nodes", "label")),
    "node_budget_batches": lambda s, d: dataset.budget_batches(view(s, d, "items").select(F.col("item_id").alias("graph_id"), "nodes")),
    "focal_loss": lambda s, d: dataset.focal_loss(records(s, d).where("gnn_score >= 0").select(F.col("gnn_score").alias("p"), F.col("true_label").alias("y"))),
    "cfg_next": lambda s, d: graph.sequential_flow(view(s, d, "statements")),
    "def_use_asof": lambda s, d: graph.latest_before(view(s, d, "calls").where("event_type = 'signup'"), view(s, d, "calls").where("event_type = 'view'")).fillna(-1, "def_id"),
    "taint_flags": lambda s, d: graph.taint_flags(view(s, d, "files").select("package_id", F.xxhash64("path").alias("node_id"), F.lit("call_expression").alias("type"), F.col("code").alias("text"))).groupBy("flag", "detail").agg(F.count("*").alias("n")),
    "odd_manifests": odd_manifests,
    "subtree_ends": lambda s, d: flow.subtree_ends(view(s, d, "tree")),
    "def_use_scopes": lambda s, d: flow.def_use_scopes(view(s, d, "tree")),
    "cfg_edges": lambda s, d: flow.cfg_edges(view(s, d, "tree")).groupBy("package_id", "src", "dst", "edge_type").agg(F.count("*").alias("n")),
    "cfg_exits": lambda s, d: flow.exits(view(s, d, "tree")),
    "node_type_index": lambda s, d: view(s, d, "statements").groupBy(graph.type_index(F.col("type")).alias("type_index")).agg(F.count("*").alias("n")),
    "merged_edges": lambda s, d: graph.merge_edges(one_package(s, d), inner_edges(s, d).select("package_id", "src", "dst", "edge_type")),
    "edge_hist": lambda s, d: graph.edge_histogram(view(s, d, "edges")),
    "message_pass_1hop": lambda s, d: graph.message_pass(one_package(s, d), inner_edges(s, d)).select("node_id", F.posexplode("h").alias("k", "x")).select("node_id", F.col("k").cast("long").alias("k"), (F.round("x", 4) + F.lit(0.0)).alias("x")),
    "graph_pooling": lambda s, d: graph.pooled(nodes(s, d)).select("package_id", F.col("k").cast("long").alias("k"), *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("mean", "total", "most")]),
    "graph_vectors": graph_vectors,
    "network_scores": network_scores,
    "node_cap": lambda s, d: graph.cap_nodes(view(s, d, "files").select("package_id", "path", T.lines(F.col("code")).cast("long").alias("nodes")), 40),
    "lockfile_audit": lambda s, d: serve.lockfile_audit(view(s, d, "dependencies"), view(s, d, "part_verdicts")),
    "lockfile_results": lockfile_results,
    "lockfile_dependencies": lockfiles,
    "proxy_actions": lambda s, d: proxy_log(s, d).groupBy("kind", "action").agg(F.count("*").alias("n")),
    "ttl_cache_hits": lambda s, d: serve.cache_hits(view(s, d, "requests")),
    "dashboard_counts": lambda s, d: serve.dashboard(proxy_log(s, d).withColumn("event", F.when(F.col("action") == "block", "block").when(F.col("action") == "forward", "scan_complete").otherwise("other"))),
    "hourly_blocks": lambda s, d: serve.hourly(proxy_log(s, d)),
    "client_sessions": lambda s, d: serve.sessions(view(s, d, "requests")),
    "tarball_url": spec_table,
    "first_seen_versions": lambda s, d: packages.first_of_each(view(s, d, "requests").select("key", "event_id", "verdict"), ["key"], ["event_id"]),
    "rule_lines": lambda s, d: rules.file_hits(view(s, d, "files")).select("package_id", "rule_id", "file_path", F.coalesce("line_number", F.lit(0)).cast("long").alias("line_number"), "snippet"),
    "decision_labels": lambda s, d: with_manifest(s, d).groupBy(decide.decision_label(F.col("hybrid_verdict"), F.col("decision_path")).alias("label")).agg(F.count("*").alias("n")),
    "phase_labels": lambda s, d: evaluate.diagnostic_records(with_manifest(s, d)).groupBy("true_label", "phase_label").agg(F.count("*").alias("n")),
    "diagnostic_records": lambda s, d: evaluate.diagnostic_records(with_manifest(s, d)).withColumn("rules_matched", F.array_join("rules_matched", ",")),
    "replayed_records": lambda s, d: decide.replayed(records(s, d)).select("package_name", "hybrid_verdict", "confidence", "decision_bucket", "decision_path", "v2_weighted_rule_score", "v2_hard_rule_score"),
    "package_context": lambda s, d: signals.package_context(with_manifest(s, d, signals.manifest_traits(given_manifests(s, d)).drop("raw"))).withColumns({"lifecycle_hooks": F.array_join("lifecycle_hooks", ","), "rule_ids": F.array_join("rule_ids", ",")}),
    "error_shapes": lambda s, d: evaluate.manifest_shape(evaluate.errors(with_manifest(s, d), "raw")).select("package_name", "kind", "has_package_json", "package_json_error", F.array_join("script_hooks", ",").alias("script_hooks"), "dependency_count", "has_repository", "has_license", "description_length"),
    "evaluation_summary": lambda s, d: evaluate.summary(records(s, d)),
    "evaluation_report": lambda s, d: evaluate.report(records(s, d)),
    "evaluation_targets": targets,
    "missed_rules": lambda s, d: evaluate.missed_rules(records(s, d)),
    "class_separation": lambda s, d: evaluate.separation(records(s, d)),
    "optimal_thresholds": lambda s, d: sweep.find_thresholds(records(s, d)),
    "best_config": lambda s, d: sweep.best_config(swept(s, d), 0.33),
    "compact_errors": lambda s, d: sweep.compact(records(s, d), {"direct": 0.9, "confirm": 0.5, "weighted": 2.0, "hard_min_gnn": 0.35, "hard": 5.0}),
    "mid_slice_errors": lambda s, d: signals.mid_slice_errors(records(s, d)),
    "signal_outcome": lambda s, d: signals.verdict_on_signals(records(s, d), signals.context_signals() + signals.lifecycle_signals()),
    "scan_payloads": answers,
    "block_bodies": blocked,
    "log_events": lambda s, d: serve.log_events(proxy_log(s, d), "warn").groupBy("event", "level").agg(F.count("*").alias("n")).unionByName(serve.log_events(proxy_log(s, d)).where("level = 'info'").groupBy("event", "level").agg(F.count("*").alias("n"))),
    "failure_taxonomy": lambda s, d: dataset.failure_taxonomy(builds(s, d).where("status = 'failure'")),
    "build_failures": lambda s, d: packages.failures(builds(s, d)),
    "split_shape": lambda s, d: dataset.split_shape(dataset.campaign_split(view(s, d, "items")), view(s, d, "items").withColumn("edges", F.floor(F.col("nodes") * 1.5))),
    "hook_network": lambda s, d: view(s, d, "manifests").select("package_id", T.network_in_hook(F.col("raw")).alias("network")),
    "rule_titles": lambda s, d: hits(s, d).groupBy("rule_id").agg(F.count("*").alias("n")).select(T.rule_title(F.col("rule_id")).alias("title"), "n"),
    "archive_samples": archive_samples,
    "found_packages": found_packages,
    "popular_names": lambda s, d: packages.popular_names(s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))),
    "build_queue": queue,
    "packages_with_code": lambda s, d: packages.with_code(view(s, d, "manifests").select("package_id"), view(s, d, "files").where("path <> 'index.js'")),
    "node_flags": lambda s, d: graph.node_flags(code_nodes(s, d)),
    "node_features": lambda s, d: graph.node_features(code_nodes(s, d)).select("package_id", F.posexplode("features").alias("k", "x")).groupBy("package_id", F.col("k").cast("long").alias("k")).agg(F.sum("x").alias("total")),
    "package_vectors": vectors,
    "graph_states": graph_states,
}
