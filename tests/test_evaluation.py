"""Labels, sweeps, thresholds, reports and sinks against small models in Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import catalog, decide, evaluate, serve, sweep
from sievework.operators.rules import FILE_RULES
from sievework.plans.testbed import MANIFESTS, SNIPPETS
from sievework.sources import packages

RECORD = "package_name string, true_label int, gnn_score double, weighted double, hard_score double, rules_score double, rules_verdict string, hybrid_verdict string, decision_bucket string, rules_matched array<string>, cpg_status string, gnn_error_type string, metadata_risk double"


def records(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice([-1.0, 0.2, 0.35, 0.45, 0.5, 0.55, 0.78, 0.8, 0.81, 0.9, 0.99, 1.0, round(rng.random(), 3)])
        rules = rng.sample(sorted(catalog.LIVE_WEIGHT), rng.randrange(4))
        rows.append((f"p{i}", rng.randrange(2), g, rng.choice([0.0, 0.4, 1.0, 2.5, 6.0, 13.0]), rng.choice([0.0, 2.0, 5.0, 9.0, 15.0]), rng.choice([0.0, 3.0, 8.0, 12.0, 20.0]), "clean", rng.choice(["malicious", "suspicious", "clean"]), "b", rules, "success", None, 0.1))
    return rows, spark.createDataFrame(rows, RECORD)


def test_needles_leave_no_match_out(spark):
    parts = SNIPPETS + MANIFESTS + ["X.REQUEST (", "GOT (", "Fetch\n(", "id_rsa", "10.20.30.40", "CMD /c", "x |\tsh", "node -e https", "new Socket", "dgram.Socket", "\\x41" * 12, "registry.NPMJS.org", "npmjs.org", "RM (__FILENAME", "fs.unlink(process.argv [1", "os.userInfo", "é ReadFile (", "writeFileSync (", "dns . lookup("]
    df = spark.createDataFrame([(x,) for x in [*parts, None, ""]], "x string")
    names = sorted({*T.NEEDLES, *T.STRINGS, *(n for _, ns in FILE_RULES for n in ns)})
    got = df.select("x", *[T.has(F.col("x"), n).alias(n) for n in names], *[F.col("x").rlike(T.pattern(n)).alias(f"plain_{n}") for n in names]).collect()
    for r in got:
        assert [n for n in names if r[n] != r[f"plain_{n}"]] == [], r["x"]
    assert sum(r[n] or 0 for r in got for n in names) > 60


def test_entropy_of_whole_texts(spark):
    rng = random.Random(2)
    texts = ["", "a", "ab", "é" * 40 + "🎉", "a\n" * 5000, "".join(rng.choice("abcdefgh\n 0") for _ in range(3000))]
    import math
    from collections import Counter

    want = [0.0 if len(t) < 2 else round(-sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()), 6) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", T.entropy(F.col("t")).alias("e")).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=2e-6)


def test_sweep_equals_the_policy_applied_to_each_record(spark):
    rows, df = records(spark)
    axes = {"direct": [0.8, 0.9, 1.01], "confirm": [0.35, 0.5], "weighted": [1.0, 6.0], "hard_min_gnn": [0.0, 0.45], "hard": [2.0, 10.0]}
    got = {tuple(r[f"{k}_from"] for k in axes): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in sweep.sweep(df, axes).collect()}
    assert len(got) == 48
    for d, c, w, m, h in itertools.product(*axes.values()):
        cells = {(y, p): 0 for y in (0, 1) for p in (0, 1)}
        for _, y, g, a, b, *_ in rows:
            cells[y, int(g >= 0 and (g >= d or (g >= c and a >= w) or (g >= m and b >= h)))] += 1
        assert got[d, c, w, m, h] == (cells[1, 1], cells[0, 1], cells[1, 0], cells[0, 0])
    empty = sweep.sweep(df.where("false"), axes).collect()
    assert len(empty) == 48 and {r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in empty} == {0}


def test_curve_in_cells_is_the_whole_curve(spark):
    rows, df = records(spark, 300, 3)
    want, tp, fp = [], 0, 0
    for s in sorted({r[2] for r in rows if r[2] >= 0}, reverse=True):
        tp, fp = tp + sum(r[1] for r in rows if r[2] == s), fp + sum(1 - r[1] for r in rows if r[2] == s)
        want.append((s, tp, fp))
    for cells in (1, 7, 1024):
        assert sorted(((r["gnn_score"], r["tp"], r["fp"]) for r in sweep.curve(df, cells).collect()), reverse=True) == want
    one = sweep.ranking_metrics(df.where("gnn_score < 0")).collect()[0]
    assert (one["roc_auc"], one["recall_at_99p"], one["threshold_at_999p"]) == (0.0, 0.0, 1.0)


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.95), (1, 0.80), (0, 0.70), (0, 0.10)], "true_label int, gnn_score double")
    got = {r["strategy"]: r["threshold"] for r in sweep.find_thresholds(df).collect()}
    assert got["precision99"] == got["precision999"] == 0.701 and got["f1"] == got["recall95"] == 0.71
    with pytest.raises(ValueError):
        sweep.best_config(sweep.sweep(records(spark)[1], {"direct": [1.01], "confirm": [1.01], "weighted": [1.0], "hard_min_gnn": [1.01], "hard": [2.0]}), 0.99)


def test_decision_labels(spark):
    cases = [
        ("clean", "GNN unavailable", "gnn_unavailable_clean"), ("clean", None, "clean_pass"), ("malicious", "V2 direct GNN block: .9", "v2_gnn_direct_block"), ("malicious", "x", "malicious_block"),
        ("suspicious", "v2 review: low GNN", "v2_low_gnn_review"), ("suspicious", "some rule", "static_evidence_review"), ("error", "x", "uncertain_review"), (None, "GNN unavailable", "gnn_unavailable_review"),
    ]
    df = spark.createDataFrame(cases, "v string, p string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", decide.decision_label(F.col("v"), F.col("p")).alias("got")).collect())
    assert len({label for *_, label in catalog.DECISION_LABELS}) == 20


def test_summary_and_report(spark):
    rows, df = records(spark, 50, 4)
    got = {(r["section"], r["name"]): r["value"] for r in evaluate.summary(df).collect()}
    assert got["counts", "total_packages"] == 50 and got["counts", "malicious_packages"] == sum(r[1] for r in rows)
    assert got["metrics", "hybrid.tp"] == sum(r[1] == 1 and r[7] == "malicious" for r in rows)
    lines = [r["line"] for r in evaluate.report(df).where("section = 'metrics'").collect()]
    assert len(lines) == 3 and all(re.fullmatch(r"\| \w+ \| [01]\.\d{4} \| [01]\.\d{4} \| [01]\.\d{4} \| \d+ \| \d+ \| \d+ \| \d+ \|", x) for x in lines)


def test_manifest_shapes(spark):
    df = spark.createDataFrame([(1, None), (2, "{bad"), (3, '{"scripts":{"install":"x","prepare":"y"},"dependencies":{"a":"1"},"license":"MIT","description":"abc"}')], "i int, raw string")
    got = {r["i"]: (r["has_package_json"], r["package_json_error"], r["script_hooks"], r["dependency_count"], r["has_license"], r["description_length"]) for r in evaluate.manifest_shape(df).collect()}
    assert got == {1: (False, False, [], 0, False, 0), 2: (True, True, [], 0, False, 0), 3: (True, False, ["install", "prepare"], 1, True, 3)}


def test_targets_keep_the_first_and_shuffle_by_seed(spark):
    a = spark.createDataFrame([(f"p{i}", i % 2, "dir") for i in range(40)], "path string, label int, kind string")
    b = spark.createDataFrame([("p1", 1, "dir"), ("p1", 1, "tarball"), ("q", 0, "dir")], a.schema)
    every = evaluate.unite_targets([a, b]).collect()
    assert len(every) == 42 and {r["source"] for r in every if r["path"] == "p1" and r["kind"] == "dir"} == {0}
    few = [{r["path"] for r in evaluate.unite_targets([a, b], seed, 5).collect()} for seed in (1, 1, 2)]
    assert few[0] == few[1] != few[2] and len(few[0]) == 10


def test_sinks(spark, tmp_path):
    built = spark.createDataFrame([("a", "failure", "x", "m, \"q\"", 1), ("b", "success", "", "", 2), ("c", "failure", "y", "n", 3)], "package_path string, status string, error_type string, error_message string, num_js_files int")
    for _ in range(2):
        packages.write_failures(built, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '\\').csv(f"{tmp_path}/csv")
    assert back.columns == ["package_path", "error_type", "error_message", "num_js_files"] and back.count() == 4
    packages.write_splits(spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(30)], "graph_id long, split string"), f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits").where("split = 'test'").count() == 10


def test_log_levels_and_closed_failures(spark):
    log = spark.createDataFrame([("a", "malicious", "block"), ("b", "clean", "forward"), ("c", "error", "fail_closed"), ("d", "clean", "skip_scan"), ("e", "clean", "passthrough")], "key string, verdict string, action string")
    got = sorted((r["key"], r["event"], r["level"]) for r in serve.log_events(log).collect())
    assert got == [("a", "block", "warn"), ("a", "scan_complete", "warn"), ("b", "scan_complete", "info"), ("c", "fail_closed", "warn"), ("c", "scan_complete", "info"), ("d", "scan_skipped", "warn")]
    assert {r["level"] for r in serve.log_events(log, "warn").collect()} == {"warn"}


def test_cache_reads_a_key_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(3)}", i, rng.randrange(0, 400_000), rng.choice(["clean", "clean", "error"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, event_id long, t long, verdict string").withColumn("ts", F.timestamp_seconds("t"))
    since, want = {}, {}
    for k, i, t, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[i] = k in since and t - since[k] <= 86_400
        if not want[i] and v != "error":
            since[k] = t
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        assert {r["event_id"]: r["cached"] for r in serve.cache_hits(df).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
