"""Sources, service, graph and streaming operators on small inputs."""

import hashlib
import io
import json
import math
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import calibrate, dataset, evaluate, graph, rules, serve, signals
from sievework.sources import packages
from sievework.streaming import proxy


def archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("package/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    return out.getvalue()


def test_archives(spark, tmp_path):
    made = {
        "a-1.tgz": archive([("package/package.json", b'\xef\xbb\xbf{"name":"a"}'), ("package/lib/x.js", b"a\r\nb\xff"), ("package/node_modules/y.js", b"")]),
        "flat-1.tgz": archive([("index.js", b"1"), ("package.json", b"[1]")]), "evil-1.tgz": archive([("package/../../x.js", b"1")]), "bad-1.tgz": b"nothing", "big-1.tgz": archive([("package/z.js", b"\0" * 10)]) + b"\0" * 5000,
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    files = packages.read_archives(spark, str(tmp_path), 4000)
    assert {r["package_id"]: r["status"] for r in files.collect()} == {"a-1.tgz": "ok", "flat-1.tgz": "ok", "evil-1.tgz": "unsafe", "bad-1.tgz": "corrupt", "big-1.tgz": "too_large"}
    ok = files.where("status = 'ok'")
    assert sorted((r["package_id"], r["path"], r["code"]) for r in packages.source_files(ok).collect()) == [("a-1.tgz", "lib/x.js", "a\nb�"), ("flat-1.tgz", "index.js", "1")]
    assert {r["package_id"]: r["raw"] for r in packages.read_manifests(ok).collect()} == {"a-1.tgz": '{"name":"a"}', "flat-1.tgz": "{}"}


def test_lockfiles(spark):
    rows = [(1, '{"dependencies":{"a":{"version":"1"},"@s/b":{"version":"2"}}}'), (2, '{"packages":{"":{"version":"0"},"node_modules/a":{"version":"1"},"node_modules/a/node_modules/@s/b":{"version":"3"}}}'), (3, "{}"), (4, None)]
    got = packages.lockfile_dependencies(spark.createDataFrame(rows, "lockfile_id long, raw string")).collect()
    assert sorted(map(tuple, got)) == [(1, "@s/b", "2"), (1, "a", "1"), (2, "@s/b", "3"), (2, "a", "1")]


def test_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","event":"block"}\nnot json\n')
    assert [r["event"] for r in packages.read_log(spark, str(tmp_path)).collect()] == ["block"]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.parse_tarball_path(F.lit("/@a%2fb/-/b-1.2.tgz")).alias("p"), T.parse_tarball_path(F.lit("/b/latest")).alias("q"), T.parse_spec(F.lit("@a/b@1.0")).alias("s"), T.entropy(F.lit("aabb")).alias("e"), T.entropy(F.lit("a")).alias("z"),
        T.is_base64(F.lit("QUJD")).alias("b"), T.is_base64(F.lit("QUJDR")).alias("c"), T.line_of(F.lit("🎉\n🎉 fetch("), "net_send").alias("l"), packages.labelled_path(F.lit("a:b:1")).alias("lp"), T.hook_targets(F.lit("node a.js && node b.mjs; node a.js")).alias("t"),
    ).first()
    assert (row["p"]["name"], row["p"]["version"], row["q"]) == ("@a/b", "1.2", None)
    assert (row["s"]["name"], row["s"]["version"], row["e"], row["z"], row["b"], row["c"], row["l"]) == ("@a/b", "1.0", 1.0, 0.0, True, False, 2)
    assert (row["lp"]["path"], row["lp"]["label"], row["t"]) == ("a:b", 1, ["a.js", "b.mjs"])


def test_control_flow(spark):
    rows = [(1, 0, None, "program"), (1, 1, 0, "expression_statement"), (1, 2, 0, "if_statement"), (1, 7, 0, "lexical_declaration")]
    nodes = spark.createDataFrame(rows, "package_id long, node_id long, parent_id long, type string")
    assert sorted((r["src"], r["dst"]) for r in graph.sequential_flow(nodes).collect()) == [(1, 2), (2, 7)]


def test_fail_closed_blocks_errors(spark):
    row = spark.range(1).select(*[serve.action(F.lit("tarball"), F.lit("error"), F.lit(1), 10, c).alias(str(c)) for c in (True, False)]).first()
    assert tuple(row) == ("fail_closed", "fail_open")


def test_lifecycle(spark):
    files = spark.createDataFrame([(1, "build.js", "exec('curl x')")], "package_id long, path string, code string")
    raw = [(1, '{"scripts":{"postinstall":"node ./build.js"}}'), (2, '{"scripts":{"install":"node-gyp rebuild"}}'), (3, "{}")]
    got = {r["package_id"]: (r["risk_score"], r["build"]) for r in signals.lifecycle_context(files, spark.createDataFrame(raw, "package_id long, raw string")).collect()}
    assert got == {1: (2, False), 2: (0, True)}


def test_confusion_cells(spark):
    rows = [(1, 0.9, "malicious"), (0, 0.9, "malicious"), (1, 0.1, "clean"), (0, 0.1, "clean")]
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "true_label int, gnn_score double, hybrid_verdict string, rules_verdict string")
    assert {(r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"]) for r in evaluate.confusion(df).collect()} == {(1, 1, 1, 1, 0.5, 0.5)}


EVENTS = [(1, "2024-01-01T00:00:00Z", "a", "clean"), (2, "2024-01-01T01:00:00Z", "a", "clean"), (3, "2024-01-02T02:00:00Z", "a", "clean"), (4, "2024-01-01T00:00:00Z", "b", "error"), (5, "2024-01-01T00:05:00Z", "b", "clean"), (6, "2024-01-01T00:06:00Z", "b", "clean")]


def stream(spark, folder):
    for i, (e, ts, key, verdict) in enumerate(EVENTS):
        (folder / f"{i}.json").write_text(json.dumps({"event_id": e, "ts": ts, "key": key, "kind": "tarball", "verdict": verdict, "size": 1}))
    return proxy.requests(spark, str(folder))


def run(df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


@pytest.fixture
def rocksdb(spark):
    name, value = proxy.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


def test_streamed_cache_agrees_with_batch(spark, tmp_path, rocksdb):
    (tmp_path / "in").mkdir()
    got = {r["event_id"]: r["cached"] for r in run(proxy.cached(stream(spark, tmp_path / "in")), "cached", tmp_path)}
    batch = spark.createDataFrame(EVENTS, "event_id long, ts string, key string, verdict string").withColumn("ts", F.to_timestamp("ts"))
    assert got == {r["event_id"]: r["cached"] for r in serve.cache_hits(batch).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_parts_of_a_key_are_read_in_order(spark, tmp_path, rocksdb):
    """Rows of one key in many Arrow parts, latest first, then a second micro-batch that needs the state."""
    rows = [(i, f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00Z", "k", ["clean", "error"][i % 7 == 0]) for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, ts string, key string, verdict string").withColumn("ts", F.to_timestamp("ts"))
    want = {r["event_id"]: r["cached"] for r in serve.cache_hits(batch, 1000).collect()}
    (tmp_path / "in").mkdir()
    for part, lines in enumerate([rows[:120][::-1], rows[120:][::-1]]):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"event_id": e, "ts": ts, "key": k, "kind": "tarball", "verdict": v, "size": 1}) for e, ts, k, v in lines))
        os.utime(tmp_path / "in" / f"{part}.json", (1e9 + part, 1e9 + part))  # files go by their time
    source = spark.readStream.schema(proxy.REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = {r["event_id"]: r["cached"] for r in run(proxy.cached(source, 1000), "parts", tmp_path)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and 0 < sum(want.values()) < len(want)


def test_streamed_dashboard_equals_batch(spark, tmp_path):
    """After late and repeated lines the newest row is what the batch dashboard counts."""
    rows = [(i, f"2024-01-01T{(i * 7) % 24:02d}:00:00Z", f"k{i % 5}", "tarball" if i % 3 else "metadata", ["clean", "malicious", "suspicious", "error"][i % 4], i) for i in range(60)]
    names = ["event_id", "ts", "key", "kind", "verdict", "size"]
    (tmp_path / "in").mkdir()
    for part in range(4):
        lines = [r for r in rows if r[0] % 3 == part % 3]  # the last part repeats the first
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in lines))
    source = spark.readStream.schema(proxy.REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    proxy.write_dashboard(proxy.dashboard(proxy.actions(source)), str(tmp_path / "out"), str(tmp_path / "c"), None).awaitTermination()
    got = spark.read.json(str(tmp_path / "out" / "latest")).first()
    log = spark.createDataFrame(rows, names).withColumn("action", serve.action(F.col("kind"), F.col("verdict"), F.col("size"), 50 << 20))
    log = log.withColumn("event", F.when(F.col("action") == "block", "block").when(F.col("action") == "forward", "scan_complete").otherwise("other"))
    want = serve.dashboard(log).first()
    assert {c: got[c] for c in want.asDict()} == want.asDict() and got["batch"] >= 3


def test_streamed_windows_and_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = stream(spark, tmp_path / "in")
    counts = run(proxy.windowed(proxy.actions(source)), "counts", tmp_path, "complete")
    assert sum(r["n"] for r in counts) == 6 and {r["action"] for r in counts} == {"forward", "fail_open"}
    assert {r["key"] for r in run(proxy.first_scans(source), "firsts", tmp_path)} == {"a", "b"}
    proxy.write_batches(proxy.actions(source), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_uploads_by_extension(spark, tmp_path):
    for name in ("a.tgz", "b.tar.gz", "c.zip"):
        (tmp_path / name).write_bytes(archive([("package/index.js", b"1")]))
    got = {r["package_id"]: (r["status"], r["path"]) for r in packages.read_archives(spark, str(tmp_path), uploads=True).collect()}
    assert got == {"a.tgz": ("ok", "index.js"), "b.tar.gz": ("ok", "index.js"), "c.zip": ("invalid", None)}
    assert {r["package_id"] for r in packages.read_archives(spark, str(tmp_path)).collect()} == {"a.tgz"}


def test_newest_lines_first(spark, tmp_path):
    lines = [("2024-01-01T00:00:00Z", "a"), ("2024-01-03T00:00:00Z", "b"), ("2024-01-02T00:00:00Z", "c"), ("2024-01-03T00:00:00Z", "d")]
    (tmp_path / "a.jsonl").write_text("\n".join(["{broken", *(json.dumps({"timestamp": t, "event": e}) for t, e in lines)]))
    assert [r["event"] for r in packages.read_log(spark, str(tmp_path)).collect()] == ["d", "b", "c", "a"]


def test_failed_scans_are_tried_again(spark):
    asks = spark.createDataFrame([(k, n, "1") for k in range(3) for n in "abc"] + [(0, "a", "1")], "lockfile_id long, name string, version string")
    known = spark.createDataFrame([("a", "clean", None), ("b", "clean", "timeout")], "name string, verdict string, error_msg string")
    got = {r["name"]: (r["verdict"], r["error_msg"], r["asked"], r["scans"]) for r in serve.lockfile_results(asks, known).collect()}
    assert got == {"a": ("clean", None, 3, 1), "b": ("error", "timeout", 3, 3), "c": ("error", "Download failed", 3, 3)}


def test_names_at_most_two_edits_from_popular_ones(spark):
    listed = spark.createDataFrame([("lodash",), ("react",), ("ab",), (None,)], "name string")
    names = ["lodash", "lodahs", "lodas", "@s/lodahs", "vue", "reactxyz", "b", "", None]
    raw = [(i, json.dumps({"name": n, "license": "MIT", "repository": "x", "description": "d" * 20})) for i, n in enumerate(names)]
    got = {names[r["package_id"]]: r["risk"] for r in rules.metadata_risk(spark.createDataFrame(raw, "package_id long, raw string"), listed).collect()}
    assert got == {"lodash": 0.0, "lodahs": 0.3, "lodas": 0.3, "@s/lodahs": 0.0, "vue": 0.0, "reactxyz": 0.0, "b": 0.3, "": 0.3, None: 0.0}


def test_split_summary(spark, monkeypatch):
    schema = "split string, graph_id long, name string, size long, mtime long, nodes long, label int"
    files = [("a", i, f"{i}.pt", 10, 1, n, i % 2) for i, n in enumerate([5, 1, 60_000, 7, None])] + [("b", 9, None, None, None, 1, 1)]
    df = spark.createDataFrame(files, schema)
    got = {r["split"]: r.asDict() for r in dataset.split_summary(df).collect()}
    inner = hashlib.sha256(b"0.pt:10:1:5:0\n3.pt:10:1:7:1").hexdigest()
    assert got["a"] == {"split": "a", "raw_files": 5, "total": 2, "skipped": 3, "malicious": 1, "benign": 1, "avg_nodes": 6.0, "max_nodes": 7, "fingerprint": hashlib.sha256(inner.encode()).hexdigest()}
    assert (got["b"]["total"], got["b"]["avg_nodes"], got["b"]["max_nodes"], got["b"]["fingerprint"]) == (0, 0.0, 0, hashlib.sha256(b"").hexdigest())
    monkeypatch.setattr(dataset, "WIDTH", 1)  # the same files in blocks of one
    assert {r["fingerprint"] for r in dataset.split_summary(df.repartition(5)).where("split = 'a'").collect()} != {got["a"]["fingerprint"]}
    changed = spark.createDataFrame([(*f[:4], 2, *f[5:]) if f[1] == 3 else f for f in files], schema)
    assert dataset.split_summary(changed).where("split = 'a'").first()["fingerprint"] != got["a"]["fingerprint"]


def test_temperature(spark):
    """Labels drawn from softened scores: the optimum is found, its gradient is nothing, and no neighbour has less loss."""
    rows = [(z / 4, int((k * 37) % 100 < 100 / (1 + 2.718281828 ** (-z / 12)))) for z in range(-20, 21) for k in range(100)]
    got = calibrate.temperature(spark.createDataFrame([*rows, (None, 1), (1.0, None)], "z double, y int")).first()
    loss = lambda t: sum(max(z / t, 0) - z / t * y + math.log1p(math.exp(-abs(z / t))) for z, y in rows) / len(rows)
    assert got["n"] == len(rows) and got["settled"] and abs(got["gradient"]) <= 1e-9 and 2.5 < got["temperature"] < 3.5
    assert abs(got["loss_after"] - loss(got["temperature"])) < 1e-9 < min(loss(got["temperature"] * f) - got["loss_after"] for f in (0.99, 1.01)) and got["loss_before"] > got["loss_after"]


def test_temperature_without_an_optimum(spark):
    of = lambda rows, **kw: calibrate.temperature(spark.createDataFrame(rows, "z double, y int"), **kw).first()
    assert of([])["temperature"] is None and of([])["n"] == 0
    assert of([(1.0, 0), (-1.0, 1)])["temperature"] is None  # wrong way round
    apart = of([(1.0, 1), (-1.0, 0)], rounds=8)
    assert apart["temperature"] < 1 and not apart["settled"] and apart["rounds"] == 8


def test_observed_counts_are_of_the_evaluated_rows(spark):
    rows = [(1, 0.9, "malicious"), (0, -1.0, "clean"), (1, 0.1, "suspicious"), (0, 0.2, "clean")]
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "true_label int, gnn_score double, hybrid_verdict string, rules_verdict string")
    got = {r["name"]: r["value"] for r in evaluate.run_metadata(df).collect()}
    assert (got["packages"], got["malicious"], got["failures"], got["covered"], got["clean_verdicts"], got["hybrid.precision"], got["hybrid.recall"]) == (4, 2, 1, 3, 2, 1.0, 0.5)
    cube = {tuple(r)[:4]: (r["n"], r["wrong"]) for r in evaluate.class_cube(df).collect()}
    assert cube[None, None, None, 7] == (4, 1) and cube[1, None, None, 3] == (2, 1) and cube[None, -1, None, 5] == (1, 0) and cube[0, 2, "clean", 0] == (1, 0)


def test_sinks(spark, tmp_path):
    built = spark.createDataFrame([("a", "failure", "x", "no, \"js\" files", 0), ("b", "success", "", "", 2)], "package_path string, status string, error_type string, error_message string, num_js_files int")
    for _ in range(2):
        packages.write_failures(built, str(tmp_path / "failed"))
    got = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "failed"))
    assert got.columns == ["package_path", "error_type", "error_message", "num_js_files"] and [r["package_path"] for r in got.collect()] == ["a", "a"]
    graphs = spark.range(30).select(F.col("id").alias("graph_id"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    packages.write_splits(graphs, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).where("split = 'val'").count() == 10 and (tmp_path / "splits" / "split=val").is_dir()


def test_log_keeps_its_order_of_levels(spark):
    log = spark.createDataFrame([("k", "malicious", "block"), ("k", "clean", "forward"), ("k", "error", "fail_open")], "key string, verdict string, action string")
    assert sorted((r["event"], r["level"]) for r in serve.log_events(log, "warn").collect()) == [("block", "warn"), ("fail_open", "warn"), ("scan_complete", "warn")]
    assert serve.log_events(log).count() == 5
