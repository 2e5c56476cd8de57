"""Package context from manifests that many records share."""

from pyspark.sql import functions as F

from sievework.operators import signals
from sievework.plans.queries import QUERIES

RAW = [
    None, "", "{", "[1]", "{}", '{"name":"","description":""}', '{"name":"@a/b","license":"MIT","repository":{},"description":"  ","scripts":{"prepare":"x","test":"y","install":"z"}}',
    '{"name":5,"license":false,"repository":{"url":"x"},"description":"a text","scripts":[],"dependencies":{"a":"1","b":"2"},"devDependencies":{"c":"3"}}', '{"name":"x","license":"","license":"MIT","scripts":{"postinstall":null}}',
]


def test_traits_of_shared_manifests(spark):
    """Records joined to their manifests' traits have the context of records that hold their manifests' text, and those without a manifest too."""
    rows = [(i, f"p{i}", i % (len(RAW) + 1), None if i % 5 == 0 else ["CRIT_REVERSE_SHELL", "MED_INSTALL_HOOK_EXISTS", "x"][: i % 4], None if i % 3 == 0 else 0.5) for i in range(200)]
    records = spark.createDataFrame(rows, "seq long, package_name string, m long, rules_matched array<string>, gnn_score double").withColumns({"metadata_risk": F.lit(None).cast("double"), **{c: F.lit(None).cast("int") for c in ("num_js_files", "num_nodes", "num_edges")}})
    manifests = spark.createDataFrame(list(enumerate(RAW)), "m long, raw string")  # the last records' manifest is missing
    shared = signals.package_context(records.join(signals.manifest_traits(manifests).drop("raw"), "m", "left"))
    alone = signals.package_context(records.join(manifests, "m", "left"))
    got, want = sorted(shared.collect(), key=lambda r: r["record"]), sorted(alone.collect(), key=lambda r: r["record"])
    assert shared.schema == alone.schema and got == want
    by = {r["record"]: r for r in got}
    assert [by["p6"][c] for c in ("package_name", "scoped", "has_license", "has_repository", "has_description", "description_length", "scripts_count", "lifecycle_hooks")] == ["@a/b", True, True, False, False, 2, 3, ["install", "prepare"]]
    assert [by["p9"][c] for c in ("package_name", "has_package_json", "has_license", "lifecycle_hooks", "dependency_count")] == ["p9", False, False, [], 0]
    assert [by["p7"][c] for c in ("package_name", "has_license", "has_repository", "scripts_count", "dependency_count", "dev_dependency_count")] == ["5", False, True, 0, 2, 1]


def test_json_is_read_by_manifest(spark):
    """The query reads no JSON where its rows are records."""
    plan = QUERIES["package_context"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    above, _, below = plan.partition("join leftouter")
    assert below and "json_object" not in above and "variant" not in above and "json_object" in below
