"""Flow over node tables, packing, ranks and typed manifests against plain versions of the same."""

import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions import cluster
from sievework.functions import text as T
from sievework.operators import dataset, flow, graph, rules
from sievework.plans import flow_oracle

NODES = "package_id long, node_id long, parent_id long, type string, text string"
KINDS = [
    "statement_block", "statement_block", "if_statement", "else_clause", "else", "try_statement", "catch_clause", "while_statement", "for_of_statement", "expression_statement", "expression_statement", "return_statement", "function_declaration",
    "arrow_function", "function_expression", "formal_parameters", "formal_parameters", "variable_declarator", "variable_declarator", "lexical_declaration", "identifier", "identifier", "identifier", "identifier", "comment", "(",
]


def random_tree(rng, package, n):
    """A tree in pre-order: each node's parent is on the path to the node before it."""
    path, rows = [0], [(package, 0, None, "program", "")]
    for i in range(1, n):
        path = path[: rng.randrange(max(1, len(path) - 3), len(path) + 1)]
        rows.append((package, i, path[-1], rng.choice(KINDS), rng.choice("abc")))
        path.append(i)
    return rows


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(11)
    return [r for p in range(60) for r in random_tree(rng, p, rng.randrange(1, 120))]


@pytest.mark.parametrize("name,operator", [("subtree_ends", flow.subtree_ends), ("def_use_scopes", flow.def_use_scopes), ("cfg_edges", flow.cfg_edges), ("cfg_exits", flow.exits)])
def test_random_trees_equal_sql(spark, trees, name, operator):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(trees, columns=["package_id", "node_id", "parent_id", "type", "text"]).astype({"parent_id": "Int64"}))
    want = con.execute(flow_oracle.FLOW_SQL[name].replace(flow_oracle.TREE, "tree AS MATERIALIZED (SELECT * FROM given)"))
    names = [d[0] for d in want.description]
    got = operator(spark.createDataFrame(trees, NODES).repartition(5))
    if name == "cfg_edges":
        got = got.groupBy("package_id", "src", "dst", "edge_type").agg(F.count("*").alias("n"))
    got, want = sorted(tuple(r) for r in got.select(names).collect()), sorted(want.fetchall())
    assert len(want) > 50 and got == want


def test_chain_of_ten_thousand(spark):
    n = 10_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("package_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("identifier").alias("type"), F.lit("x").alias("text"))
    assert flow.subtree_ends(rows).agg(F.min("end_id"), F.count("*")).first()[:] == (n - 1, n)


def test_parent_of_all_others(spark, monkeypatch):
    """One node is the parent of all others, and its key is broadcast."""
    monkeypatch.setattr(cluster, "HOT_LEAST", 10)
    rows = spark.range(500).select(F.lit(1).cast("long").alias("package_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_id"), F.lit("comment").alias("type"), F.lit("").alias("text"))
    assert {(r["node_id"], r["end_id"]) for r in flow.subtree_ends(rows).collect()} == {(0, 499), *((i, i) for i in range(1, 500))}


def test_a_name_used_everywhere(spark):
    """20,000 definitions and 40,000 uses of one name in one package, inside and outside of functions: a product would have 800 million rows."""
    n, k = 20_000, F.col("id")
    piece = lambda o, up, kind, name="": F.struct((k * 8 + o).alias("node_id"), (k * 8 + up if up is not None else F.lit(0)).cast("long").alias("parent_id"), F.lit(kind).alias("type"), F.lit(name).alias("text"))
    rows = [piece(1, None, "function_declaration"), piece(2, 1, "identifier", "f"), piece(3, 1, "variable_declarator"), piece(4, 3, "identifier", "x"), piece(5, 1, "identifier", "x"), piece(6, None, "identifier", "x")]
    top = spark.createDataFrame([(1, 0, None, "program", ""), (1, -2, 0, "variable_declarator", ""), (1, -1, -2, "identifier", "x")], NODES)
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("package_id"), F.explode(F.array(*rows)).alias("r")).select("package_id", "r.*").unionByName(top)
    got = flow.def_use_scopes(nodes).where("dst > 0")
    inside, outside = (F.count_if((F.col("dst") % 8 == d) & (F.col("src") == s)) for d, s in ((5, F.col("dst") - 2), (6, F.lit(-2))))
    assert got.agg(inside, outside, F.count("*")).first()[:] == (n, n, 2 * n)


def sql_def_use(rows):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["package_id", "node_id", "parent_id", "type", "text"]).astype({"parent_id": "Int64"}))
    found = con.execute("SELECT package_id, src, dst FROM (" + flow_oracle.FLOW_SQL["def_use_scopes"].replace(flow_oracle.TREE, "tree AS MATERIALIZED (SELECT * FROM given)") + ")")
    return sorted(found.fetchall())


def test_packages_that_fit_a_task_are_shuffled_once(spark, trees):
    """One exchange of nodes, no join and no window."""
    nodes = spark.createDataFrame(trees, NODES)
    plan = flow.def_use_scopes(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("most", [0, 40])
def test_large_packages_are_spread(spark, monkeypatch, trees, most):
    monkeypatch.setattr(flow, "WHOLE", most)
    got = flow.def_use_scopes(spark.createDataFrame(trees, NODES).repartition(5)).select("package_id", "src", "dst")
    assert sorted(map(tuple, got.collect())) == sql_def_use(trees)


@pytest.mark.parametrize("chunk", [1, 50, 10_000])
def test_packages_over_several_batches(monkeypatch, chunk):
    """A package's rows stay together wherever batches end; deep nesting, names in other packages, and nodes without names change nothing."""
    monkeypatch.setattr(flow, "CHUNK", chunk)
    rng = random.Random(chunk)
    trees = [r for p in range(30) for r in random_tree(rng, p * 7, rng.randrange(1, 90))]
    level = lambda i: [(1, max(4 * i - 3, 0), "function_declaration", ""), (2, 4 * i + 1, "identifier", "ab"[i % 2]), (3, 4 * i + 1, "identifier", "abc"[i % 3]), (4, 4 * i + 1, "variable_declarator", "")]
    trees += [(999, 0, None, "program", "")] + [(999, 4 * i + o, up, kind, text) for i in range(100) for o, up, kind, text in level(i)]
    table = pa.table({c: pa.array([r[i] for r in trees], k) for i, (c, k) in enumerate([("package_id", pa.int64()), ("node_id", pa.int64()), ("parent_id", pa.int64())])} | {"role": pa.array([flow.ROLES.get(r[3], 0) for r in trees], pa.int8()), "name": pa.array([r[4] if r[3] == "identifier" else None for r in trees], pa.string())})
    got = sorted(tuple(r.values()) for b in flow.resolved(iter(table.to_batches(max_chunksize=17))) for r in b.to_pylist())
    assert len(got) > 50 and got == sql_def_use(trees)


def test_odd_nodes_of_small_packages(spark):
    """Null names and ids define and mean nothing, a parent that is missing or in a cycle counts as none, a repeated row counts once."""
    rows = [
        (1, 0, None, "program", ""), (1, 1, 0, "variable_declarator", ""), (1, 2, 1, "identifier", "x"), (1, 3, 0, "identifier", "x"), (1, 3, 0, "identifier", "x"), (1, 4, 0, "identifier", None), (1, 5, 77, "identifier", "x"),
        (None, 3, 0, "identifier", "x"), (1, None, 0, "identifier", "x"), (2, 3, None, "identifier", "x"), (3, 1, 2, "function_declaration", ""), (3, 2, 1, "comment", ""), (3, 3, 2, "identifier", "x"), (4, 1, None, "identifier", None),
    ]
    assert sorted(map(tuple, flow.def_use_scopes(spark.createDataFrame(rows, NODES)).collect())) == [(1, 1, 3), (1, 1, 5)]
    words = spark.createDataFrame([(str(r[0]), *r[1:]) for r in rows if r[0]], NODES.replace("package_id long", "package_id string"))
    assert sorted(map(tuple, flow.def_use_scopes(words).collect())) == [("1", 1, 3), ("1", 1, 5)]


def test_guesses_of_size_stay_short(spark, monkeypatch):
    """Spark's guess of a joined table's size is a product; its digits don't double with each round of pointers."""
    digits, settled = [], flow.settle
    monkeypatch.setattr(flow, "settle", lambda df: digits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()) or settled(df))
    level = lambda i: [(4 * i + 1, 0, "function_declaration", ""), (4 * i + 2, 4 * i + 1, "variable_declarator", ""), (4 * i + 3, 4 * i + 2, "identifier", "x"), (4 * i + 4, 0, "identifier", "x")]
    rows = [(1, 0, None, "program", ""), (1, -2, 0, "variable_declarator", ""), (1, -1, -2, "identifier", "x")] + [(1, *r) for i in range(300) for r in level(i)]
    assert flow.def_use_spread(spark.createDataFrame(rows, NODES)).where("src = -2").count() == 300
    assert len(digits) > 12 and max(digits[-6:]) < 200


SHAPES = {
    "sequence": ([("expression_statement", 0), ("lexical_declaration", 0), ("return_statement", 0), ("expression_statement", 0)], {(1, 2, "cfg_next"), (2, 3, "cfg_next")}),
    "if with else": (
        [("if_statement", 0), ("statement_block", 1), ("expression_statement", 2), ("else_clause", 1), ("statement_block", 4), ("return_statement", 5), ("expression_statement", 0)],
        {(1, 3, "cfg_branch"), (1, 6, "cfg_branch"), (3, 7, "cfg_next")},
    ),
    "if alone": ([("if_statement", 0), ("expression_statement", 1), ("expression_statement", 0)], {(1, 2, "cfg_branch"), (2, 3, "cfg_next"), (1, 3, "cfg_branch")}),
    "loop": ([("while_statement", 0), ("statement_block", 1), ("expression_statement", 2), ("expression_statement", 0)], {(1, 3, "cfg_branch"), (1, 4, "cfg_branch"), (3, 1, "cfg_branch")}),
    "try": (
        [("try_statement", 0), ("statement_block", 1), ("expression_statement", 2), ("throw_statement", 2), ("catch_clause", 1), ("statement_block", 5), ("expression_statement", 6), ("expression_statement", 0)],
        {(3, 7, "cfg_branch"), (4, 7, "cfg_branch"), (7, 8, "cfg_next"), (3, 4, "cfg_next")},
    ),
}


def test_shapes(spark):
    names = list(SHAPES)
    rows = [(p, 0, None, "program", "") for p in range(len(names))] + [(p, i, up, kind, "") for p, x in enumerate(names) for i, (kind, up) in enumerate(SHAPES[x][0], 1)]
    got = {x: set() for x in names}
    for r in flow.cfg_edges(spark.createDataFrame(rows, NODES)).collect():
        got[names[r["package_id"]]].add((r["src"], r["dst"], r["edge_type"]))
    assert got == {x: want for x, (_, want) in SHAPES.items()}


def test_exits_of_nested_bodies(spark):
    """An if at the end of a loop's body goes back to the loop, an if at a function's end has no exit."""
    kinds = [("while_statement", 0), ("statement_block", 1), ("if_statement", 2), ("statement_block", 3), ("try_statement", 4), ("statement_block", 5), ("expression_statement", 6), ("function_declaration", 0), ("statement_block", 8), ("if_statement", 9), ("expression_statement", 10)]
    rows = [(1, 0, None, "program", "")] + [(1, i, up, kind, "") for i, (kind, up) in enumerate(kinds, 1)]
    assert {(r["node_id"], r["exit_id"]) for r in flow.exits(spark.createDataFrame(rows, NODES)).collect()} == {(1, 8), (3, 1), (5, 1), (7, 1)}


def test_no_nodes(spark):
    none = spark.createDataFrame([], NODES)
    assert [f(none).count() for f in (flow.subtree_ends, flow.def_use_scopes, flow.cfg_edges, flow.exits)] == [0] * 4


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_last_before(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), rng.randrange(-50, 50), i, rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, tie long, v long").repartition(4)
    got = {r["tie"]: r["seen"] for r in cluster.last_before(df, ["k"], "at", ["tie"], F.col("v"), "seen", width).collect()}
    last, want = {}, {}
    for k, _, tie, v in sorted(rows):
        want[tie] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert got == want


def test_ranks_and_running_sums(spark):
    rows = [(i % 3 if i < 20 else 9, (i * 7919) % 1000, i % 5 or None) for i in range(900)]  # one key has nearly all rows
    got = cluster.ranked(spark.createDataFrame(rows, "k long, x long, w long"), ["k"], ["x"], "i", "w").toPandas().sort_values(["k", "x"])
    want = pd.DataFrame(rows, columns=["k", "x", "w"]).sort_values(["k", "x"]).assign(w=lambda d: d["w"].fillna(0))
    assert got["i"].tolist() == want.groupby("k").cumcount().tolist()
    assert got["i_sum"].tolist() == want.groupby("k")["w"].cumsum().astype(int).tolist()


@pytest.mark.parametrize("width", [4, 1 << 16])
def test_packing_equals_the_sequential_one(spark, monkeypatch, width):
    monkeypatch.setattr(dataset, "WIDTH", width)
    rng = random.Random(2)
    sizes = [rng.choice([0, 0, 1, 5, 20, 29, 30, 31, 100, None]) for _ in range(200)]
    used, batch, want = 0, 0, {}
    for i, x in enumerate(x or 0 for x in sizes):
        if i and used + x > 30:
            batch, used = batch + 1, 0
        used += x
        want[i] = batch
    df = spark.createDataFrame(list(enumerate(sizes)), "graph_id long, nodes long").repartition(3)
    assert {r["graph_id"]: r["batch"] for r in dataset.budget_batches(df, 30).collect()} == want
    assert dataset.budget_batches(df.where("false"), 30).count() == 0


def test_merged_edges(spark):
    nodes = spark.createDataFrame([(p, n * 10) for p in (1, 2) for n in range(5)], "package_id long, node_id long")
    edges = spark.createDataFrame([(1, 0, 40, 0), (1, 0, 7, 0), (2, 30, 10, 1), (3, 0, 0, 0)], "package_id long, src long, dst long, edge_type long")
    assert sorted(map(tuple, graph.merge_edges(nodes, edges, edges.where("src = 30")).collect())) == [(1, 0, 4, 0), (2, 3, 1, 1), (2, 3, 1, 1)]


VALUES = {
    "null": False, "false": False, "true": True, "0": False, "-0.0": False, "0e5": False, "1e-9": True, '""': False, '" "': True, '"false"': True, '"0"': True, "[]": False, "[null]": True, "{}": False, '{"a":null}': True,
}


def test_truth_of_json_values(spark):
    rows = [(v, f'{{"x": {v}}}') for v in VALUES] + [("missing", "{}"), ("none", None), ("broken", "{x"), ("no object", "[1]"), ("twice", '{"x": "", "x": "y", "z": 1, "z": 2}'), ("empty", "")]
    got = {r["v"]: r["t"] for r in spark.createDataFrame(rows, "v string, raw string").select("v", T.truthy(F.col("raw"), "$.x").alias("t")).collect()}
    twice = got.pop("twice")
    assert got == VALUES | dict.fromkeys(["missing", "none", "broken", "no object", "empty"], False) and isinstance(twice, bool)


def test_hooks_that_are_no_text(spark):
    hooks = {'"node x"': True, "null": False, "5": False, "true": False, '{"a":1}': False, '["a"]': True, '""': True}
    rows = [(h, f'{{"scripts": {{"preinstall": {h}, "postinstall": "x"}}}}') for h in hooks] + [("second", '{"scripts": {"postinstall": "x"}}'), ("none", '{"scripts": null}')]
    got = {r["h"]: r["hit"] for r in spark.createDataFrame(rows, "h string, raw string").select("h", rules.install_hook(F.col("raw")).alias("hit")).collect()}
    assert got == hooks | {"second": True, "none": False}


def test_risk_of_odd_manifests(spark):
    raw = [(1, '{"license": false, "repository": []}'), (2, '{"license": "MIT", "repository": {"url": "x"}, "description": "twenty characters at least"}'), (3, '{"description": 123456789012345678901234567890}'), (4, '{"description": ["a"], "license": 1, "repository": true}')]
    got = {r["package_id"]: r["risk"] for r in rules.metadata_risk(spark.createDataFrame(raw, "package_id long, raw string")).collect()}
    assert got == {1: 0.2, 2: 0.0, 3: 0.2, 4: 0.05}
