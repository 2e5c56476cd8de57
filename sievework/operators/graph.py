"""Code graphs as node and edge tables: control flow, definitions and uses, taint, features, message passing, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.cluster import lookup, ranked, settle
from sievework.functions.text import entropy, failed_step, has, json_keys, network_in_hook
from sievework.operators.catalog import NODE_TYPES

TERMINAL = ["return_statement", "throw_statement", "break_statement", "continue_statement"]


def is_statement(kind: Column) -> Column:
    return F.endswith(kind, F.lit("_statement")) | F.endswith(kind, F.lit("_declaration"))


def sequential_flow(nodes: DataFrame) -> DataFrame:
    """Edges from a statement to the next of the same parent; nothing leaves a terminal statement."""
    following = F.lead("node_id").over(W.partitionBy("package_id", "parent_id").orderBy("node_id"))
    rows = nodes.where(is_statement(F.col("type"))).withColumn("dst", following)
    return rows.where(F.col("dst").isNotNull() & ~F.col("type").isin(TERMINAL)).select("package_id", F.col("node_id").alias("src"), "dst")


def latest_before(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """The latest definition (key, id, at) at or before each use (key, id, at) by one window over both, for flat scopes."""
    both = uses.select("key", "id", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("d")).unionByName(defs.select("key", "id", "at", F.lit(0).alias("kind"), F.col("id").cast("long").alias("d")))
    seen = F.last("d", ignorenulls=True).over(W.partitionBy("key").orderBy("at", "kind", "id").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("def_id", seen).where("kind = 1").select("key", F.col("id").alias("use_id"), "def_id")


def taint_flags(nodes: DataFrame) -> DataFrame:
    """package_id, node_id, flag and detail: at most one source of a call, one of any node and one sink, the first that fits."""
    call, code = F.col("type") == "call_expression", F.col("text")
    source = F.when(has(code, "taint_decode"), "Buffer.from with base64").when(has(code, "taint_atob"), "atob()").when(has(code, "taint_read"), "fs.readFileSync")
    flags = F.array(
        F.struct(F.lit("source").alias("flag"), F.when(call, source).alias("detail")),
        F.struct(F.lit("source").alias("flag"), F.when(has(code, "taint_env"), "process.env access").alias("detail")),
        F.struct(F.lit("sink").alias("flag"), F.when(call & has(code, "sink"), "sink call").alias("detail")),
    )
    return nodes.select("package_id", "node_id", F.explode(flags).alias("f")).where("f.detail is not null").select("package_id", "node_id", "f.*")


def obfuscated(kind: Column, text: Column, one_line: Column) -> Column:
    """A long string, an escape, a long line, or a name of more than eight characters with more than 3.5 bits each."""
    long = F.length(text) >= 200
    name = (kind == "identifier") & (F.length(text) > 8) & (F.when(kind == "identifier", entropy(text)) > 3.5)
    return ((kind == "string") & long) | has(text, "hex_esc") | has(text, "uni_esc") | (one_line & long) | F.coalesce(name, F.lit(False))


def node_flags(nodes: DataFrame, *more: str) -> DataFrame:
    """package_id, node_id and twelve flags of each node (type, text, start_line, end_line), with further columns of the node first."""
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    call = kind == "call_expression"
    inner = F.regexp_replace(text, "^[\"'`]+|[\"'`]+$", "")
    base64 = F.contains(text, F.lit("base64")) | ((kind == "string") & (F.length(inner) > 40) & has(inner, "n_base64"))
    flags = {
        "eval_call": call & has(text, "n_eval"), "exec_call": call & has(text, "n_exec"), "network_call": call & has(text, "n_network"), "file_op": call & has(text, "n_file"), "base64": base64,
        "obfuscated": obfuscated(kind, text, F.col("start_line") == F.col("end_line")), "env_access": F.contains(text, F.lit("process.env")), "dangerous_import": call & has(text, "n_import"),
        "dynamic_require": call & has(text, "n_dynamic"), "crypto_call": call & has(text, "n_crypto"), "timer_callback": call & has(text, "n_timer"), "string_manip": has(text, "n_string"),
    }
    return nodes.select("package_id", "node_id", *more, *[c.alias(n) for n, c in flags.items()])


def node_features(nodes: DataFrame) -> DataFrame:
    """package_id, node_id and the 35 numbers that a model gets of a node: its type among 22 known ones and one for all others, then its twelve flags."""
    flags = node_flags(nodes.withColumn("_type", F.col("type")), "_type")
    at = type_index(F.col("_type"))
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(len(NODE_TYPES))), lambda k: (k == at).cast("double"))
    names = [c for c in flags.columns if c not in ("package_id", "node_id", "_type")]
    return flags.select("package_id", "node_id", F.concat(one_hot, F.array(*[F.coalesce(F.col(c), F.lit(False)).cast("double") for c in names])).alias("features"))


def package_vector(files: DataFrame, manifests: DataFrame, flags: DataFrame) -> DataFrame:
    """package_id and the eight numbers that a model gets of a package, of every package with a manifest.

    Hooks, files and lines of .js and .mjs outside node_modules, a network word in a hook, taint sources and sinks (flags as
    from taint_flags()), and whether both are there.
    """
    code = files.where(F.col("path").rlike(r"\.m?js$") & ~F.array_contains(F.split("path", "/"), "node_modules"))
    sizes = code.groupBy("package_id").agg(F.count("*").alias("n"), F.sum(F.size(F.split("code", "\n")) - 1).alias("lines"))
    taint = flags.groupBy("package_id").agg(F.count_if(F.col("flag") == "source").alias("sources"), F.count_if(F.col("flag") == "sink").alias("sinks"))
    rows = manifests.select("package_id", "raw").join(sizes, "package_id", "left").join(taint, "package_id", "left").fillna(0, ["n", "lines", "sources", "sinks"])
    keys, one = json_keys(F.col("raw"), "$.scripts"), lambda c: c.cast("double")
    return rows.select(
        "package_id", one(F.array_contains(keys, "preinstall")).alias("preinstall"), one(F.array_contains(keys, "postinstall")).alias("postinstall"), (F.col("n") / 100).alias("files"), (F.col("lines") / 10_000).alias("lines"),
        one(F.coalesce(network_in_hook(F.col("raw")), F.lit(False))).alias("network_hook"), (F.col("sources") / 10).alias("sources"), (F.col("sinks") / 10).alias("sinks"), one((F.col("sources") > 0) & (F.col("sinks") > 0)).alias("both"),
    )


def graph_status(packages: DataFrame, nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """package_id, status, error_type, num_nodes and num_edges of every package (package_id, raw: its manifest or null).

    A package that failed (failed: package_id, frames, error) is a row with the step and the kind of its error; one without nodes is a
    graph of one node without features if it has a manifest, else it has no graph.
    """
    n = nodes.groupBy("package_id").agg(F.count("*").alias("n"))
    m = edges.groupBy("package_id").agg(F.count("*").alias("m"))
    rows = packages.join(n, "package_id", "left").join(m, "package_id", "left").join(failed.select("package_id", F.concat(failed_step(F.col("frames")), F.lit(":"), "error").alias("why")), "package_id", "left")
    dummy = F.col("n").isNull() & F.col("raw").isNotNull()
    status = F.when(F.col("why").isNotNull(), "failure").when(F.col("n").isNull() & ~dummy, "cpg_none").otherwise("success")
    fine = status == "success"
    return rows.select(
        "package_id", status.alias("status"), F.when(status == "cpg_none", "CPG_NONE").otherwise(F.coalesce("why", F.lit(""))).alias("error_type"),
        F.when(fine, F.coalesce("n", F.lit(1))).otherwise(0).cast("long").alias("num_nodes"), F.when(fine & ~dummy, F.coalesce("m", F.lit(0))).otherwise(0).cast("long").alias("num_edges"),
    )


def type_index(kind: Column) -> Column:
    """Place of a node type among the 22 known ones from 0; 22 for all others."""
    kind = F.when(kind == "template_string", "template_literal").otherwise(kind)
    at = F.array_position(F.array(*map(F.lit, NODE_TYPES)), kind).cast("int")
    return F.when(at == 0, len(NODE_TYPES)).otherwise(at - 1)


def merge_edges(nodes: DataFrame, *edges: DataFrame) -> DataFrame:
    """All edges whose ends are nodes, with ends renumbered from 0 inside a package; neither a huge package nor a node with many edges is one task's."""
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    number = settle(ranked(nodes.select("package_id", "node_id"), ["package_id"], ["node_id"], "n"))
    m = every.count()
    for c in ("src", "dst"):
        every = lookup(every, number.select("package_id", F.col("node_id").alias(c), F.col("n").alias(f"{c}_n")), ["package_id", c], m)
    return every.select("package_id", F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), "edge_type")


def edge_histogram(edges: DataFrame, kinds: int = 4) -> DataFrame:
    """Shares of each edge type of a package, as columns e0, e1, ..."""
    return edges.groupBy("package_id").agg(*[F.round(F.count_if(F.col("edge_type") == k) / F.greatest(F.count("*"), F.lit(1)), 6).alias(f"e{k}") for k in range(kinds)])


def message_pass(nodes: DataFrame, edges: DataFrame, eps: float = 0.0) -> DataFrame:
    """One hop of (1 + eps) * h + sum of relu(h_src + bias of the edge type), component by component.

    nodes has package_id, node_id and h (array); edges package_id, src, dst, edge_type and bias (a number). Sums are by
    component and map-side, so a node with many edges costs its tasks partial sums only.
    """
    sent = edges.join(nodes.select("package_id", F.col("node_id").alias("src"), "h"), ["package_id", "src"])
    parts = sent.select("package_id", "dst", F.posexplode(F.transform("h", lambda x: F.greatest(x + F.col("bias"), F.lit(0.0)))).alias("k", "m"))
    own = nodes.select("package_id", F.col("node_id").alias("dst"), F.posexplode(F.transform("h", lambda x: x * (1 + eps))).alias("k", "m"))
    summed = own.unionByName(parts).groupBy("package_id", F.col("dst").alias("node_id"), "k").agg(F.sum("m").alias("m"))
    return summed.groupBy("package_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("h"))


def pooled(nodes: DataFrame) -> DataFrame:
    """Mean, sum and largest value of every component over a package's nodes, in long form."""
    each = nodes.select("package_id", F.posexplode("h").alias("k", "x"))
    return each.groupBy("package_id", "k").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.sum("x"), 9).alias("total"), F.round(F.max("x"), 9).alias("most"))


def cap_nodes(files: DataFrame, most: int = 30_000) -> DataFrame:
    """Files (package_id, path, nodes) up to and with the one that brings a package to `most` nodes, in path order."""
    above = F.coalesce(F.sum("nodes").over(W.partitionBy("package_id").orderBy(F.split("path", "/")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("before", above).where(F.col("before") < most)
