"""A graph classifier's forward pass over node and edge tables, for given weights: projection, message passing, pooling, head.

No task holds a package. Nodes are rows everywhere; only messages between neighbours and sums by package are shuffled, as vectors that each task has
added up before. Weights are a dictionary of arrays; their size, which the architecture fixes, is checked before they are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.cluster import lookup, settle

MOST_BYTES = 64 << 20
EPS = 1e-5
NODE, PACKAGE = "package_id long, node_id long, outs array<double>", "package_id long, n long, total array<double>, most array<double>"
Weights = dict[str, np.ndarray]


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def batch_norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """With the mean and variance seen in training."""
    return (x - w[f"{name}.mean"]) / np.sqrt(w[f"{name}.var"] + EPS) * w[f"{name}.scale"] + w[f"{name}.shift"]


def layer_norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=1, keepdims=True) + EPS) * w[f"{name}.scale"] + w[f"{name}.shift"]


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def vectors(x: np.ndarray) -> pa.Array:
    return pa.array(x.tolist(), pa.list_(pa.float64()))


def each_node(rows: DataFrame, columns: list[str], schema: str, change: Callable[..., np.ndarray]) -> DataFrame:
    """package_id, node_id and the vectors that change() makes of the columns' matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = change(*[matrix(b.column(c)) for c in columns]) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column("package_id"), b.column("node_id"), vectors(made)], ["package_id", "node_id", "outs"])

    return rows.select("package_id", "node_id", *columns).mapInArrow(run, schema)


def folded(rows: DataFrame, keys: list[str], made: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]] | None) -> DataFrame:
    """n, total and most (sum and largest value of each component) for each key, of the vectors that made() gives of a batch, or of partial results.

    Batches are folded where they are and again after a shuffle by key, in a stream with one key's vectors as state; so a key costs its
    task one row for each batch that had it.
    """
    names = [*keys, "n", "total", "most"]
    schema = ", ".join(f"{k} long" for k in keys) + ", n long, total array<double>, most array<double>"

    def emit(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        kinds = [pa.int64()] * (len(keys) + 1) + [pa.list_(pa.float64())] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = made(b)
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
            order = np.lexsort(key.T[::-1])
            key, x = key[order], x[order]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            n = np.diff(np.append(at, len(key)))
            total, most = np.add.reduceat(x, at), np.maximum.reduceat(x, at)
            yield emit([(*k, m, t, u) for k, m, t, u in zip(key[at].tolist(), n.tolist(), total.tolist(), most.tolist(), strict=True)])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            done = []
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                key, n, total, most = row[:-3], row[-3], np.array(row[-2]), np.array(row[-1])
                if held and held[0] == key:
                    held = (key, held[1] + n, held[2] + total, np.maximum(held[3], most))
                    continue
                if held:
                    done.append((*held[0], held[1], held[2].tolist(), held[3].tolist()))
                held = (key, n, total, most)
            yield emit(done)
        if held:
            yield emit([(*held[0], held[1], held[2].tolist(), held[3].tolist())])

    return rows.mapInArrow(first, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(second, schema)


def shared(rows: DataFrame, w: Weights):
    size = sum(x.nbytes for x in w.values())
    if size > MOST_BYTES:
        raise ValueError(f"weights of {size} bytes are too large to broadcast")
    return rows.sparkSession.sparkContext.broadcast(w)


def graph_vectors(nodes: DataFrame, edges: DataFrame, w: Weights, layers: int = 4) -> DataFrame:
    """package_id and vector: mean, sum and largest value of each component over a package's nodes, and the shares of its edge types.

    nodes have package_id, node_id and features; edges package_id, src, dst and edge_type (0 to 3). Edges whose ends are no nodes send nothing but count for
    the shares, which are 0 without edges; repeated edges count each. Layers: h + relu(norm(mlp((1 + eps) h + sum over incoming edges of relu(h_src + edge vector)))); the
    outputs of all layers are joined and projected. No nodes give no rows.
    """
    held = shared(nodes, w)
    state = settle(each_node(nodes, ["features"], NODE, lambda x: relu(batch_norm(linear(x, held.value, "in"), held.value, "in.norm"))))
    m, kinds = edges.count(), w["edge"].shape[0]
    for k in range(layers):
        sent = lookup(edges.select("package_id", F.col("src").alias("node_id"), "dst", "edge_type"), state, ["package_id", "node_id"], m)

        def message(b: pa.RecordBatch, k: int = k) -> np.ndarray:
            v, kind = held.value, b.column("edge_type").to_numpy(zero_copy_only=False)
            h = matrix(b.column("outs"))[:, -v["edge"].shape[1] :]
            return relu(h + linear(v["edge"], v, f"edge{k}")[kind])

        def step(outs: np.ndarray, got: np.ndarray, k: int = k) -> np.ndarray:
            v = held.value
            h = outs[:, -v["edge"].shape[1] :]
            x = relu(batch_norm(linear((1 + v[f"eps{k}"]) * h + got, v, f"a{k}"), v, f"a{k}.norm"))
            return np.hstack([outs, h + relu(batch_norm(linear(x, v, f"b{k}"), v, f"b{k}.norm"))])

        got = folded(sent.select("package_id", "dst", "edge_type", "outs"), ["package_id", "dst"], message).select("package_id", F.col("dst").alias("node_id"), F.col("total").alias("got"))
        none = F.array_repeat(F.lit(0.0), w["edge"].shape[1])
        state = settle(each_node(state.join(got, ["package_id", "node_id"], "left").withColumn("got", F.coalesce("got", none)), ["outs", "got"], NODE, step))

    def joined(b: pa.RecordBatch) -> np.ndarray:
        return relu(batch_norm(linear(matrix(b.column("outs")), held.value, "jump"), held.value, "jump.norm"))

    pooled = folded(state, ["package_id"], joined)
    shares = edges.groupBy("package_id").agg(F.array(*[F.count_if(F.col("edge_type") == k) / F.greatest(F.count("*"), F.lit(1)) for k in range(kinds)]).alias("shares"))
    rows = pooled.join(shares, "package_id", "left")
    return rows.select("package_id", F.concat(F.transform("total", lambda x: x / F.col("n")), "total", "most", F.coalesce("shares", F.array_repeat(F.lit(0.0), kinds))).alias("vector"))


def network_scores(graphs: DataFrame, metadata: DataFrame, w: Weights | None) -> DataFrame:
    """package_id, logit and score of graph_vectors() with each package's metadata (package_id, metadata: eight numbers); both are null without weights or metadata."""
    rows = graphs.join(metadata, "package_id", "left").withColumn("all", F.concat("vector", "metadata"))
    none = F.lit(None).cast("double")
    if w is None:
        return rows.select("package_id", none.alias("logit"), none.alias("score"))
    held = shared(graphs, w)

    def head(x: np.ndarray) -> np.ndarray:
        v = held.value
        for part in ("head0", "head1"):
            x = gelu(layer_norm(linear(x, v, part), v, f"{part}.norm"))
        return linear(x, v, "head2")

    known = each_node(rows.where("all is not null").select("package_id", F.lit(0).cast("long").alias("node_id"), "all"), ["all"], NODE, head)
    known = known.select("package_id", F.get("outs", F.lit(0)).alias("logit"))
    return known.select("package_id", "logit", (1 / (1 + F.exp(-F.col("logit")))).alias("score")).unionByName(rows.where("all is null").select("package_id", none.alias("logit"), none.alias("score")))


def ruled_weights(features: int, width: int = 128, layers: int = 4, kinds: int = 4, metadata: int = 8) -> Weights:
    """Weights by a rule, in the shapes of a trained network: entry (i, j) of the n-th array is sin(n + 0.37 i + 0.61 j) over the root of its height.

    They show the arithmetic and predict nothing. Arrays are numbered from 1 in the order in which they are made here.
    """
    w: Weights = {}

    def put(name: str, rows: int, columns: int, spread: float | None = None) -> None:
        i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
        w[name] = np.sin(len(w) + 1 + 0.37 * i + 0.61 * j) / math.sqrt(rows) if spread is None else 1 + spread * np.sin(len(w) + 1 + 0.61 * j[0])

    def dense(name: str, rows: int, columns: int, norm: bool = True, running: bool = True) -> None:
        put(f"{name}.w", rows, columns)
        put(f"{name}.b", 1, columns, 0.1)
        if norm:
            for part, spread in (("scale", 0.2), ("shift", 0.1), *((("mean", 0.1), ("var", 0.3)) if running else ())):
                put(f"{name}.norm.{part}", 1, columns, spread)

    dense("in", features, width)
    put("edge", kinds, width)
    for k in range(layers):
        dense(f"edge{k}", width, width, norm=False)
        dense(f"a{k}", width, width)
        dense(f"b{k}", width, width)
        w[f"eps{k}"] = np.array(0.1 * k)
    dense("jump", width * (layers + 1), width)
    dense("head0", 3 * width + kinds + metadata, width, running=False)
    dense("head1", width, max(1, width // 2), running=False)
    dense("head2", max(1, width // 2), 1, norm=False)
    return w
