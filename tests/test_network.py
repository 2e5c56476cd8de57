"""The distributed forward pass against one over whole arrays."""

import math

import numpy as np
import pytest

from sievework.functions import cluster
from sievework.operators import network as net


def whole(x, src, dst, kind, meta, w, layers):
    """Logit of one graph, all in memory."""
    norm = lambda v, n: (v - w[f"{n}.mean"]) / np.sqrt(w[f"{n}.var"] + 1e-5) * w[f"{n}.scale"] + w[f"{n}.shift"]
    line = lambda v, n: v @ w[f"{n}.w"] + w[f"{n}.b"]
    h = np.maximum(norm(line(x, "in"), "in.norm"), 0)
    outs = [h]
    for k in range(layers):
        got = (1 + w[f"eps{k}"]) * h
        for s, d, e in zip(src, dst, kind):
            if s < len(x) and d < len(x):
                got[d] += np.maximum(h[s] + line(w["edge"][e], f"edge{k}"), 0)
        h = h + np.maximum(norm(line(np.maximum(norm(line(got, f"a{k}"), f"a{k}.norm"), 0), f"b{k}"), f"b{k}.norm"), 0)
        outs.append(h)
    j = np.maximum(norm(line(np.hstack(outs), "jump"), "jump.norm"), 0)
    shares = np.array([kind.count(e) / max(1, len(kind)) for e in range(4)])
    v = np.concatenate([j.mean(0), j.sum(0), j.max(0), shares])
    x = np.concatenate([v, meta])
    for part in ("head0", "head1"):
        x = line(x, part)
        x = (x - x.mean()) / math.sqrt(x.var() + 1e-5) * w[f"{part}.norm.scale"] + w[f"{part}.norm.shift"]
        x = np.array([t * 0.5 * (1 + math.erf(t / math.sqrt(2))) for t in x])
    return v, line(x, "head2")[0]


@pytest.mark.parametrize("hot", [False, True])
def test_forward_pass(spark, monkeypatch, hot):
    if hot:  # the node that most edges leave is broadcast
        monkeypatch.setattr(cluster, "HOT_LEAST", 5)
    rng, width, layers = np.random.default_rng(4), 6, 3
    w = net.ruled_weights(5, width, layers)
    graphs = {}
    for p, n, m in ((1, 12, 40), (2, 1, 0), (3, 5, 9)):
        src, dst = ([0] * (m // 2) + rng.integers(0, n, m - m // 2).tolist()), rng.integers(0, n + 1, m).tolist()  # some ends are no nodes
        graphs[p] = (rng.standard_normal((n, 5)), src, dst, rng.integers(0, 4, m).tolist(), rng.random(8))
    nodes = spark.createDataFrame([(p, i, x.tolist()) for p, g in graphs.items() for i, x in enumerate(g[0])], "package_id long, node_id long, features array<double>").repartition(4)
    edges = spark.createDataFrame([(p, s, d, e) for p, g in graphs.items() for s, d, e in zip(*g[1:4])], "package_id long, src long, dst long, edge_type long").repartition(3)
    meta = spark.createDataFrame([(p, g[4].tolist()) for p, g in graphs.items() if p != 3], "package_id long, metadata array<double>")
    vectors = net.graph_vectors(nodes, edges, w, layers)
    want = {p: whole(*g, w, layers) for p, g in graphs.items()}
    got = {r["package_id"]: r["vector"] for r in vectors.collect()}
    assert set(got) == set(want) and all(np.allclose(got[p], want[p][0]) for p in want)
    scores = {r["package_id"]: (r["logit"], r["score"]) for r in net.network_scores(vectors, meta, w).collect()}
    assert scores[3] == (None, None) and all(np.allclose(scores[p], (want[p][1], 1 / (1 + math.exp(-want[p][1])))) for p in (1, 2))
    assert {tuple(r) for r in net.network_scores(vectors, meta, None).collect()} == {(p, None, None) for p in graphs}
    assert net.graph_vectors(nodes.where("false"), edges.where("false"), w, layers).count() == 0


def test_large_weights_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(net, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="too large"):
        net.graph_vectors(spark.createDataFrame([], "package_id long, node_id long, features array<double>"), spark.createDataFrame([], "package_id long, src long, dst long, edge_type long"), net.ruled_weights(5))
