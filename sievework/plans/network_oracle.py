"""DuckDB SQL for the network's graph vectors: lists for vectors, with each weight's rule written out."""

from __future__ import annotations

from sievework.operators.network import ruled_weights
from sievework.plans.queries import NETWORK_LAYERS, NETWORK_WIDTH
from sievework.plans.testbed import cte

FEATURES, D = 64, NETWORK_WIDTH
#: The number of each array in the rule, from 1.
NUMBER = {name: k for k, name in enumerate(ruled_weights(FEATURES, D, NETWORK_LAYERS), 1)}


def line(x: str, name: str, rows: int) -> str:
    """x times the matrix, plus the bias."""
    w, b = NUMBER[f"{name}.w"], NUMBER[f"{name}.b"]
    entry = f"list_transform(range({rows}), lambda i: sin({w} + 0.37::DOUBLE * i + 0.61::DOUBLE * j) / sqrt({rows}))"
    return f"list_transform(range({D}), lambda j: list_dot_product({x}, {entry}) + 1 + 0.1::DOUBLE * sin({b} + 0.61::DOUBLE * j))"


def normed(x: str, name: str) -> str:
    """Normalised by fixed means and variances; negative values are 0."""
    at = lambda part, spread: f"(1 + {spread}::DOUBLE * sin({NUMBER[f'{name}.norm.{part}']} + 0.61::DOUBLE * j))"
    return f"list_transform(range({D}), lambda j: greatest(({x}[j + 1] - {at('mean', 0.1)}) / sqrt({at('var', 0.3)} + 0.00001::DOUBLE) * {at('scale', 0.2)} + {at('shift', 0.1)}, 0))"


def layer(k: int) -> str:
    edge = f"list_transform(range({D}), lambda j: sin({NUMBER['edge']} + 0.37::DOUBLE * edge_type + 0.61::DOUBLE * j) / 2)"  # four kinds
    return f"""m{k} AS (SELECT e.package_id, e.dst, s.h, {line(edge, f"edge{k}", D)} AS v FROM ed e JOIN s{k} s ON s.package_id = e.package_id AND s.node_id = e.src),
    g{k} AS (SELECT package_id, node_id, list(x ORDER BY j) AS got FROM (SELECT package_id, dst AS node_id, j, sum(greatest(h[j + 1] + v[j + 1], 0)) AS x FROM (SELECT *, unnest(range({D})) AS j FROM m{k}) GROUP BY ALL) GROUP BY ALL),
    t{k} AS (SELECT s.*, list_transform(range({D}), lambda j: {1 + 0.1 * k}::DOUBLE * h[j + 1] + coalesce(got[j + 1], 0)) AS y FROM s{k} s LEFT JOIN g{k} USING (package_id, node_id)),
    a{k} AS (SELECT *, {line("y", f"a{k}", D)} AS y1 FROM t{k}), b{k} AS (SELECT *, {normed("y1", f"a{k}")} AS y2 FROM a{k}), c{k} AS (SELECT *, {line("y2", f"b{k}", D)} AS y3 FROM b{k}), d{k} AS (SELECT *, {normed("y3", f"b{k}")} AS y4 FROM c{k}),
    s{k + 1} AS MATERIALIZED (SELECT package_id, node_id, list_transform(range({D}), lambda j: h[j + 1] + y4[j + 1]) AS h, list_concat(outs, list_transform(range({D}), lambda j: h[j + 1] + y4[j + 1])) AS outs FROM d{k})"""


NETWORK_SQL = {
    "graph_vectors": f"""WITH ed AS ({cte("edges")}), nd AS (SELECT CAST(label AS BIGINT) AS package_id, vec_id AS node_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)) AS x FROM embeddings),
    p AS (SELECT package_id, node_id, {line("x", "in", FEATURES)} AS y FROM nd), s0 AS MATERIALIZED (SELECT package_id, node_id, {normed("y", "in")} AS h, {normed("y", "in")} AS outs FROM p),
    {", ".join(layer(k) for k in range(NETWORK_LAYERS))},
    j0 AS (SELECT package_id, {line("outs", "jump", D * (NETWORK_LAYERS + 1))} AS y FROM s{NETWORK_LAYERS}), j1 AS (SELECT package_id, unnest({normed("y", "jump")}) AS x, unnest(range({D})) AS j FROM j0),
    v AS (SELECT package_id, j, avg(x) AS a, sum(x) AS b, max(x) AS c FROM j1 GROUP BY ALL),
    h AS (SELECT package_id, edge_type, count(*) AS n FROM ed GROUP BY ALL), z AS (SELECT q.package_id, e, coalesce(h.n, 0) / greatest((SELECT sum(n) FROM h WHERE h.package_id = q.package_id), 1) AS x
        FROM (SELECT DISTINCT package_id, unnest(range(4)) AS e FROM nd) q LEFT JOIN h ON h.package_id = q.package_id AND h.edge_type = q.e)
    SELECT package_id, k, round(x, 4) + 0.0 AS x FROM (SELECT package_id, j AS k, a AS x FROM v UNION ALL SELECT package_id, {D} + j, b FROM v UNION ALL SELECT package_id, {2 * D} + j, c FROM v UNION ALL SELECT package_id, {3 * D} + e, x FROM z)""",
}
