"""DuckDB SQL for the flow queries over the tree of code pieces, written apart from the operators: lists of children, recursion and plain range joins."""

from __future__ import annotations

from sievework.plans.testbed import cte

STATEMENT = "(ends_with({0}, '_statement') OR ends_with({0}, '_declaration'))"
BODY = f"({STATEMENT.format('type')} OR type = 'statement_block')"
LOOP = "{0} IN ('for_statement', 'while_statement', 'do_statement', 'for_in_statement', 'for_of_statement')"
TERMINAL = "('return_statement', 'throw_statement', 'break_statement', 'continue_statement')"

TREE = f"tree AS MATERIALIZED ({cte('tree')})"
ENDS = """up AS (
  SELECT package_id, node_id, node_id AS below FROM tree
  UNION ALL SELECT t.package_id, t.parent_id, up.below FROM up JOIN tree t ON t.package_id = up.package_id AND t.node_id = up.node_id WHERE t.parent_id IS NOT NULL
), ends AS MATERIALIZED (SELECT package_id, node_id, max(below) AS end_id FROM up GROUP BY ALL)"""

DEF_USE = """scopes AS (
  SELECT t.package_id, t.node_id AS low, e.end_id AS high FROM tree t JOIN ends e USING (package_id, node_id) WHERE type IN ('function_declaration', 'arrow_function', 'function_expression')
  UNION ALL SELECT DISTINCT package_id, CAST(-1 AS BIGINT), CAST(1 AS BIGINT) << 60 FROM tree
), firsts AS (
  SELECT package_id, parent_id, min(node_id) AS name_id, arg_min(text, node_id) AS name FROM tree WHERE type = 'identifier' GROUP BY ALL
), declared AS (SELECT t.package_id, t.node_id AS def_id, f.name, f.name_id FROM tree t JOIN firsts f ON f.package_id = t.package_id AND f.parent_id = t.node_id WHERE t.type IN ('variable_declarator', 'function_declaration')
), lists AS (SELECT l.package_id, l.parent_id AS fn, min(l.node_id) AS list FROM tree l WHERE l.type = 'formal_parameters' GROUP BY ALL
), given AS (
  SELECT p.package_id, p.text AS name, p.node_id AS def_id, s.low, s.high FROM lists JOIN tree p ON p.package_id = lists.package_id AND p.parent_id = lists.list AND p.type = 'identifier'
  JOIN scopes s ON s.package_id = lists.package_id AND s.low = lists.fn
), defs AS (
  SELECT d.package_id, d.name, d.def_id, d.def_id AS at_, arg_max(s.high, s.low) AS high, max(s.low) AS low FROM declared d JOIN scopes s ON s.package_id = d.package_id AND s.low < d.def_id AND d.def_id <= s.high GROUP BY ALL
  UNION ALL SELECT package_id, name, def_id, low, high, low FROM given
), uses AS (
  SELECT package_id, node_id, text AS name FROM tree t WHERE type = 'identifier' AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.package_id = t.package_id AND d.name_id = t.node_id)
  AND NOT EXISTS (SELECT 1 FROM tree l WHERE l.package_id = t.package_id AND l.node_id = t.parent_id AND l.type = 'formal_parameters')
)
SELECT u.package_id, arg_max(d.def_id, (d.low, d.at_, d.def_id)) AS src, u.node_id AS dst FROM uses u JOIN defs d ON d.package_id = u.package_id AND d.name = u.name AND d.at_ <= u.node_id AND u.node_id BETWEEN d.low AND d.high
GROUP BY u.package_id, u.node_id"""

BODIES = f"""stmt AS MATERIALIZED (
  SELECT t.package_id, t.parent_id AS block, t.node_id, t.type, lead(t.node_id) OVER (PARTITION BY t.package_id, t.parent_id ORDER BY t.node_id) AS next_id
  FROM tree t JOIN tree b ON b.package_id = t.package_id AND b.node_id = t.parent_id WHERE {STATEMENT.format("t.type")} AND b.type IN ('program', 'statement_block')
), sub AS (SELECT package_id, parent_id, min(node_id) AS body, min(node_id) FILTER (WHERE type = 'statement_block') AS block FROM tree WHERE {BODY} GROUP BY ALL
), kids AS (
  SELECT package_id, parent_id AS opener, list({{id: node_id, type: type, ok: {BODY}, block: type = 'statement_block', said: {STATEMENT.format("type")}}} ORDER BY node_id) AS k FROM tree GROUP BY ALL
), open AS (SELECT s.package_id, s.node_id AS opener, s.type AS opener_type, s.next_id AS after, k, coalesce(list_position(list_transform(k, lambda x: x.type), 'else'), 1000000) AS cut FROM stmt s JOIN kids ON kids.package_id = s.package_id AND kids.opener = s.node_id
), clause AS (
  SELECT o.package_id, o.opener, arg_max(sub.body, c.node_id) AS alternate FROM open o JOIN tree c ON c.package_id = o.package_id AND c.parent_id = o.opener AND c.type = 'else_clause' JOIN sub ON sub.package_id = c.package_id AND sub.parent_id = c.node_id GROUP BY ALL
), catch AS (
  SELECT o.package_id, o.opener, max(c.node_id) AS clause FROM open o JOIN tree c ON c.package_id = o.package_id AND c.parent_id = o.opener AND c.type = 'catch_clause' WHERE o.opener_type = 'try_statement' GROUP BY ALL
), body AS MATERIALIZED (
  SELECT package_id, opener, 'then' AS part, list_filter(k[:cut - 1], lambda x: x.ok)[1].id AS body FROM open WHERE opener_type = 'if_statement'
  UNION ALL SELECT package_id, opener, 'else', coalesce(alternate, list_filter(k[cut:], lambda x: x.ok)[1].id) FROM open LEFT JOIN clause USING (package_id, opener) WHERE opener_type = 'if_statement'
  UNION ALL SELECT package_id, opener, 'loop', coalesce(list_filter(k, lambda x: x.block)[1].id, list_filter(k, lambda x: x.said)[-1].id) FROM open WHERE {LOOP.format("opener_type")}
  UNION ALL SELECT package_id, opener, 'try', list_filter(k, lambda x: x.block)[1].id FROM open WHERE opener_type = 'try_statement'
  UNION ALL SELECT c.package_id, c.opener, 'catch', sub.block FROM catch c JOIN sub ON sub.package_id = c.package_id AND sub.parent_id = c.clause
), inside AS (
  SELECT package_id, block AS body, min(node_id) AS first, max(node_id) AS last, arg_max(type, node_id) AS last_type FROM stmt GROUP BY ALL
  UNION ALL SELECT package_id, node_id, node_id, node_id, type FROM tree WHERE {STATEMENT.format("type")}
), whole AS (
  SELECT o.package_id, o.opener, o.opener_type, o.after, b.part, b.body, i.first, i.last, i.last_type NOT IN {TERMINAL} AS goes_on FROM open o JOIN body b USING (package_id, opener) JOIN inside i ON i.package_id = b.package_id AND i.body = b.body
)"""

FLOW_SQL = {
    "subtree_ends": f"WITH RECURSIVE {TREE}, {ENDS} SELECT package_id, node_id, end_id FROM ends",
    "def_use_scopes": f"WITH RECURSIVE {TREE}, {ENDS}, {DEF_USE}",
    "cfg_edges": f"""WITH {TREE}, {BODIES}, e AS (
  SELECT package_id, node_id AS src, next_id AS dst, 'cfg_next' AS edge_type FROM stmt WHERE type NOT IN {TERMINAL} AND type NOT IN ('if_statement', 'try_statement') AND NOT {LOOP.format("type")}
  UNION ALL SELECT package_id, opener, first, 'cfg_branch' FROM whole WHERE part IN ('then', 'else', 'loop')
  UNION ALL SELECT package_id, last, after, 'cfg_next' FROM whole WHERE part <> 'loop' AND goes_on
  UNION ALL SELECT package_id, last, opener, 'cfg_branch' FROM whole WHERE part = 'loop' AND goes_on
  UNION ALL SELECT package_id, opener, after, 'cfg_branch' FROM (SELECT s.package_id, s.node_id AS opener, s.next_id AS after, s.type FROM stmt s) WHERE {LOOP.format("type")}
  UNION ALL SELECT s.package_id, s.node_id, s.next_id, 'cfg_branch' FROM stmt s LEFT JOIN body b ON b.package_id = s.package_id AND b.opener = s.node_id AND b.part = 'else' WHERE s.type = 'if_statement' AND b.body IS NULL
  UNION ALL SELECT s.package_id, s.node_id, c.first, 'cfg_branch' FROM whole t JOIN whole c ON c.package_id = t.package_id AND c.opener = t.opener AND c.part = 'catch' JOIN stmt s ON s.package_id = t.package_id AND s.block = t.body WHERE t.part = 'try'
) SELECT package_id, src, dst, edge_type, count(*) AS n FROM e WHERE dst IS NOT NULL GROUP BY ALL""",
    "cfg_exits": f"""WITH RECURSIVE {TREE}, {BODIES}, own AS (SELECT b.package_id, b.body AS block, b.opener, {LOOP.format("o.opener_type")} AS loop FROM body b JOIN open o USING (package_id, opener)
), c AS (
  SELECT package_id, node_id, type, block, next_id AS exit_id FROM stmt
  UNION ALL SELECT c.package_id, c.node_id, c.type, s.block, CASE WHEN o.loop THEN o.opener ELSE s.next_id END FROM c JOIN own o ON o.package_id = c.package_id AND o.block = c.block JOIN stmt s ON s.package_id = o.package_id AND s.node_id = o.opener WHERE c.exit_id IS NULL
) SELECT package_id, node_id, exit_id FROM c WHERE exit_id IS NOT NULL AND type NOT IN {TERMINAL}""",
}
