"""DuckDB SQL for the queries over the derived views, written apart from the operators."""

from __future__ import annotations

from sievework.operators.catalog import BUILD_ERRORS, BUILD_TERMS, DECISION_LABELS, FAILED_STEPS, HARD, HOOK_NETWORK_WORDS, IDEAS, LIVE_WEIGHT, NETWORK_TERMS, NODE_TYPES, OBFUSCATION_TERMS, PATTERN, REPLAY_HARD, REPLAY_WEIGHT, SECRET_TERMS, SHELL_TERMS, SWEEP, TOP_NAMES, TWIN, UNKNOWN_WEIGHT, score, severity
from sievework.plans.flow_oracle import FLOW_SQL
from sievework.plans.network_oracle import NETWORK_SQL
from sievework.plans.queries import GOALS, MESSAGES, PHRASES, PRECISIONS, RECALLS, STACKS
from sievework.plans.testbed import RULES, cte


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rx(column: str, name: str) -> str:
    return f"regexp_matches({column}, {q(TWIN.get(name, PATTERN[name]))})"


def rows(values: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x!r}" for x in v) + ")" for v in values) + ")"


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ------------------------------------------------------------------------------------------------ records
PARTS, RAWS = [0.4, 5.0, 1.5, 0.2, 10.0, 1.0], [2.0, 5.0, 15.0, 2.0, 10.0, 5.0]
TOTAL = lambda xs, only=range(6): "round(" + " + ".join(f"CASE WHEN b{i} THEN {d(xs[i])} ELSE 0 END" for i in only) + ", 6)"


def verdict(g: str = "gnn_score", direct: str = "0.8", confirm: str = "0.45", weighted: str = "1.0", floor: str = "0.45", hard: str = "8.0") -> str:
    f = lambda x: f"CAST({x} AS DOUBLE)"
    return f"""CASE WHEN {g} < 0 THEN 'suspicious' WHEN {g} >= {f(direct)} OR ({g} >= {f(confirm)} AND weighted >= {f(weighted)}) OR ({g} >= {f(floor)} AND hard_score >= {f(hard)}) THEN 'malicious'
      WHEN {g} < {f("0.35")} AND weighted <= 0 THEN 'clean' ELSE 'suspicious' END"""


REC = f"""
base AS ({cte("base")}),
w AS (SELECT *, {TOTAL(PARTS)} AS weighted, {TOTAL(PARTS, (1, 4))} AS hard_score, {TOTAL(RAWS)} AS rules_score,
        (b1 OR b4) AS reliable, (b2 OR b3 OR b5) AS noisy, NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5) AS bare,
        CAST(network AS INT) + CAST(shell AS INT) + CAST(secrets AS INT) + CAST(obfuscation AS INT) AS risk_score FROM base),
rec AS (SELECT *, {verdict()} AS hybrid_verdict, CASE WHEN ({verdict()}) = 'malicious' THEN 1 ELSE 0 END AS guess,
        CASE WHEN b2 OR b4 OR rules_score >= 15 THEN 'malicious' WHEN rules_score > 0 THEN 'suspicious' ELSE 'clean' END AS rules_verdict,
        CASE WHEN gnn_score < 0 THEN CASE WHEN weighted > 0 OR hard_score > 0 THEN 'v2_static_review' ELSE 'v2_gnn_review' END
             WHEN gnn_score >= {d(0.8)} THEN 'v2_gnn_direct_block' WHEN gnn_score >= {d(0.45)} AND weighted >= 1 THEN 'v2_gnn_weighted_rules_block'
             WHEN gnn_score >= {d(0.45)} AND hard_score >= 8 THEN 'v2_hard_rules_block' WHEN gnn_score < {d(0.35)} AND weighted <= 0 THEN 'clean_pass' WHEN gnn_score < {d(0.35)} THEN 'v2_low_gnn_review'
             WHEN weighted > 0 OR hard_score > 0 THEN 'v2_static_review' ELSE 'v2_gnn_review' END AS decision_bucket,
        CASE WHEN bare THEN 'no_rules' WHEN reliable AND NOT noisy THEN 'high_reliability_rules_only' WHEN reliable THEN 'mixed_reliability_rules' WHEN noisy THEN 'noisy_rules_only' ELSE 'unknown_rules' END AS profile,
        CASE WHEN gnn_score < 0 THEN 'gnn_unavailable' WHEN gnn_score < {d(0.35)} THEN 'low_<0.35' WHEN gnn_score < 0.5 THEN 'low_mid_0.35_0.50' WHEN gnn_score < 0.75 THEN 'mid_0.50_0.75'
             WHEN gnn_score < {d(0.8)} THEN 'near_block_0.75_0.80' WHEN gnn_score < {d(0.9)} THEN 'high_0.80_0.90' ELSE 'very_high_>=0.90' END AS band FROM w),
long_rules AS ({" UNION ALL ".join(f"SELECT *, {q(r)} AS rule_id FROM rec WHERE b{i}" for i, r in enumerate(RULES))}),
err AS (SELECT *, CASE WHEN true_label = 0 AND guess = 1 THEN 'fp' WHEN true_label = 1 AND guess = 0 THEN 'fn' END AS kind FROM rec),
errs AS (SELECT *, CASE WHEN kind = 'fp' THEN CASE WHEN gnn_score >= {d(0.9)} AND bare THEN 'fp_gnn_very_high_without_rules' WHEN gnn_score >= {d(0.8)} AND bare THEN 'fp_gnn_high_without_rules'
               WHEN profile = 'noisy_rules_only' THEN 'fp_noisy_rule_confirmation' WHEN profile = 'mixed_reliability_rules' THEN 'fp_mixed_rule_confirmation'
               WHEN profile = 'high_reliability_rules_only' THEN 'fp_high_reliability_rule_collision' ELSE 'fp_other' END
          ELSE CASE WHEN gnn_score < {d(0.35)} AND bare THEN 'fn_low_gnn_no_rules' WHEN gnn_score < {d(0.35)} THEN 'fn_low_gnn_weak_rules' WHEN gnn_score < 0.75 AND bare THEN 'fn_mid_gnn_no_rules'
               WHEN gnn_score < 0.75 THEN 'fn_mid_gnn_weak_rules' WHEN gnn_score >= {d(0.8)} AND bare THEN 'fn_high_gnn_no_rules' WHEN gnn_score >= {d(0.8)} AND decision_bucket LIKE '%review%' THEN 'fn_high_gnn_review_policy'
               WHEN profile IN ('noisy_rules_only', 'mixed_reliability_rules') THEN 'fn_rule_signal_too_noisy' ELSE 'fn_other' END END AS category FROM err WHERE kind IS NOT NULL)
"""
CELLS = "count(*) FILTER (WHERE true_label = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE true_label = 0 AND guess = 1) AS fp, count(*) FILTER (WHERE true_label = 1 AND guess = 0) AS fn, count(*) FILTER (WHERE true_label = 0 AND guess = 0) AS tn"
P, R = "(tp / greatest(tp + fp, 1))", "(tp / greatest(tp + fn, 1))"
RATES = f"round({P}, 6) AS \"precision\", round({R}, 6) AS recall, round(2 * {P} * {R} / greatest({P} + {R}, CAST(1e-9 AS DOUBLE)), 6) AS f1"


def rec(select: str, more: str = "") -> str:
    return f"WITH {REC}{', ' + more if more else ''} {select}"


SYSTEMS = "sys AS (SELECT run, true_label, 'gnn' AS system, CASE WHEN gnn_score >= 0.5 THEN 1 ELSE 0 END AS guess FROM rec UNION ALL SELECT run, true_label, 'rules', CASE WHEN rules_verdict = 'malicious' THEN 1 ELSE 0 END FROM rec UNION ALL SELECT run, true_label, 'hybrid', guess FROM rec)"


def grid_cte(axes: dict[str, list[float]]) -> str:
    names = list(axes)
    tables = ", ".join("(SELECT * FROM (VALUES " + ", ".join(f"({i}, {d(v)})" for i, v in enumerate(axes[n])) + f") AS t_{n}(i_{n}, {n}_from))" for n in names)
    at = "0"
    for n in names:
        at = f"({at} * {len(axes[n])} + i_{n})"
    return f"cfg AS (SELECT CAST({at} AS INT) AS config_id, {', '.join(n + '_from' for n in names)} FROM {tables})"


def sweep_cte(axes: dict[str, list[float]]) -> str:
    v = verdict("gnn_score", *(f"{n}_from" for n in ("direct", "confirm", "weighted", "hard_min_gnn", "hard")))
    cell = lambda y, g: f"CAST(coalesce(sum(n) FILTER (WHERE true_label = {y} AND g = {g}), 0) AS BIGINT)"
    return f"""{grid_cte(axes)}, combo AS (SELECT gnn_score, weighted, hard_score, true_label, count(*) AS n FROM rec GROUP BY ALL),
      met AS (SELECT cfg.*, true_label, n, CASE WHEN ({v}) = 'malicious' THEN 1 ELSE 0 END AS g FROM combo, cfg),
      cnt AS (SELECT config_id, {', '.join(n + '_from' for n in axes)}, {cell(1, 1)} AS tp, {cell(0, 1)} AS fp, {cell(1, 0)} AS fn, {cell(0, 0)} AS tn FROM met GROUP BY ALL),
      swept AS (SELECT *, {RATES} FROM cnt)"""


def best(goal: str, floors: list[float], order: str) -> str:
    return rec("SELECT * FROM placed WHERE place <= 10", f"""{sweep_cte(SWEEP)}, placed AS (SELECT swept.*, floor, CAST(row_number() OVER (PARTITION BY floor ORDER BY {order}, config_id) AS INT) AS place
      FROM swept, (SELECT CAST(unnest({floors}) AS DOUBLE) AS floor) WHERE {goal} >= floor)""")


def thresholds(first: int, last: int, step: int) -> str:
    cell = lambda y, g: f"count(*) FILTER (WHERE true_label = {y} AND g = {g})"
    return f"""th AS (SELECT k / CAST(100 AS DOUBLE) AS threshold, {cell(1, 1)} AS tp, {cell(0, 1)} AS fp, {cell(1, 0)} AS fn, {cell(0, 0)} AS tn FROM (
      SELECT k, true_label, CASE WHEN gnn_score >= 0 AND gnn_score >= k / CAST(100 AS DOUBLE) THEN 1 ELSE 0 END AS g FROM rec, (SELECT unnest(range({first}, {last + 1}, {step})) AS k)) GROUP BY k),
      thr AS (SELECT *, {RATES} FROM th)"""


MID = f"gnn_score >= {d(0.35)} AND gnn_score < {d(0.8)}"
CONTEXT = [
    ("high_gnn_clean_manifest", "suppressor", f"gnn_score >= {d(0.8)} AND bare AND NOT hook AND metadata_risk <= {d(0.15)} AND license AND description_length >= 20"),
    ("noisy_only_documented", "suppressor", f"profile = 'noisy_rules_only' AND NOT hook AND metadata_risk <= {d(0.15)} AND (license OR repository) AND description_length >= 20"),
    ("tiny_graph_no_hook", "suppressor", f"num_nodes <= 1 AND NOT hook AND metadata_risk <= {d(0.15)}"),
    ("large_package_noisy_only", "suppressor", f"(num_js_files >= 20 OR num_nodes >= 30000) AND NOT hook AND profile = 'noisy_rules_only' AND metadata_risk <= {d(0.15)}"),
    ("high_metadata_risk", "confirmer", f"metadata_risk >= {d(0.4)}"),
    ("structure_rule", "confirmer", "false"),
    ("mid_gnn_hook_rule", "confirmer", f"{MID} AND hook AND b0"),
    ("mid_gnn_hook_risk", "confirmer", f"{MID} AND hook AND metadata_risk >= {d(0.2)}"),
    ("upper_mid_bare_manifest", "confirmer", f"gnn_score >= {d(0.55)} AND gnn_score < {d(0.8)} AND bare AND NOT repository AND NOT license AND description_length < 20"),
]
LIFE = [
    ("network_or_shell", "confirmer", f"{MID} AND hook AND (network OR shell)"),
    ("secrets", "confirmer", f"{MID} AND hook AND secrets"),
    ("obfuscation", "confirmer", f"{MID} AND hook AND obfuscation"),
    ("risk_2", "confirmer", f"{MID} AND hook AND risk_score >= 2"),
    ("risk_1_no_build", "confirmer", f"{MID} AND hook AND risk_score >= 1 AND NOT build"),
    ("build_hook", "suppressor", f"hook AND build AND metadata_risk <= {d(0.15)}"),
]


def signal_cte(signals: list[tuple[str, str, str]]) -> str:
    fired = " UNION ALL ".join(f"SELECT package_name, true_label, guess, {q(n)} AS signal, {q(k)} AS kind, {i} AS pos FROM rec WHERE {p}" for i, (n, k, p) in enumerate(signals))
    names = " UNION ALL ".join(f"SELECT {q(n)} AS signal, {q(k)} AS kind" for n, k, _ in signals)
    f = lambda y, g: f"count(*) FILTER (WHERE true_label = {y} AND guess = {g})"
    return f"""fired AS ({fired}), names AS ({names}), m AS (SELECT signal, {f(1, 1)} AS m_tp, {f(0, 1)} AS m_fp, {f(1, 0)} AS m_fn, {f(0, 0)} AS m_tn FROM fired GROUP BY signal),
      tot AS (SELECT {CELLS} FROM rec), j AS (SELECT names.*, coalesce(m_tp, 0) AS m_tp, coalesce(m_fp, 0) AS m_fp, coalesce(m_fn, 0) AS m_fn, coalesce(m_tn, 0) AS m_tn, CASE WHEN kind = 'suppressor' THEN 1 ELSE 0 END AS off, tot.* FROM names LEFT JOIN m USING (signal), tot),
      af AS (SELECT signal, kind, m_tp, m_fp, m_fn, m_tn, tp - off * m_tp + (1 - off) * m_fn AS tp, fp - off * m_fp + (1 - off) * m_tn AS fp, fn + off * m_tp - (1 - off) * m_fn AS fn, tn + off * m_fp - (1 - off) * m_tn AS tn FROM j),
      good AS (SELECT signal, kind, CASE WHEN off = 1 THEN m_fp ELSE m_fn END AS gain FROM j WHERE CASE WHEN off = 1 THEN m_tp ELSE m_tn END = 0 AND CASE WHEN off = 1 THEN m_fp ELSE m_fn END > 0)"""


# ------------------------------------------------------------------------------------------------ packages
SIMPLE = {
    "CRIT_EXFIL_FILES": ["net_send", "sensitive_files"], "CRIT_DNS_EXFIL": ["cred_env", "dns_exfil"], "CRIT_DYNAMIC_REQUIRE_EXEC": ["dyn_sink", "decode", "dyn_require"], "HIGH_EVAL_DECODED": ["b64_decode", "eval"],
    "HIGH_PROCESS_ENV_BULK": ["env_bulk"], "HIGH_WEBHOOK_EXFIL": ["net_send", "webhook"], "HIGH_DNS_EXFIL": ["exfil_source", "dns_usage"], "HIGH_SELF_DELETE": ["self_delete"], "HIGH_RUNTIME_PROTOTYPE_POLLUTION": ["module_exports", "proto_pollution"],
}
SCRIPT = lambda h: f"json_extract_string(raw, '$.scripts.{h}')"
KEY = lambda h: f"list_contains(json_keys(raw, '$.scripts'), '{h}')"
WHITE = "(h IN ('registry.npmjs.org', 'registry.yarnpkg.com', 'github.com', 'githubusercontent.com') OR h LIKE '%.registry.npmjs.org' OR h LIKE '%.registry.yarnpkg.com' OR h LIKE '%.github.com' OR h LIKE '%.githubusercontent.com')"
DEPS = " + ".join(f"coalesce(len(json_keys(raw, '$.{k}')), 0)" for k in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"))
PKG = f"""
files AS ({cte("files")}), manifests AS ({cte("manifests")}),
ln AS (SELECT package_id, path, i, l FROM (SELECT package_id, path, unnest(string_split(code, chr(10))) AS l, generate_subscripts(string_split(code, chr(10)), 1) AS i FROM files)),
line_of AS (SELECT 1),
pay AS (SELECT DISTINCT package_id, path, p FROM (SELECT package_id, path, unnest(regexp_extract_all(code, {q(PATTERN["b64_long"])}, 1)) AS p FROM files) WHERE length(p) >= 500),
ent AS (SELECT package_id, path, p, -sum(c / CAST(length(p) AS DOUBLE) * log2(c / CAST(length(p) AS DOUBLE))) AS e FROM (SELECT package_id, path, p, ch, count(*) AS c FROM (SELECT package_id, path, p, unnest(string_split(p, '')) AS ch FROM pay) GROUP BY ALL) GROUP BY ALL),
win AS (SELECT a.package_id, a.path, a.i, string_agg(b.l, chr(10) ORDER BY b.i) AS w FROM ln a JOIN ln b ON a.package_id = b.package_id AND a.path = b.path AND b.i BETWEEN a.i - 10 AND a.i + 9
  JOIN files f ON f.package_id = a.package_id AND f.path = a.path WHERE ({rx("f.code", "b64_40")} OR {rx("f.code", "hex10")}) AND {rx("f.code", "decode")} AND {rx("f.code", "exec_sink")} GROUP BY ALL),
fh AS ({" UNION ALL ".join(f"SELECT package_id, path, {q(r)} AS rule_id FROM files WHERE " + " AND ".join(rx("code", n) for n in names) for r, names in SIMPLE.items())}
  UNION ALL SELECT package_id, path, 'CRIT_EXFIL_CREDENTIALS' FROM files WHERE {rx("code", "net_send")} AND len(list_distinct(regexp_extract_all(code, {q(PATTERN["cred_env"])}, 1))) >= 2
  UNION ALL SELECT f.package_id, f.path, 'CRIT_REVERSE_SHELL' FROM files f WHERE ({rx("code", "rs_pipe")} OR (contains(code, 'stdin') AND (contains(code, 'stdout') OR contains(code, 'stderr'))))
    AND EXISTS (SELECT 1 FROM ln a JOIN ln b ON a.package_id = b.package_id AND a.path = b.path AND abs(a.i - b.i) <= 30 WHERE a.package_id = f.package_id AND a.path = f.path AND {rx("a.l", "rs_socket")} AND {rx("b.l", "rs_shell")})
  UNION ALL SELECT package_id, path, 'HIGH_STEGANOGRAPHIC_PAYLOAD' FROM ent WHERE e > 4.5
  UNION ALL SELECT package_id, path, 'HIGH_ENCODED_PAYLOAD_CHAIN' FROM win WHERE ({rx("w", "b64_40")} OR {rx("w", "hex10")}) AND {rx("w", "decode")} AND {rx("w", "exec_sink")}),
file_hits AS (SELECT package_id, rule_id, arg_min(path, string_split(path, '/')) AS file_path FROM fh GROUP BY ALL),
hk AS (SELECT package_id, CASE WHEN coalesce({SCRIPT("preinstall")}, '') <> '' THEN 'preinstall' WHEN coalesce({SCRIPT("postinstall")}, '') <> '' THEN 'postinstall' ELSE 'preuninstall' END AS hook,
   CASE WHEN coalesce({SCRIPT("preinstall")}, '') <> '' THEN {SCRIPT("preinstall")} WHEN coalesce({SCRIPT("postinstall")}, '') <> '' THEN {SCRIPT("postinstall")} ELSE {SCRIPT("preuninstall")} END AS command FROM manifests),
hook AS (SELECT *, regexp_replace(list_filter(regexp_split_to_array(command, '\\s+'), lambda t: t LIKE '%.js')[1], '^(\\./)+', '') AS entry FROM hk WHERE coalesce(command, '') <> ''),
src0 AS (SELECT h.package_id, h.entry, -1 AS n, code FROM hook h JOIN files f ON f.package_id = h.package_id AND f.path = h.entry),
req AS (SELECT package_id, entry, generate_subscripts(r, 1) AS n, unnest(r) AS r FROM (SELECT *, regexp_extract_all(code, {q(PATTERN["local_require"])}, 1) AS r FROM src0)),
cand AS (SELECT package_id, n, regexp_replace(entry, '[^/]*$', '') || regexp_replace(r, '^(\\./)+', '') AS p FROM req),
src1 AS (SELECT c.package_id, c.n, arg_min(f.code, CASE WHEN f.path = p THEN 0 WHEN f.path = p || '.js' THEN 1 ELSE 2 END) AS code FROM cand c JOIN files f ON f.package_id = c.package_id AND f.path IN (p, p || '.js', p || '/index.js') GROUP BY ALL),
src AS (SELECT package_id, n, code FROM src0 UNION ALL SELECT package_id, n, code FROM src1),
hook_hits AS (
  SELECT package_id, 'CRIT_INSTALL_HOOK_EXEC' AS rule_id FROM hook WHERE {rx("command", "shell_cmd")} OR {rx("command", "node_e_loader")} UNION SELECT package_id, 'CRIT_INSTALL_HOOK_EXEC' FROM src WHERE {rx("code", "child_proc")} AND {rx("code", "shell_cmd")}
  UNION SELECT package_id, 'CRIT_INSTALL_HOOK_NETWORK' FROM src WHERE {rx("code", "net_send")} AND NOT {rx("code", "localhost")}
  UNION SELECT package_id, 'HIGH_OBFUSCATED_INSTALL' FROM src WHERE len(regexp_extract_all(code, {q(PATTERN["hex_esc"])})) >= 5 OR len(regexp_extract_all(code, {q(PATTERN["uni_esc"])})) >= 5 OR {rx("code", "from_char_code")} OR {rx("code", "b64_long")}
  UNION SELECT package_id, 'MED_EVAL_USAGE' FROM src WHERE {rx("code", "eval")} AND NOT {rx("code", "b64_decode")}),
facts AS (SELECT package_id, count(*) AS n_js, CAST(sum(len(string_split(code, chr(10)))) AS BIGINT) AS n_lines, bool_or({rx("code", "file_read")}) AS reads, bool_or({rx("code", "net_send")}) AS sends, max(len(string_split(code, chr(10)))) AS l, max(octet_length(encode(code))) AS b FROM files GROUP BY package_id),
pk AS (SELECT facts.*, raw, json_extract_string(raw, '$.name') AS name FROM facts JOIN manifests USING (package_id)),
squat AS (SELECT package_id, name, arg_min(top, i) AS close_to FROM (SELECT package_id, name, unnest({TOP_NAMES}) AS top, unnest(range({len(TOP_NAMES)})) AS i FROM pk) WHERE name NOT LIKE '@%' AND abs(length(name) - length(top)) <= 2 AND levenshtein(name, top) BETWEEN 1 AND 2 GROUP BY ALL),
pkg_hits AS (SELECT package_id, 'MED_NETWORK_PLUS_FS' AS rule_id FROM pk WHERE reads AND sends
  UNION ALL SELECT package_id, 'MED_MINIFIED_SINGLE_FILE' FROM pk WHERE n_js = 1 AND ((l < 5 AND b > 10000) OR (b / l > 200 AND l < 20))
  UNION ALL SELECT package_id, 'MED_INSTALL_HOOK_EXISTS' FROM pk WHERE {KEY("preinstall")} OR {KEY("postinstall")}
  UNION ALL SELECT package_id, 'MED_SUSPICIOUS_PACKAGE_STRUCTURE' FROM pk WHERE ({KEY("preinstall")} OR {KEY("postinstall")} OR {KEY("install")}) AND n_js BETWEEN 1 AND 2 AND n_lines < 50
  UNION ALL SELECT package_id, 'HIGH_TYPOSQUAT_SIGNAL' FROM squat),
mh AS ({" UNION ALL ".join(f"SELECT package_id, '{h}' AS hook, {SCRIPT(h)} AS command FROM manifests" for h in ("preinstall", "install", "postinstall"))}),
mhook AS (SELECT * FROM mh WHERE trim(command) <> '' AND NOT {rx("command", "m_benign")}),
url AS (SELECT package_id, hook, lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS h FROM (SELECT package_id, hook, unnest(regexp_extract_all(command, {q(PATTERN["m_url"])})) AS u FROM mhook)),
body AS (SELECT *, CASE WHEN regexp_extract(command, {q(PATTERN["m_node_double"])}, 1) <> '' THEN regexp_extract(command, {q(PATTERN["m_node_double"])}, 1) WHEN regexp_extract(command, {q(PATTERN["m_node_single"])}, 1) <> '' THEN regexp_extract(command, {q(PATTERN["m_node_single"])}, 1) ELSE regexp_extract(command, {q(PATTERN["m_node_bare"])}, 1) END AS body FROM mhook),
tok AS (SELECT package_id, hook, t FROM (SELECT package_id, hook, unnest(regexp_extract_all(command, {q(PATTERN["m_b64_token"])})) AS t FROM mhook WHERE {rx("command", "m_decode")})),
man_hits AS (SELECT package_id, 'CRIT_MANIFEST_CURL_PIPE' AS rule_id, hook FROM mhook WHERE {rx("command", "m_curl_pipe")}
  UNION ALL SELECT package_id, 'CRIT_MANIFEST_NODE_EVAL', hook FROM body WHERE {rx("body", "m_node_susp")}
  UNION ALL SELECT DISTINCT package_id, 'HIGH_MANIFEST_ENCODED_PAYLOAD', hook FROM tok WHERE length(rtrim(t, '=')) % 4 <> 1
  UNION ALL SELECT DISTINCT package_id, 'HIGH_MANIFEST_SUSPICIOUS_URL', hook FROM url WHERE NOT {WHITE}
  UNION ALL SELECT DISTINCT m.package_id, 'MED_MANIFEST_INSTALL_HOOK_ONLY', CAST(NULL AS VARCHAR) FROM mhook m JOIN pk ON pk.package_id = m.package_id WHERE hook <> 'install' AND n_lines < 50 AND {DEPS} = 0),
rule AS (SELECT * FROM {rows([(r, severity(r), score(r), LIVE_WEIGHT.get(r, UNKNOWN_WEIGHT), r in HARD, REPLAY_WEIGHT.get(r, UNKNOWN_WEIGHT), r in REPLAY_HARD) for r in sorted({*LIVE_WEIGHT, "CRIT_DNS_EXFIL", "HIGH_MANIFEST_ENCODED_PAYLOAD"})])} AS t(rule_id, severity, score, weight, hard, rweight, rhard)),
allhits AS (SELECT package_id, rule_id, file_path, 'source' AS origin FROM file_hits UNION ALL SELECT package_id, rule_id, NULL, 'source' FROM hook_hits UNION ALL SELECT package_id, rule_id, NULL, 'source' FROM pkg_hits UNION ALL SELECT package_id, rule_id, hook, 'manifest' FROM man_hits),
hits AS (SELECT allhits.*, severity, CAST(score AS DOUBLE) AS score, CAST(weight AS DOUBLE) AS weight, hard, CAST(rweight AS DOUBLE) AS rweight, rhard FROM allhits JOIN rule USING (rule_id)),
sc AS (SELECT package_id, round(sum(score * weight), 6) AS weighted, round(sum(CASE WHEN hard THEN score * weight ELSE 0 END), 6) AS hard, round(sum(score), 6) AS total, bool_or(rule_id = 'MED_INSTALL_HOOK_EXISTS') AS hook FROM hits GROUP BY package_id),
risk AS (SELECT package_id, CAST(least((CASE WHEN coalesce(json_extract_string(raw, '$.repository'), '') IN ('', '{{}}') THEN 10 ELSE 0 END + CASE WHEN coalesce(json_extract_string(raw, '$.license'), '') = '' THEN 5 ELSE 0 END
   + CASE WHEN length(coalesce(json_extract_string(raw, '$.description'), '')) < 20 THEN 5 ELSE 0 END + CASE WHEN coalesce({KEY("preinstall")} OR {KEY("install")} OR {KEY("postinstall")}, false) THEN 20 ELSE 0 END
   + CASE WHEN coalesce(len(json_keys(raw, '$.dependencies')), 0) = 0 AND coalesce({KEY("preinstall")} OR {KEY("postinstall")}, false) THEN 15 ELSE 0 END), 100) AS DECIMAL(5, 2)) / 100 AS risk FROM manifests),
dec AS (SELECT s.package_id, gnn, coalesce(weighted, 0) AS weighted, coalesce(hard, 0) AS hard, coalesce(total, 0) AS total, coalesce(risk, 0) AS risk, coalesce(hook, false) AS hook FROM ({cte("scores")}) s LEFT JOIN sc USING (package_id) LEFT JOIN risk USING (package_id))
"""
CL = lambda x, lo, hi: f"round(greatest({d(lo)}, least({d(hi)}, {x})), 6)"


def live(gnn: str = "gnn") -> str:
    cases = [
        (f"{gnn} >= {d(0.8)}", "malicious", "gnn_direct", CL(gnn, 0.9, 0.97)),
        (f"{gnn} >= {d(0.35)} AND {gnn} < {d(0.8)} AND hook", "malicious", "install_hook", CL(f"{gnn} + {d(0.1)}", 0.82, 0.95)),
        (f"{gnn} >= {d(0.45)} AND weighted >= 1", "malicious", "weighted_rules", CL(f"{gnn} + {d(0.1)}", 0.8, 0.95)),
        (f"{gnn} >= 0 AND hard >= 8", "malicious", "hard_rules", CL(f"{gnn} + {d(0.08)}", 0.82, 0.95)),
        (f"{gnn} IS NULL AND hard >= 8", "malicious", "rules_only_block", d(0.85)),
        (f"{gnn} IS NULL AND (weighted > 0 OR total > 0 OR risk > 0.5)", "suspicious", "rules_only_review", d(0.65)),
        (f"{gnn} IS NULL", "clean", "rules_only_clean", d(0.5)),
        (f"{gnn} < {d(0.35)} AND weighted <= 0", "clean", "clean_pass", f"round(least({d(0.95)}, 1 - {gnn}), 6)"),
        (f"{gnn} < {d(0.35)}", "suspicious", "low_gnn_review", d(0.65)),
        ("weighted > 0 OR hard > 0", "suspicious", "static_review", CL(gnn, 0.5, 0.75)),
        ("true", "suspicious", "gnn_review", CL(gnn, 0.5, 0.75)),
    ]
    case = lambda k, f: "CASE " + " ".join(f"WHEN {c[0]} THEN {f(c[k])}" for c in cases) + " END"
    return f"SELECT package_id, {case(1, q)} AS verdict, {case(2, q)} AS path, {case(3, str)} AS confidence FROM dec"


def pkg(select: str, more: str = "") -> str:
    return f"WITH {PKG}{', ' + more if more else ''} {select}"


def any_term(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {q(t)})" for t in terms) + ")"


HOOKS4 = ("install", "postinstall", "preinstall", "prepare")
LCX = f"""lc AS (SELECT package_id, list_filter([{", ".join(SCRIPT(h) for h in HOOKS4)}], lambda x: x IS NOT NULL) AS commands FROM manifests),
lt AS (SELECT package_id, array_to_string(commands, chr(10)) AS cmd, list_slice(flatten(list_transform(commands, lambda c: coalesce(regexp_extract_all(c, '(?:^|\\s)(?:node\\s+)?([^\\s;&|]+\\.[cm]?js)\\b', 1), []))), 1, 5) AS targets FROM lc WHERE len(commands) > 0),
lf AS (SELECT t.package_id, count(*) AS found, string_agg(left(code, 131072), chr(10) ORDER BY left(code, 131072)) AS code FROM (SELECT DISTINCT package_id, regexp_replace(unnest(targets), '^(\\./)+', '') AS path FROM lt) t JOIN files f ON f.package_id = t.package_id AND f.path = t.path GROUP BY ALL),
lb AS (SELECT lt.package_id, len(targets) AS targets, coalesce(found, 0) AS found, cmd || coalesce(chr(10) || code, '') AS txt FROM lt LEFT JOIN lf USING (package_id)),
lx AS (SELECT package_id, CAST(targets AS INT) AS targets, CAST(found AS BIGINT) AS found, {any_term("txt", NETWORK_TERMS)} AS network, {any_term("txt", SHELL_TERMS)} AS shell, {any_term("txt", SECRET_TERMS)} AS secrets, {any_term("txt", OBFUSCATION_TERMS)} AS obfuscation, {any_term("txt", BUILD_TERMS)} AS build FROM lb)"""

REQ = f"req AS ({cte('requests')}), act AS (SELECT *, CASE WHEN kind = 'metadata' THEN 'passthrough' WHEN size > 150000 THEN 'skip_scan' WHEN verdict = 'malicious' THEN 'block' WHEN verdict = 'error' THEN 'fail_open' ELSE 'forward' END AS action FROM req)"
ITEMS = f"""items AS ({cte("items")}), u AS (SELECT *, CASE WHEN label = 1 THEN 'c:' || campaign ELSE 'i:' || CAST(item_id AS VARCHAR) END AS unit FROM items),
un AS (SELECT label, unit, row_number() OVER (PARTITION BY label ORDER BY md5(unit || ':42')) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT label, unit FROM u)),
split AS (SELECT item_id, u.label, campaign, CASE WHEN r <= floor(n * {d(0.7)}) THEN 'train' WHEN r <= floor(n * {d(0.7)}) + floor(n * {d(0.15)}) THEN 'val' ELSE 'test' END AS split FROM u JOIN un USING (unit))"""
EDGES = f"ed AS ({cte('edges')}), nd AS (SELECT vec_id AS node_id, CAST(label AS BIGINT) AS package_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)) AS h FROM embeddings)"

ORACLE_SQL: dict[str, str] = {
    "verdict_mix": pkg("SELECT verdict, path, count(*) AS n FROM dd GROUP BY ALL", f"dd AS ({live()})"),
    "verdict_hybrid": pkg(live()),
    "verdict_static_only": pkg(live("CAST(NULL AS DOUBLE)")),
    "rule_hits_by_rule": pkg("SELECT rule_id, count(*) AS n, sum(score) AS score FROM hits GROUP BY rule_id"),
    "rule_hits_by_severity": pkg("SELECT severity, origin, count(*) AS n FROM hits GROUP BY ALL"),
    "pkg_scores": pkg("SELECT * FROM sc"),
    "pkg_scores_replay": pkg("SELECT package_id, round(sum(score * rweight), 6) AS weighted, round(sum(CASE WHEN rhard THEN score * rweight ELSE 0 END), 6) AS hard, round(sum(score), 6) AS total, bool_or(rule_id = 'MED_INSTALL_HOOK_EXISTS') AS hook FROM hits GROUP BY package_id"),
    "package_facts": pkg("SELECT package_id, n_js, n_lines, reads, sends FROM facts"),
    "typosquat_theta": pkg("SELECT package_id, name, close_to FROM squat"),
    "near_names": "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name, b.name AS other FROM n a, n b WHERE abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(a.name, b.name) BETWEEN 1 AND 2",
    "hook_relation": pkg("SELECT h.package_id, h.hook, h.command, count(s.code) AS n_sources, CAST(coalesce(sum(length(s.code)), 0) AS BIGINT) AS n_chars FROM hook h LEFT JOIN src s USING (package_id) GROUP BY ALL"),
    "manifest_hits": pkg("SELECT package_id, rule_id, hook FROM man_hits"),
    "metadata_risk": pkg("SELECT package_id, CAST(risk AS DOUBLE) AS risk FROM risk"),
    "manifest_context": pkg(f"""SELECT package_id, array_to_string(list_filter([{", ".join(q(h) for h in HOOKS4)}], lambda h: list_contains(coalesce(json_keys(raw, '$.scripts'), []), h)), ',') AS hooks, coalesce(json_extract_string(raw, '$.license'), '') <> '' AS has_license,
        coalesce(json_extract_string(raw, '$.repository'), '') NOT IN ('', '{{}}') AS has_repository, CAST(length(coalesce(json_extract_string(raw, '$.description'), '')) AS BIGINT) AS description_length, CAST({DEPS} AS BIGINT) AS dependencies, CAST(coalesce(len(json_keys(raw, '$.scripts')), 0) AS BIGINT) AS scripts FROM manifests"""),
    "lifecycle_context": pkg("SELECT *, CAST(network AS INT) + CAST(shell AS INT) + CAST(secrets AS INT) + CAST(obfuscation AS INT) AS risk_score FROM lx", LCX),
    "file_rule_hits": pkg("SELECT package_id, rule_id, file_path FROM file_hits"),
    "confusion_3_systems": rec(f"SELECT *, {RATES} FROM c", f"{SYSTEMS}, c AS (SELECT system, {CELLS} FROM sys GROUP BY system)"),
    "coverage": rec("SELECT kind, value, n, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share FROM k", """k AS (SELECT 'gnn' AS kind, CASE WHEN gnn_score >= 0 THEN 'available' ELSE 'unavailable' END AS value, count(*) AS n FROM rec GROUP BY ALL
        UNION ALL SELECT 'error', CASE WHEN coalesce(gnn_error_type, '') = '' THEN 'UNKNOWN' ELSE gnn_error_type END, count(*) FROM rec WHERE gnn_score < 0 GROUP BY ALL UNION ALL SELECT 'cpg', cpg_status, count(*) FROM rec GROUP BY ALL)"""),
    "decision_buckets": rec("SELECT decision_bucket, count(*) AS n FROM rec GROUP BY ALL"),
    "rule_saved_hurt": rec("SELECT rule_id, count(*) FILTER (WHERE true_label = 1) AS saved, count(*) FILTER (WHERE true_label = 0) AS hurt FROM long_rules WHERE gnn_score < 0.5 AND guess = 1 GROUP BY rule_id"),
    "score_calibration": rec("SELECT bucket, low, high, count(gnn_score) AS total, CAST(coalesce(sum(true_label), 0) AS BIGINT) AS malicious, round(coalesce(sum(true_label) / count(gnn_score), 0), 6) AS rate FROM b LEFT JOIN rec ON gnn_score >= low AND (gnn_score < high OR (bucket = 9 AND gnn_score <= high)) GROUP BY ALL",
        "b AS (SELECT CAST(i AS INT) AS bucket, i / CAST(10 AS DOUBLE) AS low, (i + 1) / CAST(10 AS DOUBLE) AS high FROM (SELECT unnest(range(10)) AS i))"),
    "error_records": rec("SELECT package_name, kind, category, band, profile FROM errs"),
    "error_summary": rec("SELECT kind, 'category' AS dimension, category AS value, count(*) AS n FROM errs GROUP BY ALL UNION ALL SELECT kind, 'band', band, count(*) FROM errs GROUP BY ALL UNION ALL SELECT kind, 'profile', profile, count(*) FROM errs GROUP BY ALL"),
    "top_rules": rec("SELECT kind, rule_id, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, rule_id) AS INT) AS place FROM c QUALIFY place <= 20",
        "le AS (SELECT CASE WHEN true_label = 0 AND guess = 1 THEN 'fp' WHEN true_label = 1 AND guess = 0 THEN 'fn' END AS kind, rule_id FROM long_rules), c AS (SELECT kind, rule_id, count(*) AS n FROM le WHERE kind IS NOT NULL GROUP BY ALL)"),
    "improvement_candidates": rec("SELECT idea, area, count(*) AS n FROM errs JOIN i USING (category) GROUP BY ALL", f"i AS (SELECT * FROM {rows([(i, a, c) for i, a, cs in IDEAS for c in cs])} AS t(idea, area, category))"),
    "policy_sweep": rec("SELECT * FROM swept", sweep_cte(SWEEP)),
    "policy_sweep_full": rec("SELECT config_id, tp, fp, fn, tn FROM cnt", sweep_cte(SWEEP)),
    "best_recall_at_precision": best('"precision"', PRECISIONS, 'recall DESC, f1 DESC, "precision" DESC, fp'),
    "best_precision_at_recall": best("recall", RECALLS, '"precision" DESC, f1 DESC, fp'),
    "best_f1": rec('SELECT * FROM swept ORDER BY f1 DESC, "precision" DESC, config_id LIMIT 10', sweep_cte(SWEEP)),
    "reachable_goals": rec('SELECT p AS min_precision, r AS min_recall, bool_or("precision" >= p AND recall >= r) AS reached FROM swept, g GROUP BY ALL', sweep_cte(SWEEP) + ", g AS (SELECT CAST(p AS DOUBLE) AS p, CAST(r AS DOUBLE) AS r FROM " + rows(GOALS) + " AS t(p, r))"),
    "threshold_sweep": rec("SELECT * FROM thr", thresholds(30, 95, 5)),
    "pr_curve_86": rec('SELECT threshold, "precision", recall FROM thr', thresholds(10, 95, 1)),
    "best_threshold": rec('SELECT m AS min_precision, coalesce((SELECT threshold FROM thr WHERE "precision" >= m ORDER BY recall DESC, f1 DESC, threshold LIMIT 1), 0.5) AS threshold FROM (SELECT CAST(unnest([0.3, 0.99]) AS DOUBLE) AS m)', thresholds(10, 95, 1)),
    "score_curve": rec("SELECT gnn_score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM s WINDOW w AS (ORDER BY gnn_score DESC)", "s AS (SELECT gnn_score, sum(true_label) AS p, sum(1 - true_label) AS n FROM rec WHERE gnn_score >= 0 GROUP BY ALL)"),
    "ranking_metrics": rec("""SELECT round((SELECT sum(a.p * b.n * CASE WHEN a.gnn_score > b.gnn_score THEN 1 WHEN a.gnn_score = b.gnn_score THEN 0.5 ELSE 0 END) FROM s a, s b) / (np * nn), 6) AS roc_auc,
        (SELECT round(sum(p / np * tp / (tp + fp)), 6) FROM c) AS average_precision, (SELECT round(coalesce(min(fp / nn), 1), 6) FROM c WHERE tp / np >= 0.95) AS fpr_at_95r, (SELECT round(coalesce(max(tp / np), 0), 6) FROM c WHERE tp / (tp + fp) >= 0.99) AS recall_at_99p,
        (SELECT round(coalesce(max(tp / np), 0), 6) FROM c WHERE tp / (tp + fp) >= 0.999) AS recall_at_999p, (SELECT coalesce(min(gnn_score), 1) FROM c WHERE tp / (tp + fp) >= 0.999) AS threshold_at_999p,
        (SELECT round(coalesce(min(tp / np), 1), 6) FROM c WHERE fp / nn >= 0.01) AS recall_at_1fpr
        FROM (SELECT CAST(sum(p) AS DOUBLE) AS np, CAST(sum(n) AS DOUBLE) AS nn FROM s)""", "s AS (SELECT gnn_score, CAST(sum(true_label) AS DOUBLE) AS p, CAST(sum(1 - true_label) AS DOUBLE) AS n FROM rec WHERE gnn_score >= 0 GROUP BY ALL), c AS (SELECT gnn_score, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM s WINDOW w AS (ORDER BY gnn_score DESC))"),
    "score_histogram": rec("SELECT true_label, CAST(least(floor(gnn_score * 50), 49) AS INT) AS bin, count(*) AS n FROM rec WHERE gnn_score >= 0 GROUP BY ALL"),
    "class_bins": rec("SELECT true_label, CAST(CASE WHEN gnn_score < 0 THEN -1 ELSE least(floor(gnn_score * 10), 9) END AS INT) AS bin, count(*) AS n FROM rec GROUP BY ALL"),
    "class_score_stats": rec("SELECT true_label, count(*) AS n, round(avg(gnn_score), 6) AS mean, round(stddev_pop(gnn_score), 6) AS deviation, count(*) FILTER (WHERE gnn_score >= 0.5) AS above FROM rec WHERE gnn_score >= 0 GROUP BY ALL"),
    "fn_bands": rec("""SELECT CASE WHEN rules_score = 0 THEN '0' WHEN rules_score <= 5 THEN '(0,5]' WHEN rules_score <= 10 THEN '(5,10]' WHEN rules_score < 15 THEN '(10,15)' ELSE '>=15' END AS band, count(*) AS n,
        round(avg(gnn_score) FILTER (WHERE hybrid_verdict = 'suspicious'), 6) AS suspicious_mean FROM rec WHERE true_label = 1 AND guess = 0 GROUP BY ALL"""),
    "signal_impact": rec(f"SELECT *, {RATES} FROM af", signal_cte(CONTEXT)),
    "lifecycle_impact": rec(f"SELECT *, {RATES} FROM af", signal_cte(LIFE)),
    "harmless_signals": rec("SELECT signal, kind, gain FROM good", signal_cte(CONTEXT)),
    "combined_signals": rec(f"SELECT *, {RATES} FROM c", signal_cte(CONTEXT + LIFE) + f""", fl AS (SELECT package_name, arg_max(CASE WHEN kind = 'suppressor' THEN 0 ELSE 1 END, pos) AS v FROM fired WHERE signal IN (SELECT signal FROM good) AND ((kind = 'suppressor' AND guess = 1) OR (kind = 'confirmer' AND guess = 0)) GROUP BY ALL),
        nw AS (SELECT true_label, coalesce(v, guess) AS guess FROM rec LEFT JOIN fl USING (package_name)), c AS (SELECT {CELLS} FROM nw)"""),
    "mid_gnn_hook_slice": rec(f"SELECT *, {RATES} FROM c", f"c AS (SELECT {CELLS} FROM rec WHERE {MID} AND hook)"),
    "hard_examples": rec("SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'fp' THEN -gnn_score ELSE gnn_score END, package_name) AS INT) AS place, package_name, gnn_score FROM errs QUALIFY place <= 50"),
    "run_diff_metrics": rec("SELECT a.system, a.metric, a.v AS before, b.v AS after, round(b.v - a.v, 6) AS delta FROM l a JOIN l b ON a.system = b.system AND a.metric = b.metric WHERE a.run = 0 AND b.run = 1",
        f"{SYSTEMS}, c AS (SELECT run, system, {CELLS} FROM sys GROUP BY ALL), r AS (SELECT *, {RATES} FROM c), l AS ({' UNION ALL '.join(f'SELECT run, system, {q(m)} AS metric, CAST({chr(34)}{m}{chr(34)} AS DOUBLE) AS v FROM r' for m in ('tp', 'fp', 'fn', 'tn', 'precision', 'recall', 'f1'))} UNION ALL SELECT run, system, 'flagged', CAST(tp + fp AS DOUBLE) FROM r)"),
    "run_diff_buckets": rec("SELECT decision_bucket, count(*) FILTER (WHERE run = 0) AS before, count(*) FILTER (WHERE run = 1) AS after, count(*) FILTER (WHERE run = 1) - count(*) FILTER (WHERE run = 0) AS delta, abs(count(*) FILTER (WHERE run = 1) - count(*) FILTER (WHERE run = 0)) > 5 AS notable FROM rec GROUP BY ALL"),
    "verdict_changes": rec("SELECT before, after, change, count(*) AS n FROM ch GROUP BY ALL", f"""two AS (SELECT *, {verdict("CASE WHEN gnn_score >= 0 THEN gnn_score * 0.5 ELSE gnn_score END")} AS again FROM rec),
        lst AS (SELECT short_name, arg_max(hybrid_verdict, seq) AS before, arg_max(again, seq) AS after, arg_max(true_label, seq) AS y FROM two GROUP BY ALL),
        ok AS (SELECT *, (before = 'malicious' AND y = 1) OR (before = 'clean' AND y = 0) AS was, (after = 'malicious' AND y = 1) OR (after = 'clean' AND y = 0) AS now FROM lst WHERE before <> after),
        ch AS (SELECT before, after, CASE WHEN NOT was AND now THEN 'fixed' WHEN was AND NOT now THEN 'broken' ELSE 'moved' END AS change FROM ok)"""),
    "campaign_split": f"WITH {ITEMS} SELECT * FROM split",
    "split_stats": f"WITH {ITEMS}, c AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 1) AS malicious, count(*) FILTER (WHERE label = 0) AS benign FROM split GROUP BY split) SELECT *, round(greatest(malicious, benign) / greatest(least(malicious, benign), 1), 6) AS ratio, greatest(malicious, benign) / greatest(least(malicious, benign), 1) > 3 AS imbalanced FROM c",
    "split_leaks": f"WITH {ITEMS} SELECT campaign, count(DISTINCT split) AS splits FROM split WHERE label = 1 GROUP BY campaign HAVING count(DISTINCT split) > 1",
    "graph_filter_summary": f"WITH {ITEMS} SELECT count(*) AS n, count(*) FILTER (WHERE nodes BETWEEN 2 AND 50000) AS kept, CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws(':', item_id, nodes, label)), 1, 12) AS BIGINT)) FILTER (WHERE nodes BETWEEN 2 AND 50000), 0) AS VARCHAR) AS fingerprint FROM items",
    "cfg_next": f"""WITH s AS ({cte("statements")}), n AS (SELECT *, lead(node_id) OVER (PARTITION BY package_id, parent_id ORDER BY node_id) AS dst FROM s WHERE type LIKE '%\\_statement' ESCAPE '\\' OR type LIKE '%\\_declaration' ESCAPE '\\')
        SELECT package_id, node_id AS src, dst FROM n WHERE dst IS NOT NULL AND type <> 'return_statement'""",
    "def_use_asof": f"WITH c AS ({cte('calls')}) SELECT u.key, u.id AS use_id, coalesce(max(d.id), -1) AS def_id FROM c u LEFT JOIN c d ON d.key = u.key AND d.event_type = 'signup' AND d.at <= u.at WHERE u.event_type = 'view' GROUP BY ALL",
    "node_type_index": f"WITH s AS ({cte('statements')}) SELECT CAST(CASE WHEN list_position({NODE_TYPES}, type) > 0 THEN list_position({NODE_TYPES}, type) - 1 ELSE 22 END AS INT) AS type_index, count(*) AS n FROM s GROUP BY ALL",
    "merged_edges": f"WITH {EDGES}, num AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS n FROM nd) SELECT CAST(0 AS BIGINT) AS package_id, a.n AS src, b.n AS dst, edge_type FROM ed JOIN num a ON a.node_id = ed.src JOIN num b ON b.node_id = ed.dst",
    "edge_hist": f"WITH {EDGES} SELECT package_id, {', '.join(f'round(count(*) FILTER (WHERE edge_type = {k}) / greatest(count(*), 1), 6) AS e{k}' for k in range(4))} FROM ed GROUP BY package_id",
    "message_pass_1hop": f"""WITH {EDGES}, m AS (SELECT dst AS node_id, k, greatest(x + bias, 0) AS x FROM (SELECT dst, bias, generate_subscripts(h, 1) - 1 AS k, unnest(h) AS x FROM ed JOIN nd ON nd.node_id = ed.src WHERE dst IN (SELECT node_id FROM nd))
        UNION ALL SELECT node_id, generate_subscripts(h, 1) - 1, unnest(h) FROM nd) SELECT node_id, CAST(k AS BIGINT) AS k, round(sum(x), 4) + 0.0 AS x FROM m GROUP BY ALL""",
    "graph_pooling": f"WITH {EDGES}, e AS (SELECT package_id, generate_subscripts(h, 1) - 1 AS k, unnest(h) AS x FROM nd) SELECT package_id, CAST(k AS BIGINT) AS k, round(avg(x), 9) + 0.0 AS mean, round(sum(x), 9) + 0.0 AS total, round(max(x), 9) + 0.0 AS most FROM e GROUP BY ALL",
    "node_cap": f"WITH {PKG}, c AS (SELECT package_id, path, CAST(len(string_split(code, chr(10))) AS BIGINT) AS nodes FROM files), s AS (SELECT *, CAST(coalesce(sum(nodes) OVER (PARTITION BY package_id ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c) SELECT * FROM s WHERE before < 40",
    "lockfile_audit": f"""WITH dp AS ({cte("dependencies")}), pv AS ({cte("part_verdicts")}), c AS (SELECT lockfile_id, {", ".join(f"count(*) FILTER (WHERE coalesce(verdict, 'error') = '{v}') AS {v}" for v in ("clean", "suspicious", "malicious", "error"))} FROM dp LEFT JOIN pv USING (name) GROUP BY lockfile_id)
        SELECT *, suspicious + malicious AS flagged, malicious > 0 AS fail_high, malicious + suspicious > 0 AS fail_medium, suspicious + malicious > 0 AS fail_any FROM c""",
    "lockfile_dependencies": "SELECT DISTINCT o_custkey AS lockfile_id, 'pkg' || CAST(o_orderkey % 50 AS VARCHAR) AS name, '1.0' AS version FROM orders",
    "proxy_actions": f"WITH {REQ} SELECT kind, action, count(*) AS n FROM act GROUP BY ALL",
    "dashboard_counts": f"WITH {REQ} SELECT count(*) FILTER (WHERE action IN ('block', 'forward')) AS scanned, count(*) FILTER (WHERE verdict = 'clean') AS clean, count(*) FILTER (WHERE verdict = 'malicious') AS malicious, count(*) FILTER (WHERE action = 'block') AS blocked FROM act",
    "hourly_blocks": f"WITH {REQ}, h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (WHERE action = 'block') AS blocked FROM act GROUP BY ALL) SELECT hour, n, blocked, round(sum(blocked) OVER w / sum(n) OVER w, 6) AS block_share FROM h WINDOW w AS (ORDER BY hour RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)",
    "client_sessions": f"""WITH {REQ}, t AS (SELECT key, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM req), n AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY key ORDER BY t, event_id)),
        s AS (SELECT key, t, CAST(sum(new) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n) SELECT key, session, min(t) AS start, count(*) AS n FROM s GROUP BY ALL""",
    "tarball_url": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '@scope/' ELSE '' END || replace(p_name, ' ', '-') AS name, replace(p_name, ' ', '-') AS plain, '1.' || CAST(p_size AS VARCHAR) || '.0' AS version FROM part)
        SELECT p_partkey, 'https://registry.example/' || replace(name, '/', '%2f') || '/-/' || plain || '-' || version || '.tgz' AS url, name, version, name AS spec_name, version AS spec_version FROM p""",
    "first_seen_versions": f"WITH {REQ} SELECT key, min(event_id) AS event_id, arg_min(verdict, event_id) AS verdict FROM req GROUP BY key",
    "evidence_lines": pkg("SELECT text, count(*) AS n FROM t GROUP BY text", f"""dd AS ({live()}), t AS (SELECT 'verdict ' || verdict || ' ' || path AS text FROM dd
        UNION ALL SELECT 'rule ' || rule_id || ' [' || severity || ']' || coalesce(' ' || file_path, '') FROM hits)"""),
    "taint_flags": pkg("SELECT flag, detail, count(*) AS n FROM t GROUP BY ALL", f"""t AS (SELECT 'source' AS flag, CASE WHEN {rx("code", "taint_decode")} THEN 'Buffer.from with base64' WHEN {rx("code", "taint_atob")} THEN 'atob()' ELSE 'fs.readFileSync' END AS detail
        FROM files WHERE {rx("code", "taint_decode")} OR {rx("code", "taint_atob")} OR {rx("code", "taint_read")} UNION ALL SELECT 'source', 'process.env access' FROM files WHERE {rx("code", "taint_env")} UNION ALL SELECT 'sink', 'sink call' FROM files WHERE {rx("code", "sink")})"""),
    "focal_loss": rec(f"""SELECT round(avg(pow(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, 2) * -(t * ln(p) * w + (1 - t) * ln(1 - p))), 6) AS loss, round(any_value(w), 6) AS pos_weight FROM x""",
        f"""x AS (SELECT true_label AS y, greatest({d(1e-7)}, least({d(1 - 1e-7)}, gnn_score)) AS p, true_label * (1 - {d(0.05)}) + {d(0.05)} / 2 AS t, (SELECT sum(1 - true_label) / sum(true_label) FROM rec WHERE gnn_score >= 0) AS w FROM rec WHERE gnn_score >= 0)"""),
    "node_budget_batches": f"""WITH i AS (SELECT item_id, nodes FROM ({cte("items")})), l AS (SELECT list({{used: nodes, batch: 0::BIGINT, ids: [item_id], out: [0::BIGINT]}} ORDER BY item_id) AS g, list(nodes ORDER BY item_id) AS nodes FROM i),
        r AS (SELECT list_reduce(g, lambda a, x: {{used: CASE WHEN a.used + x.used > 30000 THEN x.used ELSE a.used + x.used END, batch: CASE WHEN a.used + x.used > 30000 THEN a.batch + 1 ELSE a.batch END,
            ids: list_concat(a.ids, x.ids), out: list_append(a.out, CASE WHEN a.used + x.used > 30000 THEN a.batch + 1 ELSE a.batch END)}}) AS a, nodes FROM l)
        SELECT unnest(a.ids) AS graph_id, unnest(nodes) AS nodes, unnest(a.out) AS batch FROM r""",
    "ttl_cache_hits": f"""WITH RECURSIVE {REQ}, q AS (SELECT key, event_id, verdict, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY key ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM req),
        r AS (SELECT key, event_id, n, false AS cached, CASE WHEN verdict <> 'error' THEN t END AS since FROM q WHERE n = 1
        UNION ALL SELECT q.key, q.event_id, q.n, coalesce(q.t - r.since <= 86400, false), CASE WHEN coalesce(q.t - r.since <= 86400, false) THEN r.since WHEN q.verdict <> 'error' THEN q.t ELSE r.since END FROM r JOIN q ON q.key = r.key AND q.n = r.n + 1)
        SELECT key, event_id, cached FROM r""",
    "file_facts": pkg("""SELECT f.package_id, f.path, CAST(len(string_split(code, chr(10))) AS BIGINT) AS n_lines, octet_length(encode(code)) AS n_bytes, net_line, credentials, requires, e.entropy FROM f JOIN e ON e.package_id = f.package_id AND e.path = f.path""",
        f"""f AS (SELECT package_id, path, code, CASE WHEN {rx("code", "net_send")} THEN CAST(len(string_split(regexp_split_to_array(code, {q(PATTERN["net_send"])})[1], chr(10))) AS BIGINT) ELSE 0 END AS net_line,
        CAST(len(list_distinct(regexp_extract_all(code, {q(PATTERN["cred_env"])}, 1))) AS BIGINT) AS credentials, CAST(len(regexp_extract_all(code, {q(PATTERN["local_require"])}, 1)) AS BIGINT) AS requires FROM files),
        ch AS (SELECT package_id, path, c, count(*) AS k FROM (SELECT package_id, path, unnest(string_split(code, '')) AS c FROM files) GROUP BY ALL),
        e AS (SELECT package_id, path, round(-sum(k / n * log2(k / n)), 6) AS entropy FROM (SELECT package_id, path, CAST(k AS DOUBLE) AS k, CAST(sum(k) OVER (PARTITION BY package_id, path) AS DOUBLE) AS n FROM ch) GROUP BY ALL)"""),
}


# ------------------------------------------------------------------------------------------------ records with manifests, builds and answers
def dealt(texts: list[str]) -> str:
    return f"[{', '.join(map(q, texts))}][CAST(seq % {len(texts)} AS INT) + 1]"


JS = lambda k: f"coalesce(json_extract_string(raw, '$.{k}'), '')"
COUNT = lambda k: f"CAST(coalesce(len(json_keys(raw, '$.{k}')), 0) AS INT)"
IN_SCRIPTS = lambda hooks: f"array_to_string(list_filter([{', '.join(map(q, hooks))}], lambda h: list_contains(coalesce(json_keys(raw, '$.scripts'), []), h)), ',')"
MANIFEST = f"""man AS ({cte("manifests")}), wm0 AS (SELECT rec.*, CASE WHEN seq % 17 = 0 THEN left(m.raw, 12) ELSE m.raw END AS given, {dealt(PHRASES)} AS decision_path FROM rec LEFT JOIN man m ON m.package_id = seq % 2111),
wm AS (SELECT *, CASE WHEN json_valid(given) THEN given END AS raw FROM wm0)"""
NOISY_BITS, GOOD_BITS = "(CAST(b2 AS INT) + CAST(b3 AS INT) + CAST(b5 AS INT))", "(CAST(b1 AS INT) + CAST(b4 AS INT))"
N_RULES = "(" + " + ".join(f"CAST(b{i} AS INT)" for i in range(6)) + ")"
RULE_LIST = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN b{i} THEN {q(r)} END" for i, r in enumerate(RULES)) + "], lambda x: x IS NOT NULL), ',')"
LABELS = f"lab AS (SELECT * FROM {rows([(i, *x) for i, x in enumerate(DECISION_LABELS)])} AS t(pos, said, words, label))"
PHASE = f"""CASE WHEN hybrid_verdict = 'malicious' THEN CASE WHEN contains(lower(decision_path), 'critical behavioral rule') THEN 'critical_override' WHEN contains(lower(decision_path), 'very high confidence') THEN 'auto_block'
  WHEN contains(lower(decision_path), 'confirming rules') OR contains(lower(decision_path), 'moderate malicious') THEN 'uncertain_rules_block' ELSE 'auto_block' END
  WHEN hybrid_verdict = 'clean' THEN CASE WHEN gnn_score >= 0 AND gnn_score < {d(0.35)} THEN 'auto_pass' ELSE 'uncertain_clean' END
  WHEN contains(lower(decision_path), 'review-only critical') OR contains(lower(decision_path), 'critical rule matched') THEN 'critical_override_review'
  WHEN gnn_score >= 0 AND gnn_score < {d(0.35)} THEN 'auto_pass_review' ELSE 'uncertain_suspicious' END"""
BUILDS = f"bl AS (SELECT package_name AS package_path, cpg_status AS status, coalesce(gnn_error_type, '') AS error_type, {dealt(MESSAGES)} AS error_message, {dealt(STACKS)} AS frames, num_js_files FROM rec)"
FIT = lambda text, table, other: "CASE " + " ".join(f"WHEN contains({text}, {q(w)}) THEN {q(n)}" for w, n in table) + f" ELSE {q(other)} END"
LIST7 = lambda source, parts: " UNION ALL ".join(f"SELECT {section} AS section, {name} AS name, CAST({value} AS DOUBLE) AS value FROM {source}" for section, name, value in parts)
CONF = f"{SYSTEMS}, cf AS (SELECT system, {CELLS} FROM sys GROUP BY system), cfr AS (SELECT *, {RATES} FROM cf)"
COVER = """cov AS (SELECT 'gnn' AS kind, CASE WHEN gnn_score >= 0 THEN 'available' ELSE 'unavailable' END AS value, count(*) AS n FROM rec GROUP BY ALL
  UNION ALL SELECT 'error', CASE WHEN coalesce(gnn_error_type, '') = '' THEN 'UNKNOWN' ELSE gnn_error_type END, count(*) FROM rec WHERE gnn_score < 0 GROUP BY ALL UNION ALL SELECT 'cpg', cpg_status, count(*) FROM rec GROUP BY ALL),
eff AS (SELECT rule_id, count(*) FILTER (WHERE true_label = 1) AS saved, count(*) FILTER (WHERE true_label = 0) AS hurt FROM long_rules WHERE gnn_score < 0.5 AND guess = 1 GROUP BY rule_id),
bkt AS (SELECT decision_bucket, count(*) AS n FROM rec GROUP BY ALL)"""
SCORES10 = """b10 AS (SELECT CAST(i AS INT) AS bucket, i / CAST(10 AS DOUBLE) AS low, (i + 1) / CAST(10 AS DOUBLE) AS high FROM (SELECT unnest(range(10)) AS i)),
cal AS (SELECT CAST(bucket AS VARCHAR) AS bucket, count(gnn_score) AS total, coalesce(sum(true_label), 0) AS malicious, round(coalesce(sum(true_label) / count(gnn_score), 0), 6) AS rate FROM b10 LEFT JOIN rec ON gnn_score >= low AND (gnn_score < high OR (bucket = 9 AND gnn_score <= high)) GROUP BY ALL)"""
LINE = lambda x: f"printf('%.4f', {x})"
LOOKED = {r: names[-1] for r, names in SIMPLE.items()} | {"CRIT_EXFIL_CREDENTIALS": "net_send", "CRIT_REVERSE_SHELL": "rs_socket"}


def located(rule: str, name: str) -> str:
    """Line and snippet of a pattern's first match in the file of a rule's hit."""
    before = f"regexp_split_to_array(code, {q(TWIN.get(name, PATTERN[name]))})[1]"
    match = f"length(regexp_extract(code, {q(PATTERN[name])}))" if name not in TWIN else f"length(regexp_extract(substr(code, length({before}) + 1), '^require\\s*\\('))"
    return f"""SELECT package_id, rule_id, file_path, CAST(len(string_split(b, chr(10))) AS BIGINT) AS line_number,
      left(replace(substr(code, greatest(length(b) - 30, 0) + 1, length(b) - greatest(length(b) - 30, 0) + m + 30), chr(10), '\\n'), 200) AS snippet
      FROM (SELECT h.*, f.code, {before} AS b, {match} AS m FROM file_hits h JOIN files f ON f.package_id = h.package_id AND f.path = h.file_path WHERE rule_id = {q(rule)})"""


CL2 = lambda x, lo, hi: f"greatest({d(lo)}, least({d(hi)}, {x}))"
ORACLE_SQL |= {
    "rule_lines": pkg(" UNION ALL ".join(located(r, n) for r, n in LOOKED.items()) + """
      UNION ALL SELECT h.package_id, h.rule_id, h.file_path, 0, arg_min(left(e.p, 200), instr(f.code, e.p)) FROM file_hits h JOIN files f ON f.package_id = h.package_id AND f.path = h.file_path JOIN ent e ON e.package_id = h.package_id AND e.path = h.file_path
        WHERE h.rule_id = 'HIGH_STEGANOGRAPHIC_PAYLOAD' AND e.e > 4.5 GROUP BY ALL
      UNION ALL SELECT h.package_id, h.rule_id, h.file_path, CAST(min(w.i) AS BIGINT), arg_min(left(w.w, 200), w.i) FROM file_hits h JOIN win w ON w.package_id = h.package_id AND w.path = h.file_path WHERE h.rule_id = 'HIGH_ENCODED_PAYLOAD_CHAIN'
        AND (""" + f"{rx('w.w', 'b64_40')} OR {rx('w.w', 'hex10')}) AND {rx('w.w', 'decode')} AND {rx('w.w', 'exec_sink')} GROUP BY ALL"),
    "decision_labels": rec("SELECT label, count(*) AS n FROM l GROUP BY label", f"""{MANIFEST}, {LABELS}, r AS (SELECT *, row_number() OVER () AS rid FROM wm), l AS (SELECT rid, arg_min(label, pos) AS label FROM r JOIN lab ON contains(lower(decision_path), words)
        AND (said = hybrid_verdict OR (said = '' AND hybrid_verdict NOT IN ('clean', 'malicious'))) GROUP BY rid)"""),
    "phase_labels": rec(f"SELECT true_label, {PHASE} AS phase_label, count(*) AS n FROM wm GROUP BY ALL", MANIFEST),
    "diagnostic_records": rec(f"SELECT package_name, true_label, gnn_score, rules_score, {RULE_LIST} AS rules_matched, hybrid_verdict, decision_bucket, decision_path, {PHASE} AS phase_label FROM wm", MANIFEST),
    "replayed_records": rec(f"""SELECT package_name, hybrid_verdict, round(CASE decision_bucket WHEN 'v2_gnn_direct_block' THEN {CL2("gnn_score", 0.9, 0.97)} WHEN 'v2_gnn_weighted_rules_block' THEN {CL2(f"gnn_score + {d(0.1)}", 0.8, 0.95)}
        WHEN 'v2_hard_rules_block' THEN {CL2(f"gnn_score + {d(0.08)}", 0.82, 0.95)} WHEN 'clean_pass' THEN least({d(0.95)}, 1 - gnn_score) WHEN 'v2_low_gnn_review' THEN {d(0.65)} ELSE {CL2("gnn_score", 0.5, 0.75)} END, 6) AS confidence,
        decision_bucket, replace(replace(decision_bucket, 'v2_', ''), '_', ' ') AS decision_path, weighted AS v2_weighted_rule_score, hard_score AS v2_hard_rule_score FROM rec"""),
    "package_context": rec(f"""SELECT package_name AS record, CASE WHEN {JS("name")} <> '' THEN {JS("name")} ELSE package_name END AS package_name, coalesce(len(json_keys(raw)), 0) > 0 AS has_package_json,
        (CASE WHEN {JS("name")} <> '' THEN {JS("name")} ELSE package_name END) LIKE '@%' AS scoped, {JS("repository")} NOT IN ('', '{{}}') AS has_repository, {JS("license")} <> '' AS has_license, trim({JS("description")}) <> '' AS has_description,
        CAST(length({JS("description")}) AS INT) AS description_length, {COUNT("scripts")} AS scripts_count, {IN_SCRIPTS(HOOKS4)} AS lifecycle_hooks, {IN_SCRIPTS(HOOKS4)} <> '' AS has_lifecycle_hook, {COUNT("dependencies")} AS dependency_count,
        {COUNT("devDependencies")} AS dev_dependency_count, gnn_score, metadata_risk, num_js_files, num_nodes, num_nodes * 2 AS num_edges, {RULE_LIST} AS rule_ids, {N_RULES} AS rules_count, {N_RULES} > 0 AS has_rules,
        {NOISY_BITS} AS noisy_rule_count, {GOOD_BITS} AS high_reliability_rule_count, {N_RULES} > 0 AND {NOISY_BITS} = {N_RULES} AND {GOOD_BITS} = 0 AS rules_noisy_only, bare AS rules_none, b0 AS has_med_install_hook_rule,
        false AS has_structural_rule, false AS has_manifest_hook_only_rule, b2 OR b4 AS has_critical_rule FROM wm""", MANIFEST),
    "error_shapes": rec(f"""SELECT package_name, CASE WHEN true_label = 0 THEN 'fp' ELSE 'fn' END AS kind, given IS NOT NULL AS has_package_json, given IS NOT NULL AND raw IS NULL AS package_json_error, {IN_SCRIPTS(["preinstall", "install", "postinstall", "prepare"])} AS script_hooks,
        {COUNT("dependencies")} AS dependency_count, {JS("repository")} NOT IN ('', '{{}}') AS has_repository, {JS("license")} <> '' AS has_license, CAST(length({JS("description")}) AS INT) AS description_length FROM wm WHERE true_label <> guess""", MANIFEST),
    "evaluation_summary": rec("SELECT * FROM a", f"""{CONF}, {COVER}, {SCORES10}, tt AS (SELECT count(*) AS t, sum(true_label) AS m FROM rec),
        a AS ({LIST7("tt", [("'counts'", "'total_packages'", "t"), ("'counts'", "'malicious_packages'", "m"), ("'counts'", "'benign_packages'", "t - m")])}
        UNION ALL {LIST7("cfr", [("'metrics'", f"system || '.{m}'", chr(34) + m + chr(34)) for m in ("precision", "recall", "f1", "tp", "fp", "fn", "tn")])}
        UNION ALL {LIST7("cov", [("'coverage'", "kind || '.' || value", "n")])} UNION ALL {LIST7("bkt", [("'decision_buckets'", "decision_bucket", "n")])}
        UNION ALL {LIST7("eff", [("'saved'", "rule_id", "saved"), ("'hurt'", "rule_id", "hurt")])}
        UNION ALL {LIST7("cal", [("'score_buckets.total'", "bucket", "total"), ("'score_buckets.malicious'", "bucket", "malicious"), ("'score_buckets.rate'", "bucket", "rate")])})"""),
    "evaluation_report": rec(f"""SELECT 'metrics' AS section, system AS name, '| ' || concat_ws(' | ', system, {LINE('"precision"')}, {LINE("recall")}, {LINE("f1")}, tp, fp, fn, tn) || ' |' AS line FROM cfr
        UNION ALL SELECT 'coverage', kind || ' ' || value, '- ' || kind || ' ' || value || ': ' || n FROM cov UNION ALL SELECT 'decision_buckets', decision_bucket, '- ' || decision_bucket || ': ' || n FROM bkt
        UNION ALL SELECT 'rules', rule_id, '| ' || concat_ws(' | ', rule_id, saved, hurt) || ' |' FROM eff""", f"{CONF}, {COVER}"),
    "evaluation_targets": """WITH l AS (SELECT 't' || s_suppkey AS path, CAST(s_suppkey % 2 AS INT) AS label, 'dir' AS kind, 0 AS source FROM supplier UNION ALL SELECT 't' || c_custkey, CAST(c_custkey % 2 AS INT), 'tarball', 1 FROM customer
        UNION ALL SELECT 't' || p_partkey, CAST(p_partkey % 2 AS INT), 'dir', 2 FROM part UNION ALL SELECT 't' || p_partkey, CAST(p_partkey % 3 AS INT), 'dir', 3 FROM part WHERE p_partkey % 3 < 2),
        f AS (SELECT path, label, kind, CAST(min(source) AS BIGINT) AS source FROM l GROUP BY ALL)
        SELECT path, label, kind, source, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', path, label, kind, 42))) AS place FROM f QUALIFY place <= 300""",
    "missed_rules": rec("SELECT rule_id, count(*) AS n FROM long_rules WHERE true_label = 1 AND hybrid_verdict = 'suspicious' GROUP BY ALL ORDER BY n DESC, rule_id LIMIT 5"),
    "class_separation": rec(f"""SELECT round(avg(s) FILTER (WHERE true_label = 1), 6) AS malicious_mean, round(avg(s) FILTER (WHERE true_label = 0), 6) AS benign_mean, round(coalesce(stddev_pop(s) FILTER (WHERE true_label = 1), 0), 6) AS malicious_deviation,
        round(coalesce(stddev_pop(s) FILTER (WHERE true_label = 0), 0), 6) AS benign_deviation, round(avg(s) FILTER (WHERE true_label = 1) - avg(s) FILTER (WHERE true_label = 0), 6) AS distance, count(*) FILTER (WHERE true_label = 1 AND s >= {d(0.8)}) AS malicious_above,
        count(*) FILTER (WHERE true_label = 0 AND s >= {d(0.8)}) AS benign_above, count(*) FILTER (WHERE true_label = 1) AS malicious, count(*) FILTER (WHERE true_label = 0) AS benign FROM (SELECT true_label, CASE WHEN gnn_score >= 0 THEN gnn_score END AS s FROM rec)"""),
    "optimal_thresholds": rec("""SELECT 'f1' AS strategy, coalesce((SELECT threshold FROM thr ORDER BY f1 DESC, threshold LIMIT 1), 0.5) AS threshold UNION ALL SELECT 'recall95', coalesce((SELECT threshold FROM thr WHERE recall >= 0.95 ORDER BY "precision" DESC, threshold LIMIT 1), 0.5)
        UNION ALL SELECT 'precision99', coalesce((SELECT threshold FROM fr WHERE "precision" >= 0.99 ORDER BY recall DESC, threshold LIMIT 1), 0.5) UNION ALL SELECT 'precision999', coalesce((SELECT threshold FROM fr WHERE "precision" >= 0.999 ORDER BY recall DESC, threshold LIMIT 1), 0.5)""",
        thresholds(10, 94, 1) + f", ft AS (SELECT k / CAST(1000 AS DOUBLE) AS threshold, count(*) FILTER (WHERE y = 1 AND g) AS tp, count(*) FILTER (WHERE y = 0 AND g) AS fp, count(*) FILTER (WHERE y = 1 AND NOT g) AS fn FROM (SELECT k, true_label AS y, gnn_score >= 0 AND gnn_score >= k / CAST(1000 AS DOUBLE) AS g FROM rec, (SELECT unnest(range(100, 1000)) AS k)) GROUP BY k), fr AS (SELECT *, {RATES} FROM ft)"),
    "best_config": rec('SELECT swept.*, CAST(0.33 AS DOUBLE) AS floor, CAST(1 AS INT) AS place FROM swept WHERE "precision" >= CAST(0.33 AS DOUBLE) ORDER BY recall DESC, f1 DESC, "precision" DESC, fp, config_id LIMIT 1', sweep_cte(SWEEP)),
    "compact_errors": rec("SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY package_name) AS INT) AS place, package_name, gnn_score FROM x WHERE kind IS NOT NULL QUALIFY place <= 25",
        f"x AS (SELECT package_name, gnn_score, CASE WHEN true_label = 0 AND v = 'malicious' THEN 'fp' WHEN true_label = 1 AND v <> 'malicious' THEN 'fn' END AS kind FROM (SELECT *, {verdict('gnn_score', '0.9', '0.5', '2.0', '0.35', '5.0')} AS v FROM rec))"),
    "mid_slice_errors": rec(f"SELECT CASE WHEN true_label = 1 THEN 'fn' ELSE 'tn' END AS kind, package_name, gnn_score, CAST(row_number() OVER (PARTITION BY true_label ORDER BY package_name) AS INT) AS place FROM rec WHERE {MID} AND hook AND guess = 0 QUALIFY place <= 50"),
    "signal_outcome": rec("""SELECT a."precision", a.recall, b."precision" AS base_precision, b.recall AS base_recall, CASE WHEN a."precision" >= 0.96 AND a.recall >= 0.88 THEN 'goal_reached' WHEN a.recall > b.recall AND a."precision" >= b."precision" THEN 'improved' ELSE 'not_enough' END AS outcome FROM a, b""",
        signal_cte(CONTEXT + LIFE) + f""", fl AS (SELECT package_name, arg_max(CASE WHEN kind = 'suppressor' THEN 0 ELSE 1 END, pos) AS v FROM fired WHERE signal IN (SELECT signal FROM good) AND ((kind = 'suppressor' AND guess = 1) OR (kind = 'confirmer' AND guess = 0)) GROUP BY ALL),
        nw AS (SELECT true_label, coalesce(v, guess) AS guess FROM rec LEFT JOIN fl USING (package_name)), ca AS (SELECT {CELLS} FROM nw), a AS (SELECT *, {RATES} FROM ca), cb AS (SELECT {CELLS} FROM rec), b AS (SELECT *, {RATES} FROM cb)"""),
    "scan_payloads": pkg("""SELECT package_id, CASE WHEN bad THEN 'error' ELSE verdict END AS verdict, CASE WHEN bad THEN 0 ELSE confidence END AS confidence, CASE WHEN bad THEN -1 ELSE coalesce(gnn, -1) END AS gnn_score,
        CASE WHEN bad THEN 'error' ELSE path END AS decision_path, CASE WHEN NOT bad AND gnn IS NULL THEN 'rules_only' END AS fallback, CASE WHEN bad THEN 'timeout' END AS error_msg FROM (SELECT dd.*, dec.gnn, dd.package_id % 13 = 0 AS bad FROM dd JOIN dec USING (package_id))""", f"dd AS ({live()})"),
    "block_bodies": pkg("""SELECT n || '@' || v AS package, 'malicious' AS verdict, confidence, e AS evidence, path AS decision, n || '@' || v || ' was blocked with confidence ' || printf('%.2f', confidence) || ': ' || CASE WHEN e <> '' THEN replace(e, ';', '; ') ELSE 'none recorded' END || ' (' || path || ')' AS note
        FROM (SELECT dd.*, json_extract_string(raw, '$.name') AS n, json_extract_string(raw, '$.version') AS v, coalesce(e, '') AS e FROM dd JOIN manifests USING (package_id) LEFT JOIN (SELECT package_id, string_agg(DISTINCT rule_id, ';' ORDER BY rule_id) AS e FROM hits GROUP BY package_id) USING (package_id) WHERE verdict = 'malicious')""", f"dd AS ({live()})"),
    "log_events": f"""WITH {REQ}, e AS (SELECT 'scan_complete' AS event, CASE WHEN verdict = 'malicious' THEN 'warn' ELSE 'info' END AS level FROM act WHERE action IN ('forward', 'block', 'fail_open')
        UNION ALL SELECT CASE action WHEN 'skip_scan' THEN 'scan_skipped' ELSE action END, 'warn' FROM act WHERE action IN ('block', 'fail_open', 'skip_scan')) SELECT event, level, count(*) AS n FROM e GROUP BY ALL""",
    "failure_taxonomy": rec(f"SELECT {FIT('lower(error_message)', BUILD_ERRORS, 'other')} AS error_class, {FIT('frames', FAILED_STEPS, 'unknown')} AS step, count(*) AS n FROM bl WHERE status = 'failure' GROUP BY ALL", BUILDS),
    "build_failures": rec("SELECT package_path, error_type, error_message, num_js_files FROM bl WHERE status = 'failure'", BUILDS),
    "split_shape": f"WITH {ITEMS} SELECT split, count(*) AS n, round(avg(nodes), 6) AS nodes, round(avg(floor(nodes * 1.5)), 6) AS edges FROM split JOIN items USING (item_id) GROUP BY split",
    "hook_network": pkg("SELECT package_id, " + " OR ".join(f"contains(lower(coalesce({SCRIPT(h)}, '')), {q(w)})" for h in ("preinstall", "install", "postinstall") for w in HOOK_NETWORK_WORDS) + " AS network FROM manifests"),
    "rule_titles": pkg("SELECT array_to_string(list_transform(string_split(lower(rule_id), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title, count(*) AS n FROM hits GROUP BY rule_id"),
    "archive_samples": r"""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'pypi' ELSE 'npm' END AS eco, CASE WHEN p_partkey % 5 = 0 THEN '@a:' ELSE '' END || replace(p_name, ' ', '?') || CASE WHEN p_partkey % 7 = 0 THEN '. ' ELSE '' END AS plain, p_size FROM part)
        SELECT DISTINCT eco || '/mal/' || plain || '/1.' || p_size || '/x.zip' AS path, rtrim(replace(replace(plain, ':', '_'), '?', '_'), '. ') AS name, '1.' || p_size AS version FROM a WHERE eco = 'npm' AND k % 11 <> 0""",
    "found_packages": """WITH f AS (SELECT 'pkg' || (o_custkey % 997) AS name, min(o_orderkey) AS seen FROM orders GROUP BY ALL) SELECT name, row_number() OVER (ORDER BY seen, name) AS place FROM f WHERE name NOT IN (SELECT 'pkg' || (s_suppkey * 3) FROM supplier) QUALIFY place <= 200""",
    "popular_names": "SELECT p_name AS name, min(p_partkey) AS position FROM part GROUP BY p_name",
    "build_queue": "WITH r AS (SELECT 'p' || p_partkey AS path, CAST(p_partkey % 2 AS INT) AS label FROM part WHERE length('p' || p_partkey) > 2 AND p_partkey % 3 <> 0) SELECT path, label FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY path) <= 5",
    "packages_with_code": pkg("SELECT DISTINCT package_id FROM files WHERE path <> 'index.js' AND package_id IN (SELECT package_id FROM manifests)"),
}

CALL = lambda name: f"(type = 'call_expression' AND {rx('text', name)})"
ORACLE_SQL |= {
    "node_flags": pkg(f"""SELECT n.package_id, n.node_id, {CALL("n_eval")} AS eval_call, {CALL("n_exec")} AS exec_call, {CALL("n_network")} AS network_call, {CALL("n_file")} AS file_op,
        contains(text, 'base64') OR (type = 'string' AND length(trim(text, '"''`')) > 40 AND {rx("trim(text, chr(34) || chr(39) || chr(96))", "n_base64")}) AS base64,
        (type = 'string' AND length(text) >= 200) OR {rx("text", "hex_esc")} OR {rx("text", "uni_esc")} OR (i % 2 = 0 AND length(text) >= 200) OR coalesce(bits > 3.5 AND length(text) > 8, false) AS obfuscated,
        contains(text, 'process.env') AS env_access, {CALL("n_import")} AS dangerous_import, {CALL("n_dynamic")} AS dynamic_require, {CALL("n_crypto")} AS crypto_call, {CALL("n_timer")} AS timer_callback, {rx("text", "n_string")} AS string_manip
        FROM n LEFT JOIN e USING (node_id, package_id)""", """n AS (SELECT package_id, path || ':' || (i - 1) AS node_id, i - 1 AS i, ['call_expression', 'string', 'identifier'][CAST((i - 1) % 3 AS INT) + 1] AS type, l AS text FROM ln),
        e AS (SELECT package_id, node_id, -sum(k / CAST(t AS DOUBLE) * log2(k / CAST(t AS DOUBLE))) AS bits FROM (SELECT package_id, node_id, c, count(*) AS k, any_value(t) AS t FROM (SELECT package_id, node_id, length(text) AS t, unnest(string_split(text, '')) AS c FROM n WHERE type = 'identifier') GROUP BY package_id, node_id, c) GROUP BY ALL)"""),
    "package_vectors": pkg(f"""SELECT package_id, CAST({KEY("preinstall")} AS DOUBLE) AS preinstall, CAST({KEY("postinstall")} AS DOUBLE) AS postinstall, f.n / 100 AS files, f.lines / 10000 AS lines,
        CAST({" OR ".join(f"contains(lower(coalesce({SCRIPT(h)}, '')), {q(w)})" for h in ("preinstall", "install", "postinstall") for w in HOOK_NETWORK_WORDS)} AS DOUBLE) AS network_hook, f.sources / 10 AS sources, f.sinks / 10 AS sinks, CAST(f.sources > 0 AND f.sinks > 0 AS DOUBLE) AS both
        FROM (SELECT package_id, coalesce(json_extract(raw, '$.scripts') IS NOT NULL, false) AS x, CASE WHEN json_extract(raw, '$.scripts') IS NULL THEN '{{"scripts":{{}}}}' ELSE raw END AS raw FROM manifests) JOIN f USING (package_id)""",
        f"""f AS (SELECT package_id, count(*) AS n, sum(len(string_split(code, chr(10))) - 1) AS lines, count(*) FILTER (WHERE {rx("code", "taint_decode")} OR {rx("code", "taint_atob")} OR {rx("code", "taint_read")}) + count(*) FILTER (WHERE {rx("code", "taint_env")}) AS sources, count(*) FILTER (WHERE {rx("code", "sink")}) AS sinks FROM files GROUP BY package_id)"""),
    "graph_states": f"""WITH s AS ({cte("statements")}), p AS (SELECT DISTINCT package_id FROM s), k AS (SELECT * FROM s WHERE package_id % 4 <> 0), n AS (SELECT package_id, count(*) AS n FROM k GROUP BY ALL),
        f AS (SELECT package_id, type, lead(node_id) OVER (PARTITION BY package_id, parent_id ORDER BY node_id) AS dst FROM k WHERE type LIKE '%\\_statement' ESCAPE '\\' OR type LIKE '%\\_declaration' ESCAPE '\\'),
        m AS (SELECT package_id, count(*) AS m FROM f WHERE dst IS NOT NULL AND type <> 'return_statement' GROUP BY ALL),
        c AS (SELECT p.package_id, n, m, CASE WHEN p.package_id % 7 = 0 THEN 'failure' WHEN n IS NULL AND p.package_id % 5 = 0 THEN 'cpg_none' ELSE 'success' END AS status, {dealt(STACKS).replace("seq", "p.package_id")} AS frames FROM p LEFT JOIN n USING (package_id) LEFT JOIN m USING (package_id))
        SELECT package_id, status, CASE status WHEN 'failure' THEN {FIT('frames', FAILED_STEPS, 'unknown')} || ':ValueError' WHEN 'cpg_none' THEN 'CPG_NONE' ELSE '' END AS error_type,
        CAST(CASE WHEN status = 'success' THEN coalesce(n, 1) ELSE 0 END AS BIGINT) AS num_nodes, CAST(CASE WHEN status = 'success' AND n IS NOT NULL THEN coalesce(m, 0) ELSE 0 END AS BIGINT) AS num_edges FROM c""",
    "payload_json": pkg("SELECT package_id, CAST(to_json({'package_id': package_id, 'verdict': verdict, 'path': path, 'confidence': confidence}) AS VARCHAR) AS body FROM dd", f"dd AS ({live()})"),
}
ORACLE_SQL |= FLOW_SQL | NETWORK_SQL

TRUE = "coalesce(CASE json_type(j, '{0}') WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN j->>'{0}' = 'true' WHEN 'VARCHAR' THEN j->>'{0}' <> '' WHEN 'ARRAY' THEN json_array_length(j, '{0}') > 0 WHEN 'OBJECT' THEN len(json_keys(j, '{0}')) > 0 ELSE CAST(j->>'{0}' AS DOUBLE) <> 0 END, false)"
ORACLE_SQL["odd_manifests"] = f"""WITH m AS (SELECT package_id, CAST(raw AS JSON) AS j FROM ({cte("odd_manifests")})), t AS (
    SELECT package_id, {TRUE.format("$.license")} AS has_license, {TRUE.format("$.repository")} AS has_repository, {TRUE.format("$.description")} AS has_description, json_type(j, '$.description') AS kind, j->>'$.description' AS said,
           coalesce(json_type(j, '$.scripts.preinstall'), json_type(j, '$.scripts.postinstall')) IN ('VARCHAR', 'ARRAY') AS install_hook FROM m)
    SELECT package_id, has_license, has_repository, CASE WHEN has_description THEN length(said) ELSE 0 END AS description_length, install_hook,
           CAST(CAST(0.35 AS DECIMAL(4, 2)) + CASE WHEN has_repository THEN 0 ELSE 0.10 END + CASE WHEN has_license THEN 0 ELSE 0.05 END + CASE WHEN kind = 'VARCHAR' AND length(said) >= 20 THEN 0 ELSE 0.05 END AS DOUBLE) AS risk FROM t"""

BIN = "CAST(CASE WHEN gnn_score < 0 THEN -1 ELSE least(floor(gnn_score * 10), 9) END AS INT)"
ORACLE_SQL["class_cube"] = rec(f"""SELECT true_label, bin, hybrid_verdict, CAST(grouping_id(true_label, bin, hybrid_verdict) AS INT) AS level, count(*) AS n, count(*) FILTER (WHERE (hybrid_verdict = 'malicious') <> (true_label = 1)) AS wrong
    FROM (SELECT *, {BIN} AS bin FROM rec) GROUP BY GROUPING SETS ((true_label, bin, hybrid_verdict), (true_label, bin), (true_label), (bin), ())""")
ORACLE_SQL["metric_table"] = rec(
    f"""SELECT run, metric, max(v) FILTER (WHERE system = 'gnn') AS gnn, max(v) FILTER (WHERE system = 'rules') AS rules, max(v) FILTER (WHERE system = 'hybrid') AS hybrid FROM (
    SELECT run, system, unnest(['tp', 'fp', 'fn', 'tn', 'precision', 'recall', 'f1']) AS metric, unnest([tp, fp, fn, tn, precision, recall, f1]) AS v FROM (SELECT *, {RATES} FROM c)) GROUP BY run, metric""",
    f"{SYSTEMS}, c AS (SELECT run, system, {CELLS} FROM sys GROUP BY run, system)",
)
ORACLE_SQL["run_metadata"] = rec(
    f"""SELECT unnest(['packages', 'malicious', 'failures', 'covered', 'clean_verdicts', 'suspicious_verdicts', 'malicious_verdicts']) AS name, CAST(unnest([count(*), sum(true_label), count(*) FILTER (WHERE gnn_score < 0), count(*) FILTER (WHERE gnn_score >= 0),
    count(*) FILTER (WHERE hybrid_verdict = 'clean'), count(*) FILTER (WHERE hybrid_verdict = 'suspicious'), count(*) FILTER (WHERE hybrid_verdict = 'malicious')]) AS DOUBLE) AS value FROM rec
    UNION ALL SELECT system || '.' || unnest(['precision', 'recall', 'f1']), unnest([precision, recall, f1]) FROM (SELECT *, {RATES} FROM c)""",
    f"{SYSTEMS}, c AS (SELECT system, {CELLS} FROM sys GROUP BY system)",
)
NEWTON = ", ".join(f"b{k + 1} AS (SELECT b - sum((1 / (1 + exp(-b * z)) - y) * z) / sum(1 / (1 + exp(-b * z)) * (1 - 1 / (1 + exp(-b * z))) * z * z) AS b FROM lg, b{k} GROUP BY b)" for k in range(12))
LOSS = "avg(greatest(z * {0}, 0) - z * {0} * y + ln(1 + exp(-abs(z * {0}))))"
ORACLE_SQL["temperature"] = rec(
    f"SELECT count(*) AS n, round(1 / any_value(b), 6) AS temperature, round({LOSS.format(1)}, 6) AS loss_before, round({LOSS.format('b')}, 6) AS loss_after, abs(avg((1 / (1 + exp(-b * z)) - y) * z)) < 1e-9 AS settled FROM lg, b12",
    f"""lg AS MATERIALIZED (SELECT ln(p / (1 - p)) AS z, CASE WHEN (seq % 97) / 97 < 0.25 + gnn_score / 2 THEN 1 ELSE 0 END AS y FROM (SELECT *, greatest(CAST(1e-7 AS DOUBLE), least(1 - CAST(1e-7 AS DOUBLE), gnn_score)) AS p FROM rec WHERE gnn_score >= 0)),
    b0 AS (SELECT CAST(0 AS DOUBLE) AS b), {NEWTON}""",
)

ORACLE_SQL["metadata_risk_popular"] = """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '-') AS name FROM part), l AS (SELECT DISTINCT name FROM p WHERE p_partkey % 2 = 0),
    m AS (SELECT p_partkey AS package_id, CASE p_partkey % 5 WHEN 0 THEN '@s/' || name WHEN 1 THEN name || 's' WHEN 2 THEN substr(name, 3) ELSE name END AS name FROM p),
    c AS (SELECT n.name FROM (SELECT DISTINCT name FROM m WHERE name NOT LIKE '@%' AND name NOT IN (SELECT name FROM l)) n WHERE EXISTS (SELECT 1 FROM l WHERE levenshtein(l.name, n.name) <= 2))
    SELECT package_id, CASE WHEN name IN (SELECT name FROM c) THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS risk FROM m"""
ORACLE_SQL["naive_split_leaks"] = f"WITH {ITEMS} SELECT campaign, count(DISTINCT item_id % 3) AS splits FROM items WHERE label = 1 GROUP BY campaign HAVING count(DISTINCT item_id % 3) > 1"
ORACLE_SQL["split_summary"] = f"""WITH {ITEMS}, g AS (SELECT ['train', 'val', 'test'][CAST(item_id % 3 + 1 AS INT)] AS split, item_id, nodes, label, nodes BETWEEN 2 AND 50000 AS kept FROM items),
    k AS (SELECT split, concat_ws(':', item_id || '.pt', nodes * 8 + 100, 1700000000 + item_id, nodes, label) AS said, row_number() OVER (PARTITION BY split ORDER BY item_id) - 1 AS i FROM g WHERE kept),
    b AS (SELECT split, i // 65536 AS block, sha256(string_agg(said, chr(10) ORDER BY i)) AS said FROM k GROUP BY ALL), f AS (SELECT split, sha256(string_agg(said, chr(10) ORDER BY block)) AS fingerprint FROM b GROUP BY split)
    SELECT split, count(*) AS raw_files, count(*) FILTER (WHERE kept) AS total, count(*) FILTER (WHERE NOT kept) AS skipped, count(*) FILTER (WHERE kept AND label = 1) AS malicious, count(*) FILTER (WHERE kept AND label = 0) AS benign,
           round(avg(nodes) FILTER (WHERE kept), 6) AS avg_nodes, max(nodes) FILTER (WHERE kept) AS max_nodes, any_value(fingerprint) AS fingerprint FROM g JOIN f USING (split) GROUP BY split"""
ORACLE_SQL["lockfile_results"] = f"""WITH dp AS ({cte("dependencies")}), pv AS ({cte("part_verdicts")}), a AS (SELECT name, version, count(DISTINCT lockfile_id) AS asked FROM dp GROUP BY ALL),
    e AS (SELECT a.*, verdict, CASE WHEN verdict IS NULL THEN 'Download failed' WHEN CAST(substr(name, 4) AS BIGINT) % 7 = 0 THEN 'timeout' END AS error_msg FROM a LEFT JOIN pv USING (name))
    SELECT name, version, CASE WHEN error_msg IS NULL THEN verdict ELSE 'error' END AS verdict, error_msg, asked, CASE WHEN error_msg IS NULL THEN 1 ELSE asked END AS scans FROM e"""
FLAGS = ["eval_call", "exec_call", "network_call", "file_op", "base64", "obfuscated", "env_access", "dangerous_import", "dynamic_require", "crypto_call", "timer_callback", "string_manip"]
ORACLE_SQL["node_features"] = f"""WITH f AS ({ORACLE_SQL["node_flags"]}), t AS (SELECT *, CAST(regexp_extract(node_id, '[0-9]+$') AS BIGINT) % 3 AS kind FROM f),
    x AS (SELECT package_id, unnest(range(35)) AS k, unnest(list_concat(list_transform(range(23), lambda i: CASE WHEN i = CASE kind WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 3 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), [{", ".join(f"CAST({c} AS INT)::DOUBLE" for c in FLAGS)}])) AS v FROM t)
    SELECT package_id, k, sum(v) AS total FROM x GROUP BY ALL"""
ORACLE_SQL["manifest_snippets"] = pkg(
    """SELECT m.package_id, rule_id, m.hook, CASE WHEN rule_id = 'HIGH_MANIFEST_SUSPICIOUS_URL' THEN o.u ELSE left(replace(command, chr(10), '\\n'), 220) END AS snippet
    FROM man_hits m JOIN mhook h ON h.package_id = m.package_id AND h.hook = m.hook LEFT JOIN outside o ON o.package_id = m.package_id AND o.hook = m.hook""",
    f"""each AS (SELECT package_id, hook, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(command, {q(PATTERN["m_url"])}) AS l FROM mhook)),
    outside AS (SELECT package_id, hook, arg_min(u, i) AS u FROM (SELECT *, lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS h FROM each) WHERE NOT {WHITE} GROUP BY ALL)""",
)
