"""Source, hook, package and manifest rules as column expressions over package files.

files has package_id, path and code; manifests package_id and raw (JSON). All file rules are one projection over files,
so a file's code is read once; what follows is on hits. hits has package_id, rule_id, severity, score, file_path,
line_number and snippet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.local import fixed_table
from sievework.operators.catalog import LIFECYCLE, TOP_NAMES, score, severity

#: rule, patterns that one file must all have; the last gives line and snippet.
FILE_RULES = [
    ("CRIT_EXFIL_FILES", ["net_send", "sensitive_files"]),
    ("CRIT_DNS_EXFIL", ["cred_env", "dns_exfil"]),
    ("CRIT_DYNAMIC_REQUIRE_EXEC", ["dyn_sink", "decode", "dyn_require"]),
    ("HIGH_EVAL_DECODED", ["b64_decode", "eval"]),
    ("HIGH_PROCESS_ENV_BULK", ["env_bulk"]),
    ("HIGH_WEBHOOK_EXFIL", ["net_send", "webhook"]),
    ("HIGH_DNS_EXFIL", ["exfil_source", "dns_usage"]),
    ("HIGH_SELF_DELETE", ["self_delete"]),
    ("HIGH_RUNTIME_PROTOTYPE_POLLUTION", ["module_exports", "proto_pollution"]),
]
HIT = "array<struct<rule_id:string,line_number:int,snippet:string>>"


def hit(rule: str, when: Column, line: Column | None = None, snippet: Column | None = None) -> Column:
    none = F.lit(None)
    fields = (F.lit(rule).alias("rule_id"), (none if line is None else line).cast("int").alias("line_number"), (none if snippet is None else snippet).cast("string").alias("snippet"))
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*fields))


def distinct_credentials(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(T.pattern("cred_env")), F.lit(1)))


def reverse_shell(code: Column, span: int = 30) -> Column:
    """A socket line and a shell line at most `span` lines apart, and a pipe or standard streams."""
    rows = F.split(code, "\n")
    at = lambda name: F.array_compact(F.transform(rows, lambda x, i: F.when(T.has(x, name), i)))
    shells = at("rs_shell")
    near = F.exists(at("rs_socket"), lambda s: F.exists(shells, lambda t: F.abs(s - t) <= span))
    streams = F.contains(code, F.lit("stdin")) & (F.contains(code, F.lit("stdout")) | F.contains(code, F.lit("stderr")))
    return T.has(code, "rs_socket") & T.has(code, "rs_shell") & (T.has(code, "rs_pipe") | streams) & near


def hidden_payloads(code: Column) -> Column:
    """Quoted base64 runs of at least 500 characters with more than 4.5 bits each."""
    return F.filter(F.regexp_extract_all(code, F.lit(T.pattern("b64_long")), F.lit(1)), lambda p: (F.length(p) >= 500) & (T.entropy(p) > 4.5))


def encoded_window(code: Column, back: int = 10, ahead: int = 9) -> Column:
    """struct(i, w): the first line whose window holds a payload, a decoder and a sink; null without one.

    Lines are looked through once; a window's text is put together only where marked lines of all three kinds are in
    reach, or where a match can run over lines (a payload has no newline, a call's bracket may follow one).
    """
    rows = F.split(code, "\n")
    window = lambda i: F.array_join(F.slice(rows, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)) + ahead + 1), "\n")
    chain = lambda w: (T.has(w, "b64_40") | T.has(w, "hex10")) & T.has(w, "decode") & T.has(w, "exec_sink")
    marked = F.array_compact(F.transform(rows, lambda x, i: F.when(T.has(x, "b64_40") | T.has(x, "hex10"), i)))
    near = F.array_distinct(F.flatten(F.transform(marked, lambda i: F.sequence(F.greatest(i - ahead, F.lit(0)), F.least(i + back, F.size(rows) - 1)))))
    tried = F.transform(F.array_sort(near), lambda i: F.struct(i.alias("i"), window(i).alias("w")))
    return F.get(F.filter(tried, lambda x: chain(x["w"])), F.lit(0))


def file_hits(files: DataFrame) -> DataFrame:
    """Hits of rules that look at one file, for each package and rule the first file by path.

    Each pattern is looked for once in a file; lines, snippets, payloads and windows only where patterns are found. (No
    filter stands on the flags: Spark would derive constraints from all combinations of them.)
    """
    code = F.col("code")
    names = sorted({n for _, ns in FILE_RULES for n in ns} | {"cred_env", "rs_socket", "rs_shell", "b64_long", "b64_40", "hex10", "exec_sink"})
    rows = files.select("package_id", "path", "code", F.lower("code").alias("low"))
    rows = rows.select("package_id", "path", "code", *[T.has(code, n, F.col("low")).alias(f"has_{n}") for n in names])
    f = {n: F.col(f"has_{n}") for n in names}
    every = lambda ns: reduce(Column.__and__, (f[n] for n in ns))
    chain = (f["b64_40"] | f["hex10"]) & f["decode"] & f["exec_sink"]
    uses = [(ns[-1], every(ns)) for _, ns in FILE_RULES] + [("net_send", f["net_send"] & f["cred_env"]), ("rs_socket", f["rs_socket"] & f["rs_shell"])]
    shown = {n: reduce(Column.__or__, (when for m, when in uses if m == n)) for n, _ in uses}
    payload = F.when(f["b64_long"], F.get(hidden_payloads(code), F.lit(0)))
    window = F.when(chain, encoded_window(code))
    at = {n: F.when(when, T.first_match(code, n)).alias(f"at_{n}") for n, when in shown.items()}
    rows = rows.select("package_id", "path", "code", payload.alias("payload"), window.alias("window"), *f.values(), *at.values())
    line, snippet = (lambda n: T.line_at(F.col(f"at_{n}"))), (lambda n: T.snippet_at(code, F.col(f"at_{n}")))
    simple = [hit(rule, every(ns), line(ns[-1]), snippet(ns[-1])) for rule, ns in FILE_RULES]
    more = [
        hit("CRIT_EXFIL_CREDENTIALS", f["net_send"] & f["cred_env"] & (F.size(distinct_credentials(code)) >= 2), line("net_send"), snippet("net_send")),
        hit("CRIT_REVERSE_SHELL", f["rs_socket"] & f["rs_shell"] & reverse_shell(code), line("rs_socket"), snippet("rs_socket")),
        hit("HIGH_STEGANOGRAPHIC_PAYLOAD", F.col("payload").isNotNull(), None, F.left("payload", F.lit(200))),
        hit("HIGH_ENCODED_PAYLOAD_CHAIN", F.col("window").isNotNull(), F.col("window.i") + 1, F.left("window.w", F.lit(200))),
    ]
    # outer, as for an inner explode Spark would work out all hits twice, once to filter by their number
    found = rows.select("package_id", "path", F.explode_outer(F.array_compact(F.array(*simple, *more)).cast(HIT)).alias("h")).where("h is not null")
    first = F.min_by(F.struct("path", "h.line_number", "h.snippet"), F.split("path", "/"))
    return found.groupBy("package_id", "h.rule_id").agg(first.alias("f")).select("package_id", "rule_id", F.col("f.path").alias("file_path"), "f.line_number", "f.snippet")


def hook_relation(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """package_id, hook, command and sources: the first hook's entry file and the local files it requires, in order."""
    raw = F.col("raw")
    named = [F.when(F.coalesce(T.script(raw, h), F.lit("")) != "", F.struct(F.lit(h).alias("hook"), T.script(raw, h).alias("command"))) for h in ("preinstall", "postinstall", "preuninstall")]
    hooks = manifests.select("package_id", F.coalesce(*named).alias("h")).where("h is not null").select("package_id", "h.hook", "h.command")
    hooks = hooks.withColumn("entry", T.normal_path(T.hook_entry(F.col("command"))))
    code = files.select("package_id", F.col("path").alias("entry"), "code")
    entries = hooks.join(code, ["package_id", "entry"]).select("package_id", "entry", "code")
    wanted = entries.select("package_id", F.regexp_replace("entry", r"[^/]*$", "").alias("base"), F.posexplode(T.local_requires(F.col("code"))).alias("n", "r"))
    path = F.concat("base", T.normal_path(F.col("r")))
    tries = F.posexplode(F.array(path, F.concat(path, F.lit(".js")), F.concat(path, F.lit("/index.js")))).alias("k", "entry")
    needed = wanted.select("package_id", "n", tries).join(code, ["package_id", "entry"])
    needed = needed.groupBy("package_id", "n").agg(F.min_by("code", "k").alias("code"))
    all_code = entries.select("package_id", F.lit(-1).alias("n"), "code").unionByName(needed)
    gathered = all_code.groupBy("package_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("sources"))
    return hooks.join(gathered, "package_id", "left").select("package_id", "hook", "command", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def hook_hits(hooks: DataFrame) -> DataFrame:
    src, cmd = F.col("sources"), F.col("command")
    obfuscated = lambda s: (F.regexp_count(s, F.lit(T.pattern("hex_esc"))) >= 5) | (F.regexp_count(s, F.lit(T.pattern("uni_esc"))) >= 5) | T.has(s, "from_char_code") | T.has(s, "b64_long")
    found = [
        hit("CRIT_INSTALL_HOOK_EXEC", T.has(cmd, "shell_cmd") | T.has(cmd, "node_e_loader") | F.exists(src, lambda s: T.has(s, "child_proc") & T.has(s, "shell_cmd"))),
        hit("CRIT_INSTALL_HOOK_NETWORK", F.exists(src, lambda s: T.has(s, "net_send") & ~T.has(s, "localhost"))),
        hit("HIGH_OBFUSCATED_INSTALL", F.exists(src, obfuscated)),
        hit("MED_EVAL_USAGE", F.exists(src, lambda s: T.has(s, "eval") & ~T.has(s, "b64_decode"))),
    ]
    return hooks.select("package_id", F.explode_outer(F.array_compact(F.array(*found)).cast(HIT)).alias("h")).where("h is not null").select("package_id", "h.rule_id", F.lit(None).cast("string").alias("file_path"), "h.line_number", "h.snippet")


def package_facts(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row for each package: what rules over a whole package need."""
    code = F.col("code")
    tests = F.exists(F.split("path", "/"), lambda p: p.isin("test", "tests"))
    readme = F.col("path").isin("README.md", "readme.md", "README", "README.txt")
    js = F.endswith("path", F.lit(".js"))
    rows = files.select("package_id", "path", "code", F.when(js, F.lower("code")).alias("low"), js.alias("js"), tests.alias("test"), F.when(readme, F.length(code)).alias("readme"))
    rows = rows.select(
        "package_id", "path", "js", "test", "readme", F.when(F.col("js"), T.lines(code)).alias("n"), F.octet_length(code).alias("b"),
        *[(F.col("js") & T.has(code, n, F.col("low"))).alias(f"has_{n}") for n in ("file_read", "net_send")],
    )
    facts = rows.groupBy("package_id").agg(
        F.count_if("js").alias("n_js"), F.sum("n").alias("n_lines"), F.bool_or("has_file_read").alias("reads"), F.bool_or("has_net_send").alias("sends"),
        F.bool_or("test").alias("tests"), F.max("readme").alias("readme"), F.max(F.when(F.col("js"), F.struct("path", "n", "b"))).alias("only"),
    )
    return facts.join(manifests.select("package_id", "raw"), "package_id", "full_outer")


def typosquats(manifests: DataFrame, top: list[str] = TOP_NAMES) -> DataFrame:
    """package_id, name and the first well-known name, in list order, that is one or two edits away."""
    known = F.array(*[F.lit(x) for x in top])
    name = F.get_json_object("raw", "$.name")
    close = F.get(F.filter(known, lambda x: (F.abs(F.length(x) - F.length("name")) <= 2) & T.distance_within(F.col("name"), x).between(1, 2)), F.lit(0))
    return manifests.select("package_id", name.alias("name")).where(~F.startswith("name", F.lit("@"))).withColumn("close_to", close).where("close_to is not null")


def install_hook(raw: Column) -> Column:
    """Whether the first of preinstall and postinstall that a manifest has is a text or an array; the rule fails on a null, a number, a boolean or an object.

    Where the text is no variant (a key twice), any such hook counts.
    """
    first = F.coalesce(*[T.kind_of(raw, f"$.scripts.{h}") for h in ("preinstall", "postinstall")])
    keys = T.json_keys(raw, "$.scripts")
    any_hook = F.arrays_overlap(keys, F.array(F.lit("preinstall"), F.lit("postinstall")))
    return F.coalesce(F.when(F.try_parse_json(raw).isNull(), any_hook).otherwise((first == "STRING") | F.startswith(first, F.lit("ARRAY"))), F.lit(False))


def package_hits(files: DataFrame, manifests: DataFrame) -> DataFrame:
    raw = F.col("raw")
    keys = T.json_keys(raw, "$.scripts")
    some = lambda *h: F.arrays_overlap(keys, F.array(*map(F.lit, h)))
    n, b = F.col("only.n"), F.col("only.b")
    found = [
        hit("MED_NETWORK_PLUS_FS", F.col("reads") & F.col("sends")),
        hit("MED_MINIFIED_SINGLE_FILE", (F.col("n_js") == 1) & (((n < 5) & (b > 10000)) | ((b / n > 200) & (n < 20)))),
        hit("MED_INSTALL_HOOK_EXISTS", install_hook(raw)),
        hit("MED_SUSPICIOUS_PACKAGE_STRUCTURE", some(*LIFECYCLE) & F.col("n_js").between(1, 2) & (F.col("n_lines") < 50) & ~F.col("tests") & (F.coalesce("readme", F.lit(0)) <= 100)),
    ]
    facts = package_facts(files, manifests)
    facts = facts.select("package_id", F.explode_outer(F.array_compact(F.array(*found)).cast(HIT)).alias("h")).where("h is not null").select("package_id", "h.rule_id", F.lit(None).cast("string").alias("file_path"), "h.line_number", "h.snippet")
    squats = typosquats(manifests).select("package_id", F.lit("HIGH_TYPOSQUAT_SIGNAL").alias("rule_id"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.col("close_to").alias("snippet"))
    return facts.unionByName(squats)


def manifest_hooks(manifests: DataFrame) -> DataFrame:
    """package_id, hook and command of every non-blank lifecycle command."""
    each = F.array(*[F.struct(F.lit(h).alias("hook"), T.script(F.col("raw"), h).alias("command")) for h in LIFECYCLE])
    return manifests.select("package_id", F.explode(each).alias("h")).select("package_id", "h.hook", "h.command").where("trim(command) <> ''")


def node_body(command: Column) -> Column:
    """What `node -e` runs: the quoted body if there is one, else all up to a separator."""
    part = lambda name: F.nullif(F.regexp_extract(command, T.pattern(name), 1), F.lit(""))
    return F.coalesce(part("m_node_double"), part("m_node_single"), part("m_node_bare"))


def manifest_hits(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Hits of manifest rules, for each hook at most one of a rule; nothing is merged with source hits."""
    hooks = manifest_hooks(manifests).where(~T.has(F.col("command"), "m_benign"))
    cmd = F.col("command")
    cut = F.left(F.replace(cmd, F.lit("\n"), F.lit("\\n")), F.lit(220))
    tokens = F.regexp_extract_all(cmd, F.lit(T.pattern("m_b64_token")), F.lit(0))
    outside = F.get(F.filter(T.urls(cmd), lambda u: ~T.whitelisted(u)), F.lit(0))
    found = [
        hit("CRIT_MANIFEST_CURL_PIPE", T.has(cmd, "m_curl_pipe"), None, cut),
        hit("CRIT_MANIFEST_NODE_EVAL", T.has(node_body(cmd), "m_node_susp"), None, cut),
        hit("HIGH_MANIFEST_ENCODED_PAYLOAD", T.has(cmd, "m_decode") & F.exists(tokens, T.is_base64), None, cut),
        hit("HIGH_MANIFEST_SUSPICIOUS_URL", outside.isNotNull(), None, outside),
    ]
    by_hook = hooks.select("package_id", "hook", F.explode_outer(F.array_compact(F.array(*found)).cast(HIT)).alias("h")).where("h is not null").select("package_id", "h.rule_id", F.col("hook").alias("file_path"), "h.line_number", "h.snippet")
    sized = files.groupBy("package_id").agg(
        F.sum(F.when(F.col("path").rlike(r"\.[cm]?js$"), T.lines(F.col("code")))).alias("n"),
        F.bool_or(F.exists(F.split("path", "/"), lambda p: p.isin("test", "tests", "__tests__"))).alias("tests"),
        F.min(F.when(F.startswith("path", F.lit("README")), F.struct("path", F.length("code").alias("n")))).alias("readme"),
    )
    lonely = hooks.where("hook <> 'install'").select("package_id").distinct().join(manifests.select("package_id", "raw"), "package_id").join(sized, "package_id", "left")
    lonely = lonely.where((F.coalesce("n", F.lit(0)) < 50) & ~F.coalesce("tests", F.lit(False)) & (F.coalesce("readme.n", F.lit(0)) < 100) & (T.dependency_count(F.col("raw")) == 0))
    none = F.lit(None).cast("string")
    return by_hook.unionByName(lonely.select("package_id", F.lit("MED_MANIFEST_INSTALL_HOOK_ONLY").alias("rule_id"), none.alias("file_path"), F.lit(None).cast("int").alias("line_number"), none.alias("snippet")))


def rule_dim(spark) -> DataFrame:
    """rule_id, severity and score of every rule: 27 rows."""
    from sievework.operators.catalog import LIVE_WEIGHT

    ids = sorted({*LIVE_WEIGHT, "CRIT_DNS_EXFIL", "HIGH_MANIFEST_ENCODED_PAYLOAD"})
    return fixed_table(spark, [(r, severity(r), score(r)) for r in ids], "rule_id string, severity string, score double")


def rule_hits(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """All hits, with severity and score."""
    code = files.where(F.endswith("path", F.lit(".js")) & ~F.exists(F.split("path", "/"), lambda p: p.isin("node_modules", ".git", "vendor")))
    source = file_hits(code).unionByName(hook_hits(hook_relation(code, manifests))).unionByName(package_hits(files, manifests)).withColumn("origin", F.lit("source"))
    every = source.unionByName(manifest_hits(files, manifests).withColumn("origin", F.lit("manifest")))
    return every.join(F.broadcast(rule_dim(files.sparkSession)), "rule_id").select("package_id", "rule_id", "severity", "score", "file_path", "line_number", "snippet", "origin")


def described(raw: Column) -> Column:
    """Whether the description has 20 parts at least: characters of a text, elements of an array, keys of an object; numbers and booleans have none."""
    path, kind = "$.description", T.kind_of(raw, "$.description")
    text = F.get_json_object(raw, path)
    parts = F.when(kind == "STRING", F.length(text)).when(F.startswith(kind, F.lit("ARRAY")), F.json_array_length(text)).when(F.startswith(kind, F.lit("OBJECT")), F.size(F.json_object_keys(text))).when(kind.isNotNull(), 0)
    return F.coalesce(parts, F.length(F.when(F.try_parse_json(raw).isNull(), text)), F.lit(0)) >= 20


def near(names: DataFrame, others: DataFrame) -> DataFrame:
    """name and other for distinct names of both sides (column name) that differ by one or two edits.

    Two such names are equal after at most two deletions from each, so names meet at what deletions leave of them, some length squared
    / 2 short rows for each; lists of any length meet like this.
    """
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    less = F.when(F.length("name") > 0, one(F.col("name"))).otherwise(F.array().cast("array<string>"))
    least = F.flatten(F.transform(less, lambda x: F.when(F.length(x) > 0, one(x)).otherwise(F.array(x))))
    cut = lambda df: df.where("name is not null").select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(F.array("name"), less, least))).alias("cut"))
    pairs = cut(names).join(cut(others).withColumnRenamed("name", "other"), "cut").where("name <> other").select("name", "other").distinct()
    return pairs.where(T.distance_within(F.col("name"), F.col("other")).between(1, 2))


def metadata_risk(manifests: DataFrame, popular: DataFrame | None = None) -> DataFrame:
    """package_id and risk in [0, 1], summed in decimals.

    popular (name) is a list of any length; a name without scope that isn't on it but is at most two edits from one that is adds 0.30.
    """
    raw = F.col("raw")
    part = lambda when, x: F.when(F.coalesce(when, F.lit(False)), F.lit(x).cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
    name, keys = F.get_json_object(raw, "$.name"), T.json_keys(raw, "$.scripts")
    some = lambda *h: F.arrays_overlap(keys, F.array(*map(F.lit, h)))
    rows, squat = manifests.withColumn("_name", name), F.lit(False)
    if popular is not None:
        asked = rows.select(F.col("_name").alias("name")).where(~F.startswith("name", F.lit("@"))).distinct().join(popular.select("name"), "name", "left_anti")
        close = near(asked, popular).select(F.col("name").alias("_name")).distinct().withColumn("_close", F.lit(True))
        rows, squat = rows.join(close, "_name", "left"), F.col("_close")
    total = (
        part(squat, "0.30") + part(~T.truthy(raw, "$.repository"), "0.10") + part(~T.truthy(raw, "$.license"), "0.05") + part(~described(raw), "0.05")
        + part(some(*LIFECYCLE), "0.20") + part((F.size(T.json_keys(raw, "$.dependencies")) == 0) & some("preinstall", "postinstall"), "0.15")
    )
    return rows.select("package_id", F.least(total.cast("double"), F.lit(1.0)).alias("risk"))


def first_by_path(files: DataFrame) -> DataFrame:
    """files with their rank in path order inside a package, from 1."""
    return files.withColumn("rank", F.row_number().over(W.partitionBy("package_id").orderBy(F.split("path", "/"))))
