"""Column functions over code, commands, urls and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.operators.catalog import BUILD_ERRORS, FAILED_STEPS, HOOK_NETWORK_WORDS, LIFECYCLE, PATTERN, URL_WHITELIST

DIALECT = "(?d)"


def pattern(name: str) -> str:
    """A catalog pattern with `.` stopping at newlines only."""
    return DIALECT + PATTERN[name]


#: Strings of which a text that a pattern matches has at least one (in lower case where the pattern ignores case). Looking
#: for them first is some ten times faster than the pattern. They follow from the patterns and decide nothing.
NEEDLES = {
    "cred_env": ["process.env"],
    "net_send": ["http", "fetch", "axios.", "net.socket", "got", "superagent", ".request"],
    "file_read": ["readfile", "createreadstream", "readdir"],
    "child_proc": ["child_process", ".exec", ".spawn"],
    "shell_cmd": ["curl ", "wget ", "powershell", "bash", "/bin/sh", "cmd", "|"],
    "node_e_loader": ["node"],
    "dns_exfil": ["dns.", "dgram."],
    "rs_socket": ["net", "Socket", "dgram."],
    "rs_shell": ["child_process", "/bin/", "cmd.exe", "powershell", "spawn"],
    "rs_pipe": [".pipe"],
    "eval": ["eval", "Function", "vm.runInNewContext"],
    "b64_decode": ["base64", "atob"],
    "env_bulk": ["process.env"],
    "dyn_require": ["require"],
    "dyn_sink": ["eval", "Function", "require"],
    "hex10": ["\\x"],
    "decode": ["Buffer.from", "atob", "decodeURIComponent", "String.fromCharCode"],
    "exec_sink": ["eval", "Function", "require", "http", "fetch", "axios"],
    "dns_usage": ["dns.", "dgram"],
    "exfil_source": ["process.env", "os.", "readFile"],
    "proto_pollution": ["__proto__", "prototype"],
    "self_delete": ["__filename", "process.argv"],
    "taint_decode": ["base64"],
    "taint_atob": ["atob"],
    "taint_read": ["readFileSync"],
    "taint_env": ["process.env"],
    "sink": ["eval", "Function", "exec", "spawn", "http", "fetch", "writeFileSync", "Socket", "dns"],
}
#: Patterns that are nothing but alternative strings.
STRINGS = {
    "sensitive_files": ["/etc/passwd", "/etc/shadow", "~/.ssh", ".ssh/", "id_rsa", ".aws/credentials", ".npmrc", ".bash_history", ".gitconfig", ".gnupg"],
    "localhost": ["localhost", "127.0.0.1", "0.0.0.0", "npmjs.org"],
    "module_exports": ["module.exports"],
    "from_char_code": ["string.fromcharcode"],
}


def has(text: Column, name: str, low: Column | None = None) -> Column:
    """Whether the pattern matches somewhere in the text; low is the text in lower case, if it is at hand."""
    words = STRINGS.get(name) or NEEDLES.get(name)
    if not words:
        return text.rlike(pattern(name))
    where = text if not PATTERN[name].startswith("(?i)") else F.lower(text) if low is None else low
    some = reduce(Column.__or__, (F.contains(where, F.lit(w)) for w in words))
    return some if name in STRINGS else some & text.rlike(pattern(name))


def distance_within(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance, or -1 beyond `most`."""
    return F.levenshtein(a, b, most)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits for each character, 0 below two characters, rounded to 6 places; of the whole text.

    The characters are sorted, so that equal ones are runs, and the runs' lengths are the counts.
    """
    n = F.length(text).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    share = F.transform(runs, lambda r: F.length(r) / n)
    return F.when(F.length(text) < 2, 0.0).otherwise(F.round(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)), 6))


def before(text: Column, name: str) -> Column:
    """What stands before the first match; the text where nothing matches."""
    return F.get(F.split(text, pattern(name), 2), F.lit(0))


def line_of(text: Column, name: str) -> Column:
    """Line of the first match, from 1."""
    return F.when(has(text, name), F.size(F.split(before(text, name), "\n")))


def first_match(text: Column, name: str) -> Column:
    """struct(before, length): what stands before the first match and how long that is. Meant for a column of its own, as
    line and snippet come from it without looking for the pattern again."""
    return F.struct(before(text, name).alias("before"), F.length(F.regexp_extract(text, pattern(name), 0)).alias("length"))


def line_at(found: Column) -> Column:
    return F.size(F.split(found["before"], "\n"))


def snippet_at(text: Column, found: Column) -> Column:
    """A match with 30 characters on each side, newlines escaped, cut to 200."""
    start = F.length(found["before"])
    low = F.greatest(start - 30, F.lit(0))
    return F.left(F.replace(F.substr(text, low + 1, start - low + found["length"] + 30), F.lit("\n"), F.lit("\\n")), F.lit(200))


def lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def contains_any(text: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def whitelisted(url: Column) -> Column:
    h = host_of(url)
    return F.exists(F.array(*map(F.lit, URL_WHITELIST)), lambda w: (h == w) | F.endswith(h, F.concat(F.lit("."), w)))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern("m_url")), F.lit(0))


def is_base64(token: Column) -> Column:
    """Whether the token is valid base64 once padded to a multiple of four."""
    padded = F.rpad(token, F.ceil(F.length(token) / 4).cast("int") * 4, F.lit("="))
    return padded.rlike("^[A-Za-z0-9+/]*={0,2}$") & F.try_to_binary(padded, F.lit("base64")).isNotNull()


def hook_targets(command: Column) -> Column:
    """Script files that a command names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(command, F.lit(r"(?:^|\s)(?:node\s+)?([^\s;&|]+\.[cm]?js)\b"), F.lit(1)))


def hook_entry(command: Column) -> Column:
    return F.get(F.filter(F.split(command, r"\s+"), lambda t: F.endswith(t, F.lit(".js"))), F.lit(0))


def local_requires(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern("local_require")), F.lit(1))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "")


def json_keys(raw: Column, path: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(raw, path)), F.array().cast("array<string>"))


def dependency_count(raw: Column) -> Column:
    kinds = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
    return sum((F.size(json_keys(raw, f"$.{k}")) for k in kinds), F.lit(0))


def script(raw: Column, hook: str) -> Column:
    return F.get_json_object(raw, f"$.scripts.{hook}")


def has_hook(raw: Column, hooks: list[str] = LIFECYCLE) -> Column:
    return F.arrays_overlap(json_keys(raw, "$.scripts"), F.array(*map(F.lit, hooks)))


def score_band(score: Column) -> Column:
    bands = [(0.35, "low_<0.35"), (0.50, "low_mid_0.35_0.50"), (0.75, "mid_0.50_0.75"), (0.80, "near_block_0.75_0.80"), (0.90, "high_0.80_0.90")]
    out = F.when(score < 0, "gnn_unavailable")
    for high, name in bands:
        out = out.when(score < high, name)
    return out.otherwise("very_high_>=0.90")


def tarball_url(registry: Column, name: Column, version: Column) -> Column:
    base = F.regexp_replace(registry, "/+$", "")
    plain = F.regexp_replace(name, "^@[^/]*/", "")
    return F.concat(base, F.lit("/"), F.replace(name, F.lit("/"), F.lit("%2f")), F.lit("/-/"), plain, F.lit("-"), version, F.lit(".tgz"))


def parse_tarball_path(path: Column) -> Column:
    """struct(name, version) of a registry path, null unless the file is named after the package."""
    p = F.try_url_decode(path)
    name = F.regexp_extract(p, r"^/?((?:@[^/]+/)?[^/]+)/-/", 1)
    plain = F.regexp_replace(name, "^@[^/]*/", "")
    file = F.regexp_extract(p, r"/-/([^/]+)\.tgz$", 1)
    ok = (name != "") & F.startswith(file, F.concat(plain, F.lit("-")))
    return F.when(ok, F.struct(name.alias("name"), F.substr(file, F.length(plain) + 2).alias("version")))


def parse_spec(spec: Column) -> Column:
    """struct(name, version) of name@version, where a name may begin with @."""
    g = lambda n: F.regexp_extract(spec, r"^(@?[^@]+)(?:@(.*))?$", n)
    return F.struct(g(1).alias("name"), F.nullif(g(2), F.lit("")).alias("version"))


def network_in_hook(raw: Column) -> Column:
    """Whether a lifecycle command of the manifest has a network word, anywhere and in any case."""
    return reduce(Column.__or__, (contains_any(script(raw, h), HOOK_NETWORK_WORDS) for h in LIFECYCLE))


def rule_title(rule_id: Column) -> Column:
    return F.initcap(F.replace(rule_id, F.lit("_"), F.lit(" ")))


def first_fit(text: Column, table: list[tuple[str, str]], other: str) -> Column:
    """The class of the first entry of the table whose words the text has."""
    out = F.lit(other)
    for words, name in reversed(table):
        out = F.when(F.contains(text, F.lit(words)), name).otherwise(out)
    return out


def build_error(message: Column) -> Column:
    return first_fit(F.lower(F.coalesce(message, F.lit(""))), BUILD_ERRORS, "other")


def failed_step(frames: Column) -> Column:
    """The step of a failure from the names of the functions on its stack, joined by spaces."""
    return first_fit(F.coalesce(frames, F.lit("")), FAILED_STEPS, "unknown")


def sample_path(path: Column) -> Column:
    """struct(ecosystem, name, version) of a path {ecosystem}/{category}/{name}/{version}/...; null for a shorter one.

    name has no characters that file systems refuse and no dots or spaces at its end.
    """
    parts = F.split(path, "/")
    name = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(2)), r'[<>:"/\\|?*]', "_"), r"[. ]+$", "")
    return F.when(F.size(parts) >= 4, F.struct(F.get(parts, F.lit(0)).alias("ecosystem"), name.alias("name"), F.get(parts, F.lit(3)).alias("version")))


def typed(raw: Column, path: str) -> Column:
    """The JSON value at a path as a variant; null where there is none or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(raw), path, "variant")


def kind_of(raw: Column, path: str) -> Column:
    """STRING, BOOLEAN, VOID (a null), a number's type, or what begins with ARRAY or OBJECT; null where there is no value."""
    return F.schema_of_variant(typed(raw, path))


def truthy(raw: Column, path: str) -> Column:
    """Whether there is a value that is not null, false, zero, an empty text, an empty array or an empty object.

    A text that JSON allows but variants don't, such as an object with a key twice, is judged by its value's text alone.
    """
    value, kind = typed(raw, path), kind_of(raw, path)
    text = F.to_json(value)
    known = (
        F.when(kind == "VOID", False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != '""').when(F.startswith(kind, F.lit("ARRAY")), text != "[]").when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
        .otherwise(F.try_variant_get(F.try_parse_json(raw), path, "double") != 0)
    )
    plain = ~F.coalesce(F.get_json_object(raw, path), F.lit("")).isin("", "{}", "[]", "false", "0")
    return F.coalesce(F.when(F.try_parse_json(raw).isNull(), plain).otherwise(known), F.lit(False))
