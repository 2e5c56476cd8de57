"""URL filters by association rules that Spark's FP-growth mines, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import ascii_lower, broadcast_if, settle

#: Fixed rules: verdict, host, start of the path.
LISTED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BAD = "label=bad"
#: A rule's bad pages are this share of the labelled pages at least, its confidence is at least this and this many times the
#: share of bad pages, and its distance from that share this many standard errors.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_DEVIATIONS = 0.001, 0.5, 1.5, 4.0
BROADCAST_RULES = 100_000


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((h == name) | F.endswith(h, F.lit("." + name))) & F.startswith(p, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Items of one url: scheme, each suffix of the host, each path segment with its depth, each parameter, fragment.

    Runs of digits in segments and in parameters' values become 0, so numbered pages share an item; parameters' names stay.
    """
    u = F.coalesce(url, F.lit(""))
    names = F.filter(F.split(host(u), r"\."), lambda x: x != "")
    hosts = F.transform(names, lambda x, i: F.concat(F.lit("host="), F.array_join(F.slice(names, i + 1, F.size(names)), ".")))
    steps = F.filter(F.split(path(u), "/"), lambda x: x != "")
    steps = F.transform(steps, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, r"\d+", "0")))
    asked = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    asked = F.transform(asked, lambda x: F.concat(F.lit("ask="), F.regexp_extract(x, r"(?s)^[^=]*", 0), F.regexp_replace(F.regexp_extract(x, r"(?s)=.*$", 0), r"\d+", "0")))
    rest = F.filter(
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(u, r"(?s)^(.*?)://", 1)), F.concat(F.lit("part="), F.regexp_extract(u, r"#(.+)", 1))),
        lambda x: ~F.endswith(x, F.lit("=")),
    )
    return F.array_distinct(F.concat(hosts, steps, asked, rest))


def pruning(base: float, n: int, min_support: float = MIN_SUPPORT, lift: float = MIN_LIFT) -> tuple[float, float]:
    """(least support, least confidence) of rules among n pages of which the share `base` is bad.

    More than half of a rule's pages must be bad, lest it blocks more good pages than bad ones; where bad pages are common,
    `lift` times their share must be, or half way from it to 1 if that is less. Of pages that are all bad a rule needs so many that chance alone is MIN_DEVIATIONS standard errors away; with fewer no rule can pass, so they
    are left out while mining already, whatever the table's size.
    """
    least = MIN_DEVIATIONS**2 * base / (1 - base)
    return min(1.0, max(min_support, math.ceil(least) / n)), max(MIN_CONFIDENCE, min(base * lift, (1 + base) / 2))


def alike(each: DataFrame, least: float) -> DataFrame:
    """token, item and members: tokens that are on exactly the same rows are one item, named by the first of its members.

    each has row, bad and token; only tokens on `least` bad rows at least can be in a rule, the others go. Sets of rows are compared by their size and 128
    bits of hashes, which need one pass and no lists of rows.
    """
    bits = [F.bit_xor(F.xxhash64(F.lit(k), F.col("row"))).alias(f"h{k}") for k in (1, 2)]
    tokens = each.groupBy("token").agg(F.count("*").alias("m"), F.count_if("bad").alias("m_bad"), *bits).where(F.col("m_bad") >= least)
    found = tokens.groupBy("m", "m_bad", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return settle(found.select(F.get("members", F.lit(0)).alias("item"), "members", F.explode("members").alias("token")))


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, lift: float = MIN_LIFT) -> DataFrame:
    """Rules that point at bad pages: rule_id, items, confidence, support, n and members (for each item all tokens that may stand for it).

    Labels belong to the page whose page_id is their doc_id; a page is bad if it is toxic or of low quality, and equal
    labels of one page count once. All labelled pages are mined. FP-growth lists every set of items that is frequent, so tokens that always come together, such
    as the parameters of one template or the suffixes of one host, are made one item first (alike()): any number of them cost what one does. A rule
    stands for those with any of its items' members in place of them, which have the same pages. What stays exponential is
    the number of tokens that share many bad pages without being on exactly the same ones. Rules are pruned by
    support and by confidence against the share of bad pages (see pruning()); one that holds a rule of one item less
    and no less confidence is pruned as well, which changes no verdict or confidence. Without labels of both kinds
    there are no rules; a repeated page counts as often as it is there.
    """
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    baskets = settle(pages.select("page_id", url_tokens(F.col("url")).alias("t")).join(known, F.col("page_id") == F.col("doc_id")).select("t", "bad", F.monotonically_increasing_id().alias("row")))
    n, n_bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if not 0 < n_bad < n:
        nothing = [F.lit(0).alias("rule_id"), F.col("t").alias("items"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"), F.lit(0).alias("n"), F.array("t").alias("members")]
        return baskets.select(nothing).where("false")
    base = n_bad / n
    support, confidence = pruning(base, n, min_support, lift)
    each = baskets.select("row", "bad", F.explode_outer("t").alias("token"))
    same = alike(each, support * n - 1e-6)
    met = each.join(broadcast_if(same.select("token", "item")), "token", "left").groupBy("row", "bad").agg(F.collect_set("item").alias("t"))
    items = F.concat("t", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(met.select(items.alias("items")))
    rules = model.associationRules.where(F.get("consequent", F.lit(0)) == BAD)
    pages_of = F.round(F.col("support") * n / F.col("confidence"))
    apart = (F.col("confidence") - base) / F.sqrt(F.lit(base * (1 - base)) / pages_of) >= MIN_DEVIATIONS
    rules = settle(rules.where(apart).select(F.array_sort("antecedent").alias("items"), "confidence", "support"))
    rules = rules.select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "support", F.size("items").alias("n"))
    shorter = rules.select("rule_id", "confidence", F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("part"))
    other = rules.select(F.col("items").alias("part"), F.col("confidence").alias("other_c"))
    held = shorter.join(other, "part").where("other_c >= confidence").select("rule_id").distinct()
    kept = settle(rules.join(held, "rule_id", "left_anti"))
    told = kept.select("rule_id", F.explode("items").alias("item")).join(same.select("item", "members").distinct(), "item")
    members = told.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "members"))), lambda x: x["members"]).alias("members"))
    return settle(kept.join(members, "rule_id"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls (column url, each once) that some rule fits, with the strongest rule's confidence.

    A rule fits where each of its items has a member among the url's tokens. An inverted index leads from the members of a rule's longest
    item to the rule; the items that remain are then looked up in the url.
    """
    key = F.array_max(F.transform("members", lambda m: F.struct(F.length(F.get(m, F.lit(0))).alias("n"), m.alias("m"))))["m"]
    index = rules.select(F.explode(key).alias("token"), "members", "confidence")
    few = index.count() <= BROADCAST_RULES
    words = urls.select("url", url_tokens(F.col("url")).alias("t")).select("url", "t", F.explode("t").alias("token"))
    fits = words.join(F.broadcast(index) if few else index, "token").where(F.forall("members", lambda m: F.arrays_overlap(m, F.col("t"))))
    return fits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, listed: list[tuple[str, str, str]] = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence for every row of pages.

    A listed rule decides where one fits (longest first); else a page that a mined rule fits is blocked, and the others
    allowed. Null urls and urls without :// have an empty host and path, fit no listed rule and are allowed unless a
    mined rule fits; a page that is not labelled, or has no page_id, is judged like any other. Repeated rows stay, urls of any
    length are read whole, no rows give no rows. Only page_id and url are read.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    rows = pages.select("page_id", "url", h.alias("host"), p.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"))
    open_urls = rows.where(F.col("said").isNull() & F.col("url").isNotNull()).select("url").distinct()
    hits = match_rules(open_urls, mine_rules(pages, labels)).select(F.col("url").alias("hit_url"), "confidence")
    return rows.join(hits, F.col("url") == F.col("hit_url"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("hit_url").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("said").isNull(), F.col("confidence")).alias("confidence"),
    )
