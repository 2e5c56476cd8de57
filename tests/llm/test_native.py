"""Operators in DataFrame functions only, against small models in Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import chat, decontaminate, license, mix, shard, urls

DOCS = "doc_id long, text string, source string, __mix string, size long, th string, word string"


def docs(spark, rows):
    """Documents with columns that operators use inside too."""
    return spark.createDataFrame([(i, t, s, "x", 7, "y", "z") for i, t, s in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = ["plain", "", None, "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<|", "<\\\\|x<|im_end|>", "a\n<|im_end|>\n", "é 🎉 <|im_end|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, r, TEXTS[(c + t) % len(TEXTS)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "assistant", "a%b\nc<|"])]
    rows += [(20, None, None, None), (20, 1, "user", "b"), (20, 1, "user", "a"), (20, 1, "user", "a"), (None, 0, "assistant", "x" * 50_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert len(got) == 11
    for c in got:
        mine = sorted([(-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c])
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in mine))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_escapes_only_conflicts(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b | c"), (2, 0, "user", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df).collect()}
    assert out == {1: "<|im_start|>user\na < b | c<|im_end|>\n", 2: "<|im_start|>user\n<\\|im_end|><|im_end|>\n"}


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_targets_and_draws(spark):
    rows = [(i, " ".join(["w"] * (i % 50 + 1)), f"s{min(i % 40, 6)}") for i in range(3000)] + [(i, "one two\u00a0three", None) for i in range(3000, 3010)] + [(5000, None, "s1"), (5001, "", "s0"), (5001, "", "s0")]
    out = mix.mix_report(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _, _ in rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    want, source = water(sizes), {i: s for i, _, s in rows}
    taken = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=60)
    assert sorted(map(str, out)) == sorted(map(str, mix.mix_report(docs(spark, rows)).collect()))


def test_mix_emits_rows_as_often(spark):
    rows = [(i, "a b c", "x" if i % 10 else "y") for i in range(500)]
    df = docs(spark, rows)
    copies = {r["doc_id"]: r["taken"] // 3 for r in mix.mix_report(df).collect()}
    out = mix.mix(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert mix.mix(df.where("false")).count() == 0


def brute_shards(rows, cell_rows, shards=8):
    """The shard of every document: prefix sums over one global order, cut where a group's or a row's middle byte lies."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda b: signed(xxhash.xxh64_intdigest(b, 42))
    text, size = [t or "" for _, t, _ in rows], [len((t or "").encode()) + 1 for _, t, _ in rows]
    th, total = [h(t.encode()) for t in text], sum(size)
    often, held = Counter(th), Counter()
    for x, s in zip(th, size):
        held[x] += s
    cells = max(shard.LEAST_CELLS, math.ceil(len(rows) / cell_rows))
    large = {x: math.ceil(often[x] / cell_rows) for x in often if often[x] > 1 and held[x] > shard.TOLERANCE * total / shards}
    cell = lambda x: math.floor((x / 2.0**64 + 0.5) * cells)
    order = sorted(range(len(rows)), key=lambda k: (cell(th[k]), th[k] in large, th[k] if th[k] in large else 0, h(rows[k][0].to_bytes(8, "little", signed=True)) % large.get(th[k], 1), th[k], rows[k][0]))
    upto, out, k = 0, {}, 0
    while k < len(order):
        n = 1 if th[order[k]] in large else sum(th[j] == th[order[k]] for j in order[k : k + often[th[order[k]]]])
        part = sum(size[j] for j in order[k : k + n])
        out |= {rows[j][0]: min(shards - 1, (2 * upto + part) * shards // (2 * total)) for j in order[k : k + n]}
        upto, k = upto + part, k + n
    return out


def test_shards(spark):
    rows = [(i, f"t{i % 900}" * (i % 7 + 1), "s") for i in range(4000)] + [(i, "hot copy " * 20, "s") for i in range(4000, 6000)] + [(9000, None, "s"), (9001, "", "s"), (9001, "", "s")]
    out = shard.shard_by_bytes(docs(spark, rows), cell_rows=300).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _, _ in rows)
    text = {i: t or "" for i, t, _ in rows}
    sums, slots = Counter(), {}
    for r in out:
        t = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sums) == set(range(8)) and max(sums.values()) - min(sums.values()) < 0.05 * sum(sums.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["doc_id"]: r["shard"] for r in out} == brute_shards(rows, 300)
    small = {}
    for r in out:
        if r["doc_id"] < 4000:
            small.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in small.values())
    assert shard.shard_by_bytes(docs(spark, rows).where("false")).count() == 0


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    grams = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t, _ in rows:
        w, hit, ids = low(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= grams[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Short ITEM here"), (3, None), (4, " .,! "), (10, "short item here"), (11, "É one"), (12, "x x x x x x x x x x x")]
PASSAGES = ["", None, "intro " + ITEMS[0][1].upper() + " outro", "a SHORT-item, here! short item here", "é one", "É One", " ".join(["x"] * 40), "w1 w2 w3", " ".join(f"w{i}" for i in range(3, 14)) + " tail", "word " * 30_000 + "short item here"]


@pytest.mark.parametrize("few", [200_000, 4])
def test_decontamination(spark, few):
    rows = [(i, t, "s") for i, t in enumerate(PASSAGES)] + [(2, PASSAGES[2], "s"), (0, "", "s"), (None, PASSAGES[3], "s"), (None, "w1 w2 w3", None), (None, None, "s")]
    bench = spark.createDataFrame([(*x, "extra") for x in ITEMS], "item_id long, text string, gram string")
    df, key = docs(spark, rows), lambda x: str(x[0])
    if few > 4:
        got = decontaminate.contamination(df, bench)
        got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
        assert got == sorted(brute_hits(rows, ITEMS), key=str)
    found = decontaminate.find_hits(df, bench, broadcast_windows=few).where("hits is not null")
    found = {(r["doc_id"], r["n"], r["rows"]) for r in found.select("doc_id", "rows", F.size(decontaminate.hit_words(F.col("hits"))).alias("n")).collect()}
    assert found == {(x[0], x[2], 2 if x[0] == 2 else 1) for x in brute_hits(rows, ITEMS) if x[5]}
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([x[0] for x in brute_hits(rows, ITEMS) if not x[5]], key=str)


def test_decontamination_of_a_million_words(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs(spark, [(1, "word Other " * 500_000 + ITEMS[0][1], "s")]), bench).collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == [(1_000_014, 14, 1)]


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs(spark, [(1, "short item here and more", "s"), (2, "none", None)])
    assert decontaminate.contamination(df.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(df, bench.where("false")).collect()} == {0}
    assert {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(df, bench).collect()} == {1: "and more", 2: "none"}
    more = docs(spark, [(None, "Short item, here! a short (item) here", "s"), (3, None, "s"), (4, "", "s"), (4, "x", "s"), (4, "x", "s")])
    assert sorted([(r["doc_id"], r["text"]) for r in decontaminate.cut_spans(more, bench).collect()], key=str) == sorted([(None, "a "), (3, None), (4, ""), (4, "x"), (4, "x")], key=str)


URLS = [
    ("https://EN.Example.org/es/1", "en.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://a.com/fr/x?y", "a.com", "/fr/x", "com/fr/", "allow"), ("https://com/de/", "com", "/de/", "com/de/", "block"), ("https://b.net#p", "b.net", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"),
    ("://", "", "", None, "allow"), ("http://x.org?q=/es/", "x.org", "", None, "allow"), ("http://notorg/", "notorg", "/", None, "allow"), ("http://a.org/x://b.com/de/", "a.org", "/x://b.com/de/", "org/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r)[:5] for r in urls.judge_urls(pages, labels).collect())
    assert got == sorted([(i, *x[1:]) for i, x in enumerate(URLS)] + [(0, *URLS[0][1:])], key=lambda r: (r[0],))


def test_mined_url_rules(spark):
    bad = [(i, f"https://spam.example.net/win/{i}") for i in range(60)]
    good = [(i, f"https://news.example.net/a/{i}") for i in range(100, 200)]
    pages = spark.createDataFrame(bad + good + [(900, "https://spam.example.net/win/900"), (901, "https://news.example.net/b/1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good] + [(0, 0, 1)], "doc_id long, quality int, toxic int")
    rules = urls.mine_rules(pages, labels).collect()
    assert rules and all(r["confidence"] >= 0.5 and "label=bad" not in r["items"] for r in rules)
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, labels).collect()}
    assert got[900] == "block" and got[901] == "allow" and {got[i] for i, _ in good} == {"allow"}


def test_mined_url_rules_of_many_items(spark):
    """Five tokens mark a bad page; any four of them are on more good pages than bad ones."""
    tokens, others = ["spam.net", "win", "now", "a=b", "c=d"], ["news.org", "x", "y", "e=f", "g=h"]
    url = lambda t: f"https://{t[0]}/{t[1]}/{t[2]}?{t[3]}&{t[4]}"
    bad = [(i, url(tokens)) for i in range(30)]
    good = [(100 + 40 * k + i, url(tokens[:k] + [others[k]] + tokens[k + 1 :])) for k in range(5) for i in range(31)]
    pages = spark.createDataFrame(bad + good + [(900, url(tokens)), (901, url(others))], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["verdict"], r["confidence"]) for r in urls.judge_urls(pages, labels).where("rule is null").collect()}
    assert got[900] == ("block", 1.0) and {got[i] for i, _ in bad} == {("block", 1.0)}
    assert all(got[i][0] == "allow" for i, _ in good if i in got)


def brute_rules(baskets):
    """Items to confidence of every rule that passes, by counting all sets of tokens."""
    n, base = len(baskets), sum(b for _, b in baskets) / len(baskets)
    support, confidence = urls.pruning(base, n)
    seen, bad = Counter(), Counter()
    for t, b in baskets:
        for k in range(1, len(t) + 1):
            for x in itertools.combinations(sorted(t), k):
                seen[x] += 1
                bad[x] += b
    apart = lambda x: (bad[x] / seen[x] - base) / math.sqrt(base * (1 - base) / seen[x]) >= urls.MIN_DEVIATIONS
    kept = {x: bad[x] / seen[x] for x in seen if bad[x] / n >= support - 1e-12 and bad[x] / seen[x] >= confidence and apart(x)}
    return {x: c for x, c in kept.items() if not any(kept.get(x[:i] + x[i + 1 :], -1) >= c for i in range(len(x)))}


def test_mined_url_rules_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        host, lang, ref = rng.choice(["a.one.net", "b.one.net", "two.net", "pills.three.com"]), rng.choice(["en", "de", "fr"]), rng.choice(["?x=1", "?y=2", "", "#top"])
        chance = 0.9 if host.startswith("pills") and lang != "fr" else 0.75 if (host, ref) == ("two.net", "?x=1") else 0.2
        rows.append((i, f"https://{host}/{lang}/{rng.randrange(50)}{ref}", rng.random() < chance))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(5000, "https://x.pills.three.com/de/1?x=1"), (5001, "https://two.net/fr/9?y=2"), (None, "https://two.net/fr/9?x=3")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, _, b in rows], "doc_id long, quality int, toxic int")
    tokens = {r["url"]: r["t"] for r in pages.select("url", urls.url_tokens(F.col("url")).alias("t")).collect()}
    want = brute_rules([(tokens[u], b) for _, u, b in rows])
    mined = urls.mine_rules(pages, labels)
    got = {tuple(sorted(x)): r["confidence"] for r in mined.collect() for x in itertools.product(*r["members"])}
    assert set(got) == set(want) and len(got) > 2 and all(got[x] == pytest.approx(want[x]) for x in want)
    hits = {r["url"]: r["confidence"] for r in urls.match_rules(pages.select("url").distinct(), mined).collect()}
    for u, t in tokens.items():
        fits = [c for x, c in want.items() if set(x) <= set(t)]
        assert hits.get(u) == (pytest.approx(max(fits)) if fits else None)
    said = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, labels).collect()}
    assert said[5001] == "allow" and said[None] == "block"


def test_tokens_that_always_come_together(spark):
    """Sixty parameters on the same 40 bad pages are one item; a page with only one of them is blocked as by the rule of that one."""
    template = "?" + "&".join(f"p{k}=v" for k in range(60))
    bad = [(i, f"https://a.shop.net/x/{i}{template}") for i in range(40)]
    good = [(100 + i, f"https://b.news.org/y/{i}") for i in range(200)]
    more = [(900, "https://c.info/?p17=v"), (901, "https://c.info/?p60=v"), (902, "https://z.net/"), (903, "https://c.info/"), (904, "https://b.news.org/y/7" + template)]
    pages = spark.createDataFrame(bad + good + more, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    rules = urls.mine_rules(pages, labels).collect()
    assert [(r["n"], r["confidence"], len(r["members"][0])) for r in rules] == [(1, 1.0, 60 + 3 + 1)]  # three host suffixes and a path
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, labels).collect()}
    assert [got[i] for i, _ in more] == ["block", "allow", "block", "allow", "allow"]  # the last is listed
    assert {got[i] for i, _ in bad} == {"block"} and {got[i] for i, _ in good} == {"allow"}


def test_parameter_names_keep_their_digits(spark):
    row = spark.range(1).select(urls.url_tokens(F.lit("https://h/?p1=12&p2=12&q&=7")).alias("t")).first()["t"]
    assert {x for x in row if x.startswith("ask=")} == {"ask=p1=0", "ask=p2=0", "ask=q", "ask==0"}


def test_license_scan(spark):
    files = [
        ("a/LICENSE", "Text\nReleased under the MIT License.\n"), ("a/b/c.txt", "nothing"), ("a/b/d.txt", "prose\n\n  licensed under the APACHE license, version 2.0\nmore"), ("ab/c.txt", "x"), ("top.txt", None), (None, "y"),
        ("a/x/COPYING", "Licensed under CC BY-NC 4.0."), ("a/x/y/z.txt", ""), ("a/x/y/z.txt", ""),
    ]
    df = spark.createDataFrame([(*f, "extra") for f in files], "path string, text string, license string")
    got = sorted([(r["path"] or "", r["license"], r["how"], r["license_from"]) for r in license.scan(df.select("path", "text"), license.template_table(spark)).collect()], key=str)
    assert got == sorted([
        ("a/LICENSE", "MIT", "header", None), ("a/b/c.txt", "MIT", "inherited", "a/LICENSE"), ("a/b/d.txt", "Apache-2.0", "header", None), ("ab/c.txt", None, "none", None), ("top.txt", None, "none", None), ("", None, "none", None),
        ("a/x/COPYING", "CC-BY-NC-4.0", "header", None), ("a/x/y/z.txt", "CC-BY-NC-4.0", "inherited", "a/x/COPYING"), ("a/x/y/z.txt", "CC-BY-NC-4.0", "inherited", "a/x/COPYING"),
    ], key=str)
    assert license.scan(df.select("path", "text").where("false"), license.template_table(spark)).count() == 0


def brute_notices(files, similar=0.6):
    """Path to (license, score) by TF-IDF over all terms, of lines, runs of lines and whole license files."""
    n, seen = len(files), Counter(t for _, x in files for t in set(low(x)))
    idf = lambda t: math.log((1 + n) / (1 + seen[t])) + 1
    vector = lambda x: {t: k * idf(t) for t, k in Counter(low(x)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    made = [(name, vector(notice)) for name, notice in license.TEMPLATES]
    most, found = max(len(low(x)) for _, x in license.TEMPLATES), {}
    for path, text in files:
        found[path] = {}
        for line in (text or "").split("\n"):
            if tag := re.match(r"(?i)\s*(?:\W{1,4}|rem |dnl )?\s*SPDX-License-Identifier: *((?:[\w.+()-]+|(?<=\S) +(?=\S))+)", line):
                found[path][tag[1].strip()] = -1.0
                break
    for path, text in files:
        lines = [x for x in (text or "").splitlines() if low(x)]
        parts = ["\n".join(lines[i : i + k]) for i in range(len(lines)) for k in range(1, most + 1) if i + k <= len(lines)]
        if re.fullmatch(r"(?i)(licen[cs]e|copying|notice)(\.\w+)?", (path or "").split("/")[-1]) and lines:
            parts.append("\n".join(lines))
        for v in map(vector, parts):
            for name, w in made:
                score = round(sum(x * v.get(t, 0) for t, x in w.items()) / norm(v) / norm(w), 9)
                needed = {"AGPL-3.0": "affero 3", "GPL-2.0": "2", "GPL-3.0": "3", "LGPL-2.1": "lesser 2 1", "LGPL-3.0": "lesser 3"}.get(name, "")
                if score >= similar and all(t in v for t in needed.split()):
                    found[path][name] = min(found[path].get(name, 0), -score)
    for names in found.values():
        for held, by in (("BSD-2-Clause", "BSD-3-Clause"), ("GPL-2.0", "LGPL-2.1")):
            if by in names:
                names.pop(held, None)
    best = {p: min((s, name) for name, s in names.items()) for p, names in found.items() if names}
    return {p: (name, -s) for p, (s, name) in best.items()}


def test_license_scores_equal_brute_force(spark):
    common = ["for this file and all of it mit einem Wort", "Copyright 2020 the authors and others", "use of this work is subject to review by the others"]
    files = [(f"p/{i}.txt", "\n".join(common[: i % 3 + 1]) + f"\nword{i} for and file") for i in range(120)]
    for i, (_, notice) in enumerate(license.TEMPLATES):
        w = notice.split()
        files += [(f"n{i}/one.txt", f"{notice} for"), (f"n{i}/two.txt", f"x\n// {notice} and file"), (f"n{i}/rare.txt", f"{notice} unheard{i} of{i} here{i}"), (f"n{i}/half.txt", " ".join(w[len(w) // 2 :]))]
        files += [(f"n{i}/wrapped.txt", "Copyright\n\n# " + " ".join(w[:4]) + "\r\n#\n# " + " ".join(w[4:]) + "\nend"), (f"n{i}/each.txt", "\n".join(w)), (f"n{i}/LICENSE", "\n".join(w + ["for", "and"] + w))]
    want = brute_notices(files)
    files += [("spdx/a.c", "/* SPDX-License-Identifier: Zlib */\nReleased under the BSD License, more or less"), ("spdx/b.c", "// SPDX-License-Identifier: (MIT OR Apache-2.0)")]
    files.append(("long/LICENSE", "MIT License\n\nCopyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including\nwithout limitation the rights"))
    want = brute_notices(files)
    assert want["spdx/a.c"] == ("Zlib", 1.0) and want["spdx/b.c"][0] == "(MIT OR Apache-2.0)" and want["long/LICENSE"][0] == "MIT"
    assert {"n1/one.txt", "n0/wrapped.txt", "n2/LICENSE"} <= set(want) and not any(p.startswith("p/") for p in want)
    got = {r["path"]: (r["license"], r["score"]) for r in license.notices(spark.createDataFrame(files, "path string, text string"), license.template_table(spark)).collect()}
    assert set(got) == set(want)
    for p, (name, score) in want.items():
        assert got[p][1] == pytest.approx(score, abs=2e-9) and got[p][0] == name, p


#: The usual headers and heads of licenses, and tags, with the names they stand for.
LICENSED = [
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("GPL-2.0", " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse"),
    ("Zlib", "1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0\nint main;"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"),
    (None, "Put the tag SPDX-License-Identifier: MIT into each file, as all others do."),
]


def test_usual_license_texts_are_named(spark):
    files = [(f"t/{i:02}.txt", text) for i, (_, text) in enumerate(LICENSED)] + [(f"f/{i}.txt", f"the version {i} of it and all that is in the work, as it was then") for i in range(400)]
    got = {r["path"]: r["license"] for r in license.scan(spark.createDataFrame(files, "path string, text string"), license.template_table(spark)).collect()}
    assert [got[f"t/{i:02}.txt"] for i in range(len(LICENSED))] == [name for name, _ in LICENSED]
    assert not any(got[f"f/{i}.txt"] for i in range(400))
