"""Operators with numpy inside tasks, against brute force."""

import hashlib
from zlib import crc32

import numpy as np
import xxhash

from sievework.llm import embed, repeats, simhash, toxicity
from sievework.llm.common import components


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_spanning_keeps_components():
    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 500, (2, 300))
    p, q = simhash.spanning(u, v, 500)
    assert len(p) <= 500

    def labels(a, b):
        x = np.arange(500)
        for _ in range(500):
            m = np.minimum(x[a], x[b])
            np.minimum.at(x, a, m)
            np.minimum.at(x, b, m)
        return x.tolist()

    assert labels(u, v) == labels(p, q)


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_passages(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(14) for _ in range(6)]
    rows = [(i, text(20) + " " + shared[i % 6][: 40 + i % 45] + " " + text(10)) for i in range(60)]
    rows += [(100, shared[0] + shared[0]), (101, "a" * 400), (102, "a" * 300), (103, "a" * 49), (104, ""), (105, None), (90, shared[1]), (90, shared[1] + "x"), (7, shared[2] * 3), (200, text(30_000))]
    rows += [(300 + i, rows[5][1]) for i in range(5)] + [(400, rows[-1][1])]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, kept string").repartition(7)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect())
    assert got == brute_repeats(rows)
    assert repeats.remove_repeats(df.where("false")).count() == 0


def test_repeats_over_many_chunks_and_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("xyz "), 300)) for _ in range(10)]
    rows = [(i, base[i % 10][i % 50 :] + "".join(rng.choice(list("xyz "), 80)) + base[(i * 3) % 10][: 60 + i % 90]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(repeats, "BUCKET", 3000)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df, with_text=False).collect())
    assert got == brute_repeats(rows)


def fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        t = [str(x) for x in rng.choice(words, 200)]
        rows.append((1000 - i, " ".join(t)))
        if i % 3 == 0:
            t[5] = "Changed"
            rows.append((2000 + i, " ".join(t)))
    rows += [(1, ""), (2, None), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é" * 30_000), (7, "é" * 30_000)]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, fp string")
    fp = [fingerprint(t) for _, t in rows]
    label = [i for i, _ in rows]
    for _ in range(20):
        label = [min(y for y, g in zip(label, fp) if bin(f ^ g).count("1") <= 2) for f in fp]
    got = sorted(tuple(r) for r in simhash.near_duplicates(df).collect())
    assert got == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, label))
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_tiles_of_any_size_give_the_same_components(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 40)
    fps = {int(b ^ (1 << int(i)) ^ (1 << int(j))) for b in base for i, j in rng.integers(0, 62, (8, 2))} | {int(b) for b in base}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = [sorted((r["node"], r["component"]) for r in components(simhash.near_links(df, tile=t, quarters_from=q)).collect()) for t, q in ((4096, 10**9), (5, 10**9), (5, 1))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def brute_links(rows, cosine=0.95):
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, label = {k: 0 for k in range(len(rows))}, {k: r[0] for k, r in enumerate(rows)}
    near = {(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine}
    for a, b in near:
        links[a] += 1
        links[b] += 1
    for _ in range(30):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return sorted((rows[k][0], links[k], label[k], rows[k][0] == label[k]) for k in range(len(rows)))


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        v = rng.standard_normal(32).astype(np.float32)
        rows.append((i, v.tolist()))
        if i % 4 == 0:
            rows += [(100 + 10 * i + k, (v + rng.standard_normal(32).astype(np.float32) * 0.05).tolist()) for k in range(3)]
    rows += [(900 + i, rows[0][1]) for i in range(4)] + [(950, None), (951, []), (952, [0.0] * 32), (953, [float("nan")] + [1.0] * 31), (954, [None] + [1.0] * 31), (955, [float("inf")] + [1.0] * 31), (956, [1.0, 2.0]), (957, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in embed.near_duplicates(df).collect())
    assert got == brute_links(rows)
    assert embed.near_duplicates(df.where("false")).count() == 0


def test_embedding_blocks_count_each_pair_once(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal(16)
    rows = [(i, (v + rng.standard_normal(16) * 0.02).astype(np.float32).tolist()) for i in range(150)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "node long, embedding array<float>, n long")
    n = sum(r["n"] for r in embed.near_links(df, block=20).where("b is null").collect())
    assert n == sum(x[1] for x in brute_links(rows))
    cut = embed.candidate_groups(embed.candidates(df, embed.COSINE, embed.table_plan(150), block=20)).collect()
    assert {r["grp"] for r in cut} == {0} and len(cut) == 150


def test_embeddings_in_double_precision_and_with_any_id(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [1.0, 0.0]), (low, [0.0, 1.0]), (high, [0.0, 1.0]), (high - 1, [0.0, 3.0]), (None, [0.0, 2.0]), (None, [-1.0, 0.0]), (None, [-2.0, 0.0]), (None, None), (9, [1.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted((tuple(r) for r in embed.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (low, 3, low, True), (high, 3, low, False), (high - 1, 3, low, False), (None, 3, low, False)]
    want += [(None, 1, None, True)] * 2 + [(None, 0, None, True)] + [(9, 1, 9, True)] * 2
    assert got == sorted(want, key=str)


def test_embedding_recall_against_all_pairs(spark):
    rng = np.random.default_rng(18)
    base = rng.standard_normal((1500, 64))
    x = np.concatenate([base, base[:700] + rng.standard_normal((700, 64)) * rng.uniform(0.1, 0.33, (700, 1))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cos = x.astype(float) @ x.astype(float).T
    pairs = int(((cos >= embed.COSINE).sum() - len(x)) / 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = sum(r["n_links"] for r in embed.near_duplicates(df).collect()) / 2
    assert pairs > 300 and 0.97 * pairs <= found <= pairs


def test_embeddings_that_chain(spark):
    """A walk of near but mostly unlinked vectors is one group: it goes to buckets, and gives the same counts as all pairs."""
    rng = np.random.default_rng(28)
    walk = [rng.standard_normal(48)]
    while len(walk) < 900:  # neighbours have cosines of 0.9 to 0.98
        step = rng.standard_normal(48) * rng.uniform(0.2, 0.48) / np.sqrt(48)
        walk.append(walk[-1] / np.linalg.norm(walk[-1]) + step)
    x = np.concatenate([walk, rng.standard_normal((300, 48)) + 1.9 * rng.standard_normal(48)])
    x = x[rng.permutation(len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    near = (cos >= embed.COSINE).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "node long, embedding array<double>, n long")
    tables = embed.table_plan(len(x), typical=embed.typical_distance(df))
    assert abs(embed.typical_distance(df) - np.sqrt(2 - 2 * cos.mean())) < 0.001
    links = embed.candidates(df, embed.COSINE, tables)
    groups = embed.candidate_groups(links)
    places = links.selectExpr("explode(array(a, b)) node", "bucket").distinct().join(groups, "node")
    assert embed.scattered(places, 16).count() >= 1
    counts = {}
    for r in embed.near_links(df, block=16).where("b is null").groupBy("a").sum("n").collect():
        counts[r[0]] = r[1]
    got = np.array([counts.get(i, 0) for i in range(len(x))])
    assert (got <= near).all() and got.sum() >= 0.98 * near.sum() > 0


def test_embeddings_that_chain_at_512_bits(spark):
    """Steps that the longer sketches still follow: the walk's groups go to buckets, and give the same counts as all pairs."""
    rng = np.random.default_rng(28)
    walk = [rng.standard_normal(48)]
    while len(walk) < 900:  # neighbours have cosines of 0.93 to 0.98
        step = rng.standard_normal(48) * rng.uniform(0.2, 0.34) / np.sqrt(48)
        walk.append(walk[-1] / np.linalg.norm(walk[-1]) + step)
    x = np.concatenate([walk, rng.standard_normal((300, 48)) + 1.9 * rng.standard_normal(48)])
    x = x[rng.permutation(len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= embed.COSINE).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "node long, embedding array<double>, n long")
    links = embed.candidates(df, embed.COSINE, embed.table_plan(len(x), typical=embed.typical_distance(df)))
    places = links.selectExpr("explode(array(a, b)) node", "bucket").distinct().join(embed.candidate_groups(links), "node")
    wide = {r["wide"] for r in embed.scattered(places, 16).collect()}
    sizes = {r["grp"]: r["count"] for r in places.select("grp", "node").distinct().groupBy("grp").count().collect()}
    assert wide and max(sizes, key=sizes.get) in wide
    counts = {r[0]: r[1] for r in embed.near_links(df, block=16).where("b is null").groupBy("a").sum("n").collect()}
    got = np.array([counts.get(i, 0) for i in range(len(x))])
    assert (got <= near).all() and got.sum() >= 0.98 * near.sum() > 0


def test_toxicity_learns_words_and_stems(spark):
    rng = np.random.default_rng(9)
    calm = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        t = [str(x) for x in rng.choice(calm, int(rng.integers(5, 150)))]
        toxic = i % 4 == 0
        if toxic:
            for k in rng.integers(0, len(t), 2):
                t[k] = "zqxw" + str(rng.choice(calm))[:3]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "... !!!"), (1003, "calm " * 40_000 + "zqxwabc zqxwdef")]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, lab).collect()}
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i]["held_out"]]
    hit = sum(got[i]["predicted"] for i in held if truth[i])
    assert len(held) > 150 and hit >= 0.9 * sum(truth[i] for i in held)
    assert sum(got[i]["predicted"] for i in held if not truth[i]) <= 0.05 * len(held)
    assert got[1003]["predicted"] == 1 and [got[i]["predicted"] for i in (1000, 1001, 1002)] == [0, 0, 0]
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}
    big = 1152921504606846977
    odd = spark.createDataFrame([(big, rows[0][1], 1), (big + 2, None, 1), (None, rows[0][1], 1), (-(1 << 63), "x", 1)], "doc_id long, text string, score int").coalesce(1)
    seen = {r["doc_id"]: r["held_out"] for r in toxicity.score(df.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), lab).collect()}
    assert all(seen[i] == (crc32(str(i).encode()) % 3 == 1) for i in (big, big + 2, -(1 << 63))) and seen[None] is False
    copies = lab.where("toxic = 1").crossJoin(spark.range(20)).drop("id").unionByName(lab)
    some = toxicity.sampled(df.unionByName(df), copies, (50, 60)).collect()
    assert sorted(r["toxic"] for r in some) == [0] * 60 + [1] * 50 and len({r["doc"] for r in some}) == 110
    none = toxicity.score(df, lab.where("false")).collect()
    assert {r["score"] for r in none} == {0.0} and toxicity.score(df.where("false"), lab).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(10)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["ab", "cde", "fghij", "k"]
    rows, flat, size = toxicity.features(words)
    ids = np.zeros((3, 6), np.int64)
    ids[0], ids[1, :4], ids[2, :2] = rng.integers(1, 5, 6), rng.integers(1, 5, 4), [1, 2]
    y, mask = np.array([1.0, 0.0, 1.0]), np.ones((3, 6), bool)
    grad = net.gradients(ids, y, rows, flat, size, mask, mask)

    def loss():
        x = ids.T
        g = np.where((x > 0)[:, :, None], net.vectors(rows, flat, size)[np.maximum(x, 1) - 1] @ net.p["w"] + net.p["b"], net.pad_inputs()[0])
        p = toxicity.sigmoid(net.pool(net.states(g)[0], x > 0)[2])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, at in (("w", (3, 5)), ("w", (12, 30)), ("u0", (2, 20)), ("u1", (1, 3)), ("att", (4,)), ("out", (9,)), ("b", (17,)), ("gram", (flat[0], 2)), ("word", (rows[1], 1))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-3 + 0.05 * abs(grad[k][at]), k


def brute_kept(rows, similar=0.8):
    """The rows that stay: one for each component of exact similarities of five-word shingle sets."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if words[a] == words[b] or len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]) > 0]
    for _ in range(len(rows)):
        new = list(label)
        for a, b in near:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    best = {}
    for k, (i, _) in enumerate(rows):
        best[label[k]] = min(best.get(label[k], (True, 0)), (i is None, i or 0))
    return sorted(best.values())


def test_keep_one(spark):
    rng = np.random.default_rng(25)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = []
    for k in range(60):
        t = text(int(rng.integers(3, 400)))
        rows.append((5000 - k, " ".join(t)))
        for c in range(k % 4):
            u = list(t)
            for at in rng.integers(0, len(t), 1 + len(t) * c // 150):
                u[at] = "changed"
            rows.append((100 * k + c, "\n".join(u).upper() if c else " ".join(u)))
    rows += [(None, rows[3][1]), (None, " ".join(text(50))), (9000, ""), (9001, None), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two three four"), (9006, " ".join(text(30_000)))]
    rows += [(9007, rows[-1][1] + " more"), (9007, rows[-1][1] + " more")]
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, th string, n int").repartition(5)
    want = brute_kept(rows)
    for tile, block in ((4096, 256), (7, 3)):
        kept = simhash.keep_one(df, tile, block)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want


def test_pairs_of_just_the_least_similarity_are_candidates():
    rng = np.random.default_rng(26)

    def prints(s):
        other = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.array([[simhash.majority(s), simhash.majority(other ^ (other >> np.uint64(32))), len(s), 0]])

    found = 0
    for k in range(200):
        both = rng.integers(0, 1 << 62, 2 * 300 - 267).astype(np.uint64)  # 267 of 333 are shared: 0.80
        a, b = prints(both[:300].copy()), prints(both[33:].copy())
        b[0, 3] = 1
        found += len(simhash.compare_prints(a, b)[0])
    assert found >= 190


def test_keep_one_goes_by_rows_and_not_by_ids(spark):
    text = lambda *at: " ".join(f"w{i}" for i in range(*at))
    low = -(1 << 63)
    rows = [(None, text(0, 90)), (None, text(100, 190)), (None, text(100, 190)), (7, text(200, 290)), (7, text(300, 390)), (3, text(300, 390)), (7, text(400, 490)), (7, text(400, 490)), (None, text(200, 290))]
    rows += [(low, text(500, 590)), (None, text(500, 590)), (None, text(600, 690)), (low, text(700, 790)), ((1 << 60) + 1, text(800, 890)), ((1 << 60) + 3, text(800, 890))]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, key string")
    want = [(None, text(0, 90)), (None, text(100, 190)), (7, text(200, 290)), (3, text(300, 390)), (7, text(400, 490))]
    want += [(low, text(500, 590)), (None, text(600, 690)), (low, text(700, 790)), ((1 << 60) + 1, text(800, 890))]
    for n in (1, 4):
        kept = simhash.keep_one(df.repartition(n))
        assert kept.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one(df.where("false")).count() == 0


def test_repeats_in_every_order_of_ids(spark):
    passage = "a passage of well over fifty bytes that several rows hold, whatever their ids"
    top, big = repeats.LAST, (1 << 60) + 1
    none = top + 1  # for brute force: larger than any id
    for ids in ([1, 2, 1], [None, 5, None], [2, 1, 2], [5, None, 5], [1, 2, 1, 3], [None, None], [top, None], [None, top, -top - 1, top - 1], [top, top], [big, big + 2, None]):
        rows = [(none if i is None else i, f"{k} {passage} {k}") for k, i in enumerate(ids)]
        df = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows)], "doc_id long, text string").coalesce(1)
        got = sorted((none if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect())
        assert got == brute_repeats(rows), ids
