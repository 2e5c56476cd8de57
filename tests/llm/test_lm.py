"""The language model against plain recursions, token by token."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sievework.llm import lm, queries


def recursion(x, model):
    """log10 of the probability, and expected first states, moves and emissions."""
    n, k = len(x), len(model.first)
    alpha, p, log = np.empty((n, k)), model.first, 0.0
    for t in range(n):
        f = p * model.emit[x[t]]
        log, alpha[t] = log + np.log10(f.sum()), f / f.sum()
        p = alpha[t] @ model.move
    move, emit, rest = np.zeros((k, k)), np.zeros(model.emit.shape), np.ones(k)
    for t in range(n - 1, -1, -1):
        state = alpha[t] * rest / (alpha[t] * rest).sum()
        emit[x[t]] += state
        if t:
            pair = np.outer(alpha[t - 1], model.emit[x[t]] * rest) * model.move
            move += pair / pair.sum()
            rest = model.move @ (model.emit[x[t]] * rest)
            rest /= rest.sum()
    return log, state, move, emit


def test_runs_equal_the_recursion():
    rng = np.random.default_rng(1)
    move, first, emit = rng.random((3, 3)), rng.random(3), rng.random((20, 3)) ** 8
    model = lm.Model(first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    texts = [rng.integers(0, 20, n) for n in (1, 5, lm.RUN, lm.RUN + 1, 2 * lm.RUN, 700, 3, 200)]
    want = [recursion(x, model) for x in texts]
    assert np.allclose(lm.Runs(texts, model, False).log10(), [w[0] for w in want])
    for got, i in zip(lm.Runs(texts, model, True).expected(), (1, 2, 3), strict=True):
        assert np.allclose(got, sum(w[i] for w in want))


TEXTS = {i: t for i, t in enumerate(["Der Hund  und die\tKatze", "the dog and the cat", None, "", "The dog x \x0bdog", "perro y gato", "unseen words onlyhere", "und die die", "the cat the dog", "y y gato", "é É", "der hund"] * 3)}


def scores_by_hand(rows, rounds):
    said = [lm.words(t) for _, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    c = Counter(w for s, h in zip(said, held, strict=True) if not h for w in s)
    n, v = sum(c.values()), len(c)
    top = sorted((w for w in c if c[w] >= lm.LEAST), key=lambda w: (-c[w], w))[: lm.FREQUENT]
    own = {w: k for k, w in enumerate(top)}
    at = lambda w: own.get(w, lm.ending(w))
    sums = np.zeros(lm.CLASSES)
    for w in c:
        sums[at(w)] += c[w]
    shares = sums + (np.arange(lm.CLASSES) >= lm.FREQUENT)
    shares /= shares.sum()
    first, move, emit = lm.start(shares)
    mix = lambda e: (1 - lm.BACKGROUND) * e + lm.BACKGROUND * shares[:, None]
    for _ in range(rounds):
        model = lm.Model(first, move, mix(emit))
        done = [recursion([at(w) for w in s], model) for s, h in zip(said, held, strict=True) if not h]
        p, m, e = (sum(d[i] for d in done) for i in (1, 2, 3))
        first, move = (p + 1) / (p + 1).sum(), (m + 1) / (m + 1).sum(axis=1, keepdims=True)
        weight = e.sum(axis=0) / e.sum()
        emit = e * (1 - lm.BACKGROUND) * emit / np.where(model.emit > 0, model.emit, 1)
        emit[lm.FREQUENT :] += weight
        emit /= emit.sum(axis=0)
    model = lm.Model(first, move, mix(emit))
    out = []
    for (i, _), s, h in zip(rows, said, held, strict=True):
        inner = sum(np.log10(max(c[w], 1) / (sums[at(w)] + 1)) for w in s if w not in own)
        out.append((i, h, len(s), sum(w in c for w in s), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in s), recursion([at(w) for w in s], model)[0] + inner))
    return out


def check(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "CLASSES", frequent + lm.ENDINGS)
    rows = [*TEXTS.items(), (None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, held_out string, base double").repartition(3)
    got = sorted((tuple(r) for r in lm.score_texts(docs, 2).collect()), key=str)
    want = sorted(scores_by_hand(rows, 2), key=str)
    assert [g[:5] for g in sorted(got, key=lambda r: str(r[:5]))] == [w[:5] for w in sorted(want, key=lambda r: str(r[:5]))]
    by = lambda r: (str(r[0]), r[2], r[5])
    assert np.allclose([g[5:] for g in sorted(got, key=by)], [w[5:] for w in sorted(want, key=by)])


def test_scores_equal_plain_ones(spark, monkeypatch):
    check(spark, monkeypatch, lm.FREQUENT)


def test_few_frequent_words(spark, monkeypatch):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(lm)  # so that workers see the patched numbers
    try:
        check(spark, monkeypatch, 3)
    finally:
        cloudpickle.unregister_pickle_by_value(lm)


def test_probabilities_sum_to_one():
    counts = np.zeros(lm.CLASSES, dtype=np.int64)
    counts[:2] = 5, 3
    counts[lm.FREQUENT] = 4
    shares = lm.Classes([b"a", b"b"], counts, 12, 4).shares()
    _, move, emit = lm.start(shares)
    assert np.isclose(shares.sum(), 1) and np.allclose(emit.sum(axis=0), 1) and np.allclose(move.sum(axis=1), 1)


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert lm.score_texts(spark.createDataFrame([], schema), 1).count() == 0
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = lm.score_texts(spark.createDataFrame([(i, "a b") for i in ids], schema), 1).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)] * 2 and all(r["score"] < 0 for r in got)


def test_held_out_texts_gain(spark):
    rows = queries.op13_lm_score(spark, "/root/testdata/sf0.001").where("held_out").toPandas()
    assert len(rows) and (rows["score"] > rows["base_score"]).mean() > 0.9


def test_arrow_cuts_the_same_words(monkeypatch):
    rng = np.random.default_rng(4)
    marks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "　", "a", "B", "Z", "é", "É", "İ", "漢", "\x00", "."]
    texts = [None, "", " ", "\n x  ", *("".join(rng.choice(marks, n)) for n in rng.integers(0, 30, 500))]
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    w, p = lm.cut(column), 0
    named = w.named.to_pylist()
    assert len(set(named)) == len(named) and lm.endings(w.named).tolist() == [lm.ending(x) for x in named]
    for n, text in zip(w.sizes, texts, strict=True):
        assert [named[i] for i in w.at[p : p + n]] == lm.words(text)
        p += n
    assert p == len(w.at)
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(lm, "PIECE", size)
        parts = [x.column("text").to_pylist() for x in lm.pieces(batch)]
        assert sum(parts, []) == texts and max(sum(len((t or "").encode()) for t in x[:-1]) for x in parts) <= size


def test_many_texts_need_no_matrices(monkeypatch):
    """Texts of some hundred tokens are one run each where a batch holds many of them; cut or not, in few tokens at a time or many, they give the same."""
    rng = np.random.default_rng(5)
    move, emit = np.full((3, 3), 0.02) + 0.94 * np.eye(3), rng.random((20, 3)) ** 8
    model = lm.Model(np.full(3, 1 / 3), move, emit / emit.sum(axis=0))
    texts = [rng.integers(0, 20, n) for n in rng.integers(1, 400, 60)]
    monkeypatch.setattr(lm, "RUNS", 60)
    cut = lm.Runs(texts, model, True)  # runs of some 200 tokens
    assert len(cut.text) > 60
    monkeypatch.setattr(lm, "RUNS", 20)  # of some 600
    want = [recursion(x, model) for x in texts]
    with monkeypatch.context() as m:
        m.setattr(lm.Runs, "effect", None)
        whole = lm.Runs(texts, model, True)
    assert len(whole.text) == 60
    for tokens in (1, 1000, 1 << 19):
        monkeypatch.setattr(lm, "TOKENS", tokens)
        for runs in (cut, whole):
            assert np.allclose(runs.log10(), [w[0] for w in want])
            for got, i in zip(runs.expected(), (1, 2, 3), strict=True):
                assert np.allclose(got, sum(w[i] for w in want))


def test_few_words_reach_the_driver(spark, monkeypatch):
    """Of many partitions' words only those go to the driver that may be among the most frequent."""
    rows = [(f"w{i}".encode(), 3_000_000 // (i + 1) ** 2 + 1) for i in range(3000)]
    counts = spark.createDataFrame(rows, "word binary, n long").repartition(20)
    for most in (1, 50, 200, 100_000):
        n = lm.least_count(counts, most)
        got, all_ = sum(r[1] >= n for r in rows), sum(r[1] >= lm.LEAST for r in rows)
        assert min(most, all_) <= got <= min(1.1 * most + 1, all_)
    assert lm.least_count(counts.where("false"), 5) == lm.LEAST
    monkeypatch.setattr(lm, "FREQUENT", 50)
    monkeypatch.setattr(lm, "CLASSES", 50 + lm.ENDINGS)
    known = lm.word_classes(counts)
    assert known.frequent == [w for w, _ in rows[:50]] and known.counts[:50].tolist() == [n for _, n in rows[:50]]
    assert (known.counts >= 0).all() and known.counts.sum() == known.tokens == sum(n for _, n in rows) and known.distinct == 3000
