"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word's input is an embedding of the word and the mean embedding of its character 3- to 5-grams, both hashed. Gated
recurrent units read windows of 32 words forwards and backwards, attention pools their states, and a document's score
is that of its worst window; windows overlap by half and cover the whole text.

The network is trained here, in numpy, on a bounded sample of labelled documents, of which Spark reads the whole texts:
first to count which words and n-grams stand in toxic and in clean documents, then to find the windows with most
evidence among all windows of each document, and, once trained, to score all windows of the documents that were set apart
for the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import settle

WINDOW, STRIDE, HIDDEN = 32, 16, 8
WORDS, GRAMS, DIM = 1 << 14, 1 << 16, 8
#: Embeddings that fewer sampled documents use stay at zero: what one document alone has is not evidence.
LEAST_DOCS = 3
#: Log odds from which a word is not swapped for a clean one while training.
EVIDENCE = 2.0
THRESHOLD = 0.7
#: At most so many toxic and clean documents are sampled; of the windows of each so many, chosen among all, are learned from.
SAMPLE, LEARNED_WINDOWS = (1500, 3000), 12
STEPS, BATCH, RATE, SEED = 320, 256, 0.01, 42
LEXICON, BLOCK = 300_000, 2048
FIND = re.compile(r"\w+").findall


def held_out(doc_id: Column) -> Column:
    """Labels of these rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(text: str | None) -> list[str]:
    return FIND((text or "").lower())


def grams(word: str) -> list[int]:
    b = f"<{word}>".encode()
    return [crc32(b[i : i + n]) % GRAMS for n in (3, 4, 5) for i in range(max(1, len(b) - n + 1))]


def features(new: list[str], part: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, gram rows, number of grams) of words."""
    flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(new), part):
        each = [grams(w) for w in new[i : i + part]]
        flat.append(np.fromiter((x for g in each for x in g), np.int32))
        size.append(np.array([len(g) for g in each], np.int64))
    return np.array([crc32(w.encode()) % WORDS for w in new], np.int32), np.concatenate(flat), np.concatenate(size)


def window_starts(n: int) -> range:
    return range(0, max(0, n - WINDOW + STRIDE - 1) // STRIDE * STRIDE + 1, STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lexicon(dict):
    """Numbers of words from 1; pending holds those whose inputs are not computed yet."""

    def __init__(self) -> None:
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self.pending.append(word)
        self[word] = n = len(self) + 1
        return n


class Network:
    def __init__(self, seed: int = SEED) -> None:
        rng, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": normal(WORDS, DIM, scale=0.1), "gram": normal(GRAMS, DIM, scale=0.3), "w": normal(2 * DIM, 6 * h, scale=0.3), "b": np.zeros(6 * h, np.float32),
            "u0": normal(h, 3 * h, scale=0.3), "u1": normal(h, 3 * h, scale=0.3), "att": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "bias": np.full(1, -1, np.float32),
        }
        self.lexicon, self.table = Lexicon(), None

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.p, self.lexicon, self.table = state["p"], Lexicon(), None

    def vectors(self, rows: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(self.p["gram"][flat], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][rows], mean], axis=1)

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers of the lexicon, with zeros up to the end of its last window."""
        look = self.lexicon
        ids = [look[w] for w in words(text)]
        return np.array(ids + [0] * (window_starts(len(ids))[-1] + WINDOW - len(ids)), np.int64)

    def pad_inputs(self) -> np.ndarray:
        pad = np.zeros((1, 6 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = 30
        return pad

    def look_up(self) -> np.ndarray:
        """The gates' inputs for all words met so far; number 0, the padding, leaves any state as it is."""
        if self.table is None:
            self.table = self.pad_inputs()
        for i in range(0, len(self.lexicon.pending), 10_000):
            vectors = self.vectors(*features(self.lexicon.pending[i : i + 10_000]))
            self.table = np.concatenate([self.table, vectors @ self.p["w"] + self.p["b"]])
        self.lexicon.pending = []
        return self.table

    def states(self, g: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of both directions, (steps, windows, 2 * HIDDEN), from the gates' inputs, and what training needs."""
        steps, n, h = len(g), g.shape[1], HIDDEN
        out, kept = np.empty((steps, n, 2 * h), np.float32), []
        for way, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            u, state, trail = self.p[f"u{way}"], np.zeros((n, h), np.float32), []
            for t in order:
                x, hu = g[t, :, way * 3 * h : (way + 1) * 3 * h], state @ u
                zr = sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                new = np.tanh(x[:, 2 * h :] + zr[:, h:] * hu[:, 2 * h :])
                if keep:
                    trail.append((t, state, zr, new, hu[:, 2 * h :]))
                state = new + zr[:, :h] * (state - new)
                out[t, :, way * h : (way + 1) * h] = state
            kept.append(trail)
        return out, kept

    def pool(self, s: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(real, s @ self.p["att"], np.float32(-1e9))
        a = np.exp(e - e.max(0)) * real
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", a, s)
        return a, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def score_windows(self, ids: np.ndarray) -> np.ndarray:
        """A score for each row of word numbers."""
        table, out = self.look_up(), np.empty(len(ids), np.float32)
        for i in range(0, len(ids), BLOCK):
            x = ids[i : i + BLOCK].T
            out[i : i + BLOCK] = sigmoid(self.pool(self.states(table[x])[0], x > 0)[2])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The largest score of each text's windows; a text without words is one window of padding."""
        if len(self.lexicon) > LEXICON:
            self.lexicon, self.table = Lexicon(), None
        ids = [self.numbers(t) for t in texts]
        count = np.array([(len(x) - WINDOW) // STRIDE + 1 for x in ids])
        flat = np.concatenate(ids)
        begins = np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]
        first = np.cumsum(count) - count
        starts = np.repeat(begins - first * STRIDE, count) + np.arange(count.sum()) * STRIDE
        step, out = np.arange(WINDOW), np.empty(len(starts), np.float32)
        for i in range(0, len(starts), 16 * BLOCK):
            out[i : i + 16 * BLOCK] = self.score_windows(flat[starts[i : i + 16 * BLOCK, None] + step])
        return np.maximum.reduceat(out, first)

    def gradients(self, ids: np.ndarray, y: np.ndarray, rows: np.ndarray, flat: np.ndarray, size: np.ndarray, mask: np.ndarray, word_mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over rows of word numbers (0 padding); rows, flat and size as from features() of words 1, 2, ...

        mask leaves out words, word_mask their word embeddings only.
        """
        p, h = self.p, HIDDEN
        x = ids.T
        real = x > 0
        own, at = np.unique(x, return_inverse=True)
        own, at = np.maximum(own, 1) - 1, at.reshape(x.shape)
        n = size[own]
        places = flat[np.repeat((np.cumsum(size) - size)[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        v = self.vectors(rows[own], places, n)[at] * (real & mask.T)[:, :, None]
        v[:, :, :DIM] *= word_mask.T[:, :, None]
        g = v @ p["w"] + p["b"]
        g[~real] = self.pad_inputs()[0]
        s, kept = self.states(g, keep=True)
        a, pooled, logit = self.pool(s, real)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grad = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        da = np.einsum("tnk,nk->tn", s, dp)
        de = a * (da - (a * da).sum(0))
        ds = a[:, :, None] * dp + de[:, :, None] * p["att"]
        grad["att"] = np.einsum("tn,tnk->k", de, s)
        dg = np.zeros_like(g)
        for way in (0, 1):
            u, dh, du = p[f"u{way}"], np.zeros((len(y), h), np.float32), np.zeros_like(p["u0"])
            for t, before, zr, new, hu in reversed(kept[way]):
                dh = dh + ds[t, :, way * h : (way + 1) * h]
                z, r = zr[:, :h], zr[:, h:]
                dn = dh * (1 - z) * (1 - new * new)
                dz, dr = dh * (before - new) * z * (1 - z), dn * hu * r * (1 - r)
                dg[t, :, way * 3 * h : (way + 1) * 3 * h] = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ dhu
                dh = dh * z + dhu @ u.T
            grad[f"u{way}"] = du
        dg *= real[:, :, None]
        grad["b"] = dg.sum((0, 1))
        grad["w"] = np.einsum("tnd,tng->dg", v, dg, optimize=True)
        used = real & mask.T
        dv = dg @ p["w"].T
        dv[:, :, :DIM] *= word_mask.T[:, :, None]
        dv = dv[used]
        each = np.stack([np.bincount(at[used], dv[:, k], len(own)) for k in range(2 * DIM)], axis=1)
        part = np.repeat(each[:, DIM:] / n[:, None], n, axis=0)
        grad["word"] = np.stack([np.bincount(rows[own], each[:, k], WORDS) for k in range(DIM)], axis=1).astype(np.float32)
        grad["gram"] = np.stack([np.bincount(places, part[:, k], GRAMS) for k in range(DIM)], axis=1).astype(np.float32)
        return grad


class Evidence:
    """Log odds of hashed words and n-grams, from the numbers of toxic and clean documents that have them."""

    def __init__(self, use: dict[str, np.ndarray], docs: np.ndarray) -> None:
        self.known = {k: x.sum(0) >= LEAST_DOCS for k, x in use.items()}
        odds = {k: np.log((x[1] + 1) / (docs[1] + 2)) - np.log((x[0] + 1) / (docs[0] + 2)) for k, x in use.items()}
        self.odds = {k: np.where(self.known[k], x, 0) for k, x in odds.items()}

    def of(self, rows: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each word, given features(): its own log odds and the largest of its n-grams'."""
        if not len(rows):
            return np.zeros(0)
        return self.odds["word"][rows] + np.maximum.reduceat(self.odds["gram"][flat], np.cumsum(size) - size)


def train(windows: pd.DataFrame, evidence: Evidence, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """A network from rows of doc, toxic, at and words, which hold both labels.

    Only a document is labelled, so a toxic document stands with its worst window, and half of the clean windows are
    the worst of all. First the evidence says which those are, then, again and again, the network. Words, and more often
    their word embeddings alone, are left out at random, and in toxic windows half of the words without evidence give
    way to clean ones, so that a window is not learned by heart.
    """
    windows = windows.sort_values(["doc", "at"], kind="stable").reset_index(drop=True)
    toxic, of = windows["toxic"].to_numpy() == 1, windows["doc"].to_numpy()
    net, rng = Network(seed), np.random.default_rng(seed)
    look = Lexicon()
    ids = np.zeros((len(windows), WINDOW), np.int32)
    for i, w in enumerate(windows["words"]):
        w = [look[x] for x in w.split()]
        ids[i, : len(w)] = w
    rows, flat, size = features(look.pending)
    begin = np.cumsum(size) - size
    of_word = np.append(evidence.of(rows, flat, size), -99.0)
    score = of_word[ids - 1].max(1)
    for k, some in evidence.known.items():
        net.p[k][~some] = 0
    clean = np.flatnonzero(~toxic)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))

    def all_scores() -> np.ndarray:
        cuts = [(k, k + 10_000, begin[k], (begin[k + 10_000 : k + 10_001].tolist() or [len(flat)])[0]) for k in range(0, len(rows), 10_000)]
        net.table = np.concatenate([net.pad_inputs(), *(net.vectors(rows[k:e], flat[i:j], size[k:e]) @ net.p["w"] + net.p["b"] for k, e, i, j in cuts)])
        return net.score_windows(ids)

    for step in range(1, steps + 1):
        if step > steps // 8 and step % (steps // 6) == 1:
            score = all_scores()
        if step == 1 or step % (steps // 6) == 1:
            bad = pd.DataFrame({"s": score, "of": of})[toxic].groupby("of")["s"].idxmax().to_numpy()
            hard = clean[np.argsort(-score[clean])[: max(batch, len(clean) // 40)]]
        some = np.concatenate([rng.choice(bad, batch // 4), rng.choice(clean, batch * 3 // 8), rng.choice(hard, batch * 3 // 8)])
        x, y = ids[some], toxic[some].astype(np.float32)
        other = ids[rng.choice(clean, batch)]
        x = np.where(toxic[some, None] & (rng.random(x.shape) < 0.5) & (x > 0) & (other > 0) & (of_word[x - 1] < EVIDENCE), other, x)
        grad = net.gradients(x, y, rows, flat, size, rng.random(x.shape) > 0.1, rng.random(x.shape) > 0.5)
        for k, seen in evidence.known.items():
            grad[k][~seen] = 0
        now = rate * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            change = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
            net.p[k] -= now * (change + (0.01 * net.p[k] if k in ("word", "gram") else 0))
    net.lexicon, net.table = Lexicon(), None
    return net


def least_errors(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1, half way to the next score below, or above that towards the bulk of the toxic scores."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + toxic.sum())
    k = int(f1.argmax())
    low = s[k + 1] if k + 1 < len(s) else s[k] - 1
    return float(max((s[k] + low) / 2, low + (np.quantile(score[toxic], 0.1) - low) * 0.65))


def sampled(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """doc (a number from the id), toxic, apart and text of at most so many toxic and clean labelled documents.

    They are those least by a hash of the id among ids that are not held out. An id with several labels is toxic if any
    says so, and stands once, with the first of its texts. apart marks a fifth that is not trained on.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in zip((1, 0), sample)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")  # as many ids as the sample has
    one = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return one.select(F.xxhash64("doc_id").alias("doc"), "toxic", (F.floor(number / 3) % 5 == 0).alias("apart"), "text")


def count_evidence(chosen: DataFrame) -> Evidence:
    """From the whole texts; what is collected has a row for each hashed word and n-gram at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = {"word": np.zeros((2, WORDS), np.int64), "gram": np.zeros((2, GRAMS), np.int64), "doc": np.zeros((2, 1), np.int64)}
        for batch in batches:
            for y, text in zip(batch["toxic"], batch["text"]):
                rows, flat, _ = features(list(set(words(text))))
                use["word"][y, np.unique(rows)] += 1
                use["gram"][y, np.unique(flat)] += 1
                use["doc"][y, 0] += 1
        for kind, x in use.items():
            y, at = np.nonzero(x)
            yield pd.DataFrame({"kind": kind, "toxic": y, "at": at, "n": x[y, at]})

    counted = chosen.select("toxic", "text").mapInPandas(count, "kind string, toxic int, at int, n long").groupBy("kind", "toxic", "at").agg(F.sum("n").alias("n")).toPandas()
    use = {k: np.zeros((2, n), np.int64) for k, n in (("word", WORDS), ("gram", GRAMS), ("doc", 1))}
    for kind, x in counted.groupby("kind"):
        use[kind][x["toxic"].to_numpy(), x["at"].to_numpy()] = x["n"].to_numpy()
    docs = use.pop("doc")[:, 0]
    return Evidence(use, docs)


def suspicious_windows(chosen: DataFrame, evidence: Evidence, most: int = LEARNED_WINDOWS) -> pd.DataFrame:
    """doc, toxic, at and words of up to `most` windows of each document, chosen among all its windows.

    Of a toxic document these are the windows with most evidence; of a clean one half are, the others are any.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, y, text in zip(batch["doc"], batch["toxic"], batch["text"]):
                w = words(text)
                look = Lexicon()
                ids = [look[x] for x in w]
                weight = np.append(evidence.of(*features(look.pending)), -99.0)[np.array(ids + [0] * WINDOW, np.int64) - 1]
                at = np.array(window_starts(len(w)))
                order = np.argsort(-np.lib.stride_tricks.sliding_window_view(weight, WINDOW)[at].max(1), kind="stable")
                first = most if y else most // 2
                rest = np.random.default_rng(doc & 0xFFFFFFFF).permutation(order[first:])[: most - first]
                at = np.sort(at[np.concatenate([order[:first], rest])])
                yield pd.DataFrame({"doc": doc, "toxic": y, "at": at, "words": [" ".join(w[i : i + WINDOW]) for i in at]})

    return chosen.select("doc", "toxic", "text").mapInPandas(pick, "doc long, toxic int, at int, words string").toPandas()


def scorer(net: Network):
    @F.pandas_udf(T.DoubleType())
    def rate(texts: pd.Series) -> pd.Series:
        parts = [net.score(texts.iloc[i : i + 256].tolist()) for i in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts).astype(float) if parts else [], dtype=float)

    return rate


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Network | None:
    """A network trained on the sample; None unless it has both labels.

    The bias is moved at the end so that the best cut between the scores of the documents set apart, of all their
    windows, lies at the threshold.
    """
    chosen = settle(sampled(docs, labels, sample))
    there = {(r["apart"], r["toxic"]) for r in chosen.groupBy("apart", "toxic").count().collect()}
    if len({y for _, y in there}) < 2:
        return None
    apart = {(True, 0), (True, 1), (False, 0), (False, 1)} <= there
    learned, judged = (chosen.where("not apart"), chosen.where("apart")) if apart else (chosen, chosen)
    evidence = count_evidence(learned)
    net = train(suspicious_windows(learned, evidence), evidence)
    found = judged.select("toxic", scorer(net)("text").alias("score")).toPandas()  # a number for each sampled document
    score = np.clip(found["score"].to_numpy(float), 1e-9, 1 - 1e-7)
    net.p["bias"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - least_errors(np.log(score / (1 - score)), found["toxic"].to_numpy() == 1))
    return net


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; reads doc_id and text only.

    A null text is empty; texts without words get the network's score for no evidence; texts are read whole, window by
    window. Without labels of both kinds every score is 0. Only the text goes to Python, so ids of any size and null
    ids stay as they are; a null doc_id is not held out. Repeated rows stay; no rows give no rows.
    """
    net = fit(docs, labels)
    rated = docs.select("doc_id", (scorer(net)("text") if net else F.lit(0.0)).alias("score"))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, columns as in docs; nulls, empty and long texts as in score()."""
    net = fit(docs, labels)
    return docs if net is None else docs.where(scorer(net)("text") < THRESHOLD)
