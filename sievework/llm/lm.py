"""Scores of texts by a hidden Markov model of words, learned by Baum-Welch over all training texts.

Every distinct word of the training texts is counted. A state emits one of FREQUENT + ENDINGS classes: each of the most frequent
words is a class of its own, all others share one with the words of the same ending (a hash of their last three bytes). Within
a class words have the probability (count) / (class count + 1), and the 1 is left for words that training never saw; so all words together have
probability 1. The classes bound the model's size, which every task gets (STATES numbers for each class); the counts of
words don't fit in a bound and are joined.

Long texts are cut into runs. What a run does to the states is a matrix, so numpy works on many runs at once, and the exact
vectors at their borders follow from one product for each run. A matrix costs more than the vectors do, so runs are as long as leaves enough of
them, and a text of one run needs none. Each task adds up its expected counts, Spark sums them by class, and a round ends
with new parameters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored

STATES, ROUNDS = 6, 6
#: At most so many words, each with LEAST occurrences at least, are classes of their own; so many classes hold the others.
FREQUENT, ENDINGS, LEAST = 24_576, 8_192, 5
CLASSES = FREQUENT + ENDINGS
#: Share of the corpus' class shares in every state's emissions, and of other states in the first transitions.
BACKGROUND, LEAVING = 0.05, 0.1
SEED = 7
#: Tokens of a run: so many that a batch has about RUNS of them, but no fewer than RUN and no more than LONGEST; tokens that are worked on at once.
RUN, LONGEST, RUNS, TOKENS = 128, 2_048, 2_048, 1 << 19
#: Steps between two scalings of vectors.
SCALED = 8
END = b" "
#: Bytes of text that are cut into words at once, about.
PIECE = 1 << 22


def sums(place: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sums of x by place, of n places."""
    return np.bincount(place, x, n).astype(float)


def shared_out(columns: np.ndarray) -> np.ndarray:
    """Columns scaled to the sum 1."""
    return columns / columns.sum(axis=0)


class Model(NamedTuple):
    """first: of the first state; move: of the next state by state; emit: of a class by state (classes x states)."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, and the end."""
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id's decimal text modulo folds is fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


class Words(NamedTuple):
    """The words of several texts. named: distinct ones, the last is END; at: the place in named of each token; sizes: tokens by text."""

    named: pa.Array
    at: np.ndarray
    sizes: np.ndarray


def cut(texts: pa.Array) -> Words:
    """What words() gives for each text, with Arrow's hash table for distinct words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    named, at, sizes = coded.dictionary, coded.indices.to_numpy(), np.diff(parts.offsets.to_numpy())
    full = pc.binary_length(named).to_numpy() > 0  # white space at a text's ends leaves an empty part
    if not full.all():
        real = full[at]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        named, at = named.filter(pa.array(full)), (np.cumsum(full) - 1)[at[real]]
    at = np.insert(at, np.cumsum(sizes), len(named))
    return Words(pa.concat_arrays([named.cast(pa.binary()), pa.array([END], pa.binary())]), at, sizes + 1)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (column text), as many at a time as have about PIECE bytes of text."""
    upto, begin = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PIECE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes) and n over all texts (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                w = cut(piece.column("text"))
                yield pa.RecordBatch.from_arrays([w.named, pa.array(np.bincount(w.at, minlength=len(w.named)), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-3:]) % ENDINGS


def crc_table() -> np.ndarray:
    """The CRC-32 of each byte, before and after the inversions: what a step of it looks up."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def endings(named: pa.Array) -> np.ndarray:
    """ending() of each word."""
    if not len(named):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(named.buffers()[1], np.int32, len(named) + 1, named.offset * 4)
    data, table = np.frombuffer(named.buffers()[2] or b"", np.uint8), crc_table()
    size, crc = np.minimum(np.diff(offsets), 3), np.full(len(named), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        has = np.flatnonzero(size >= k)
        crc[has] = table[(crc[has] ^ data[offsets[1:][has] - k]) & 0xFF] ^ (crc[has] >> 8)
    return FREQUENT + (~crc % ENDINGS).astype(np.int64)


class Classes(NamedTuple):
    """Frequent words with their counts, in order, the counts of all classes, and the numbers of tokens and distinct words."""

    frequent: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int

    def shares(self) -> np.ndarray:
        """Shares of classes, with one unseen word for each ending."""
        shares = self.counts.astype(float)
        shares[FREQUENT:] += 1
        return shares / shares.sum()


def least_count(counts: DataFrame, most: int) -> int:
    """A count that at least `most` words have, or all with LEAST; seldom many more, as counts are graded in steps of 4 %."""
    graded = counts.where(F.col("n") >= LEAST).groupBy(F.floor(F.log2("n") * 16).alias("grade")).agg(F.count("*").alias("m"), F.min("n").alias("n"))
    least, found = LEAST, 0
    for _, m, n in sorted(graded.collect(), reverse=True):
        least, found = n, found + m
        if found >= most:
            break
    return least


def word_classes(counts: DataFrame) -> Classes:
    """Reads FREQUENT words and ENDINGS sums at most to the driver; each task gives it the words that may be among them, so words below their counts are left out first."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("n") >= least_count(counts, FREQUENT)).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    table = np.zeros(CLASSES, dtype=np.int64)
    by_ending = F.crc32(F.substring("word", -3, 3)) % ENDINGS
    for e, n in counts.groupBy(by_ending.alias("e")).agg(F.sum("n")).collect():
        table[FREQUENT + e] = n
    for k, (word, n) in enumerate(top):
        table[k] = n
        table[ending(bytes(word))] -= n
    return Classes([bytes(r["word"]) for r in top], table, tokens, distinct)


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, within double, classes binary, rare array<binary>, times array<int>"


def encoded(docs: DataFrame, held: Column, known: Classes) -> DataFrame:
    """Texts (doc_id, text) as packed classes, with what the frequent words give, and the other words with how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, tokens, distinct = shared.value
        frequent, names = pa.array(frequent, pa.binary()), [x.split()[0] for x in ENCODED.split(", ")]
        base = np.log10((counts + 1) / (tokens + distinct + 1))
        inner = -np.log10(np.maximum(counts, 0) + 1.0)
        for piece in (p for batch in batches for p in pieces(batch)):
            w, n = cut(piece.column("text")), piece.num_rows
            place = pc.fill_null(pc.index_in(w.named, value_set=frequent), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.where(place < 0, endings(w.named), place)
            text, at = np.repeat(np.arange(n), w.sizes), place[w.at]
            others = at >= FREQUENT
            mine, both = text[~others], np.sort(text[others] * len(w.named) + w.at[others])
            new = np.flatnonzero(np.diff(both, prepend=-1))
            in_text, word = np.divmod(both[new], len(w.named))
            upto = pa.array(np.searchsorted(in_text, np.arange(n + 1)), pa.int32())
            packed = np.ascontiguousarray(at.astype("<u2"))
            borders = np.concatenate([[0], 2 * np.cumsum(w.sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(piece.column(c) for c in ("row", "doc_id", "held_out")),
                    pa.array(w.sizes, pa.int64()), pa.array(np.bincount(mine, minlength=n), pa.int64()),
                    pa.array(sums(mine, base[at[~others]], n)), pa.array(sums(text[others], inner[at[others]], n)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(borders), pa.py_buffer(packed)]),
                    pa.ListArray.from_arrays(upto, w.named.take(pa.array(word))),
                    pa.ListArray.from_arrays(upto, pa.array(np.diff(new, append=len(both)), pa.int32())),
                ],
                names,
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    return rows.mapInArrow(encode, ENCODED)


def unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u2") for x in column]


class Runs:
    """The runs of several texts with the exact vectors at their borders. A row of an array is a state, a column a run or a token.

    pred: probabilities of the state before a run's first token is seen; rest: how likely what follows the run is, by the state
    that would come next (up to a factor). Emissions are divided by their class' mean, so that SCALED steps stay far from what
    single precision can hold.
    """

    def __init__(self, texts: list[np.ndarray], model: Model, backward: bool) -> None:
        self.lengths = lengths = np.array([len(x) for x in texts])
        self.x, self.model, self.forth = np.concatenate(texts), model, np.ascontiguousarray(model.move.T)
        self.mean = np.maximum(model.emit.mean(axis=1), 1e-300)
        self.even = np.ascontiguousarray(model.emit.T) / self.mean
        run = int(np.clip(lengths.sum() // RUNS, RUN, LONGEST))
        n = -(-lengths // run)
        first = np.cumsum(n) - n
        self.text = np.repeat(np.arange(len(texts)), n)
        inside = np.arange(n.sum()) - first[self.text]
        self.start = (np.cumsum(lengths) - lengths)[self.text] + inside * run
        self.size = np.minimum(run, lengths[self.text] - inside * run)
        self.opens, self.ends = inside == 0, inside == n[self.text] - 1
        k = len(model.first)
        self.pred, self.rest = np.tile(model.first[:, None], len(self.text)), np.ones((k, len(self.text)))
        several = ~(self.opens & self.ends)
        if not several.any():
            return
        matrix = np.zeros((k, k, len(self.text)))
        for runs in self.slices(np.flatnonzero(several)):
            matrix[:, :, runs] = self.effect(runs)
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        for j in range(1, n[0]):
            here = first[: np.searchsorted(-n, -j)] + j
            self.pred[:, here] = shared_out(np.einsum("kn,kln->ln", self.pred[:, here - 1], matrix[:, :, here - 1]))
        for j in range(n[0] - 1, 0, -1) if backward else ():
            here = first[: np.searchsorted(-n, -j)] + j
            self.rest[:, here - 1] = shared_out(np.einsum("kln,ln->kn", matrix[:, :, here], self.rest[:, here]))

    def slices(self, runs: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """All runs, or these, from the longest to the shortest, as many at a time as have about TOKENS tokens."""
        runs = np.arange(len(self.text)) if runs is None else runs
        runs = runs[np.argsort(-self.size[runs], kind="stable")]
        upto, begin = np.cumsum(self.size[runs]), 0
        while begin < len(runs):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + TOKENS)))
            yield runs[begin:end]
            begin = end

    def steps(self, runs: np.ndarray) -> Iterator[np.ndarray]:
        """The classes of the runs' first tokens, of their second ones, and so on; runs go from the longest to the shortest."""
        start, size = self.start[runs], self.size[runs]
        for t, n in enumerate(np.searchsorted(-size, -np.arange(size[0])).tolist()):
            yield self.x[start[:n] + t].astype(np.intp)

    def effect(self, runs: np.ndarray) -> np.ndarray:
        """For each run the matrix from the state before its first token to the one after its last, up to a factor."""
        k, forth, even = len(self.model.first), self.forth.astype(np.float32), self.even.astype(np.float32)
        m = np.tile(np.eye(k, dtype=np.float32)[:, :, None], len(runs))
        for t, x in enumerate(self.steps(runs)):
            m[:, :, : len(x)] = forth @ (m[:, :, : len(x)] * even.take(x, axis=1))
            if t % SCALED == SCALED - 1:
                m[:, :, : len(x)] /= m[:, :, : len(x)].sum(axis=(0, 1))
        return m

    def log10(self) -> np.ndarray:
        """The logarithm of each text's probability: the scaled forward recursion's factors."""
        out = np.add.reduceat(np.log10(self.mean)[self.x], np.cumsum(self.lengths) - self.lengths)
        for runs in self.slices():
            p, logs, size = self.pred[:, runs], np.zeros(len(runs)), self.size[runs]
            for t, x in enumerate(self.steps(runs)):
                f = p[:, : len(x)] * self.even.take(x, axis=1)
                left = len(x) if t % SCALED == SCALED - 1 else int(size[len(x) - 1] == t + 1) and len(x) - int(np.searchsorted(-size, -t - 1))
                if left:  # all runs, or those that end here
                    s = f[:, -left:].sum(axis=0)
                    logs[len(x) - left : len(x)] += np.log10(s)
                    f[:, -left:] /= s
                p = self.forth @ f
            np.add.at(out, self.text[runs], logs)
        return out

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected numbers of first states, moves, and emissions (classes x states)."""
        k = len(self.model.first)
        first, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(self.model.emit.shape)
        for runs in self.slices():
            p, held = self.pred[:, runs], []
            for t, x in enumerate(self.steps(runs)):
                f = p[:, : len(x)] * self.even.take(x, axis=1)
                if t % SCALED == SCALED - 1:
                    f /= f.sum(axis=0)
                held.append((x, f))
                p = self.forth @ f
            rest, size, ends = self.rest[:, runs], self.size[runs], self.ends[runs]
            seen, upto = np.empty((k, size.sum())), size.sum()
            for t in range(len(held) - 1, -1, -1):
                x, f = held[t]
                n, after = len(x), rest[:, : len(x)]
                back = self.model.move @ after
                state = f * back
                weight = 1 / state.sum(axis=0)
                np.multiply(state, weight, out=seen[:, upto - n : upto])
                upto -= n
                if size[n - 1] == t + 1:  # no move follows a text's last token
                    weight[(size[:n] == t + 1) & ends[:n]] = 0
                move += (f * weight) @ after.T
                rest[:, :n] = self.even.take(x, axis=1) * back
                if t % SCALED == 0:
                    rest[:, :n] /= rest[:, :n].sum(axis=0)
            first += seen[:, : len(runs)][:, self.opens[runs]].sum(axis=1)
            x = np.concatenate([h[0] for h in held])
            for j in range(k):
                emit[:, j] += np.bincount(x, seen[j], minlength=len(emit))
        return first, move * self.model.move, emit


def start(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First parameters: states differ by fixed random factors and are seldom left."""
    e = shares[:, None] * np.exp(2 * np.random.default_rng(SEED).standard_normal((len(shares), STATES)))
    move = np.full((STATES, STATES), LEAVING / (STATES - 1))
    np.fill_diagonal(move, 1 - LEAVING)
    return np.full(STATES, 1 / STATES), move, e / e.sum(axis=0)


def learn(packed: DataFrame, shares: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of packed (classes). A state's emissions are its own ones mixed with the corpus' shares."""
    first, move, own = start(shares)
    sc = packed.sparkSession.sparkContext
    schema = f"at int, {', '.join(f's{j} double' for j in range(STATES))}"

    def mixed() -> Model:
        return Model(first, move, (1 - BACKGROUND) * own + BACKGROUND * shares[:, None])

    for _ in range(rounds):
        model = mixed()
        shared = sc.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 + STATES + CLASSES, STATES))
            for batch in batches:
                if batch.num_rows:
                    f, m, e = Runs(unpacked(batch.column("classes")), shared.value, True).expected()
                    total += np.vstack([f, m, e])
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, j]) for j in range(STATES))], ["at", *(f"s{j}" for j in range(STATES))])

        sums = packed.select("classes").mapInArrow(expect, schema).groupBy("at").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(STATES)])
        total = np.zeros((1 + STATES + CLASSES, STATES))
        for row in sums.collect():
            total[row["at"]] = row[1:]
        first, move = (total[0] + 1) / (total[0] + 1).sum(), total[1 : 1 + STATES] + 1
        move /= move.sum(axis=1, keepdims=True)
        weight = total[1 + STATES :].sum(axis=0) / max(total[1 + STATES :].sum(), 1)
        gained = total[1 + STATES :] * (1 - BACKGROUND) * own / np.where(model.emit > 0, model.emit, 1)  # the part that the state's own emissions take
        gained[FREQUENT:] += weight  # the unseen word of each ending is dealt to the states as all tokens are
        own = np.where(gained.sum(axis=0) > 0, gained / np.maximum(gained.sum(axis=0), 1e-300), own)
        shared.unpersist()
    return mixed()


def chain_scores(packed: DataFrame, model: Model) -> DataFrame:
    """packed without its words, and the logarithm of the probability of its classes."""
    shared = packed.sparkSession.sparkContext.broadcast(model)
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "within"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = Runs(unpacked(batch.column("classes")), shared.value, False).log10() if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(logs)], [*kept, "chain"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, within double, chain double"
    return packed.select(*kept, "classes").mapInArrow(score, schema)


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Reads doc_id and text and ignores other columns. A null text is empty: its one token is the end. A null id is in training.
    Rows with repeated ids or texts are scored, and learned from, one by one. No rows give no rows; without training rows
    every word is unseen: base_score is 0 and score is that of the model before learning. base_score is that of single words with one added to each count; score is the model's,
    both as logarithms to the base 10.
    """
    held = held_out(F.col("doc_id"))
    counts = stored(word_counts(docs.where(~held)))
    known = word_classes(counts)
    rows = stored(encoded(docs, held, known))
    model = learn(rows.where("not held_out"), known.shares(), rounds)

    each = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    n, everything = F.coalesce("n", F.lit(0)), float(known.tokens + known.distinct + 1)
    rare = each.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((n + 1) / everything)).alias("rare_base"),
        F.sum(F.col("times") * F.log10(F.greatest(n, F.lit(1)).cast("double"))).alias("rare_within"),
    )
    both = chain_scores(rows, model).join(rare, "row", "left").fillna(0, ["known", "rare_base", "rare_within"])
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.col("known")).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"), (F.col("chain") + F.col("within") + F.col("rare_within")).alias("score"),
    )
