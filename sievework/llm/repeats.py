"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A suffix matters to a depth of 50 bytes only, and only if those 50 bytes start in two documents. The passes go from the
most significant digit on, and suffixes that are alone in their group leave:

1. The first digit is the 20-byte string with the least hash among the 31 that lie in the window of 50 bytes. Equal
   windows have equal first digits at equal places, so digits need to be sorted, not suffixes: about one for 15 bytes.
   Four bytes of hash for each go to buckets; a digit that only one document has is done.
2. Neighbouring windows with one first digit go on together, as a run of 50 to 80 bytes. In a bucket equal runs fall
   together with the smallest doc_id they have. If a digit has one run only, its windows are settled.
3. The rest is sorted window by window, eight bytes a pass, to a depth of 50. Equal groups are the repeated windows.

Texts travel as compressed chunks with a number of their own, and what a bucket has found goes back to the chunk as
bits, so no document is looked up one by one and a passage that all documents share costs a bucket one entry a chunk.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import settle

DEPTH, DIGIT = 50, 20
TURNS = DEPTH - DIGIT + 1
RUN = DEPTH + TURNS - 1
#: Bytes of text in a chunk and, about, behind a bucket.
CHUNK, BUCKET = 8 << 20, 16 << 20
STEP, PLACE = 1 << 16, (1 << 20) - 1
U = np.uint64
BASE, MIX, MIX2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
POWER = {n: U(pow(BASE, n, 1 << 64)) for n in (1, 2, 4, 8)}
LAST = np.iinfo(np.int64).max
ENTRY = np.dtype((np.void, 10 + RUN))


def pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes(), 3)


def unpack(x: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def digits(part: np.ndarray) -> np.ndarray:
    """A hash of the 20 bytes from each place on."""
    h1 = part.astype(np.uint64) + U(1)
    h2 = h1[:-1] * POWER[1] + h1[1:]
    h4 = h2[:-2] * POWER[2] + h2[2:]
    h8 = h4[:-4] * POWER[4] + h4[4:]
    h = h8[:-8] * POWER[8] + h8[8:]
    h = h[:-4] * POWER[4] + h4[16:]
    h ^= h >> U(32)
    h *= U(MIX)
    h ^= h >> U(29)
    return h


def runs(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(low, high, doc, at, hash) of each run: its first and last window, its document, its digit's place and hash."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    found = []
    for b in range(0, len(text) - DEPTH + 1, STEP):
        n = min(STEP, len(text) - DEPTH + 1 - b)
        h = digits(text[b : b + n + DEPTH - 1])
        k = (h & ~U(PLACE)) | np.arange(len(h), dtype=np.uint64)
        for s in (1, 2, 4, 8):
            k = np.minimum(k[:-s], k[s:])
        k = np.minimum(k[: -(TURNS - 16)], k[TURNS - 16 :])
        at = (k & U(PLACE)).astype(np.int64)
        own = starts[np.searchsorted(starts, b) : np.searchsorted(starts, b + n)] - b
        cut = np.unique(np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, own]))
        found.append((cut + b, np.append(cut[1:], n) - 1 + b, at[cut] + b, h[at[cut]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    low, high, at, h = (np.concatenate(x) for x in zip(*found))
    doc = np.searchsorted(starts, low, "right") - 1
    doc = np.where(ends[doc] > low, doc, np.searchsorted(ends, low, "right"))
    high = np.minimum(high, ends[doc] - DEPTH)
    ok = high >= low
    return low[ok], high[ok], doc[ok], at[ok], h[ok]


def in_buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper half, four bytes of hash in the lower."""
    h = h * U(MIX2)
    h ^= h >> U(31)
    return (((h >> U(32)) * U(buckets)) >> U(32) << U(32)) | (h & U(0xFFFFFFFF))


def by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << U(32))


def first_digits(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and whether more than one document has them."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[new], np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new) if len(k) else np.zeros(0, bool)


class Chunk:
    """The runs of a chunk's text, and after narrow() its entries: the different runs whose first digit is repeated.

    For comparisons a null id is the largest number; `free` is a number that no document has, and ids above it move down
    by one to make room, so that the largest id and null stay two.
    """

    def __init__(self, row: dict, buckets: int, free: int) -> None:
        self.text, self.own_ids, self.none = unpack(row["text"]), unpack(row["ids"], np.int64), unpack(row["none"], bool)
        self.ends, self.buckets = unpack(row["ends"], np.int64), buckets
        self.ids = np.where(self.none, LAST, self.own_ids - (self.own_ids > free))
        self.low, self.high, self.doc, at, h = runs(self.text, self.ends)
        self.key, self.place = in_buckets(h, buckets), at - self.low

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        return first_digits(self.key, self.ids[self.doc])

    def narrow(self, bits: dict[int, bytes]) -> None:
        keys = np.unique(self.key)
        cuts, again = by_bucket(keys, self.buckets), np.zeros(len(keys), bool)
        for b, x in bits.items():
            again[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=cuts[b + 1] - cuts[b])
        keep = again[np.searchsorted(keys, self.key)]
        self.low, self.high, self.doc, self.key, self.place = (x[keep] for x in (self.low, self.high, self.doc, self.key, self.place))
        rows = np.zeros((len(self.low), 10 + RUN), np.uint8)
        rows[:, :8] = self.key.astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 8], rows[:, 9] = self.place, self.high - self.low
        step = np.arange(RUN)
        for i in range(0, len(rows), STEP):
            low, size = self.low[i : i + STEP, None], (self.high - self.low)[i : i + STEP, None] + DEPTH
            rows[i : i + STEP, 10:] = np.where(step < size, self.text[np.minimum(low + step, len(self.text) - 1)], 0)
        self.entries, self.entry = np.unique(rows.view(ENTRY).ravel(), return_inverse=True)
        self.least = np.full(len(self.entries), LAST)
        np.minimum.at(self.least, self.entry, self.ids[self.doc])
        head = np.ascontiguousarray(self.entries.view(np.uint8).reshape(-1, 10 + RUN)[:, :8]).view(">u8").ravel().astype(np.uint64)
        self.cuts = by_bucket(head, self.buckets)

    def removed(self, masks: dict[int, np.ndarray]) -> np.ndarray:
        """Whether each byte lies in a window that starts in a smaller document too."""
        mask = np.zeros(len(self.entries), np.uint32)
        for b, x in masks.items():
            mask[self.cuts[b] : self.cuts[b + 1]] = x
        own = np.where(self.ids[self.doc] > self.least[self.entry], np.uint32(0xFFFFFFFF), mask[self.entry])
        start = np.zeros(len(self.text) + 1, np.int32)
        for a in range(TURNS):
            hit = ((own >> np.uint32(a)) & np.uint32(1)).astype(bool) & (self.low + a <= self.high)
            start[self.low[hit] + a] = 1
        upto = np.cumsum(start[:-1], dtype=np.int64)
        upto[DEPTH:] -= upto[:-DEPTH].copy()
        return upto > 0


def windows_least(runs_of: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest document of every window of every different run, runs in order: one row for each run."""
    best = np.repeat(least[:, None], TURNS, 1)
    head = np.ascontiguousarray(runs_of[:, 4:8]).view(">u4").ravel()
    new = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    size = np.diff(np.append(new, len(head)))
    many = np.flatnonzero(np.repeat(size > 1, size))
    turns = runs_of[many, 9].astype(np.int64) + 1
    run = np.repeat(many, turns)
    turn = np.arange(len(run)) - np.repeat(np.cumsum(turns) - turns, turns)
    group = head[run].astype(np.int64)
    flat, width = runs_of.ravel(), runs_of.shape[1]
    for d in range(0, DEPTH, 8):
        at = run * width + 10 + turn + d
        word = np.zeros(len(run), np.uint64)
        for i in range(min(8, DEPTH - d)):
            word = (word << U(8)) | flat[at + i].astype(np.uint64)
        order = np.lexsort((word, group))
        run, turn, word, group = run[order], turn[order], word[order], group[order]
        if not len(run):
            return best
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        group = np.cumsum(new)
        alone = np.concatenate([new[1:], [True]]) & new
        run, turn, group = run[~alone], turn[~alone], group[~alone]
    if len(run):
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        small = np.minimum.reduceat(least[run], new)
        best[run, turn] = np.repeat(small, np.diff(np.append(new, len(run))))
    return best


def into_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts, ids, none, held = [], [], [], 0

    def row() -> pd.DataFrame:
        ends, of = np.cumsum([len(t) for t in texts], dtype=np.int64), np.array(ids, np.int64)
        return pd.DataFrame({"text": [pack(b"".join(texts))], "ids": [pack(of)], "none": [pack(np.array(none, bool))], "ends": [pack(ends)], "size": [held], "last": [bool((of == LAST).any())]})

    for batch in batches:
        for i, n, t in zip(batch["doc_id"], batch["none"], batch["text"]):
            texts.append(t or b"")
            ids.append(i)
            none.append(n)
            held += len(texts[-1])
            if held >= CHUNK:
                yield row()
                texts, ids, none, held = [], [], [], 0
    if ids:
        yield row()


def free_id(chunks: DataFrame) -> int:
    """A number that no document has: the smallest, or the first of a fixed sequence."""

    def has(i: int) -> bool:
        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"has": [bool((unpack(x, np.int64) == i).any()) for x in batch["ids"]]})

        return bool(chunks.select("ids").mapInPandas(look, "has boolean").agg(F.max("has")).first()[0])

    rng = np.random.default_rng(0)
    return next(i for i in itertools.chain([-LAST - 1], (int(x) for x in iter(lambda: rng.integers(-LAST, LAST), None))) if not has(i))


def repeated_digits(g: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: a bit for each digit of each chunk, whether another document has it."""
    parts = [np.frombuffer(x, np.uint32) for x in g["keys"]]
    key = np.concatenate(parts)
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(g["many"], parts)])
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(new, len(k)))
    again = np.empty(len(k), bool)
    again[order] = np.repeat((size > 1) | (np.maximum.reduceat(many[order], new) > 0), size)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pd.DataFrame({"chunk": g["chunk"], "bucket": g["bucket"], "bits": [np.packbits(x).tobytes() for x in np.split(again, cuts)]})


def settled_runs(g: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: a bit for each window of each entry of each chunk, whether a smaller document has it."""
    parts = [unpack(x).reshape(-1, 10 + RUN) for x in g["entries"]]
    docs = np.concatenate([unpack(x, np.int64) for x in g["least"]])
    rows = np.concatenate(parts)
    different, which = np.unique(rows.view(ENTRY).ravel(), return_inverse=True)
    least = np.full(len(different), LAST)
    np.minimum.at(least, which, docs)
    masks = np.zeros(len(rows), np.uint32)
    if len(rows):
        best = windows_least(different.view(np.uint8).reshape(-1, 10 + RUN), least)
        for i in range(0, len(rows), STEP):
            small = best[which[i : i + STEP]] < docs[i : i + STEP, None]
            masks[i : i + STEP] = (small.astype(np.uint32) << np.arange(TURNS, dtype=np.uint32)).sum(1, dtype=np.uint32)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pd.DataFrame({"chunk": g["chunk"], "bucket": g["bucket"], "bits": g["bits"], "masks": [pack(x) for x in np.split(masks, cuts)]})


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.iloc[i].to_dict()


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept for every row of docs; kept is what remains, as bytes.

    with_text=False leaves kept null.

    Reads doc_id and text, whole. Each byte goes that a 50-byte string covers which also starts in a document with a
    smaller doc_id; strings are judged on the input. A null text is empty. Rows with equal doc_id do not count against
    one another, and a null doc_id is larger than any other. A document is never cut, so a task needs some 12 bytes of
    memory for each byte of the longest one. No rows give no rows.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("none"), F.col("text").cast("binary").alias("text"))
    chunks = rows.mapInPandas(into_chunks, "text binary, ids binary, none binary, ends binary, size long, last boolean")
    chunks = settle(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    total, last = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("last"), F.lit(False))).first()
    buckets = max(1, -(-total // BUCKET))
    free = free_id(chunks) if last else LAST

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in rows_of(batches):
            key, many = Chunk(row, buckets, free).first()
            cuts = by_bucket(key, buckets)
            own = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            cut = [slice(cuts[b], cuts[b + 1]) for b in own]
            yield pd.DataFrame({"chunk": row["chunk"], "bucket": own, "keys": [key[c].astype(np.uint32).tobytes() for c in cut], "many": [np.packbits(many[c]).tobytes() for c in cut]})

    keys = chunks.mapInPandas(first, "chunk long, bucket long, keys binary, many binary")
    bits = settle(keys.groupBy("bucket").applyInPandas(repeated_digits, "chunk long, bucket long, bits binary"))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in rows_of(batches):
            c = Chunk(row, buckets, free)
            bits = {x["bucket"]: x["bits"] for x in row["found"]}
            c.narrow(bits)
            cut = {b: slice(c.cuts[b], c.cuts[b + 1]) for b in bits}
            yield pd.DataFrame({"chunk": row["chunk"], "bucket": list(bits), "bits": list(bits.values()), "entries": [pack(c.entries[x]) for x in cut.values()], "least": [pack(c.least[x]) for x in cut.values()]})

    back = bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))
    entries = chunks.join(back, "chunk").mapInPandas(second, "chunk long, bucket long, bits binary, entries binary, least binary")
    masks = settle(entries.groupBy("bucket").applyInPandas(settled_runs, "chunk long, bucket long, bits binary, masks binary"))

    def third(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in rows_of(batches):
            c = Chunk(row, buckets, free)
            found = row["found"] if row["found"] is not None else []
            c.narrow({x["bucket"]: x["bits"] for x in found})
            gone = c.removed({x["bucket"]: unpack(x["masks"], np.uint32) for x in found})
            out = []
            for i, none, s, e in zip(c.own_ids.tolist(), c.none, np.concatenate([[0], c.ends[:-1]]), c.ends):
                g = gone[s:e]
                kept = c.text[s:e][~g].tobytes()
                out.append((None if none else i, e - s, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            found = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield found.assign(doc_id=pd.array([x[0] for x in out], "Int64"))

    back = masks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits", "masks")).alias("found"))
    return chunks.join(back, "chunk", "left").mapInPandas(third, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
