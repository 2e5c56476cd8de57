"""SimHash near-duplicates by tiled exact comparison of fingerprints.

near_duplicates() links fingerprints of three-word shingles. keep_one(), for corpora, works on five-word shingles: a
wider radius gives candidates, and a link is a similarity (Jaccard) of 0.8 or more of whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import broadcast_if, components, in_groups, settle

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints in a tile, about.
TILE = 4096
#: From this many fingerprints on, tiles go by the population counts of quarters, below by those of halves.
QUARTERS_FROM = 2_000_000
STEP = 65_536
#: Of keep_one(): words in a shingle, least similarity, and the bits in which the 64 that tiles compare, and all 128 that
#: confirm, may differ. Two texts of just SIMILAR differ in 9.7 of 64 bits, standard deviation 2.9.
NEAR_SHINGLE, SIMILAR, NEAR_RADIUS, CONFIRM_RADIUS = 5, 0.8, 16, 29
#: Population counts in one class of tiles; texts of a group whose shingles are compared in one piece, about.
COUNTS, BLOCK = 8, 256
KNOWN_WORDS = 300_000


def shingles(text: str | None, n: int = SHINGLE) -> list[bytes]:
    """Every run of n words, A-Z in lower case, joined by a space; a shorter text is one shingle, an empty one none."""
    w = (text or "").encode().lower().split()
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(n)))] if len(w) >= n else [b" ".join(w)][: len(w)]


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number: a bit is 1 if it is set in over half of the shingles' hashes."""
    parts = shingles(text)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(parts), STEP):
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts[i : i + STEP]), "<u8", min(STEP, len(parts) - i))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes 0 to n - 1 with the same components as the links u, v, at most one for each node."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links (at most one for each fingerprint) with the components of all pairs of a and b within the radius."""
    us, vs, held = [], [], 0
    for i in range(0, len(a), rows):
        near = np.bitwise_count(a[i : i + rows, None] ^ b[None, :]) <= radius
        if near.any():
            u, v = np.nonzero(near)
            us, vs, held = [*us, u + i], [*vs, v + len(a)], held + len(u)
            if held > 1 << 20:
                u, v = spanning(np.concatenate(us), np.concatenate(vs), len(a) + len(b))
                us, vs, held = [u], [v], len(u)
    both = np.concatenate([a, b])
    u, v = spanning(np.concatenate(us), np.concatenate(vs), len(both)) if us else (np.zeros(0, int), np.zeros(0, int))
    return both[u], both[v]


def meet_tiles(coded: DataFrame, payload: list[str], others: Column, tile: int) -> DataFrame:
    """Columns left and right: the payload of every pair of tiles that meet, once, as flat arrays of numbers.

    coded has cls, id and the payload. A class with many rows is cut into tiles by a hash of id, so a tile's size is
    bounded. others is the array of the classes (itself among them), none before it, that a class meets.
    """
    classes = settle(coded.groupBy("cls").agg(F.ceil(F.count("*") / tile).alias("tiles")))
    tiles = coded.join(broadcast_if(classes), "cls").withColumn("k", F.pmod(F.xxhash64("id"), F.col("tiles")))
    held = F.collect_list(payload[0]) if len(payload) == 1 else F.flatten(F.collect_list(F.array(*payload)))
    tiles = settle(tiles.groupBy("cls", "k").agg(held.alias("held")))
    pairs = classes.select("cls", "tiles", F.explode(others).alias("cls2"))
    pairs = pairs.join(classes.select(F.col("cls").alias("cls2"), F.col("tiles").alias("tiles2")), "cls2")
    pairs = pairs.select("cls", "cls2", "tiles2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("k"))
    pairs = pairs.select("cls", "k", "cls2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles2") - 1)).alias("k2"))
    left = pairs.where("cls <> cls2 or k <= k2").join(tiles.select("cls", "k", F.col("held").alias("left")), ["cls", "k"])
    right = tiles.select(F.col("cls").alias("cls2"), F.col("k").alias("k2"), F.col("held").alias("right"))
    return left.join(right, ["cls2", "k2"]).select("left", "right")


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, quarters_from: int = QUARTERS_FROM) -> DataFrame:
    """Columns a and b: links whose components are those of all pairs of distinct fingerprints (column fp) within radius.

    Population counts of 2 halves (or 4 quarters) differ in sum by no more than the bits do, so tiles hold fingerprints
    with equal counts, and a tile meets only tiles whose counts are within the radius; all others are skipped. No pairs
    leave a comparison: it gives back at most one link for each fingerprint.
    """
    parts = 4 if fps.count() >= quarters_from else 2
    width = 64 // parts
    base = width + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))) for i in range(parts)]
    code = sum((c * base**i for i, c in enumerate(counts)), F.lit(0))
    offsets = [o for o in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, o)) <= radius and o[::-1] >= (0,) * parts]
    digit = [F.pmod(F.floor(F.col("cls") / base**i), F.lit(base)) for i in range(parts)]
    inside = [
        F.when(sum(((d + o).between(0, width).cast("int") for d, o in zip(digit, off)), F.lit(0)) == parts, F.col("cls") + sum(o * base**i for i, o in enumerate(off)))
        for off in offsets
    ]
    met = meet_tiles(fps.select("fp", F.col("fp").alias("id"), code.cast("long").alias("cls")), ["fp"], F.array_compact(F.array(*inside)), tile)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["left"], batch["right"]):
                u, v = compare_tiles(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius)
                yield pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})

    return met.mapInPandas(meet, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of docs; reads doc_id and text only.

    Texts are read whole. A null text is empty, and texts without words have fingerprint zero, linked like any other.
    Equal fingerprints are one node, whatever the size of their group; component_id is the smallest doc_id that links
    of at most `radius` bits reach. Repeated rows stay; no rows give no rows.
    """
    rows = settle(docs.select("doc_id", fingerprints("text").alias("fp")))
    reps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = components(near_links(reps.select("fp"), radius))
    linked = linked.union(linked.select("component", "component").distinct()).select(F.col("node").alias("fp"), "component")
    least = linked.join(reps, "fp").groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("fp", "least")
    named = settle(reps.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class Words(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, known: Words) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; a shorter text is one shingle, one without words none."""
    w = (text or "").encode().lower().split()
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = min(NEAR_SHINGLE, len(h))
    if len(known) > KNOWN_WORDS:
        known.clear()
    out = np.full(len(h) - n + 1 if n else 0, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def majority(h: np.ndarray) -> int:
    """64 bits: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), STEP):
        ones += np.unpackbits(h[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.StructType([T.StructField(k, T.BinaryType() if k == "th" else T.LongType()) for k in ("fp", "fp2", "n", "th")]))
def near_prints(texts: pd.Series) -> pd.DataFrame:
    """Two fingerprints of the set of shingles, its size, and a 128-bit hash of the words in order."""
    known, out = Words(), []
    for x in texts:
        s = shingle_set(x, known)
        other = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((majority(s), majority(other ^ (other >> np.uint64(32))), len(s), xxhash.xxh3_128_digest(b" ".join((x or "").encode().lower().split()))))
    return pd.DataFrame(out, columns=["fp", "fp2", "n", "th"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: pd.Series) -> pd.Series:
    known = Words()
    return pd.Series([shingle_set(x, known).view(np.int64) for x in texts])


def compare_prints(a: np.ndarray, b: np.ndarray, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links (at most one for each text) that span the candidates of two tiles; columns fp, fp2, n and node."""
    us, vs, node = np.zeros(0, int), np.zeros(0, int), np.concatenate([a[:, 3], b[:, 3]])
    x, y = (np.ascontiguousarray(t[:, :2]).view(np.uint64) for t in (a, b))
    for i in range(0, len(a), rows):
        u, v = np.nonzero(np.bitwise_count(x[i : i + rows, :1] ^ y[:, 0]) <= NEAR_RADIUS)
        u += i
        off = np.bitwise_count(x[u] ^ y[v]).sum(1, dtype=np.int64)
        m, n = a[u, 2], b[v, 2]
        ok = (off <= CONFIRM_RADIUS) & (np.minimum(m, n) >= SIMILAR * np.maximum(m, n)) & (a[u, 3] != b[v, 3])
        us, vs = np.concatenate([us, u[ok]]), np.concatenate([vs, v[ok] + len(a)])
        if len(us) > 1 << 20:
            us, vs = spanning(us, vs, len(node))
    us, vs = spanning(us, vs, len(node))
    return node[us], node[vs]


def candidates(texts: DataFrame, tile: int = TILE) -> DataFrame:
    """Columns a and b: links whose components hold all pairs of texts (node, fp, fp2, n) that can be near.

    A class of tiles has set sizes within one band, a factor of 1 / SIMILAR wide, and population counts within COUNTS of
    one another; it meets its own and the neighbouring band, and counts that can be within NEAR_RADIUS.
    """
    band = F.floor(F.log("n") / float(-np.log(SIMILAR)))
    code = band * 16 + F.floor(F.bit_count("fp") / COUNTS)
    most = (NEAR_RADIUS - 1) // COUNTS + 1
    steps = [(0, k) for k in range(most + 1)] + [(1, k) for k in range(-most, most + 1)]
    met = meet_tiles(
        texts.where("n > 0").select("fp", "fp2", "n", "node", F.col("node").alias("id"), code.cast("long").alias("cls")),
        ["fp", "fp2", "n", "node"], F.array_compact(F.array(*[F.when((F.col("cls") % 16 + k).between(0, 15), F.col("cls") + 16 * j + k) for j, k in steps])), tile,
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["left"], batch["right"]):
                u, v = compare_prints(np.asarray(a, np.int64).reshape(-1, 4), np.asarray(b, np.int64).reshape(-1, 4))
                yield pd.DataFrame({"a": u, "b": v})

    return met.mapInPandas(meet, "a long, b long").where("a <> b")


def similar_links(g: dict[str, np.ndarray], similar: float = SIMILAR) -> pd.DataFrame:
    """a and b: links that span the components of all pairs of each whole group with a similarity of at least `similar`."""
    us, vs = [np.zeros(0, int)], [np.zeros(0, int)]
    new = np.flatnonzero(np.concatenate([[True], g["group"][1:] != g["group"][:-1]]))
    for s, e in zip(new, np.append(new[1:], len(g["node"]))):
        sets, block, i, j = g["shingles"][s:e], g["block"][s:e], g["i"][s], g["j"][s]
        n = np.array([len(x) for x in sets])
        _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        own, shared = np.repeat(np.arange(e - s), n), np.flatnonzero(often > 1)
        place = np.full(len(often), -1)
        place[shared] = np.arange(len(shared))
        at = place[at]
        both = np.zeros((e - s, e - s), np.float32)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(0, len(shared) + 4096, 4096))
        for k, (p, q) in enumerate(zip(cuts[:-1], cuts[1:])):
            has = np.zeros((e - s, 4096), np.float32)
            has[own[order[p:q]], at[order[p:q]] - 4096 * k] = 1
            both += has @ has.T
        near = both >= similar * (n[:, None] + n - both) - 1e-6 * (n[:, None] + n)
        u, v = np.nonzero(np.triu(near, 1) & (((block[:, None] == i) & (block == j)) | ((block[:, None] == j) & (block == i))))
        u, v = spanning(u, v, e - s)
        us, vs = [*us, u + s], [*vs, v + s]
    return pd.DataFrame({"a": g["node"][np.concatenate(us)], "b": g["node"][np.concatenate(vs)]})


def similar_texts(docs: DataFrame, texts: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """node and component (its smallest node) of each text that has a near one; texts has node, h, h2, fp, fp2 and n.

    Texts with candidates are read again for their shingles, which go to the group of candidates once, or once for
    each pair of blocks of a large group; all pairs of a group are compared exactly.
    """
    linked = components(candidates(texts, tile))
    linked = settle(linked.union(linked.select("component", "component").distinct()))
    members = settle(linked.join(texts.select("node", "h", "h2"), "node").select("node", F.col("component").alias("grp"), F.col("h").alias("at_h"), F.col("h2").alias("at_h2")))
    rows = docs.select(*text_key(docs["text"]), docs["text"].alias("text"))
    rows = rows.join(broadcast_if(members), F.col("h").eqNullSafe(F.col("at_h")) & F.col("h2").eqNullSafe(F.col("at_h2")))
    found = rows.groupBy("grp", "node").agg(F.first("text").alias("text")).select("grp", "node", shingle_sets("text").alias("shingles"))
    return components(in_groups(found, "grp", block, similar_links, "a long, b long"))


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text; null has none."""
    return [F.when(text.isNotNull(), F.xxhash64(text)).alias("h"), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("h2")]


def keep_one(docs: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """One row of docs for each group of near-duplicates, that with the smallest doc_id; columns as in docs.

    Texts with equal words (A-Z in lower case) are near, and so are texts whose sets of five-word shingles have a
    similarity of 0.8 or more; groups are what such links reach. All texts without words, null and empty, are one group.
    Texts are read whole. Groups are of rows, not of ids: rows with equal doc_id, or with none, stay if their texts are
    in different groups. A null doc_id is larger than any other; of rows with equal doc_id in one group the first by the
    text's hash stays, and of rows that are equal in doc_id and text one. No rows give no rows.
    """
    key = ["none", "doc_id", "h", "h2"]
    mine = docs.select(F.isnull("doc_id").alias("none"), "doc_id", *text_key(docs["text"]), near_prints("text").alias("p"))
    rows = settle(mine.select(*key, "p.*"))
    texts = rows.groupBy("th").agg(F.min(F.struct(*key)).alias("f"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.first("n").alias("n"))
    texts = settle(texts.select("th", *[F.col(f"f.{k}").alias(k) for k in key], "fp", "fp2", "n").withColumn("node", F.monotonically_increasing_id()))
    linked = settle(similar_texts(docs, texts, tile, block))
    linked = linked.union(linked.select("component", "component").distinct())
    first = texts.select("node", F.struct(*key).alias("f")).join(linked, "node").groupBy("component").agg(F.min("f").alias("f"))
    other = linked.join(first, "component").select("node", "f")
    kept = texts.select("th", "node", F.struct(*key).alias("own")).join(other, "node", "left").select("th", F.coalesce("f", "own").alias("f"))
    # rows to leave out, by their keys: all but the kept ones, and kept ones that are there more than once, of which one comes back
    often = rows.groupBy(*key, "th").agg(F.count("*").alias("often")).join(kept, "th")
    is_kept = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"f.{k}")) for k in key))
    gone = settle(often.where(~is_kept | (F.col("often") > 1)).select(*[F.col(k).alias(f"gone_{k}") for k in key[1:]], is_kept.alias("back")))
    each = docs.select(F.struct(*docs.columns).alias("row"))
    mine = dict(zip(key[1:], [F.col("row.doc_id"), *text_key(F.col("row.text"))]))
    same = reduce(Column.__and__, (mine[k].eqNullSafe(F.col(f"gone_{k}")) for k in mine))
    stay = each.join(broadcast_if(gone.drop("back")), same, "left_anti").select("row.*")
    back = gone.where("back")
    if back.isEmpty():
        return stay
    one = each.join(broadcast_if(back), same).groupBy(*[f"gone_{k}" for k in key[1:]]).agg(F.first("row").alias("row")).select("row.*")
    return stay.unionByName(one)
