"""Near-duplicate embeddings by Euclidean p-stable hashing with exact cosine checks.

1. Equal vectors are one class. The unit vector of each class gets a bucket in every table, from quantised random
   projections, and a sketch of 512 bits: whether its step on finer projections is odd.
2. Only numbers, buckets and sketches go to the buckets. Members whose sketches differ in no more bits than those of a
   pair at the threshold are candidates; a bucket gives back links that span them, at most one for a member.
3. What these links connect is a group. A group goes to one place, where all its pairs are compared by exact cosines in
   double precision, unless it has grown by chains of unrelated vectors: where fewer copies of vectors reach the buckets
   in which they have candidates, they go there, and only pairs whose sketches are near are compared, each in the first
   bucket that it shares.

Both ways compare every candidate, and every pair once. Steps depend on distances only, so that a direction that all
vectors share (as embeddings of many models have it) blurs neither buckets nor sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import broadcast_if, components, in_groups, settle
from sievework.llm.simhash import spanning

COSINE, WIDTH, SEED = 0.95, 2.0, 42
#: Chance that a pair of just COSINE meets in no table; chance that its sketches differ too much.
MISS, SKETCH_MISS, BITS = 0.01, 1e-3, 512
SKETCH = [f"s{k}" for k in range(BITS // 64)]
#: Comparisons of sketches that cost about as much as sending a row to a bucket.
ROW_COST = 2000
#: Members of one bucket and vectors of one group that are compared in one piece, about.
BUCKET_BLOCK, BLOCK = 4096, 1024


def meets(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection is equal for two vectors at this distance (Datar et al., 2004)."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_plan(n: int, cosine: float = COSINE, miss: float = MISS, typical: float = math.sqrt(2)) -> tuple[int, int]:
    """(projections in a table, tables) for n vectors whose pairs are `typical` apart: the cheapest of those by which close ones meet nearly always."""
    close = math.sqrt(2 - 2 * cosine)
    near, far = meets(close), meets(max(typical, close))
    plans = [(k, math.ceil(math.log(miss) / math.log1p(-(near**k)))) for k in range(4, 65)]
    return min(plans, key=lambda p: p[1] * (ROW_COST + n * far ** p[0]))


def typical_distance(classes: DataFrame) -> float:
    """The root of the mean squared distance of two unit vectors of equal dimension, from the sums of all; 0 without any."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for d, same in batch.groupby(batch["embedding"].map(len)):
                n, s = sums.get(d, (0, 0.0))
                sums[d] = (n + len(same), s + unit(same["embedding"]).sum(0))
        yield pd.DataFrame([(d, n, s) for d, (n, s) in sums.items()], columns=["d", "n", "s"])

    sums = classes.select("embedding").mapInPandas(add, "d int, n long, s array<double>")
    parts = sums.select("d", "n", F.posexplode("s")).groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    pairs = F.col("n").cast("double") ** 2
    square = parts.groupBy("d").agg(F.first("n").alias("n"), F.sum(F.col("s") ** 2).alias("s2")).agg(F.sum(2 * (pairs - F.col("s2"))) / F.sum(pairs)).first()[0]
    return round(math.sqrt(max(square or 0.0, 0.0)), 3)


def odd_steps(distance: float, width: float) -> float:
    """Chance that two steps of this width, on a projection of vectors at this distance, differ in being odd (the mean of a triangle wave)."""
    return 0.5 - sum(4 / (math.pi * j) ** 2 * math.exp(-((math.pi * j * distance / width) ** 2) / 2) for j in range(1, 40, 2))


def sketch_width(cosine: float = COSINE) -> float:
    return math.sqrt(10) * math.sqrt(2 - 2 * cosine)


def sketch_radius(cosine: float = COSINE, miss: float = SKETCH_MISS) -> int:
    """The least number of bits that two sketches of such a cosine exceed with no more than this chance."""
    p, upto = odd_steps(math.sqrt(2 - 2 * cosine), sketch_width(cosine)), 0.0
    for r in range(BITS + 1):
        upto += math.comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
        if upto >= 1 - miss:
            return r
    return BITS


def unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, k: int, tables: int, seed: int = SEED) -> np.ndarray:
    """A 64-bit name of the bucket of every unit vector in every table; depends on seed and dimension alone."""
    rng = np.random.default_rng([seed, x.shape[1]])
    h = np.floor((x @ rng.standard_normal((x.shape[1], k * tables)) + rng.uniform(0, WIDTH, k * tables)) / WIDTH).astype(np.int64)
    mix, salt = rng.integers(1, 1 << 62, k * tables) | 1, rng.integers(1, 1 << 62, tables)
    s = ((h * mix).reshape(len(x), tables, k).sum(2) + salt).view(np.uint64)
    for _ in range(2):
        s = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (s ^ (s >> np.uint64(32))).view(np.int64)


def sketches(x: np.ndarray, cosine: float = COSINE, seed: int = SEED) -> np.ndarray:
    """The sketch of every unit vector, as unsigned numbers."""
    rng, width = np.random.default_rng([seed, x.shape[1], BITS]), sketch_width(cosine)
    steps = np.floor((x @ rng.standard_normal((x.shape[1], BITS)) + rng.uniform(0, width, BITS)) / width)
    return np.packbits(steps.astype(np.int64) & 1 == 1, axis=1).view(np.uint64)


def within(s: np.ndarray, radius: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether the sketches at these places differ in no more bits."""
    return sum(np.bitwise_count(c[u] ^ c[v]).astype(np.uint16) for c in s.T) <= radius


def pairs_in(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs (first before second) inside consecutive groups of these sizes."""
    begin = np.cumsum(sizes) - sizes
    after = np.repeat(begin + sizes, sizes) - np.arange(sizes.sum()) - 1
    u = np.repeat(np.arange(sizes.sum()), after)
    return u, u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(after) - after, after)


def near_pairs(new: np.ndarray, g: dict[str, np.ndarray], some, product, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the near pairs of whole groups that begin at the places `new`.

    Small groups are compared all at once by some(u, v), the others by product(left, right); a group of two different
    blocks holds the pairs of one block's rows with the other's.
    """
    size = np.diff(np.append(new, len(g["node"])))
    short = (size <= small) & (g["i"][new] == g["j"][new])
    rows = np.flatnonzero(np.repeat(short, size))
    upto, begin = np.cumsum(size[short]), 0
    while begin < short.sum():  # as many small groups at a time as have about a million pairs
        end = max(begin + 1, int(np.searchsorted(np.cumsum(size[short][begin:] ** 2), 1 << 20)) + begin)
        u, v = pairs_in(size[short][begin:end])
        first = upto[begin] - size[short][begin]
        u, v = rows[u + first], rows[v + first]
        near = some(u, v)
        yield u[near], v[near]
        begin = end
    for s, m in zip(new[~short], size[~short]):
        block, i, j = g["block"][s : s + m], g["i"][s], g["j"][s]
        left, right = s + np.flatnonzero(block == i), s + np.flatnonzero(block == j)
        for k in range(0, len(left), 256):
            p, q = np.nonzero(product(left[k : k + 256], right))
            p, q = left[k : k + 256][p], right[q]
            keep = p < q if i == j else np.ones(len(p), bool)
            yield p[keep], q[keep]


def starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def candidate_links(g: dict[str, np.ndarray], radius: int) -> pd.DataFrame:
    """a, b and bucket: links that span the components of the members of a bucket whose sketches are near, at most one for a member."""
    s, n = np.stack([g[c].view(np.uint64) for c in SKETCH], axis=1), len(g["node"])
    us, vs = np.zeros(0, int), np.zeros(0, int)
    for u, v in near_pairs(starts(g["group"]), g, lambda p, q: within(s, radius, p, q), lambda p, q: within(s, radius, p[:, None], q[None, :])):
        us, vs = np.concatenate([us, u]), np.concatenate([vs, v])
        if len(us) > 1 << 20:
            us, vs = spanning(us, vs, n)
    us, vs = spanning(us, vs, n)
    return pd.DataFrame({"a": g["node"][us], "b": g["node"][vs], "bucket": g["bucket"][us]})


def exact_links(g: dict[str, np.ndarray], cosine: float, tables: tuple[int, int] | None = None) -> pd.DataFrame:
    """a, b, n: for each vector with links the number of vectors they lead to (b null), and links that span the components.

    With tables (as from table_plan()) the groups are buckets: compared are pairs with near sketches, in the first bucket that both share.
    """
    x, n = unit(g["embedding"]), len(g["node"])
    found, us, vs = np.zeros(n, np.int64), np.zeros(0, int), np.zeros(0, int)
    some, product = (lambda u, v: np.einsum("nd,nd->n", x[u], x[v]) >= cosine), (lambda p, q: x[p] @ x[q].T >= cosine)
    if tables:
        s, names, radius = sketches(x, cosine), buckets(x, *tables), sketch_radius(cosine)
        linked = some

        def some(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            near = within(s, radius, u, v)
            first = (names[u[near]] == names[v[near]]).argmax(1)
            near[near] = names[u[near], first] == g["bucket"][u[near]]
            near[near] = linked(u[near], v[near])
            return near

        def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            near = within(s, radius, p[:, None], q[None, :])
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 16):
                near[i[k : k + (1 << 16)], j[k : k + (1 << 16)]] = some(p[i[k : k + (1 << 16)]], q[j[k : k + (1 << 16)]])
            return near

    for u, v in near_pairs(starts(g["group"]), g, some, product):
        np.add.at(found, u, g["n"][v])
        np.add.at(found, v, g["n"][u])
        us, vs = np.concatenate([us, u]), np.concatenate([vs, v])
        if len(us) > 1 << 20:
            us, vs = spanning(us, vs, n)
    us, vs = spanning(us, vs, n)
    some = np.flatnonzero(found)
    b = pd.array([*[None] * len(some), *g["node"][vs].tolist()], "Int64")
    return pd.DataFrame({"a": g["node"][np.concatenate([some, us])], "b": b, "n": np.concatenate([found[some], np.zeros(len(us), np.int64)])})


def candidates(classes: DataFrame, cosine: float, tables: tuple[int, int], block: int = BUCKET_BLOCK) -> DataFrame:
    """a, b and bucket: links between candidates that span them in each bucket."""
    radius = sketch_radius(cosine)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["embedding"].map(len)):
                x = unit(same["embedding"])
                s = np.repeat(sketches(x, cosine).view(np.int64), tables[1], axis=0)
                yield pd.DataFrame({"node": np.repeat(same["node"].to_numpy(), tables[1]), "bucket": buckets(x, *tables).ravel()} | dict(zip(SKETCH, s.T)))

    met = classes.select("node", "embedding").mapInPandas(sign, "node long, bucket long, " + ", ".join(f"{c} long" for c in SKETCH))
    return in_groups(met, "bucket", block, lambda g: candidate_links(g, radius), "a long, b long, bucket long")


def candidate_groups(links: DataFrame) -> DataFrame:
    """node and grp (the smallest node of its group) for all that have a candidate."""
    linked = components(links.select("a", "b"))
    return linked.union(linked.select("component", "component").distinct()).select("node", F.col("component").alias("grp"))


def scattered(places: DataFrame, block: int) -> DataFrame:
    """wide: the groups of places (node, grp, bucket) that have more than a block of nodes and send fewer copies of vectors to buckets than to one place."""
    held = places.groupBy("grp", "bucket").agg(F.count("*").alias("c"))
    copies = lambda n: n * F.ceil(n / block)
    sent = held.groupBy("grp").agg(F.sum(copies(F.col("c"))).alias("sent"))
    whole = places.select("grp", "node").distinct().groupBy("grp").agg(F.count("*").alias("m")).where(F.col("m") > block)
    return whole.join(sent, "grp").where(F.col("sent") < copies(F.col("m"))).select(F.col("grp").alias("wide"))


def near_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Columns a, b and n as from exact_links(), over classes with node, embedding and n."""
    tables = table_plan(classes.count(), cosine, typical=typical_distance(classes))
    links = settle(candidates(classes, cosine, tables))
    groups = settle(candidate_groups(links))
    places = links.select(F.explode(F.array("a", "b")).alias("node"), "bucket").distinct().join(groups, "node")
    wide = broadcast_if(settle(scattered(places, block)))
    vectors = classes.select("node", "embedding", "n", F.size("embedding").alias("d"))

    def comparing(tables: tuple[int, int] | None):
        def compare(g: dict[str, np.ndarray]) -> pd.DataFrame:
            parts = [exact_links({c: x[g["d"] == d] for c, x in g.items()}, cosine, tables) for d in np.unique(g["d"])]
            return pd.concat(parts, ignore_index=True)

        return compare

    whole = groups.join(wide, F.col("grp") == F.col("wide"), "left_anti").join(vectors, "node")
    spread = places.join(wide, F.col("grp") == F.col("wide"), "left_semi").drop("grp").join(vectors, "node")
    schema = "a long, b long, n long"
    return in_groups(whole, "grp", block, comparing(None), schema).union(in_groups(spread, "bucket", block, comparing(tables), schema))


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row; reads vec_id and embedding, never labels.

    Vectors that are null, empty or zero, or hold a null or a component that is not finite, link with nothing, as do
    vectors of different dimensions. Equal vectors are one class and count as linked; the cosine of two classes is
    taken in double precision of the components as given. A null vec_id is larger than any other: its row counts and
    links like the rest, and is kept only where its whole component has none. Repeated rows stay and count as vectors of
    their own; a vector of any length is hashed whole; no rows give no rows.
    """
    if not isinstance(rows.schema["embedding"].dataType.elementType, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("embedding")).alias("embedding"))
    key = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("h2")]  # 128 bits
    classes = rows.where("embedding is not null").select(*key, "vec_id", "embedding").groupBy("h", "h2")
    classes = classes.agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    found = settle(near_links(classes, cosine))
    linked = components(found.where("b is not null").select("a", "b"))
    linked = linked.union(linked.select("component", "component").distinct())
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    reps = classes.select("node", "rep", "h", "h2", "n")
    least = linked.join(reps, "node").groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    named = reps.join(counts, "node", "left").join(linked, "node", "left").select(
        F.col("h").alias("class_h"), F.col("h2").alias("class_h2"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("least", "rep").alias("least"), F.lit(True).alias("found")
    )
    mine = rows.select("vec_id", *[F.when(F.col("embedding").isNotNull(), k).alias(f"my_{n}") for k, n in zip(key, ("h", "h2"))])
    component = F.when(F.col("found"), F.col("least")).otherwise(F.col("vec_id"))
    return mine.join(named, (F.col("my_h") == F.col("class_h")) & (F.col("my_h2") == F.col("class_h2")), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
