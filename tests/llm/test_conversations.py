"""The prefix trie and the repair of conversations against brute force and SQL, with odd rows."""

import functools
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sievework.llm import oracle, queries, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, words long"
ODD = [
    (0, 0, "system", "be kind.", 1), (0, 1, "user", "a b", 2), (0, 2, "assistant", "c?", 3), (0, 3, "user", None, 4), (1, 0, None, "x y.", 5), (1, None, "user", "null first", 6), (1, None, "assistant", "null too!", 7),
    (2, 0, "user", "tie", 8), (2, 0, "user", "tie", 9), (2, 0, "assistant", "tie", 0), (3, 0, "tool", " \t\n", 0), (3, 5, "user", "gap.", 0), (20, 0, "user", "q" * 5000 + ".", 0), (21, 0, "user", "own", 0), (21, 1, "assistant", "own too.", 0),
    (22, 0, "user", "own", 0), (22, 1, "assistant", "own too.", 0), (25, 7, "a", "initial a.", 0), (-3, 0, "user", "negative.", 0), (None, 0, "user", "no id.", 0), (2**60 + 1, 0, "user", "large id", 0), (2**60 + 1, 1, "u", "ends ", 0),
    *[(100 + i, t, ["system", "user", "assistant"][(t + i % 2) % 3], f"shared {t}.", 0) for i in range(30) for t in range(4)],
]


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(None if v != v else v for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ODD, SCHEMA).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_structure_repair"])
@pytest.mark.parametrize("given", [True, False])
def test_query_equals_sql(spark, odd, name, given):
    folder = "/root/testdata/sf0.001" if given else odd
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet{'' if given else '/*.parquet'}')")
    want, got = con.execute(oracle.ORACLE_SQL[name]).fetchall(), queries.queries()[name](spark, folder)
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(names).collect())


def trie_by_hand(turns, ids):
    """Nodes of {conv: [(role, text, words)]} by plain dictionaries."""
    members = {}
    for c in ids:
        path = tuple(turns.get(c, []))
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in members)]
        ends = ",".join(str(c) for c in sorted(convs) if len(turns.get(c, [])) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), up, len(convs), sum(1 for p in members if p and p[:-1] == path), len(leaves), sum((len(members[p]) - 1) * (p[-1][2] if p else 0) for p in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [2, 8, None])
def test_trie_with_any_sketch(spark, bits):
    """A sketch too small to prove anything, one in between and a large one give the same nodes."""
    rng = random.Random(5)
    turns = {c: [(rng.choice("ua"), (w := rng.choice(["x", "x y", "x y z"])), len(w.split())) for _ in range(rng.randrange(6))] for c in range(80)} | {c: [("u", "hot", 1)] * 3 for c in range(500, 540)}
    flat = [(c, t, r, x) for c, said in turns.items() for t, (r, x, _) in enumerate(said)]
    df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string").repartition(3)
    ids = spark.createDataFrame([(c,) for c in turns], "conv_id long")
    got = trie.prefix_trie(trie.narrow_turns(df), ids, bits).collect()
    assert sorted(map(tuple, got), key=str) == trie_by_hand(turns, list(turns))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.narrow_turns(none), none.select("conv_id")).count() == 0
    alone = spark.createDataFrame([(7,)], "conv_id long")  # a conversation without turns is the root
    assert [tuple(r)[:7] for r in trie.prefix_trie(trie.narrow_turns(none), alone).collect()] == [(7, 0, None, 1, 0, 1, 0)]


def test_estimates_never_too_low(spark):
    keys = [hashlib.sha256(str(i % 700).encode()).digest()[:16] for i in range(1000)]
    df = spark.createDataFrame([(k, 1) for k in keys], "key binary, depth long").repartition(7)
    table = trie.sketch(df, 6)
    assert (table[trie.cells(keys, 6)].min(axis=1) >= [min(2, keys.count(k)) for k in keys]).all()
    assert (trie.sketch(df, 16)[trie.cells(keys, 16)].min(axis=1) == [min(2, keys.count(k)) for k in keys]).all()


def every_way(kinds):
    """The least (cost, audit) over all paths, by memory of whole audits."""

    @functools.cache
    def best(i, state):
        if i == len(kinds):
            return repair.ENDING[state]
        return min((c + best(i + 1, q)[0], edits + best(i + 1, q)[1]) for p, q, c, edits in repair.STEPS[kinds[i]] if p == state)

    return best(0, repair.NOTHING)


def test_halves_meet_on_the_least_audit():
    rng = random.Random(3)
    for n in [*range(1, 25), 200, 333]:
        for _ in range(60 if n < 30 else 3):
            kinds = bytes(rng.randrange(12) for _ in range(n))
            cost, edits = repair.cheapest(kinds)
            assert (cost, "".join(edits)) == every_way(kinds)
    assert repair.cheapest(b"") == (0, [""])


def test_repaired_turns(spark):
    said = [(1, 0, "system", "s.", 0), (1, 1, "assistant", "a.", 0), (1, 2, "user", "cut", 0), (2, 0, "user", "b.", 0), (2, 1, "user", "b.", 0), (3, 0, "user", "", 0), (None, 1, "user", "x.", 0), (None, 2, "robot", "y.", 0)]
    turns = spark.createDataFrame(said, SCHEMA)
    edits = repair.planned(turns)
    got = [tuple(r) for r in repair.repair(turns, edits).orderBy("conv_id", "position").collect()]
    assert got == [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (1, 1, "system", "s."), (1, 2, "user", ""), (1, 3, "assistant", "a."), (2, 1, "user", "b."), (2, 2, "assistant", "")]
    told = {r["conv_id"]: (r["cost"], r["audit"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) for r in repair.audits(edits).collect()}
    assert told == {None: (2, "KR", 0, 0, 0, 1), 1: (5, "KIKD", 0, 0, 1, 1), 2: (5, "KDI", 0, 1, 0, 1), 3: (3, "D", 1, 0, 0, 0)}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(none, none).count() == 0
    lost = repair.repair_report(none, spark.createDataFrame([(4,)], "conv_id long")).first()
    assert tuple(lost) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.damage(none.withColumn("fault", F.lit(1))).columns == ["conv_id", "turn", "role", "text"]
