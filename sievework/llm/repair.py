"""Conversation repair: the cheapest edits that give each conversation the roles `(system? (user assistant)+)?`.

What has been said so far is in one of four states: nothing, a system turn, a user turn last, an assistant turn last.
A row is kept (cost 0), given the other role (2) or deleted (3); empty turns may be inserted anywhere (2 each); a truncated
row that stays costs 1, and blank rows and repeats must go. Hirschberg's method finds the cheapest edits: costs from the
front and costs from the back meet in the middle, the state with the least sum (of equal ones that with the least audit) is
where the best path crosses, and both halves are solved alike. Vectors have four numbers, so nothing is kept for each row
but its kind and its edit.

Edits are planned on narrow rows, without any text. Texts are shuffled once, by conversation, and meet their edits in one
merged, sorted stream, in which no conversation is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import settle, turn_digest

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn: an assistant's after a user's, a user's otherwise.
NEXT = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
SPOKEN = {"s": (SYSTEM, (NOTHING,)), "u": (USER, (NOTHING, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
#: Cost and audit of what ends a conversation, by state.
ENDING = [(0, ""), (4, "II"), (2, "I"), (0, "")]
FINE, TRUNCATED, MUST_GO = range(3)
SPACE = " \t\n\x0b\x0c\r"
FAR = float("inf")

Step = tuple[int, int, int, str]


def steps_of(letter: str, fault: int) -> list[Step]:
    """(from, to, cost, audit) of the best way over one row between two states, insertions before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state = start
        for inserted in range(3):  # a third one would come back to the state after the first
            ways = [(state, 3, "D")]
            if fault != MUST_GO:
                ways.append((NEXT[state], 2 + fault, "R"))
                if letter in SPOKEN and state in SPOKEN[letter][1]:
                    ways.append((SPOKEN[letter][0], fault, "K"))
            for to, cost, edit in ways:
                way = (cost + 2 * inserted, "I" * inserted + edit)
                best[start, to] = min(best.get((start, to), way), way)
            state = NEXT[state]
    return [(p, q, *way) for (p, q), way in best.items()]


#: Steps by kind of row: the place of its letter in "suax" times 3, plus its fault.
STEPS = [steps_of(letter, fault) for letter in "suax" for fault in (FINE, TRUNCATED, MUST_GO)]


def forward(kinds: bytes, start: int) -> tuple[list[float], list[int]]:
    """Least costs of reaching each state over all rows, and the order of the least audits that do so.

    Audits of different states differ and none begins another, as each ends with its last row's edit; so their order
    stays whatever follows, and one rank for each state is enough to compare them.
    """
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for kind in kinds:
        best: list[tuple[float, int, str] | None] = [None] * 4
        for p, q, c, edits in STEPS[kind]:
            if cost[p] < FAR:
                way = (cost[p] + c, rank[p], edits)
                if best[q] is None or way < best[q]:
                    best[q] = way
        cost, rank = [way[0] if way else FAR for way in best], [0] * 4
        for place, q in enumerate(sorted((q for q in range(4) if best[q]), key=lambda q: best[q][1:])):
            rank[q] = place
    return cost, rank


def backward(kinds: bytes, end: int) -> list[float]:
    """Least costs of reaching the state end over all rows from each state."""
    cost = [FAR] * 4
    cost[end] = 0
    for kind in reversed(kinds):
        before = [FAR] * 4
        for p, q, c, _ in STEPS[kind]:
            if cost[q] + c < before[p]:
                before[p] = cost[q] + c
        cost = before
    return cost


def between(kinds: bytes, start: int, end: int) -> Iterator[str]:
    """The edits of each row on the best path from one state to another."""
    if len(kinds) == 1:
        yield next(edits for p, q, _, edits in STEPS[kinds[0]] if (p, q) == (start, end))
        return
    middle = len(kinds) // 2
    cost, rank = forward(kinds[:middle], start)
    rest = backward(kinds[middle:], end)
    crossing = min(range(4), key=lambda q: (cost[q] + rest[q], rank[q]))
    yield from between(kinds[:middle], start, crossing)
    yield from between(kinds[middle:], crossing, end)


def cheapest(kinds: bytes) -> tuple[int, list[str]]:
    """The cost of the best edits, and the edits of each row and of the end."""
    cost, rank = forward(kinds, NOTHING)
    end = min(range(4), key=lambda q: (cost[q] + ENDING[q][0], rank[q]))
    edits = list(between(kinds, NOTHING, end)) if kinds else []
    return int(cost[end]) + ENDING[end][0], [*edits, ENDING[end][1]]


def damage(turns: DataFrame) -> DataFrame:
    """The rows with faults planted by the CRC-32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.`, `!`
    and `?`, 3 repeats it, 4 makes its role user. A null role, text, conv_id or turn counts as one space there; null ids and turns stay null.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def filled(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), turn_digest(role, text).alias("digest"))


def planned(turns: DataFrame) -> DataFrame:
    """Edits as rows: one for each row that stays (role_out, inserted: states of the turns put before it), one `last` row for each conversation with its audit."""
    rows = filled(turns)
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut")
    ).withColumn("again", again)
    order = ["conv_id", "turn", "role", "digest", "again"]
    schema = "conv_id long, last boolean, turn long, role string, digest binary, role_out string, inserted binary, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return settle(narrow.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(plan, schema))


def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            if held and held[-1]["conv_id"] != row["conv_id"]:
                out += conversation(held)
                held = []
            held.append(row)
        yield edit_rows(out)
    if held:
        yield edit_rows(conversation(held))


def edit_rows(rows: list[dict]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = [("conv_id", number), ("last", pa.bool_()), ("turn", number), ("role", text), ("digest", pa.binary()), ("role_out", text), ("inserted", pa.binary())]
    kinds += [(c, number) for c in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", text)]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def conversation(rows: list[dict]) -> list[dict]:
    """The edit rows of one conversation, whose narrow rows are given in order."""
    faults = [MUST_GO if r["blank"] or r["again"] else TRUNCATED if r["cut"] else FINE for r in rows]
    letters = [r["role"][:1] for r in rows]
    kinds = bytes("suax".find(x if x in SPOKEN else "x") * 3 + fault for x, fault in zip(letters, faults, strict=True))
    cost, edits = cheapest(kinds)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    blank = sum(r["blank"] for r in rows)
    told = {
        "n_rows": len(rows), "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": blank, "duplicate": faults.count(MUST_GO) - blank, "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), "cost": cost, "audit": "".join(edits),
    }
    out, state, inserted = [], NOTHING, bytearray()
    for row, letter, edit in zip(rows, letters, edits):
        for _ in range(len(edit) - 1):
            state = NEXT[state]
            inserted.append(state)
        if edit[-1] != "D":
            state = SPOKEN[letter][0] if edit[-1] == "K" else NEXT[state]
            role = row["role"] if edit[-1] == "K" else NAMES[state]
            out.append({c: row[c] for c in ("conv_id", "turn", "role", "digest")} | {"last": False, "role_out": role, "inserted": bytes(inserted)})
            inserted = bytearray()
    for _ in edits[-1]:
        state = NEXT[state]
        inserted.append(state)
    return [*out, {"conv_id": rows[0]["conv_id"], "last": True, "inserted": bytes(inserted)} | told]


def audits(edits: DataFrame) -> DataFrame:
    """One row for each conversation of planned(): its faults, the cost and the audit of its repair."""
    return edits.where("last").select("conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role and text of the repaired conversations, in order inside a partition.

    Reads conv_id, turn, role and text of turns and ignores other columns; edits is planned(turns). Rows go by turn (null first),
    then role, then the SHA-256 of role and text; a null role or text is empty, so a null text is blank and goes; a null conv_id is a conversation of its own.
    Of repeated rows the first stays. A conversation without rows that stay has none; no rows give no rows.

    Planning holds a conversation's narrow rows (no texts) in one task, and its audit is one string; texts pass by one at a time.
    """
    marks = edits.select("conv_id", "last", "turn", "role", "digest", F.lit(None).cast("string").alias("text"), "role_out", "inserted", F.lit(0).alias("kind"))
    texts = filled(turns).select("*", F.lit(False).alias("last"), F.lit(None).cast("string").alias("role_out"), F.lit(None).cast("binary").alias("inserted"), F.lit(1).alias("kind"))
    both = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "last", "turn", "role", "digest", "kind")
    return both.select("conv_id", "last", "digest", "text", "role_out", "inserted").mapInArrow(merge, "conv_id long, position long, role string, text string")


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edit comes right before the row that it is for; rows without one go."""
    wanted, conv, position = None, object(), 0
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, position, wanted = row["conv_id"], 0, None
            said = []
            if row["inserted"] is not None:
                said = [(NAMES[state], "") for state in row["inserted"]]
                wanted = None if row["last"] else row
            elif wanted and wanted["digest"] == row["digest"]:
                said, wanted = [(wanted["role_out"], row["text"])], None
            for role, text in said:
                position += 1
                out.append((conv, position, role, text))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "position", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of `role:text` lines of repair()'s rows, read in their order; one hash is the only state."""
    return repaired.mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None
    rows = lambda done: pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if state is None or row["position"] == 1:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = row["conv_id"], hashlib.sha256()
            state.update(("\n" * (row["position"] > 1) + f"{row['role']}:{row['text']}").encode())
        yield rows(done)
    if state is not None:
        yield rows([(conv, state.hexdigest())])


def repair_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """For each conv_id of ids: the faults of its rows in turns, the cost and audit of their repair and the digest of the repaired ones.

    A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    edits = planned(turns)
    known = audits(edits).drop("n_rows").withColumnRenamed("conv_id", "c")
    said = digests(repair(turns, edits)).withColumnRenamed("conv_id", "d")
    rows = ids.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(said, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
