"""Conversation prefix trie: which conversations share which first turns.

A turn is 16 bytes of a SHA-256, a prefix 16 bytes of a hash chain over its turns. A count-min sketch of all prefixes has a
fixed largest size; as it never counts too low, an estimate of one proves that a prefix, and so every longer one, belongs to one
conversation: those nodes are written where they stand. Only prefixes that may be shared are shuffled and
grouped exactly. A sketch that is full merely proves less; results are the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import settle, turn_digest

#: The sketch has four rows of 2**16 to 2**22 counters of one byte (0, 1, more): 16 MB at most.
LEAST_BITS, MOST_BITS = 16, 22
BLOCK = 1 << 16
ROOT = hashlib.blake2b(b"", digest_size=16).digest()
#: Conversation ids of one value of id >> CHUNK_BITS are joined before they are hashed.
CHUNK_BITS = 10
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def narrow_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 1), digest and words of each turn: no texts from here on.

    Turns go by turn (null first), then role, then the SHA-256 of role and text. A null role or text is empty; rows without a conv_id belong
    to no conversation and go. Other columns are ignored; repeated rows are turns of their own; no rows give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), turn_digest(role, text).alias("digest"), words.alias("words"))
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "digest"))
    return rows.select("conv_id", at.cast("long").alias("at"), "digest", "words")


def with_shared_heads(rows: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Narrow turns of conversations that open like the first of their group: h turns of conversation c - c % group, then c's own after its first h.

    h is the CRC-32 of the decimal conv_id, modulo `most`. A head has fewer than `most` turns and goes to fewer than 2 * group conversations.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("first"), h.alias("h"))
    heads = rows.where((F.col("conv_id") % group == 0) & (F.col("at") < most)).withColumnRenamed("conv_id", "first")
    given = convs.join(heads, "first").where("at <= h").select("conv_id", "at", "digest", "words")
    return rows.where(F.col("at") > h).unionByName(given)


def prefix_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conversation (conv_id of ids) and depth: key, up (the key of the prefix before), words of its last turn, and whether it is the whole conversation.

    Rows of a conversation are read in order by one task, which holds one key; the result keeps its partitions, in order.
    """
    tops = ids.select("conv_id").where("conv_id is not null").distinct().select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    order = W.partitionBy("conv_id").orderBy("at")
    ordered = rows.select("conv_id", "at", "digest", "words").unionByName(tops).withColumn("whole", F.lead("at").over(order).isNull())
    return settle(ordered.sortWithinPartitions("conv_id", "at").mapInArrow(chained, "conv_id long, depth long, key binary, up binary, words long, whole boolean"))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, depth = ROOT, 0
    for batch in batches:
        depths, keys, ups = [], [], []
        for digest in batch.column("digest").to_pylist():
            if digest is None:
                up, key, depth = None, ROOT, 0
            else:
                up, key, depth = key, hashlib.blake2b(key + digest, digest_size=16).digest(), depth + 1
            depths.append(depth)
            keys.append(key)
            ups.append(up)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(ups, pa.binary()), batch.column("words"), batch.column("whole")],
            ["conv_id", "depth", "key", "up", "words", "whole"],
        )


def cells(keys: list[bytes], bits: int) -> np.ndarray:
    """The counter of each key in each of the four rows of the sketch."""
    parts = np.frombuffer(b"".join(keys), dtype="<u4").reshape(-1, 4).astype(np.int64) & ((1 << bits) - 1)
    return parts + (np.arange(4) << bits)


def sketch(prefixes: DataFrame, bits: int) -> np.ndarray:
    """The merged counters (0, 1, 2 for more) of all keys: each task counts, blocks of counters are merged by block."""

    size = min(BLOCK, 4 << bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(4 << bits, dtype=np.uint8)
        for batch in batches:
            if len(batch):
                at, n = np.unique(cells(list(batch["key"]), bits), return_counts=True)
                table[at] = np.minimum(2, table[at] + n)
        for block in np.flatnonzero(table.reshape(-1, size).any(axis=1)):
            yield pd.DataFrame({"block": [int(block)], "counters": [zlib.compress(table[block * size : (block + 1) * size].tobytes(), 1)]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counters in zip(batch["block"], batch["counters"], strict=True):
                more = np.frombuffer(zlib.decompress(counters), dtype=np.uint8)
                merged[block] = np.minimum(2, merged.get(block, 0) + more)
        for block, counters in merged.items():
            yield pd.DataFrame({"block": [block], "counters": [zlib.compress(counters.astype(np.uint8).tobytes(), 1)]})

    kind = "block int, counters binary"
    table = np.zeros(4 << bits, dtype=np.uint8)
    for row in prefixes.where("depth > 0").select("key").mapInPandas(count, kind).repartition("block").mapInPandas(merge, kind).collect():
        table[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(zlib.decompress(row["counters"]), dtype=np.uint8)
    return table


def screened(prefixes: DataFrame, bits: int) -> DataFrame:
    """prefixes with alone (the sketch proves that no other conversation has it) and first_alone (its parent isn't proven)."""
    table = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, bits))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proven = False
        for batch in batches:
            depths, keys = batch.column("depth").to_pylist(), batch.column("key").to_pylist()
            once = table.value[cells(keys, bits)].min(axis=1) == 1 if keys else np.zeros(0, dtype=bool)
            alone, first = [], []
            for depth, one in zip(depths, once.tolist(), strict=True):
                before = proven and depth > 0
                proven = before or (one and depth > 0)
                alone.append(proven)
                first.append(proven and not before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone, pa.bool_()), pa.array(first, pa.bool_())], [*batch.schema.names, "alone", "first_alone"])

    return settle(prefixes.mapInArrow(screen, "conv_id long, depth long, key binary, up binary, words long, whole boolean, alone boolean, first_alone boolean"))


def ends(rows: DataFrame) -> DataFrame:
    """key and the SHA-256 of the ascending ids of the conversations that end there.

    Ids are joined to strings of at most 2**CHUNK_BITS ids; a hash reads a node's strings in order and holds nothing else.
    """
    chunks = rows.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("key", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch["key"], batch["ids"], strict=True):
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])

    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInPandas(run, "key binary, ends_sha256 string")


def with_parents(children: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """children (up and others) with parent_conv_id. Nodes with more than a 400th of all rows as children, fewer than 400, are broadcast; a root has no parent."""
    names = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = F.col("n_children") > max(n // 400, 1000)
    hot = settle(names.where(large).select("up", "parent_conv_id"))
    rest = names.where(~large).select("up", "parent_conv_id")
    return (
        children.where("up is not null").join(F.broadcast(hot), "up")
        .unionByName(children.where("up is not null").join(F.broadcast(hot), "up", "left_anti").join(rest, "up"))
        .unionByName(children.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select("up", *[c for c in children.columns if c != "up"], "parent_conv_id"))
    )


def prefix_trie(rows: DataFrame, ids: DataFrame, bits: int | None = None) -> DataFrame:
    """The nodes of the trie over conversations (conv_id of ids) with the turns of narrow_turns().

    A node is a distinct sequence of first turns, the root has none. Columns: conv_id (its smallest member) and depth, which
    together name it; parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes at or below it), saved_tokens (words that
    storing each turn once saves, at and below it) and ends_sha256 (of the ids that end there). No conversations give no rows. bits: the logarithm of the sketch's width;
    by default the smallest that has four counters for each prefix, within LEAST_BITS and MOST_BITS.

    Sums over subtrees need no walk: what a node adds is put on the prefixes of its smallest member, summed from the deepest up in that conversation,
    and then for each node over its members.
    """
    prefixes = prefix_rows(rows, ids)
    n = prefixes.count()
    marked = screened(prefixes, min(MOST_BITS, max(LEAST_BITS, (4 * n).bit_length())) if bits is None else bits)
    maybe, alone = marked.where("not alone"), marked.where("alone")
    tops = alone.where("first_alone")

    found = maybe.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("up").alias("up"), F.min("words").alias("words"))
    children = found.select("up").unionByName(tops.select("up")).where("up is not null").groupBy("up").agg(F.count("*").alias("n_children"))
    nodes = settle(found.join(children.withColumnRenamed("up", "key"), "key", "left").fillna(0, ["n_children"]))

    adds = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    put = maybe.select("conv_id", "depth", "key").join(adds, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaves"])
    put = put.unionByName(tops.select("conv_id", "depth", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves")))
    below = W.partitionBy("conv_id").orderBy(F.desc("depth"))
    sums = put.select("key", F.sum("saved").over(below).alias("saved"), F.sum("leaves").over(below).alias("leaves"))
    totals = sums.where("key is not null").groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    shared = nodes.join(totals, "key").join(ends(maybe.where("whole").select("key", "conv_id")), "key", "left")
    shared = with_parents(shared.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).drop("key", "words"), nodes, n)
    own = F.when(F.col("whole"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing)
    one = F.lit(1).cast("long")
    single = alone.select("conv_id", "depth", "up", "first_alone", one.alias("n_convs"), (~F.col("whole")).cast("long").alias("n_children"), one.alias("n_leaves"), (one - one).alias("saved_tokens"), own.alias("ends_sha256"))
    joined = with_parents(single.where("first_alone"), nodes, n)
    return shared.select(NODE).unionByName(joined.select(NODE)).unionByName(single.where("not first_alone").withColumn("parent_conv_id", F.col("conv_id")).select(NODE))
