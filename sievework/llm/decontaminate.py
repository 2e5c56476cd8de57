"""Benchmark decontamination by a broadcast set of test n-grams, in DataFrame functions only.

The hash of every window of a document's words is looked up in the broadcast set of hashes of benchmark windows, as a
row of a few numbers that doesn't carry the text. Where a hash is found, the words there are read again and the window
is compared in full, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import ascii_lower, broadcast_if, settle

#: Words before A-Z are put in lower case; lower-casing neither joins nor splits them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Hashes of benchmark windows (8 bytes each) up to which their set is broadcast; beyond it rows of numbers are shuffled once.
BROADCAST_WINDOWS = 2_000_000
#: Hash of no words at all; no window has it, so it stands for a document's row.
NO_WORDS = 42


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def with_words(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (text and others) with `keep` and w, the words of tokens(); splitting at gaps is twice as fast as finding words."""
    cut = rows.select(*keep, F.split(F.coalesce("text", F.lit("")), GAP).alias("w"))
    first, last = (F.get("w", F.lit(0)) == "").cast("int"), (F.element_at("w", -1) == "").cast("int")
    return cut.select(*keep, F.slice("w", first + 1, F.greatest(F.size("w") - first - last, F.lit(0))).alias("w"))


def word_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every window of every item, once for each item: item_id, gram, hash, len.

    gram is the window's words with A-Z in lower case, joined by a space; hash is of the hashes of the words in full lower
    case, which are equal wherever the gram is. Items without words (null and empty texts) have no window.
    """
    w = F.transform(tokens(F.col("text")), ascii_lower)
    items = benchmark.select("item_id", w.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    grams = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))).alias("g"))
    return grams.select("item_id", F.array_join("g", " ").alias("gram"), F.xxhash64(F.transform("g", word_hash)).alias("hash"), F.size("g").alias("len")).distinct()


def window_hashes(w: Column, n: int) -> Column:
    """struct(start, len, hash) of every run of n words; empty for fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.xxhash64(F.slice(w, i + 1, n)).alias("hash")))
    return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<struct<start:int,len:int,hash:bigint>>"))


def look_up(docs: DataFrame, grams: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, th (hash of the text), start and len: every window whose hash is in the benchmark, and for every row of docs one with start -1 and its number of words as len."""
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most WINDOW numbers
    row = F.array(F.struct(F.lit(-1).alias("start"), F.size("w").alias("len"), F.lit(NO_WORDS).cast("long").alias("hash")))
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    rows = with_words(rows, "doc_id", "th").select("doc_id", "th", F.transform("w", word_hash).alias("w"))
    # outer, as for an inner explode Spark would work out all hashes twice, once to filter by their number
    rows = rows.select("doc_id", "th", F.explode_outer(F.concat(row, *[window_hashes(F.col("w"), n) for n in lengths])).alias("x"))
    keys = grams.select("hash").union(grams.sparkSession.range(1).select(F.lit(NO_WORDS).cast("long"))).distinct()
    return rows.select("doc_id", "th", "x.*").join(broadcast_if(keys, broadcast_windows), "hash", "left_semi").select("doc_id", "th", "start", "len")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each distinct doc_id and text of docs: doc_id, th (hash of the text), rows, n_words, hits, items.

    rows is how often docs has it. hits has struct(start, len) of each occurrence of a window, in words from 0; items
    the ids of the items they come from; both are null without a hit. A null text has no words and is not the empty text; no
    rows give no rows; no benchmark gives no hits. A text is read whole, at a cost that is linear in its words: a row of
    numbers for each window goes to the broadcast set, and texts are read a second time only where a hash was found.
    """
    grams = settle(benchmark_windows(benchmark, window))
    met = settle(look_up(docs, grams, broadcast_windows))
    every = met.where("start < 0").groupBy("doc_id", "th").agg(F.count("*").alias("rows"), F.max("len").cast("long").alias("n_words"))
    places = met.where("start >= 0").distinct().select(F.col("doc_id").alias("at_id"), F.col("th").alias("at_th"), "start", "len")
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("th") == F.col("at_th"))
    texts = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    texts = texts.join(broadcast_if(settle(places.select("at_id", "at_th").distinct())), same, "left_semi")
    texts = texts.join(places.groupBy("at_id", "at_th").agg(F.collect_list(F.struct("start", "len")).alias("at")), same)
    texts = with_words(texts, "doc_id", "th", "at")
    here = F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), ascii_lower(F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ")).alias("gram")))
    read = texts.select("doc_id", "th", F.explode_outer(here).alias("x")).select("doc_id", "th", "x.*")
    found = read.join(grams.select("gram", "len", "item_id"), ["gram", "len"]).groupBy(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"))
    found = found.agg(F.collect_set(F.struct("start", "len")).alias("hits"), F.collect_set("item_id").alias("items"))
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left").drop("hit_id", "hit_th")


def hit_words(hits: Column) -> Column:
    """The places of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs; nulls, empty and long texts as in find_hits()."""
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size(hit_words(F.col("hits"))), F.lit(0)).cast("long")
    found = find_hits(docs, benchmark).withColumn("items", F.col("items").cast("array<string>"))
    found = found.select("n_words", F.when(F.col("hits").isNull(), F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"), F.array_sort(items).alias("items"), "doc_id", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("one"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit, columns as in docs; rows with null or repeated ids go by their own texts."""
    bad = settle(find_hits(docs, benchmark).where("hits is not null").select(F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th")))
    th = text_hash(docs["text"])
    return docs.join(broadcast_if(bad), docs["doc_id"].eqNullSafe(bad["__bad_id"]) & (th == bad["__bad_th"]), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the hit words taken out of their texts; what stands between words stays.

    A word goes with what follows it up to the next word; texts without a hit stay as they are, nulls and empty texts
    among them. Columns as in docs, repeated rows stay.
    """
    found = find_hits(docs, benchmark).where("hits is not null")
    found = settle(found.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), hit_words(F.col("hits")).alias("hit_at")))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row.text")
    both = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (text_hash(text) == F.col("hit_th")), "left")
    gaps = F.split(text, WORD)
    hit = F.map_from_entries(F.transform("hit_at", lambda i: F.struct(i, F.lit(True))))
    kept = F.transform(tokens(text), lambda w, i: F.when(F.element_at(hit, i).isNotNull(), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    return both.select(F.when(F.col("hit_at").isNull(), F.col("row")).otherwise(F.col("row").withField("text", cut)).alias("row")).select("row.*")
