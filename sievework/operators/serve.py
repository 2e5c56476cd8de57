"""Batch forms of the service: lockfile audits, proxy actions, cached verdicts and dashboard counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.operators.catalog import LOG_LEVELS


def lockfile_audit(dependencies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """lockfile_id, counts of the four verdicts, flagged and the gates at each level; unknown packages are errors."""
    v = F.coalesce("verdict", F.lit("error"))
    counted = dependencies.select("lockfile_id", "name", "version").distinct().join(verdicts.select("name", "verdict"), "name", "left").groupBy("lockfile_id")
    rows = counted.agg(*[F.count_if(v == x).alias(x) for x in ("clean", "suspicious", "malicious", "error")])
    return rows.select("*", (F.col("suspicious") + F.col("malicious")).alias("flagged"), (F.col("malicious") > 0).alias("fail_high"), (F.col("malicious") + F.col("suspicious") > 0).alias("fail_medium"), (F.col("suspicious") + F.col("malicious") > 0).alias("fail_any"))


def lockfile_results(dependencies: DataFrame, scanned: DataFrame) -> DataFrame:
    """name, version, verdict, error_msg, asked and scans: each package that lockfiles (lockfile_id, name, version) ask for, once.

    scanned has name, verdict and error_msg (null unless the scan failed); a package without a row couldn't be downloaded. Only results are remembered: a package
    with one is scanned once, however many lockfiles ask, and a failure is tried again for each.
    """
    asked = dependencies.select("lockfile_id", "name", "version").distinct().groupBy("name", "version").agg(F.count("*").alias("asked"))
    rows = asked.join(scanned.select("name", "verdict", "error_msg"), "name", "left")
    error = F.when(F.col("verdict").isNull(), "Download failed").otherwise(F.col("error_msg"))
    return rows.select("name", "version", F.when(error.isNull(), F.col("verdict")).otherwise("error").alias("verdict"), error.alias("error_msg"), "asked", F.when(error.isNull(), 1).otherwise(F.col("asked")).cast("long").alias("scans"))


def action(kind: Column, verdict: Column, size: Column, limit: int, closed: bool = False) -> Column:
    """What a proxy does with a request; real verdicts only are cached, so an error never forwards in closed mode."""
    return (
        F.when(kind == "metadata", "passthrough").when(size > limit, "skip_scan").when(verdict == "malicious", "block")
        .when(verdict == "error", "fail_closed" if closed else "fail_open").otherwise("forward")
    )


def cache_hits(requests: DataFrame, ttl: int = 86_400) -> DataFrame:
    """requests (key, event_id, ts, verdict) with cached: whether a real verdict of the key is at most ttl seconds old.

    A request that finds none scans and stores, if its verdict is not an error; a stored verdict lasts from its scan.
    Scans follow one another by the ttl, so each key's requests are read once in time order, batch by batch, with the time
    of the last scan as the only state; from one scan the next is found by a search and not request by request.
    """
    rows = requests.select("key", "event_id", F.unix_timestamp("ts").alias("t"), (F.col("verdict") == "error").alias("bad"))
    rows = rows.repartition("key").sortWithinPartitions("key", "t", "event_id")

    def one_key(t: np.ndarray, bad: np.ndarray, since: int | None) -> tuple[np.ndarray, int | None]:
        out, good, j = np.zeros(len(t), bool), np.flatnonzero(~bad), 0
        while j < len(t):
            if since is not None:
                end = int(np.searchsorted(t, since + ttl, "right"))
                out[j:end] = True
                j = max(j, end)
            k = int(np.searchsorted(good, j))
            if k == len(good):
                break
            since, j = int(t[good[k]]), int(good[k]) + 1
        return out, since

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, since = None, None
        for batch in batches:
            name = batch["key"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else []
            cached = np.zeros(len(name), bool)
            for i, j in zip(cuts, [*cuts[1:], len(name)]):
                since = since if name[i] == key else None
                key = name[i]
                cached[i:j], since = one_key(batch["t"].to_numpy()[i:j], batch["bad"].to_numpy()[i:j], since)
            yield pd.DataFrame({"key": name, "event_id": batch["event_id"], "cached": cached})

    return rows.mapInPandas(run, "key string, event_id long, cached boolean")


def scan_payload(decided: DataFrame) -> DataFrame:
    """The body of an answer for each package (package_id, verdict, path, confidence, gnn and error, null unless the scan failed).

    A failed scan is a row with the verdict error and no confidence; without a model's score the rules alone decided.
    """
    failed = F.col("error").isNotNull()
    gnn = F.when(failed, F.lit(-1.0)).otherwise(F.coalesce("gnn", F.lit(-1.0)))
    return decided.select(
        "package_id", F.when(failed, "error").otherwise(F.col("verdict")).alias("verdict"), F.when(failed, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"), gnn.alias("gnn_score"),
        F.when(failed, "error").otherwise(F.col("path")).alias("decision_path"), F.when(~failed & (gnn < 0), "rules_only").alias("fallback"), F.col("error").alias("error_msg"),
    )


def block_body(blocked: DataFrame) -> DataFrame:
    """package, verdict, confidence, evidence, decision and note of each blocked package (name, version, confidence, evidence, path)."""
    package = F.concat("name", F.lit("@"), "version")
    why = F.when(F.size("evidence") > 0, F.array_join("evidence", "; ")).otherwise("none recorded")
    note = F.concat(package, F.lit(" was blocked with confidence "), F.coalesce(F.format_string("%.2f", "confidence"), F.lit("n/a")), F.lit(": "), why, F.lit(" ("), F.col("path"), F.lit(")"))
    return blocked.select(package.alias("package"), F.lit("malicious").alias("verdict"), "confidence", "evidence", F.col("path").alias("decision"), note.alias("note"))


def log_events(log: DataFrame, least: str = "info") -> DataFrame:
    """event, level and others of the lines that a proxy writes for requests (key, verdict, action, cached), from a level on.

    A forwarded or blocked tarball was scanned; each block, each failure that is let through or not, and each skipped scan
    has a line of its own. Malicious scans and everything that was not plain forwarding are warnings.
    """
    done = F.struct(F.lit("scan_complete").alias("event"), F.when(F.col("verdict") == "malicious", "warn").otherwise("info").alias("level"))
    own = lambda action, event, level: F.when(F.col("action") == action, F.struct(F.lit(event).alias("event"), F.lit(level).alias("level")))
    each = F.array_compact(F.array(
        F.when(F.col("action").isin("forward", "block", "fail_open", "fail_closed"), done), own("block", "block", "warn"), own("fail_open", "fail_open", "warn"), own("fail_closed", "fail_closed", "warn"), own("skip_scan", "scan_skipped", "warn"),
    ))
    ranks = F.create_map(*[F.lit(x) for kv in LOG_LEVELS.items() for x in kv])
    return log.select("key", "verdict", F.explode(each).alias("e")).select("key", "verdict", "e.*").where(F.element_at(ranks, F.col("level")) >= LOG_LEVELS[least])


def dashboard(log: DataFrame) -> DataFrame:
    """scanned, clean, malicious and blocked of log events."""
    e, v = F.col("event"), F.col("verdict")
    return log.agg(F.count_if(e.isin("scan_complete", "block")).alias("scanned"), F.count_if(v == "clean").alias("clean"), F.count_if(v == "malicious").alias("malicious"), F.count_if(e == "block").alias("blocked"))


def hourly(log: DataFrame, hours: int = 24) -> DataFrame:
    """Requests and blocks in each hour, and the share of blocks over the last `hours` hours with requests."""
    each = log.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "block").alias("blocked"))
    back = W.partitionBy().orderBy(F.col("hour").cast("long")).rangeBetween(-(hours - 1) * 3600, 0)  # a row for each hour
    return each.select("hour", "n", "blocked", F.round(F.sum("blocked").over(back) / F.sum("n").over(back), 6).alias("block_share"))


def sessions(log: DataFrame, gap: int = 1800) -> DataFrame:
    """key, start, n of runs of requests with less than `gap` seconds between them."""
    t = F.unix_timestamp("ts")
    w = W.partitionBy("key").orderBy("t", "event_id")
    rows = log.select("key", "event_id", t.alias("t")).withColumn("new", F.when(F.coalesce(F.col("t") - F.lag("t").over(w) < gap, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("key", "session").agg(F.min("t").alias("start"), F.count("*").alias("n")).select("key", "session", "start", "n")
