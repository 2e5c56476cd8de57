"""Package sources and report sinks: archives, trees, lockfiles, manifests, records and logs."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T

ARCHIVE = "package_id string, path string, size_bytes long, content binary, status string"
LOG = "timestamp timestamp, level string, message string, event string, package string, verdict string, gnn_score double, rules array<string>, decision string, scan_ms double, cached boolean, evidence array<string>, reason string, size long, limit long"


def members(name: str, data: bytes) -> Iterator[tuple]:
    """Rows of one .tgz: its files, below `package/` if there is such a folder; one `corrupt` or `unsafe` row instead if a member escapes."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
            entries = tar.getmembers()
            if any(posixpath.isabs(m.name) or posixpath.normpath(m.name).startswith("..") for m in entries):
                yield name, None, None, None, "unsafe"
                return
            files = [(posixpath.normpath(m.name), m) for m in entries if m.isfile()]
            below = [(p[8:], m) for p, m in files if p.startswith("package/")]
            for path, m in below or files:
                content = tar.extractfile(m).read()
                yield name, path, len(content), content, "ok"
    except (tarfile.TarError, EOFError, OSError):
        yield name, None, None, None, "corrupt"


def read_archives(spark: SparkSession, folder: str, most_bytes: int = 50 << 20, uploads: bool = False) -> DataFrame:
    """Files of all .tgz below a folder, read by Spark; archives above most_bytes become a `too_large` row.

    uploads: all files below the folder are taken for archives; one whose name ends neither in .tgz nor in .tar.gz becomes an `invalid` row, whatever its size.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    every = (reader if uploads else reader.option("pathGlobFilter", "*.tgz")).load(folder)
    named = F.endswith("path", F.lit(".tgz")) | F.endswith("path", F.lit(".tar.gz"))
    found = every.where(named)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(members(posixpath.basename(path), data)), columns=["package_id", "path", "size_bytes", "content", "status"])

    name = F.regexp_extract("path", "[^/]*$", 0).alias("package_id")
    marked = lambda df, status: df.select(name, F.lit(None).cast("string").alias("path"), F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("content"), F.lit(status).alias("status"))
    large = marked(found.where(F.col("length") > most_bytes), "too_large").unionByName(marked(every.where(~named), "invalid"))
    return found.where(F.col("length") <= most_bytes).select("path", "content").mapInPandas(unpack, ARCHIVE).unionByName(large)


def decode(content: Column) -> Column:
    """Text of UTF-8 bytes, bad ones replaced, with newlines as \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def source_files(files: DataFrame) -> DataFrame:
    """package_id, path and code of the .js files that rules look at."""
    out = F.exists(F.split("path", "/"), lambda p: p.isin("node_modules", ".git", "vendor"))
    return files.where(F.endswith("path", F.lit(".js")) & ~out).select("package_id", "path", decode(F.col("content")).alias("code"))


def read_manifests(files: DataFrame) -> DataFrame:
    """package_id and raw of every package.json: a byte order mark goes, and what isn't a JSON object is {}."""
    raw = F.regexp_replace(decode(F.col("content")), "^﻿", "")
    good = F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")
    return files.where("path = 'package.json'").select("package_id", F.when(F.coalesce(good, F.lit(False)), raw).otherwise("{}").alias("raw"))


def lockfile_dependencies(lockfiles: DataFrame) -> DataFrame:
    """lockfile_id, name and version, each once, from raw JSON of version 1 (dependencies) or 2 and 3 (packages)."""
    entry = "map<string,struct<version:string>>"
    old, new = F.from_json(F.get_json_object("raw", "$.dependencies"), entry), F.from_json(F.get_json_object("raw", "$.packages"), entry)
    named = F.transform_keys(F.map_filter(F.coalesce(new, F.create_map().cast(entry)), lambda k, v: F.contains(k, F.lit("node_modules/"))), lambda k, v: k)
    pairs = F.when(F.size(F.coalesce(old, F.create_map().cast(entry))) > 0, F.map_entries(old)).otherwise(F.map_entries(named))
    rows = lockfiles.select("lockfile_id", F.explode(pairs).alias("e"))
    return rows.select("lockfile_id", F.regexp_replace("e.key", "^.*node_modules/", "").alias("name"), F.col("e.value.version").alias("version")).distinct()


def read_corpus(spark: SparkSession, path: str, label: int) -> DataFrame:
    """package_name, version, path and label of a corpus manifest in CSV."""
    return spark.read.option("header", True).schema("package_name string, version string, path string").csv(path).withColumn("label", F.lit(label))


def existing(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """rows whose path is among the folders (path)."""
    return rows.join(folders.select("path").distinct(), "path", "left_semi")


def build_queue(rows: DataFrame, done: DataFrame, trial: int = 0) -> DataFrame:
    """Labelled rows (path, label) whose output is not among `done` (path) yet; a trial run takes the first `trial` of each label."""
    from pyspark.sql import Window as W

    left = rows.join(done.select("path").distinct(), "path", "left_anti")
    if not trial:
        return left
    return left.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("path"))).where(F.col("n") <= trial).drop("n")


def with_code(packages: DataFrame, files: DataFrame) -> DataFrame:
    """packages that have a .js file."""
    return packages.join(files.where(F.endswith("path", F.lit(".js"))).select("package_id").distinct(), "package_id", "left_semi")


def malware_samples(archives: DataFrame) -> DataFrame:
    """path, name and version of the npm samples among archive paths {ecosystem}/{category}/{name}/{version}/file."""
    parsed = archives.select("path", T.sample_path(F.col("path")).alias("p"))
    return parsed.where("p.ecosystem = 'npm'").select("path", "p.name", "p.version")


def search_results(pages: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """name and place of found packages (name, page, position), each once where it came first, without known ones, up to `most`."""
    from pyspark.sql import Window as W

    first = pages.groupBy("name").agg(F.min(F.struct("page", "position")).alias("at"))
    new = first.join(known.select("name").distinct(), "name", "left_anti").orderBy("at", "name").limit(most)
    return new.withColumn("place", F.row_number().over(W.partitionBy().orderBy("at", "name"))).select("name", "place")  # `most` rows


def popular_names(listed: DataFrame) -> DataFrame:
    """name and its first position in a list (name, position), each name once, in the list's order; no list gives no rows."""
    return listed.groupBy("name").agg(F.min("position").alias("position"))


def failures(built: DataFrame) -> DataFrame:
    """package_path, error_type, error_message and num_js_files of the builds that failed."""
    return built.where("status = 'failure'").select("package_path", "error_type", "error_message", "num_js_files")


def write_failures(built: DataFrame, path: str) -> None:
    """Adds the failed builds to a folder of CSV with a header."""
    failures(built).write.mode("append").option("header", True).csv(path)


def write_splits(graphs: DataFrame, path: str) -> None:
    """Graphs as Parquet, one folder for each split."""
    graphs.repartition("split", F.pmod(F.xxhash64(*graphs.columns[:1]), F.lit(16))).write.mode("overwrite").partitionBy("split").parquet(path)


def labelled_path(text: Column) -> Column:
    """struct(path, label) of PATH:LABEL."""
    return F.struct(F.regexp_extract(text, "(?s)^(.*):([01])$", 1).alias("path"), F.regexp_extract(text, "(?s)^(.*):([01])$", 2).cast("int").alias("label"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; order decides, not arrival."""
    from pyspark.sql import Window as W

    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Decision log lines, newest first: by their time, and of equal times the later line of a file first; bad lines go."""
    rows = spark.read.schema(LOG + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("timestamp is not null").drop("_bad")
    return rows.orderBy(F.desc("timestamp"), F.desc(F.monotonically_increasing_id()))


def payload(verdicts: DataFrame) -> DataFrame:
    """package_id and the JSON body of its verdict."""
    return verdicts.select("package_id", F.to_json(F.struct("package_id", "verdict", "path", "confidence")).alias("body"))


def write_report(summary: DataFrame, path: str) -> None:
    """Aggregates as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def markdown(title: str, rows: list) -> str:
    """A table of collected aggregate rows, numbers to four places."""
    if not rows:
        return f"## {title}\n\nnone\n"
    names = rows[0].__fields__
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join([f"## {title}", "", "| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |", *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
