"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory, in DataFrame functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import ascii_lower, settle, shared_folder

#: Notices, headers and sentences of license texts, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-3.0", "General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-2.0", "General Public License as published by the Free Software Foundation; either version 2"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "Lesser General Public License as published by the Free Software Foundation; version 2.1"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("Zlib", "The origin of this software must not be misrepresented; you must not claim"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
]
#: Licenses whose text, or a line of whose header, another license's holds: where both are found, it is the other.
HELD_BY = {"BSD-2-Clause": "BSD-3-Clause", "GPL-2.0": "LGPL-2.1"}
#: Terms without which nothing is that license's, as near as the rest may be.
NEEDED = {"AGPL-3.0": ["affero", "3"], "GPL-2.0": ["2"], "GPL-3.0": ["3"], "LGPL-2.1": ["lesser", "2", "1"], "LGPL-3.0": ["lesser", "3"]}
SIMILAR = 0.6
GAP = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: A file that states its license by an expression of identifiers, at a line's start or after comment signs.
NAME = r"[(]*[A-Za-z0-9.+-]+[)]*"
TAG = rf"(?im)^[ \t]*(?:[^0-9A-Za-z\s]{{1,4}}[ \t]*|(?:rem|dnl)[ \t]+)?SPDX-License-Identifier:[ \t]*({NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{NAME})*)"


def terms(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda x: x != ""), F.lower)


def document_frequencies(files: DataFrame) -> DataFrame:
    """term and df, the number of files that have it, for every term of all files."""
    return files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def inverse(n: int, df: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + F.coalesce(df, F.lit(0)))) + 1.0


def text_map(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])


def template_weights(seen: DataFrame, n: int, templates: DataFrame) -> DataFrame:
    """template, term, tf, weight (unit length for each template) and idf of every template term; seen counts all n files.

    idf = ln((1 + files) / (1 + files with the term)) + 1.
    """
    words = templates.select("template", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    vocabulary = words.select("term").distinct()
    df = F.broadcast(seen.join(F.broadcast(vocabulary), "term", "left_semi"))
    weighed = words.join(df, "term", "left").select("template", "term", inverse(n, F.col("df")).alias("idf"), "tf").withColumn("x", F.col("tf") * F.col("idf"))
    return weighed.select("template", "term", "idf", "tf", (F.col("x") / F.sqrt(F.sum(F.col("x") ** 2).over(W.partitionBy("template")))).alias("weight"))


def product(known: Column, of: list) -> Column:
    """The product of a template with terms, given its rows of term, idf and weight."""
    worth = F.create_map(*[F.lit(x) for r in of for x in (r["term"], r["idf"] * r["weight"])])
    return F.aggregate(known, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.element_at(worth, x), F.lit(0.0)))


def weight_in(known: Column, weight: Column) -> Column:
    """The sum of a map's values at these keys."""
    return F.aggregate(known, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(weight, x), F.lit(0.0)))


def candidates(files: DataFrame, weights: list, similar: float) -> DataFrame:
    """path, part and terms: what can reach `similar` of the lines of each file, of its runs of lines, and of whole license files.

    Lines without words don't count. A run has no more lines than the longest notice has terms, so it holds a notice
    however it is wrapped; it starts and ends with a template's term, as it would be nearer without other ends.
    Left out is only what can't reach `similar`. By Cauchy-Schwarz the terms that a part shares with a
    template must hold `similar` squared of the template's length, so a part needs a term of some template's heavier ones.
    With d the sum of its terms' idf times their largest weight and o its other terms (none has an idf below 1), its
    product with a template is at most d, and its square length at least that product's square plus o. What remains is
    judged likewise for each template, the others' square length being at least their count squared by their number.
    part is a hash of the text, so that no text goes with each of its terms.
    """
    heavy, most, up_to = set(), {}, {}
    for r in sorted(weights, key=lambda r: (r["template"], r["weight"], r["term"])):
        up_to[r["template"]] = up_to.get(r["template"], 0.0) + r["weight"] ** 2
        most[r["term"]] = max(most.get(r["term"], 0.0), r["idf"] * r["weight"])
        if up_to[r["template"]] >= similar * similar:
            heavy.add(r["term"])
    if not heavy:
        return files.select("path", F.lit("").alias("part"), terms(F.col("text")).alias("terms")).where("false")
    longest = max(sum(r["tf"] for r in weights if r["template"] == x) for x in up_to)
    some = "(?i)(?<![0-9A-Za-z\\x80-\\x{10FFFF}])(?:" + "|".join(sorted(heavy)) + ")(?![0-9A-Za-z\\x80-\\x{10FFFF}])"
    worth = F.create_map(*[F.lit(x) for kv in sorted(most.items()) for x in kv])

    def reachable(known: Column) -> Column:
        """Whether the template terms among these distinct ones can make up `similar` of some template."""
        shares = [F.create_map(*[F.lit(x) for r in weights if r["template"] == t for x in (r["term"], r["weight"] ** 2)]) for t in sorted(up_to)]
        held = [weight_in(known, m) for m in shares]
        return reduce(Column.__or__, (h + 1e-6 >= similar * similar for h in held))

    def stat(line: Column) -> Column:
        known = F.filter(terms(line), lambda x: x.isin(*most))
        d = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + F.element_at(worth, x))
        return F.struct(d.alias("d"), (F.size(terms(line)) - F.size(known)).cast("double").alias("o"), line.rlike(some).alias("h"))

    rows = files.where(F.col("text").rlike(some)).select("path", F.filter(F.split("text", r"\R"), lambda x: x.rlike(WORD)).alias("lines"))
    rows = rows.select("path", "lines", F.transform("lines", stat).alias("stats"))
    lines, stats, size = F.col("lines"), F.col("stats"), F.size("lines")

    def total(run: Column, name: str) -> Column:
        return F.aggregate(F.slice(stats, run["i"] + 1, run["n"]), F.lit(0.0), lambda acc, x: acc + x[name])

    def near(run: Column) -> Column:
        ends = (F.get(stats, run["i"])["d"] > 0) & (F.get(stats, run["i"] + run["n"] - 1)["d"] > 0)
        able = total(run, "d") ** 2 * (1 - similar**2) + 1e-6 >= similar**2 * total(run, "o")
        return (ends | (run["n"] == size)) & F.exists(F.slice(stats, run["i"] + 1, run["n"]), lambda x: x["h"]) & able

    each = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(int(longest)), size - i)), lambda n: F.struct(i.alias("i"), n.alias("n")))))
    whole = F.when(is_license_file(F.col("path")), F.array(F.struct(F.lit(0).alias("i"), size.alias("n")))).otherwise(F.slice(each, 1, 0))
    parts = F.transform(F.filter(F.concat(each, whole), near), lambda r: F.array_join(F.slice(lines, r["i"] + 1, r["n"]), "\n"))
    found = rows.where(size > 0).select("path", F.explode(F.array_distinct(parts)).alias("part"))
    found = found.select("path", F.md5("part").alias("part"), terms(F.col("part")).alias("terms"))
    found = found.select("path", "part", "terms", F.filter("terms", lambda x: x.isin(*most)).alias("known"), F.filter("terms", lambda x: ~x.isin(*most)).alias("other"))
    o = F.coalesce(F.size("other") ** 2 / F.nullif(F.size(F.array_distinct("other")), F.lit(0)), F.lit(0.0))
    found = found.where(reachable(F.array_distinct("known")))
    able = [product(F.col("known"), [r for r in weights if r["template"] == x]) ** 2 * (1 - similar**2) + 1e-6 >= similar**2 * o for x in sorted(up_to)]
    return found.where(reduce(Column.__or__, able)).select("path", "part", "terms").dropDuplicates(["path", "part"])


def notices(files: DataFrame, templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """path, license and score of the best notice of each file that has one, from path and text.

    Compared are every line of the whole text, every run of lines that a wrapped notice can fill, and license files as
    a whole. All terms weigh by the files that have them. Equal scores go to the license first in order. A license in
    HELD_BY gives way to the one whose text holds its own, if that is found too, whatever the scores; one in NEEDED is found only where its
    terms are. A file that states an SPDX
    expression at a line's start (after comment signs) has that expression as its license, with score 1; of several
    the first stated. A license's whole text is found by its sentences, which are templates of their own.
    """
    n = files.count()
    at = f"{shared_folder(files.sparkSession)}/terms-{uuid.uuid4()}"
    document_frequencies(files).write.parquet(at)  # compressed, unlike a checkpoint
    seen = files.sparkSession.read.parquet(at)
    weights = settle(template_weights(seen, n, templates))
    parts = candidates(files, weights.collect(), similar)
    tf = parts.select("path", "part", F.explode("terms").alias("term")).groupBy("path", "part", "term").agg(F.count("*").alias("tf"))
    of = weights.groupBy("term").agg(F.collect_list(F.struct("template", "weight")).alias("of"))
    both = tf.join(seen, "term").withColumn("x", F.col("tf") * inverse(n, F.col("df"))).join(F.broadcast(of), "term", "left")
    length = F.sqrt(F.sum(F.col("x") ** 2).over(W.partitionBy("path", "part")))
    dots = both.withColumn("length", length).where("of is not null").select("path", "part", "term", "x", "length", F.explode("of").alias("o"))
    names = templates.select("template", "license", F.try_element_at(text_map(NEEDED), F.col("license")).alias("needed"))
    dots = dots.withColumn("template", F.col("o.template")).join(F.broadcast(names), "template")
    has_needed = F.count_if(F.array_contains("needed", F.col("term"))) == F.coalesce(F.array_size(F.first("needed")), F.lit(0))
    score = F.round(F.sum(F.col("x") * F.col("o.weight")) / F.first("length"), 9)
    named = dots.groupBy("path", "part", "template", "license").agg(score.alias("score"), has_needed.alias("ok")).where((F.col("score") >= similar) & F.col("ok"))
    tag = F.regexp_extract("text", TAG, 1)
    stated = files.select("path", tag.alias("license"), F.lit(1.0).alias("score")).where("license <> ''")
    each = named.groupBy("path", "license").agg((-F.max("score")).alias("s")).unionByName(stated.select("path", "license", (-F.col("score")).alias("s")))
    holder = F.try_element_at(text_map(HELD_BY), F.col("license"))
    ranked = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("s", "license", holder.alias("holder")))).alias("found"))  # a row for each license
    names = F.transform("found", lambda x: x["license"])
    first = F.get(F.filter("found", lambda x: ~F.coalesce(F.array_contains(names, x["holder"]), F.lit(False))), F.lit(0))
    return ranked.select("path", first.alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def folder(path: Column) -> Column:
    """All before the last slash; the root, and what has no slash, is the empty string."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def is_license_file(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1).rlike(r"(?i)^(licen[cs]e|copying|notice)(\.\w+)?$")


def scan(files: DataFrame, templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """path, license, score, how and license_from for every row of files (path, text).

    A file's own notice comes first (how = header); else the notice of the license file in the nearest directory above
    it (how = inherited, license_from its path, the first by path of several); else all are null and how = none.
    Inheritance is settled once for each directory, so a directory that holds a third of all files costs no more than
    another. Null paths are in no directory, null and empty texts have no notice; rows with equal path share what is found.
    Whole texts are read, at a cost linear in their lines.
    """
    found = settle(notices(files, templates, similar))
    licensed = found.where(is_license_file(F.col("path"))).groupBy(folder(F.col("path")).alias("up")).agg(F.min(F.struct("path", "license", "score")).alias("own"))
    dirs = files.select(folder(F.col("path")).alias("dir")).where("dir is not null").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("up")))).alias("a"))
    nearest = above.select("dir", "a.depth", "a.up").join(licensed, "up").groupBy("dir").agg(F.max(F.struct("depth", "own")).alias("n")).select("dir", F.col("n.own").alias("own"))
    nearest = nearest.withColumnRenamed("dir", "own_dir")
    mine = found.select(F.col("path").alias("found_path"), "license", "score")
    rows = files.select("path", folder(F.col("path")).alias("dir"))
    rows = rows.join(mine, F.col("path") == F.col("found_path"), "left").join(nearest, F.col("dir") == F.col("own_dir"), "left")
    has = F.col("license").isNotNull()
    return rows.select(
        "path",
        F.coalesce("license", "own.license").alias("license"),
        F.coalesce("score", "own.score").alias("score"),
        F.when(has, "header").when(F.col("own").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~has, F.col("own.path")).alias("license_from"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source, thousands of the id, and for the second half of each hundred its hundreds.

    The first document of a directory by id, if there, is its LICENSE file. Without an id a document's name and place are
    those of a hash of its text.
    """
    i = F.coalesce("doc_id", F.xxhash64("text"))
    name = F.when(F.isnull("doc_id"), F.concat(F.lit("x"), F.hex(i), F.lit(".txt"))).when((i % 1000 == 0) | (i % 100 == 50), "LICENSE").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".txt")))
    parts = [F.coalesce("source", F.lit("none")), F.floor(i / 1000).cast("string"), F.when(i % 100 >= 50, F.floor(i % 1000 / 100).cast("string"))]
    return docs.select("doc_id", F.concat_ws("/", *parts, name).alias("path"), "text")


def scan_documents(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id and what scan() finds, each document a file of the tree of as_files().

    Nulls, empty and repeated rows as in scan(); rows with equal source and id are one path and share what is found in
    any of their texts. A null doc_id has a path by its text, so such rows are files of their own.
    """
    files = as_files(docs.select("doc_id", "source", "text"))
    found = scan(files.select("path", "text"), templates).dropDuplicates(["path"])
    return files.select("doc_id", F.col("path").alias("p")).join(found, F.col("p") == F.col("path")).select("doc_id", "path", "license", "score", "how", "license_from")


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template (a number), license and notice."""
    each = [F.struct(F.lit(k).alias("template"), F.lit(n).alias("license"), F.lit(x).alias("notice")) for k, (n, x) in enumerate(templates)]
    return spark.range(1).select(F.explode(F.array(*each)).alias("t")).select("t.*")
