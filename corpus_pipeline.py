"""A training corpus in five stages, each an operator of sievework.llm, from the table documents to a list of shards.

The rows of each stage are written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import decontaminate, mix, shard, simhash, toxicity
from sievework.llm.common import remove_folder, shared_folder, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    A null text is empty and scores as no evidence; rows with null or repeated ids are judged by their own texts. Columns and
    all other rows stay as they are; no rows give no rows.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id stays.

    Texts without words, null and empty, are one group. A null id is larger than any other; rows with null or repeated ids
    stay if their texts are in different groups; of equal rows one stays. Columns stay as they are; no rows give no rows.
    """
    return simhash.keep_one(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go.

    Null and empty texts have no words and stay; rows with null or repeated ids go by their own texts. Columns and repeated
    rows stay as they are; no rows give no rows.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says.

    A null source is one of its own; texts without words, null among them, have size 0 and are copied like the rest of their
    source; rows with equal or null ids draw alike. Columns stay as they are; no rows give no rows.
    """
    return mix.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every copy.

    A null text has size 1; copies of a text share a shard unless their group is too large for the balance. Only what
    places a document is returned; no rows give no rows.
    """
    return shard.shard_by_bytes(docs)


STAGES = [("toxicity", clean), ("simhash", unique), ("decontamination", untested), ("mixing", mixed), ("sharding", sharded)]

#: A trained network decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")  # only the last stage's rows are read from here on
    return docs
