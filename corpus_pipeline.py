"""A training-data pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the next docs. run()
applies them to `documents`, writing each result to the shared folder and reading it again. Every stage but the
last keeps all columns, whatever their names and types. An empty table stays empty, texts of any length are
read whole, and no stage needs a rule for ties but near_duplicates, which states it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.llm.decontaminate import without_leaks
from covara.llm.jaccard import set_hashes
from covara.llm.mixing import mix_sources
from covara.llm.quality import quality_verdict
from covara.llm.secrets import redact_secrets
from covara.llm.simhash import near_duplicates
from covara.llm.tables import copied, materialise, remove_folder, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, null and empty texts among them; repeated rows are judged each."""
    return docs.filter(quality_verdict(F.col("text")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id.

    Null and empty texts are copies of each other. A group without any doc_id keeps one of its rows with the smallest hash of its
    shingles. Where several rows have the kept doc_id and equal shingles, the one least as JSON stays, so reruns
    agree; rows of one doc_id with texts of different groups stay each. Texts are not shuffled while the dropped ids are few
    enough to be copied.
    """
    found = materialise(near_duplicates(docs).select("doc_id", "fp", "first"))
    ids = materialise(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("first").alias("first")))
    odd = ids.filter("n > 1").select("doc_id")
    gone = materialise(ids.filter("n > 1 or not first").select("doc_id"))
    kept = docs.filter("doc_id is not null").join(copied(gone), "doc_id", "left_anti").select(*docs.columns)
    if odd.isEmpty() and found.filter("doc_id is null").isEmpty():
        return kept
    # rows that their doc_id alone does not name: by doc_id and hash of the shingles
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unnamed = named.filter("doc_id is null").unionByName(named.join(copied(odd), "doc_id", "left_semi").select("row", "doc_id", "text"))
    first = found.filter("first").select(F.col("doc_id").alias("id"), F.col("fp").alias("hash")).distinct()
    unnamed = unnamed.select("row", F.col("doc_id").alias("id"), set_hashes(F.col("text")).alias("hash"))
    some = unnamed.join(first, unnamed["id"].eqNullSafe(first["id"]) & (unnamed["hash"] == first["hash"]), "left_semi")
    one = some.groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(one.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row in which a benchmark item is found. Null and empty texts hold none; repeated rows are judged each, rows without doc_id too."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay, repeated rows too, null texts as they are."""
    return redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null texts have none, a null source is one of its own, repeated rows count each."""
    return mix_sources(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("mixing", mixing_stage)]

#: The stages hold compression ratios, hashes and edit distances, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir; the results before it are deleted as soon as the next one is written."""
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
