"""Corpus pipeline: raw documents become encoded training data in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before
kept; all but the last return the columns of documents. Decisions of a stage are joined
to the documents by a hash of the whole row, so rows that repeat are decided alike.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoledger.llm import bpe, jaccard, langid, mixing, toxicity
from duoledger.llm.common import shared_dir, small, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows up to which a stage's decisions are broadcast; more are joined by shuffle.
BROADCAST = 1_000_000


def _row() -> Column:
    return F.xxhash64("doc_id", "text", "lang", "source")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the rows (hash row) that are rejected."""
    return docs.withColumn("row", _row()).join(small(stored(rejected.select("row").distinct(), "rejected"), BROADCAST), "row", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; texts without a quarter of letters, or of no likely language, go."""
    rows = langid.documents_as_rows(docs.select(*COLUMNS)).withColumn("row", F.xxhash64("doc_id", "text", "declared", "host")).drop("doc_id")
    return _without(docs, langid.identify(rows).where(~F.col("accepted")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    scored = toxicity.score(docs.withColumn("row", _row()), "row", "text", toxicity.model_of(spark, docs, sf_dir))
    return _without(docs, scored.where("score >= 0.7").select(F.col("id").alias("row")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard 0.8 of five-word shingles: that of the smallest id, and of rows of one id the one of the least hash.

    Rows are told apart by their hash, so different texts under one id are documents of
    their own; rows that repeat are one. Rows without an id stay.
    """
    rows = docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), _row()))
    found = stored(jaccard.similar(rows, "row", "text", 5, 80, 100).where("id is not null").groupBy(F.col("id").alias("row")).agg(F.min("component_id").alias("component"), F.count("*").alias("times")), "groups")
    many = found.groupBy("component").agg(F.count("*").alias("rows")).where("rows > 1").select("component")
    members = stored(found.join(small(stored(many, "many"), BROADCAST), "component", "left_semi").select("row", "component"), "members")
    ids = rows.select("row", "doc_id").join(small(members, BROADCAST), "row").groupBy("component").agg(F.min_by("row", F.struct("doc_id", "row")).alias("first"))
    gone = stored(members.join(ids, "component").where("row <> first").select("row"), "gone")
    kept = rows.join(small(gone, BROADCAST), "row", "left_anti")
    again = stored(found.where("times > 1").select("row"), "again")
    if again.limit(1).count():
        again = small(again, BROADCAST)
        kept = kept.join(again, "row", "left_anti").unionByName(kept.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a row that repeats, as often as all its repeats together."""
    mixed = mixing.mix(docs.withColumn("row", _row()), "row", "text", "source").groupBy(F.col("id").alias("row"))
    taken = stored(mixed.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "taken")
    rows = docs.withColumn("row", _row()).join(small(taken, BROADCAST), "row")
    if taken.where("rows > 1").limit(1).count():
        rows = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["row"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document taken."""
    done = bpe.encode(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("toxicity", toxic), ("ngram_jaccard", near_duplicates), ("mixing", mixture), ("bpe", encoded)]
#: SQL cannot express the stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark).rstrip('/')}/duoledger/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
