"""A training corpus from ``documents``: toxic texts out, exact copies out, near copies out, sources mixed, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; rows that a stage drops are gone from there on.
Rows with a null id are documents like others, but link with nothing; other columns than doc_id, text and source only
pass through; an empty table passes through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from traceloom.llm.common import held_out, materialize, read, scratch_dir
from traceloom.llm.hashing import without
from traceloom.scratch import drop, scratch_tables


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labelled rows that are not held out."""
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, the one with the smallest doc_id stays."""
    linked = ngram_join.jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, materialize(linked, "linked"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows meet their numbers of copies by id and
    the text's hash, so that null ids are no hot key; rows that repeat both get their numbers by a count of rows."""
    mixed = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("copies").cast("int").alias("_copies"))
    taken = mixed.groupBy("_id", "_hash").agg(F.sort_array(F.collect_list("_copies")).alias("_copies")).where("exists(_copies, c -> c > 0)")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_rid"), F.xxhash64("text").alias("_rhash"))
    met = rows.join(taken, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rhash") == F.col("_hash")))
    same = Window.partitionBy("_rid", "_rhash").orderBy("_rid")
    several = met.where(F.size("_copies") > 1).withColumn("_n", F.element_at("_copies", F.row_number().over(same)))
    single = met.where(F.size("_copies") == 1).withColumn("_n", F.element_at("_copies", 1))
    copies = F.explode(F.sequence(F.lit(1), F.col("_n")))
    return single.unionByName(several).where("_n > 0").select("_row", copies).select("_row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with what op3 says of them."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, vocabulary, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Trees, similarity components and merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input, and what it wrote on its way, is deleted once its output stands."""
    docs, before = read(spark, sf_dir, "documents"), None
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
