"""A corpus pipeline of five stages over documents; each stage is written as Parquet and read again.

Language identification, near-duplicate removal, benchmark decontamination, mixing of sources, sharding. Every stage
works on all that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, language, mixing, sharding, simhash
from tidelog.llm.common import bounded_broadcast, discard, written

#: Documents in which less than this share of the words is in one language are rejected, as are those without letters.
LEAST_LANGUAGE = 0.3


def released(spark: SparkSession) -> None:
    """Frees what stages before have left in the driver: Spark cleans up shuffles, broadcasts and plans only once both
    sides of the driver have collected them, which may not happen for long while there is room in its heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words have a language. Null and empty texts and those without letters go; a null doc_id stays."""
    released(spark)
    told = language.learn_and_identify(docs, F.lit(True), names=("_lang_pred", "_lang_score"))
    return told.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_LANGUAGE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least doc_id (null first), then of the least text hash.

    Texts of no words are a group; rows that repeat a doc_id and its text leave one. An empty table stays empty.
    """
    released(spark)
    comp = written(simhash.similar_documents(docs))
    stay = comp.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("one")).select(F.col("one.doc_id").alias("_at"), F.col("one.h").alias("_at_h"))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.withColumn("_h", h).join(stay, F.col("doc_id").eqNullSafe(F.col("_at")) & (F.col("_h") == F.col("_at_h")), "left_semi")
    # rows that repeat a doc_id and its text cannot be told apart; only where there are any is one of them picked
    again = comp.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "_h"]) if again else kept).select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by doc_id and text: others of the same doc_id, or of none, stay.

    Null and empty texts hold none; rows that repeat a leaking one go with it; with an empty benchmark all stay.
    """
    released(spark)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", "text", h.alias("_h"))
    found = decontaminate.leaks(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("_h",))
    bad = written(found.select(F.col("doc_id").alias("_at"), F.col("_h").alias("_at_h")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_at")) & (F.col("_h") == F.col("_at_h"))
    return docs.withColumn("_h", h).join(bounded_broadcast(bad), same, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times.

    Rows are told apart by all their columns. Rows that are equal in all are one row that is written as often as they are
    taken together, so that the stage's words are the mix's. Null texts have no words; an empty table stays empty.
    """
    released(spark)
    row = F.xxhash64(F.lit(23), *[F.col(c) for c in docs.columns])
    taken = mixing.mix(docs.withColumn("_row", row).withColumn("_row2", F.xxhash64(F.lit(24), *[F.col(c) for c in docs.columns])), keep=("_row", "_row2")).filter("copies > 0")
    taken = written(taken.groupBy("_row", "_row2").agg(F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")))
    both = docs.withColumn("_row", row).withColumn("_row2", F.xxhash64(F.lit(24), *[F.col(c) for c in docs.columns]))
    if taken.filter("_rows > 1").limit(1).count():
        both = both.dropDuplicates(["_row", "_row2"])
    return both.join(taken, ["_row", "_row2"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every document; what is null or empty or repeats has a place like any other."""
    released(spark)
    return sharding.shard(docs)


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: Trained models and hash-based groups are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
