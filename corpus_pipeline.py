"""The corpus pipeline: quality classifier, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last adds slot and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import bm25_decontam, jaccard_join, quality_gam, sharding, source_mix
from inkloom.llm._common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model, at_least=0.5).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that with the smallest id, then the least hash of its text. Rows without an id or without words stay.

    Texts, not ids, are linked, so a row goes only for its own text, and of exactly repeated rows one stays. Rows are found
    by the hash of their text in a list of texts that go or occur several times; it is broadcast if it is small.
    """
    digest = F.when(F.col("doc_id").isNotNull(), F.xxhash64("text"))
    texts = jaccard_join.join_components(docs.select(digest.alias("__text_hash"), "text"), "__text_hash").where("n_shingles > 0 and doc_id is not null")
    part = texts.select(F.col("doc_id").alias("__hash"), "component_id").distinct()
    seen = docs.groupBy(digest.alias("__hash")).agg(F.min("doc_id").alias("__id"), F.count("*").alias("__n"))
    placed = cut(seen.join(part, "__hash"), "texts")
    # Joined by the hash of the text, so the texts of a large component don't meet in one task.
    kept = placed.groupBy("component_id").agg(F.min(F.struct("__id", "__hash")).alias("kept")).select("kept.__hash", "kept.__id")
    found = placed.select("__hash", "__n").join(kept, "__hash", "left")
    listed = cut(found.where("__id is null or __n > 1"), "listed")
    marked = docs.withColumn("__hash", digest)
    single = marked.join(listed.select("__hash"), "__hash", "left_anti")
    several = listed.where("__id is not null").select("__hash", "__id")
    first = marked.join(several, "__hash").where(F.col("doc_id") == F.col("__id")).dropDuplicates(["__hash"])
    return single.select(*docs.columns).unionByName(first.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return bm25_decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice."""
    return source_mix.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return sharding.place(docs, "doc_id", spread=["text"], split_hot=True)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier is fitted by boosting, which SQL can't express; a test holds run() against its stages done by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
