"""A corpus from raw documents to packed batches, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import contamination, jaccard, packing, quality, suffixes
from quillon.llm.shared import Shelf, table

#: Keys of removed rows that are broadcast, about 8 bytes each; more are joined by exchange.
BROADCAST_IDS = 1_000_000
KEY = "near_duplicate_key"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: of good quality and not toxic."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, model, carry=docs.columns)
    return judged.where(F.col("keep")).select(*(F.col(c + "_" * (c in quality.SCORES)).alias(c) for c in docs.columns))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, KEY, "left_anti")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least doc_id, of each group of near duplicates; rows without an id come last, texts without a word stay.

    Rows are told apart by a hash of doc_id and text, so rows that share a doc_id but not the text are judged apart. Of rows
    that agree in both any one stays; only these are exchanged with their texts.
    """
    shelf, keyed = Shelf(spark, "near-duplicates"), docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    found = jaccard.near_duplicates(keyed, id_col=KEY).where("n_shingles > 0").groupBy(F.col("doc_id").alias(KEY), "component_id").agg(F.count("*").alias("times"))
    placed = shelf.put(found.join(keyed.select(KEY, "doc_id").distinct(), KEY), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", KEY))[KEY].alias("first")
    groups = shelf.put(placed.groupBy("component_id").agg(first, F.count("*").alias("n")).where("n > 1").select("component_id", "first"), "groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups  # a large group's rows needn't meet
    others = shelf.put(placed.join(groups, "component_id").where(F.col(KEY) != F.col("first")).select(KEY), "others")
    kept = _without(keyed, others)
    repeated = shelf.put(placed.where("times > 1").select(KEY).join(others, KEY, "left_anti"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, KEY, "left_semi").dropDuplicates([KEY])
    return _without(kept, repeated).union(once.select(*kept.columns)).select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes and more that stand anywhere else."""
    cut = suffixes.cut_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a batch."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    shelf, docs = Shelf(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = shelf.put(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
