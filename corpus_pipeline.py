"""The corpus pipeline: each stage reads what its predecessor has written, and returns a DataFrame.

Decisions are joined to the documents by doc_id. Rows that share a doc_id share a decision; rows without a doc_id are
one such group, except where a stage says otherwise. Null and empty texts,
extra columns and empty tables pass as each stage's operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored, table
from tickloom.llm.decontam import contaminated
from tickloom.llm.jaccard import jaccard_components
from tickloom.llm.packing import best_fit_packing
from tickloom.llm.passages import repeated_passages, without_passages
from tickloom.llm.quality import quality_rules
from tickloom.llm.queries import tokenizer_path


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) a row in ids(_id); a null doc_id equals a null _id."""
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), how).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; of rows that share a doc_id, all stay if one is kept."""
    kept = quality_rules(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return _by_id(docs, kept, "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays: the one with the smallest doc_id (rows without
    one come last) and, of texts that share it, the smallest hash; of rows that are equal in both, one stays.

    Documents without words are linked with nothing and stay.
    """
    rows = jaccard_components(docs)
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"), F.lit(True).alias("_once"))
    wordless = rows.where("component is null").select("doc_id", "text_hash", F.lit(False)).distinct()
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    kept = docs.withColumns({"_own": F.col("doc_id").cast("long"), "_text": F.xxhash64(F.col("text").cast("string"))}).join(first.union(wordless), same)
    once = kept.where("_once").dropDuplicates(["_own", "_text"])
    return once.unionByName(kept.where("not _once")).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document also holds are cut out of the text; documents that consist of them go."""
    return without_passages(docs, repeated_passages(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return _by_id(docs, found, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Near duplicates, windows and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
