"""A corpus pipeline: quality, toxicity, near-duplicates, benchmark leaks, packing. Each stage reads what the one before kept.

Defined cases, in any stage: a null text counts as empty, and null and blank texts are near-duplicates of each other, so that one
stays; documents without an id are kept or dropped by their text like any others; rows equal in id and text become one row in the
near-duplicate stage, and an id with several texts is decided text by text; texts of any length are worked on whole, one at a
time beyond a few MB; without labels of both kinds a classifier gives every document one score, so that all stay or go alike;
an empty table gives empty tables; further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm import decontam, packing, quality, simhash, toxicity
from streakframe.llm.common import drop_folder, fresh, new_folder, remainder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(spark, docs, labels, "quality", remainder("doc_id", 5) != 0)
    name = fresh("score", docs.columns)
    return quality.score(docs, model, docs.columns, name).where(F.col(name) >= 0.3).select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(spark, docs, labels, "toxic", remainder("doc_id", 3) != 1)
    name = fresh("score", docs.columns)
    return toxicity.score(docs, model, docs.columns, name).where(F.col(name) < 0.7).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: three fingerprints of a text's words."""
    return simhash.keep_one(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    # workers and the JVM still hold what earlier stages took
    cut = packing.pieces(docs, "byte_bpe_50k.json", end=0, share=0.25)
    return packing.pack(spark, cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models and fingerprints have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; between stages the rows are written and read again, and then go."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
