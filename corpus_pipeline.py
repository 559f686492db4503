"""Training corpus from raw documents: five stages, each working on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import decontaminate, minhash, mixing, quality, toxicity
from barloom.llm.common import keyed, shared_folder, staged

#: SQL has no form for the learned stages; the stages are held against brute-force versions in tests
ORACLE_SQL = None


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows of `keyed` documents whose number isn't the doc_id of a row in gone; the number is dropped."""
    return rows.join(gone.select(F.col("doc_id").alias(name)), name, "left_anti").drop(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score below 0.3). Null and empty texts have scores too, whole texts count; rows without an
    id and repeated rows are judged one by one; extra columns are kept."""
    rows, name = keyed(docs)
    stats = staged(quality.measured(rows.select("doc_id", "text", name), name))
    model = quality.learned(stats, labels_of(spark, sf_dir))
    numbered = stats.select(F.col(name).alias("doc_id"), "stats")
    return without(rows, staged(quality.scored(numbered, model).where("predicted = 0").select("doc_id")), name)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (score of 0.7 or more). Nulls, empty and long texts, repeated rows and extra columns as in the
    stage before."""
    rows, name = keyed(docs)
    model = toxicity.learned(rows.select("doc_id", "text"), labels_of(spark, sf_dir))
    numbered = rows.select(F.col(name).alias("doc_id"), "text")
    return without(rows, staged(toxicity.scored(numbered, model).where("predicted = 1").select("doc_id")), name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id, null last, and
    one of its rows if the id repeats. Texts without words are no copies of each other; extra columns are kept."""
    rows, name = keyed(docs)
    found = minhash.near_duplicates(rows.select(name, "text"), id_col=name).select(F.col("doc_id").alias(name), "component_id")
    named = staged(found.join(rows.select(name, F.col("doc_id").alias("id")), name))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", name)).alias("first")).select(f"first.{name}")
    return without(rows, staged(named.join(staged(first), name, "left_anti").select(F.col(name).alias("doc_id"))), name)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with benchmark items; those with nothing else go."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the mix of what is left."""
    return mixing.mixed(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near duplicates", one_of_each), ("decontamination", decontaminated), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
