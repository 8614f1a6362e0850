"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what the next
one reads. All but the last return the columns of ``documents``. Nulls, empty tables and further
columns are handled as the operators say; further columns pass through, and a clashing name that
an operator makes for itself never leaves its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm import common, language, mixing, packing, pii, simhash

#: Documents whose best language is less sure than this are rejected, and those without letters.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language; ``lang`` becomes what was identified."""
    found = language.identify(docs, language.train(docs))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose SimHashes of three-word shingles are linked at 2 or fewer differing bits, the one with the
    smallest ``doc_id`` stays, of several with that id the first.

    Each row has a key of its own, its place in the table as it is read, so rows with a null id (after all others),
    repeated rows and different texts under one id are each judged by their text.
    """
    rows = docs.withColumn("_row_key", F.monotonically_increasing_id())
    groups = simhash.simhash_components(rows.select(F.col("_row_key").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_row_key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key")
    first = rows.select("_row_key", "doc_id").join(groups, "_row_key").groupBy("component_id").agg(F.min(order)["_row_key"].alias("_row_key"))
    return rows.join(first, "_row_key", "left_semi").select(*[docs[c] for c in docs.columns])


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data become their kind in brackets."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with their calibrated chances."""
    return mixing.mix(docs).where("kept").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence."""
    return packing.digest(packing.pack(docs, packing.default_tokenizer()))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, similarity and packing are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
