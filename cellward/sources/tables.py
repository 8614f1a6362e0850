"""The given tables, and the clinical tables they stand for.

``customer`` plays person, ``orders`` condition_occurrence, ``lineitem`` drug_exposure and
``nation``/``region`` location. Columns that the given tables lack (birth year, age, ZIP) are
derived from keys by plain arithmetic, so that SQL can derive the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the identifiers still in it; ``safe_view`` takes them out."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("person_id"),
        F.col("c_name").alias("patient_name"),
        F.col("c_mktsegment").alias("gender_concept_id"),
        (1920 + key % 90).cast("int").alias("year_of_birth"),
        (1 + key % 12).cast("int").alias("month_of_birth"),
        (key % 5).alias("race_concept_id"),
        (key % 3).alias("ethnicity_concept_id"),
        F.col("c_nationkey").cast("long").alias("location_id"),
        (2024 - (1920 + key % 90)).cast("int").alias("age"),
        # three ZIP areas of different size, and one malformed code
        F.when(key % 97 == 0, "n/a")
        .otherwise(
            F.format_string(
                "%03d%02d",
                F.when(key % 10 < 6, 100).when(key % 10 < 9, 200).otherwise(300 + key % 7),
                key % 100,
            )
        )
        .alias("zip"),
        F.col("c_acctbal").alias("balance"),
    )


def condition_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("condition_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderpriority").alias("condition_concept_id"),
        F.col("o_orderdate").alias("condition_start_date"),
        F.col("o_orderstatus").alias("condition_status_concept_id"),
        F.col("o_totalprice").alias("cost"),
    )


def drug_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("visit_occurrence_id"),
        F.col("l_partkey").alias("drug_concept_id"),
        F.col("l_shipdate").alias("drug_exposure_start_date"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_suppkey").alias("provider_id"),
    )


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation: state level and above."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("location_id"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("country"),
    )


CLINICAL = {
    "person": person,
    "condition_occurrence": condition_occurrence,
    "drug_exposure": drug_exposure,
    "location": location,
}
