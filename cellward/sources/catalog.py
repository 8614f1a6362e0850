"""The approved clinical schema: 13 tables of the public OMOP CDM 5.4, as DDL strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellward.session import literal_table
from cellward.sources.vocabulary import DEFAULT, Vocabulary

SCHEMA_NAME = "OMOP 5.4"

# Table and column names of the model (the types are ours).
TABLES = {
    "person": """person_id bigint, gender_concept_id bigint, year_of_birth int,
        month_of_birth int, day_of_birth int, birth_datetime timestamp, race_concept_id bigint,
        ethnicity_concept_id bigint, location_id bigint, provider_id bigint,
        care_site_id bigint, person_source_value string, gender_source_value string,
        race_source_value string, ethnicity_source_value string""",
    "observation_period": """observation_period_id bigint, person_id bigint,
        observation_period_start_date date, observation_period_end_date date,
        period_type_concept_id bigint""",
    "visit_occurrence": """visit_occurrence_id bigint, person_id bigint,
        visit_concept_id bigint, visit_start_date date, visit_start_datetime timestamp,
        visit_end_date date, visit_end_datetime timestamp, visit_type_concept_id bigint,
        provider_id bigint, care_site_id bigint, visit_source_value string,
        admitted_from_concept_id bigint, discharged_to_concept_id bigint""",
    "condition_occurrence": """condition_occurrence_id bigint, person_id bigint,
        condition_concept_id bigint, condition_start_date date,
        condition_start_datetime timestamp, condition_end_date date,
        condition_end_datetime timestamp, condition_type_concept_id bigint,
        condition_status_concept_id bigint, stop_reason string, provider_id bigint,
        visit_occurrence_id bigint, condition_source_value string,
        condition_source_concept_id bigint""",
    "drug_exposure": """drug_exposure_id bigint, person_id bigint, drug_concept_id bigint,
        drug_exposure_start_date date, drug_exposure_start_datetime timestamp,
        drug_exposure_end_date date, drug_exposure_end_datetime timestamp,
        drug_type_concept_id bigint, stop_reason string, refills int, quantity double,
        days_supply int, sig string, route_concept_id bigint, lot_number string,
        provider_id bigint, visit_occurrence_id bigint, drug_source_value string,
        drug_source_concept_id bigint""",
    "procedure_occurrence": """procedure_occurrence_id bigint, person_id bigint,
        procedure_concept_id bigint, procedure_date date, procedure_datetime timestamp,
        procedure_end_date date, procedure_end_datetime timestamp,
        procedure_type_concept_id bigint, modifier_concept_id bigint, quantity double,
        provider_id bigint, visit_occurrence_id bigint, procedure_source_value string,
        procedure_source_concept_id bigint""",
    "measurement": """measurement_id bigint, person_id bigint, measurement_concept_id bigint,
        measurement_date date, measurement_datetime timestamp,
        measurement_type_concept_id bigint, operator_concept_id bigint,
        value_as_number double, value_as_concept_id bigint, unit_concept_id bigint,
        range_low double, range_high double, provider_id bigint, visit_occurrence_id bigint,
        measurement_source_value string, measurement_source_concept_id bigint,
        unit_source_value string""",
    "observation": """observation_id bigint, person_id bigint, observation_concept_id bigint,
        observation_date date, observation_datetime timestamp,
        observation_type_concept_id bigint, value_as_number double, value_as_string string,
        value_as_concept_id bigint, qualifier_concept_id bigint, unit_concept_id bigint,
        provider_id bigint, visit_occurrence_id bigint, observation_source_value string,
        observation_source_concept_id bigint, unit_source_value string""",
    "death": """person_id bigint, death_date date, death_datetime timestamp,
        death_type_concept_id bigint, cause_concept_id bigint, cause_source_value string,
        cause_source_concept_id bigint""",
    "location": """location_id bigint, address_1 string, address_2 string, city string,
        state string, zip string, county string, country string, latitude double,
        longitude double, location_source_value string""",
    "care_site": """care_site_id bigint, care_site_name string,
        place_of_service_concept_id bigint, location_id bigint,
        care_site_source_value string""",
    "provider": """provider_id bigint, provider_name string, npi string, dea string,
        specialty_concept_id bigint, care_site_id bigint, year_of_birth int,
        gender_concept_id bigint, provider_source_value string,
        specialty_source_value string""",
    "concept": """concept_id bigint, concept_name string, domain_id string,
        vocabulary_id string, concept_class_id string, standard_concept string,
        concept_code string, valid_start_date date, valid_end_date date,
        invalid_reason string""",
}

CATALOG_DDL = (
    "table_name string, column_name string, ordinal int, prohibited boolean, reason string"
)


def table_schema(name: str) -> StructType:
    """For ``spark.read.schema(...)``."""
    return StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, path: str, name: str, format: str = "parquet", **options):
    """A clinical table with its approved schema (no inference, columns by name)."""
    return spark.read.schema(table_schema(name)).format(format).options(**options).load(path)


def catalog_columns(tables=TABLES) -> dict[str, list[str]]:
    return {t: [part.split()[0] for part in ddl.split(",")] for t, ddl in tables.items()}


def column_catalog(
    spark: SparkSession, vocab: Vocabulary = DEFAULT, tables=TABLES
) -> DataFrame:
    """One row per approved column; ``reason`` is the category that prohibits it."""
    reason = {n: c for c in ("date", "geographic", "direct") for n in vocab.names(c)}
    rows = [
        (table, column, ordinal, column in reason, reason.get(column))
        for table, columns in catalog_columns(tables).items()
        for ordinal, column in enumerate(columns)
    ]
    return literal_table(spark, rows, CATALOG_DDL)


def catalog_gap(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Columns the catalog prohibits although the name lists miss them."""
    listed = [(n,) for n in sorted(vocab.prohibited(strict=False))]
    return (
        column_catalog(spark, vocab)
        .where("prohibited")
        .join(literal_table(spark, listed, "column_name string"), "column_name", "left_anti")
        .select("table_name", "column_name", F.col("reason").alias("category"))
    )
