"""Query logs in exploded form: names, tables and group lists as rows that join with catalogs.

Dictionaries and catalogs join without a hint: Catalyst broadcasts them while their known size
is below its threshold and falls back to a shuffle join beyond it.

The generators are outer ones, followed by a filter: for an inner one Catalyst would add a "not
empty" filter on the array, push it to the scan and so compute the whole text analysis twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellward.functions import statements as st
from cellward.operators.verdicts import column_uses, read_statements, table_names
from cellward.policy import Policy
from cellward.sources.vocabulary import DEFAULT, Vocabulary


def identifier_rows(log: DataFrame) -> DataFrame:
    """One row per name in a text: ``request_id, ordinal, clause, token, name, is_function``."""
    return (
        read_statements(log)
        .select("request_id", F.posexplode_outer("_ids").alias("ordinal", "_i"))
        .where(F.col("_i").isNotNull())
        .select("request_id", "ordinal", "_i.*")
    )


def prohibited_rows(identifiers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names that the dictionary prohibits (semi join). Functions only count as date parts."""
    names = dictionary.where(~F.col("allowed")).select(F.col("name").alias("_name"), "category")
    hit = (F.col("name") == F.col("_name")) & (
        ~F.col("is_function") | (F.col("category") == "date")
    )
    return identifiers.join(names, hit, "left_semi")


def name_usage(log: DataFrame) -> DataFrame:
    """How often each name is used as a column or table, over the whole log."""
    names = identifier_rows(log).where(~F.col("is_function"))
    return names.groupBy("name").agg(F.count("*").alias("n_uses"))


def group_by_rows(log: DataFrame) -> DataFrame:
    """Group list items: ``request_id, ordinal, item``."""
    items = F.posexplode_outer(st.group_by_columns(F.col("_lists")))
    return (
        read_statements(log)
        .select("request_id", items.alias("ordinal", "item"))
        .where(F.col("item").isNotNull())
    )


def check_group_by(
    log: DataFrame,
    catalog: DataFrame,
    vocab: Vocabulary = DEFAULT,
    *,
    policy: Policy = Policy(),
) -> DataFrame:
    """Every group list item with its status: ``ok``, ``person_key``, ``expression``,
    ``prohibited`` or ``unknown`` (in none of the query's tables)."""
    items = (
        read_statements(log)
        .select(
            "request_id",
            table_names().alias("_tables"),
            F.posexplode_outer(st.group_by_columns(F.col("_lists"))).alias("ordinal", "item"),
        )
        .where(F.col("item").isNotNull())
        .withColumn("_name", st.item_name(F.col("item")))
    )
    homes = catalog.groupBy(F.col("column_name").alias("_name")).agg(
        F.collect_set("table_name").alias("_homes")  # at most the catalog's number of tables
    )
    status = (
        F.when(st.names_person(F.col("item")), "person_key")
        .when(~st.is_plain_column(F.col("item")), "expression")
        .when(F.col("_name").isin(*vocab.prohibited(policy.strict)), "prohibited")
        .when(F.coalesce(F.arrays_overlap("_tables", "_homes"), F.lit(False)), "ok")
        .otherwise("unknown")
    )
    return items.join(homes, "_name", "left").select(
        "request_id", "ordinal", "item", status.alias("status")
    )


def unknown_tables(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables that the approved schema does not have (E101)."""
    used = read_statements(log).select(
        "request_id", F.explode_outer(table_names()).alias("table_name")
    )
    used = used.where(F.col("table_name").isNotNull())
    return used.join(catalog.select("table_name"), "table_name", "left_anti")


def unknown_columns(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns that their table does not have, or none of the query's tables if they are not
    qualified (E102)."""
    used = read_statements(log).select("request_id", F.explode_outer(column_uses()).alias("_use"))
    used = used.where(F.col("_use").isNotNull()).select("request_id", "_use.name", "_use.homes")
    known = catalog.select("table_name", F.col("column_name").alias("_column"))
    found = (F.col("name") == F.col("_column")) & F.array_contains(F.col("homes"), F.col("table_name"))
    missing = used.join(known, found, "left_anti")
    return missing.select("request_id", F.col("name").alias("column_name"))
