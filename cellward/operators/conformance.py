"""Checks of data tables: prohibited columns, approved schema, foreign keys, output characters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellward.functions import characters as chars
from cellward.session import literal_table
from cellward.sources.vocabulary import DEFAULT, Vocabulary, phi_dictionary


def _columns_table(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = [
        (table, column, column.lower().replace("-", "_"))
        for table, df in tables.items()
        for column in df.columns
    ]
    return literal_table(spark, rows, "table_name string, column_name string, name string")


def scan_catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """Prohibited columns of the given tables, with the number of values they expose.

    Each table is read once, and only its prohibited columns are read.
    """
    dictionary = phi_dictionary(spark, vocab).where(~F.col("allowed"))
    found = _columns_table(spark, tables).join(dictionary, "name")
    exposed = []
    for table, df in tables.items():
        flagged = [
            c for c in df.columns if c.lower().replace("-", "_") in vocab.prohibited()
        ]
        if flagged:
            counts = df.agg(
                F.count("*").alias("_rows"),
                *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(flagged)],
            )
            entries = F.array(
                *[
                    F.struct(
                        F.lit(table).alias("table_name"),
                        F.lit(c).alias("column_name"),
                        F.col("_rows").alias("n_rows"),
                        F.col(f"_n{i}").alias("n_values"),
                    )
                    for i, c in enumerate(flagged)
                ]
            )
            exposed.append(counts.select(F.inline(entries)))
    if not exposed:
        return found.select(
            "table_name", "column_name", "category", "identifier_type", "source",
            F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_values"),
        )
    values = reduce(DataFrame.unionByName, exposed)
    return found.join(values, ["table_name", "column_name"]).select(
        "table_name", "column_name", "category", "identifier_type", "source",
        "n_rows", "n_values",
    )


def conformance(
    spark: SparkSession, tables: Mapping[str, DataFrame], catalog: DataFrame
) -> DataFrame:
    """Every difference between tables and the approved schema, with the table's row count.

    ``unknown_table``/``unknown_column``: in the data only; ``missing_column``: approved for a
    table that is present, but not in it.
    """
    have = _columns_table(spark, tables).withColumnRenamed("name", "_name")
    approved = catalog.select("table_name", F.col("column_name").alias("_name"))
    known_tables = catalog.select("table_name").distinct()
    surplus = have.join(approved, ["table_name", "_name"], "left_anti")
    unknown_column = surplus.join(known_tables, "table_name", "left_semi").select(
        "table_name", "column_name", F.lit("unknown_column").alias("status")
    )
    unknown_table = surplus.join(known_tables, "table_name", "left_anti").select(
        "table_name", "column_name", F.lit("unknown_table").alias("status")
    )
    missing = (
        approved.join(have.select("table_name").distinct(), "table_name", "left_semi")
        .join(have, ["table_name", "_name"], "left_anti")
        .select(
            "table_name",
            F.col("_name").alias("column_name"),
            F.lit("missing_column").alias("status"),
        )
    )
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(table))
            for table, df in tables.items()
        ],
    )
    return unknown_table.unionByName(unknown_column).unionByName(missing).join(
        counts, "table_name"
    )


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str):
    """Keys of the child without a parent, and the rows that use them (null is no reference).

    The child is first counted per key, so a key held by very many rows joins as one row.
    """
    keys = (
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("key"))
        .agg(F.count("*").alias("_n"))
    )
    parents = parent.select(F.col(parent_key).alias("key"))
    return keys.join(parents, "key", "left_anti").agg(
        F.count("*").alias("orphan_keys"),
        F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("orphan_rows"),
    )


def scan_output_ascii(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Result cells with a forbidden character, counted per string column in one pass."""
    names = list(cols or [f.name for f in df.schema if isinstance(f.dataType, StringType)])
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.col(f"`{c}`")).alias("n_cells"),
                F.count(F.when(F.col(f"`{c}`").rlike(chars.FORBIDDEN), True)).alias("n_bad"),
                F.coalesce(
                    F.max(F.col(f"`{c}`").rlike(chars.FORBIDDEN)), F.lit(False)
                ).alias("has_bad"),
            )
            for c in names
        ]
    )
    return df.agg(entries.alias("_e")).select(F.inline("_e"))


def ascii_positions(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """One row per forbidden character: key columns, 0-based position, character, code point.

    Clean texts are filtered out first; the characters stream through the generator, so no row
    holds its whole result. (An inner generator would split each text twice, see log_tables.)
    """
    return (
        df.where(F.col(text).rlike(chars.FORBIDDEN))
        .select(*key, F.posexplode_outer(F.split(F.col(text), "")).alias("position", "character"))
        .where(F.col("character").rlike(chars.FORBIDDEN))
        .withColumn("code_point", F.ascii("character"))
    )


def character_profile(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Characters per class of a text column, optionally per group."""
    counted = df.select(*by, chars.class_counts(F.col(text)).alias("_c"))
    names = ["printable", "control_allowed", "control_forbidden", "non_ascii"]
    sums = counted.groupBy(*by).agg(*[F.sum(f"_c.{n}").alias(n) for n in names])
    return sums.unpivot(list(by), names, "char_class", "n_chars")
