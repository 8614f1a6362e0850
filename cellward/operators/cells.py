"""Guarded aggregates: grouped results whose cells cover enough distinct persons.

The count is exact - a privacy threshold must not be estimated. Spark plans one distinct count
as two aggregations, first by (dimensions, person) and then by dimensions, both combined before
their shuffle: a cell that holds a third of all rows is spread over its persons, and a person
who holds a third of all rows collapses before the shuffle. The threshold filter refers to the
aggregate's output, so no predicate of a caller can move above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellward.policy import COUNT_ALIAS, MIN_PATIENT_COUNT, PERSON_COLUMN, GuardError

# The aggregates allowed beside the person count (sample versions).
AGGREGATES = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
}


def patient_count(person_col: str = PERSON_COLUMN) -> Column:
    return F.count_distinct(F.col(person_col)).alias(COUNT_ALIAS)


def _check_dimensions(df: DataFrame, dims: Sequence[str], person_col: str):
    known = {c.lower() for c in df.columns}
    for dim in dims:
        if dim.lower() == person_col.lower():
            raise GuardError("E305", f"cannot group by the person key '{dim}'")
        if dim.lower() not in known:
            raise GuardError("E305", f"cannot group by '{dim}': no such column")


def cell_counts(df: DataFrame, dims: Sequence[str], *, person_col: str, aggs=()) -> DataFrame:
    """All cells with their person count, before the threshold (internal, not for release)."""
    _check_dimensions(df, dims, person_col)
    extra = [
        AGGREGATES[function.lower()](column).alias(name) for name, function, column in aggs
    ]
    for name, function, column in aggs:
        if name.lower() == COUNT_ALIAS.lower():
            raise GuardError("E303", f"'{name}' is reserved for the person count")
        if column.lower() == person_col.lower() and function.lower() != "count":
            raise GuardError("E305", f"'{name}' would show values of the person key")
    return df.groupBy(*dims).agg(patient_count(person_col), *extra)


def guarded_aggregate(
    df: DataFrame,
    dims: Sequence[str] = (),
    *,
    person_col: str = PERSON_COLUMN,
    aggs: Sequence[tuple[str, str, str]] = (),
    k: int = MIN_PATIENT_COUNT,
    order_by: Sequence[str | Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Cells with at least ``k`` distinct persons.

    ``aggs`` are ``(output name, function, column)`` with a function of ``AGGREGATES``. Without
    dimensions the result is one global cell. Ordering and limit apply after the threshold.
    """
    cells = cell_counts(df, dims, person_col=person_col, aggs=aggs)
    kept = cells.where(F.col(COUNT_ALIAS) >= F.lit(k))
    if order_by:
        kept = kept.orderBy(*order_by)
    return kept if limit is None else kept.limit(limit)


def distinct_participation(
    facts: DataFrame, person_col: str, dims: Sequence[str]
) -> DataFrame:
    """A fact table reduced to the distinct (person, dimensions) pairs that a person count needs.

    Run before joining persons: a person with very many facts then brings at most one row per
    dimension value into the join, and the pairs' partitioning by person serves it.
    """
    return facts.where(F.col(person_col).isNotNull()).select(person_col, *dims).distinct()


def summarise_by_person(facts: DataFrame, person_col: str, column: str, dims: Sequence[str] = ()):
    """Mergeable statistics of a fact column per person (and fact dimension).

    The other aggregates need all facts, not only distinct persons. Summarised first, a person
    with very many facts joins the person table as one row per dimension value.
    """
    value = F.col(column)
    count = F.count(value)
    return (
        facts.where(F.col(person_col).isNotNull())
        .groupBy(person_col, *dims)
        .agg(
            count.alias("_n"),
            F.sum(value).alias("_sum"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
            (F.var_pop(value) * count).alias("_dev"),  # squared deviations from the own mean
        )
    )


def guarded_summary(
    summaries: DataFrame,
    dims: Sequence[str],
    name: str,
    *,
    person_col: str = PERSON_COLUMN,
    k: int = MIN_PATIENT_COUNT,
) -> DataFrame:
    """Guarded count, sum, avg, min, max, stddev and variance from per-person summaries.

    Equal to aggregating the facts: squared deviations add up within persons, plus the
    deviations between the persons' means.
    """
    _check_dimensions(summaries, dims, person_col)
    n, total = F.sum("_n"), F.sum("_sum")
    squares = F.sum(F.try_divide(F.col("_sum") * F.col("_sum"), F.col("_n")))
    between = squares - F.try_divide(total * total, n)
    variance = F.when(n > 1, F.try_divide(F.sum("_dev") + between, n - 1))
    return (
        summaries.groupBy(*dims)
        .agg(
            patient_count(person_col),
            F.coalesce(n, F.lit(0)).alias(f"n_{name}"),
            total.alias(f"sum_{name}"),
            F.try_divide(total, n).alias(f"avg_{name}"),
            F.min("_min").alias(f"min_{name}"),
            F.max("_max").alias(f"max_{name}"),
            F.sqrt(variance).alias(f"stddev_{name}"),
            variance.alias(f"variance_{name}"),
        )
        .where(F.col(COUNT_ALIAS) >= F.lit(k))
    )


def suppression_report(
    df: DataFrame, dims: Sequence[str], *, person_col: str = PERSON_COLUMN, k: int
) -> DataFrame:
    """How many cells, and persons in them, the threshold publishes and withholds."""
    cells = cell_counts(df, dims, person_col=person_col)
    n = F.col(COUNT_ALIAS)
    hidden = n < k
    zero = F.lit(0).cast("long")

    def total(value, condition):
        return F.coalesce(F.sum(F.when(condition, value)), zero)

    return cells.agg(
        F.count("*").alias("cells"),
        total(F.lit(1).cast("long"), ~hidden).alias("cells_published"),
        total(F.lit(1).cast("long"), hidden).alias("cells_withheld"),
        total(n, ~hidden).alias("persons_published"),
        total(n, hidden).alias("persons_withheld"),
    )
