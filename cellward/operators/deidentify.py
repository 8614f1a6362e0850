"""De-identified views: prohibited columns out, dates to years, ages and areas generalised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellward.policy import PERSON_COLUMN
from cellward.sources.vocabulary import DEFAULT, Vocabulary

# Ages above 89 form one group; a three-digit area needs more than 20,000 people.
OLDEST_AGE = 89
OLDEST_GROUP = "90+"
MIN_AREA_POPULATION = 20000
WITHHELD_AREA = "000"


def is_prohibited(name: str, vocab: Vocabulary = DEFAULT, strict: bool = True) -> bool:
    return name.lower().replace("-", "_") in vocab.prohibited(strict)


def safe_view(
    df: DataFrame,
    vocab: Vocabulary = DEFAULT,
    *,
    keep: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """The table without prohibited columns (``keep`` narrows it further).

    A projection only: it costs nothing at run time, and whoever queries the view gets an
    analysis error for any other column.
    """
    wanted = [c for c in df.columns if not is_prohibited(c, vocab, strict)]
    if keep:
        chosen = {c.lower() for c in keep}
        wanted = [c for c in wanted if c.lower() in chosen]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def year_only(date: Column) -> Column:
    return F.year(date)


def age_group(age: Column) -> Column:
    return F.when(age > OLDEST_AGE, OLDEST_GROUP).otherwise(age.cast("string"))


def area_code(zip_code: Column) -> Column:
    """First three digits of a five- or nine-digit ZIP code, null for anything else."""
    return F.when(zip_code.rlike(r"^\d{5}(?:-?\d{4})?$"), F.substring(zip_code, 1, 3))


def generalise_zip(
    df: DataFrame,
    zip_col: str,
    *,
    person_col: str = PERSON_COLUMN,
    min_population: int = MIN_AREA_POPULATION,
    output: str = "zip_3",
) -> DataFrame:
    """Replace a ZIP column by its area code, withheld unless the area holds *more than*
    ``min_population`` distinct persons of the table.

    There are at most 1000 area codes (three digits, enforced by ``area_code``), so the list of
    large areas has a fixed bound and is broadcast: the table itself is not shuffled by area.
    """
    marked = df.withColumn(output, area_code(F.col(zip_col)))
    large = (
        marked.where(F.col(output).isNotNull())
        .groupBy(output)
        .agg(F.count_distinct(person_col).alias("_population"))
        .where(F.col("_population") > min_population)
        .select(F.col(output).alias("_large"))
    )
    joined = marked.join(F.broadcast(large), F.col(output) == F.col("_large"), "left")
    return joined.withColumn(output, F.coalesce("_large", F.lit(WITHHELD_AREA))).drop(
        "_large", zip_col
    )


def generalise(
    df: DataFrame,
    *,
    dates: Sequence[str] = (),
    ages: Sequence[str] = (),
    zips: Sequence[str] = (),
    person_col: str = PERSON_COLUMN,
    min_population: int = MIN_AREA_POPULATION,
) -> DataFrame:
    """Dates to ``<name>_year``, ages to ``<name>_group``, ZIP codes to ``<name>_3``; the raw
    columns are dropped."""
    out = df
    for name in dates:
        out = out.withColumn(f"{name}_year", year_only(F.col(name))).drop(name)
    for name in ages:
        out = out.withColumn(f"{name}_group", age_group(F.col(name))).drop(name)
    for name in zips:
        out = generalise_zip(
            out, name, person_col=person_col, min_population=min_population, output=f"{name}_3"
        )
    return out
