"""Guarded aggregates, de-identified views, data checks - against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cellward.operators import cells, conformance, deidentify
from cellward.policy import GuardError
from cellward.session import fresh_path, literal_table
from cellward.sources import catalog
from cellward.sources.vocabulary import DEFAULT


def people(spark, counts):
    """``counts`` persons per group, each on two rows."""
    rows = [
        (g, f"{g}-{i}", float(i)) for g, n in counts.items() for i in range(n) for _ in range(2)
    ]
    return literal_table(spark, rows, "g string, person_id string, v double")


def test_threshold_is_inclusive(spark):
    df = people(spark, {"below": 9, "at": 10, "above": 11})
    got = {r["g"]: r["Count_Patients"] for r in cells.guarded_aggregate(df, ["g"], k=10).collect()}
    assert got == {"at": 10, "above": 11}


def test_default_threshold_hides_small_data(spark):
    assert cells.guarded_aggregate(people(spark, {"a": 50}), ["g"]).count() == 0


def test_global_aggregate_on_empty_input(spark):
    empty = people(spark, {"a": 1}).where("false")
    assert cells.guarded_aggregate(empty, k=1).count() == 0


def test_null_group_and_null_persons(spark):
    rows = [(None, "p1"), (None, "p2"), ("a", None), ("a", "p3")]
    df = literal_table(spark, rows, "g string, person_id string")
    got = {r["g"]: r["Count_Patients"] for r in cells.guarded_aggregate(df, ["g"], k=1).collect()}
    assert got == {None: 2, "a": 1}


def test_no_cell_below_k_leaves_under_skew(spark):
    """One cell and one person each hold a third of all rows."""
    rng = random.Random(7)
    rows = [("hot", rng.randrange(400)) for _ in range(2000)]
    rows += [(f"g{rng.randrange(40)}", 1) for _ in range(2000)]
    rows += [(f"g{rng.randrange(40)}", rng.randrange(400)) for _ in range(2000)]
    persons = defaultdict(set)
    for g, p in rows:
        persons[g].add(p)
    df = literal_table(spark, rows, "g string, person_id bigint").repartition(5)
    got = {r["g"]: r["Count_Patients"] for r in cells.guarded_aggregate(df, ["g"], k=49).collect()}
    assert got == {g: len(p) for g, p in persons.items() if len(p) >= 49}


def test_refusals(spark):
    df = people(spark, {"a": 3})
    with pytest.raises(GuardError) as person:
        cells.guarded_aggregate(df, ["PERSON_ID"], k=1)
    assert person.value.code == "E305"
    with pytest.raises(GuardError):
        cells.guarded_aggregate(df, ["nope"], k=1)
    with pytest.raises(GuardError):
        cells.guarded_aggregate(df, ["g"], aggs=[("count_patients", "max", "v")], k=1)
    with pytest.raises(GuardError):
        cells.guarded_aggregate(df, ["g"], aggs=[("x", "min", "person_id")], k=1)


def test_caller_predicates_stay_below_the_threshold(spark):
    df = people(spark, {"a": 10, "b": 10})
    kept = cells.guarded_aggregate(df, ["g"], k=10).where("g <> 'b'")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Count_Patients") < plan.index("Aggregate")
    assert [r["g"] for r in kept.collect()] == ["a"]


def test_summary_equals_plain_aggregation(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice("ab"), 1 if rng.random() < 0.4 else rng.randrange(30),
         None if rng.random() < 0.1 else rng.uniform(-5, 1000))
        for _ in range(3000)
    ]
    rows += [("c", 99, None)]
    df = literal_table(spark, rows, "g string, person_id bigint, v double")
    names = ["n_v", "sum_v", "avg_v", "min_v", "max_v", "stddev_v", "variance_v"]
    functions = ["count", "sum", "avg", "min", "max", "stddev", "variance"]
    plain = cells.guarded_aggregate(
        df, ["g"], aggs=[(n, f, "v") for n, f in zip(names, functions)], k=1
    )
    summary = cells.guarded_summary(
        cells.summarise_by_person(df, "person_id", "v", ["g"]), ["g"], "v", k=1
    )
    a = {r["g"]: r for r in plain.collect()}
    b = {r["g"]: r for r in summary.collect()}
    assert a.keys() == b.keys() == {"a", "b", "c"}
    for g in a:
        assert a[g]["Count_Patients"] == b[g]["Count_Patients"]
        for n in names:
            expected = a[g][n] if a[g][n] is None else pytest.approx(a[g][n], rel=1e-9)
            assert b[g][n] == expected


def test_suppression_report_adds_up(spark):
    df = people(spark, {"a": 3, "b": 20, "c": 5})
    row = cells.suppression_report(df, ["g"], k=5).first()
    assert row.asDict() == {
        "cells": 3, "cells_published": 2, "cells_withheld": 1,
        "persons_published": 25, "persons_withheld": 3,
    }


def test_safe_view_hides_columns_from_analysis(spark):
    raw = spark.range(3).selectExpr(
        "id AS person_id", "'x' AS `Patient-Name`", "1 AS npi", "2 AS state", "3 AS CITY"
    )
    assert deidentify.safe_view(raw).columns == ["person_id", "state"]
    assert deidentify.safe_view(raw, strict=False).columns == ["person_id", "npi", "state"]
    assert deidentify.safe_view(raw, keep=["State"]).columns == ["state"]
    deidentify.safe_view(raw).createOrReplaceTempView("safe_test")
    with pytest.raises(AnalysisException):
        spark.sql("SELECT npi FROM safe_test")


def test_generalise(spark):
    rows = [
        (p, "2020-05-0" + str(1 + p % 9), 85 + p, z)
        for p, z in enumerate(["10001"] * 4 + ["10099-1234"[:5]] + ["20001"] * 3 + ["x", None])
    ]
    df = literal_table(spark, rows, "person_id int, d string, age int, zip string")
    df = df.withColumn("d", F.to_date("d"))
    out = deidentify.generalise(df, dates=["d"], ages=["age"], zips=["zip"], min_population=3)
    got = {r["person_id"]: (r["d_year"], r["age_group"], r["zip_3"]) for r in out.collect()}
    assert set(out.columns) == {"person_id", "d_year", "age_group", "zip_3"}
    # area 100 holds five persons; area 200 exactly three, which is not more than three
    assert [got[i][2] for i in range(10)] == ["100"] * 5 + ["000"] * 5
    assert [got[i][1] for i in (4, 5)] == ["89", "90+"] and got[0][0] == 2020


def test_fk_orphans_ignores_null_and_counts_hot_keys(spark):
    child = literal_table(spark, [(1,)] * 3 + [(9,)] * 50 + [(8,), (None,)], "k int")
    parent = literal_table(spark, [(1,), (2,)], "id int")
    row = conformance.fk_orphans(child, parent, "k", "id").first()
    assert (row["orphan_keys"], row["orphan_rows"]) == (2, 51)


def test_scan_and_conformance(spark):
    tables = {
        "location": spark.range(4).selectExpr("id AS location_id", "'a' AS City", "'b' AS state"),
        "misc": spark.range(2).selectExpr("id AS x"),
    }
    found = conformance.scan_catalog(spark, tables).collect()
    assert [(r["table_name"], r["column_name"], r["category"], r["n_values"]) for r in found] == [
        ("location", "City", "geographic", 4)
    ]
    diff = conformance.conformance(spark, tables, catalog.column_catalog(spark)).collect()
    status = {(r["table_name"], r["column_name"]): r["status"] for r in diff}
    assert status[("misc", "x")] == "unknown_table"
    assert status[("location", "zip")] == "missing_column"
    assert ("location", "City") not in status
    assert not conformance.scan_catalog(spark, {"misc": tables["misc"]}).collect()


def test_output_scan(spark):
    df = literal_table(spark, [("ok", "é"), (None, "x")], "a string, b string")
    got = {
        r["column_name"]: (r["n_cells"], r["n_bad"], r["has_bad"])
        for r in conformance.scan_output_ascii(df).collect()
    }
    assert got == {"a": (1, 0, False), "b": (2, 1, True)}


@pytest.mark.parametrize("format", ["parquet", "json", "csv"])
def test_read_clinical_table(spark, format):
    path = fresh_path(spark, "person")
    written = spark.range(5).selectExpr("id AS person_id", "1990 AS year_of_birth", "7 AS extra")
    options = {"header": "true"} if format == "csv" else {}
    if format == "csv":  # files of this format go by position, so they hold every column
        names = catalog.catalog_columns()["person"]
        written = written.selectExpr(
            *[n if n in ("person_id", "year_of_birth") else f"string(null) AS {n}" for n in names]
        )
    written.write.format(format).options(**options).save(path)
    people = catalog.read_table(spark, path, "person", format, **options)
    assert people.schema == catalog.table_schema("person")
    view = deidentify.safe_view(people)
    assert "month_of_birth" not in view.columns
    assert cells.guarded_aggregate(view, ["year_of_birth"], k=5).collect() == [(1990, 5)]


def test_vocabulary_sizes():
    assert len(DEFAULT.prohibited(strict=False)) == 166
    assert len(DEFAULT.prohibited()) == 190
    names = [c for columns in catalog.catalog_columns().values() for c in columns]
    assert (len(catalog.TABLES), len(names)) == (13, 156)
    assert sum(n in DEFAULT.prohibited() for n in names) == 37
