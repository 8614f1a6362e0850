"""The guard around submitted SQL, including ways around it."""

from functools import partial

import pytest

from cellward.plans.guarded_sql import guarded_session, guarded_sql, release
from cellward.policy import GuardError, Policy

COUNT = "COUNT(DISTINCT person_id) AS Count_Patients"


def _person(spark):
    return spark.range(300).selectExpr(
        "id AS person_id", "id % 3 AS gender_concept_id", "1000 + id AS location_id",
        "concat('n', id) AS patient_name",
    )


def _condition(spark):
    return spark.range(900).selectExpr(
        "id AS condition_occurrence_id", "id % 300 AS person_id", "id % 2 AS condition_concept_id"
    )


TABLES = {"person": _person, "condition_occurrence": _condition}


@pytest.fixture(scope="module")
def run(spark):
    spark.range(9).selectExpr("id AS person_id", "'s' AS ssn").createOrReplaceTempView("raw_people")
    session = guarded_session(spark, TABLES)
    return partial(guarded_sql, session, tables=TABLES, policy=Policy(min_cell=100))


def test_threshold_above_the_text(run):
    rows = run(f"SELECT gender_concept_id, {COUNT} FROM person GROUP BY gender_concept_id;")
    assert {r["Count_Patients"] for r in rows.collect()} == {100}
    few = run(
        f"SELECT gender_concept_id, {COUNT} FROM person WHERE location_id > 1001 "
        "GROUP BY gender_concept_id"
    )
    assert few.count() == 1  # the filter runs below the threshold


def test_join(run):
    text = (
        "SELECT p.gender_concept_id, co.condition_concept_id, COUNT(DISTINCT p.person_id) AS "
        "Count_Patients FROM person AS p INNER JOIN condition_occurrence co "
        "ON p.person_id = co.person_id GROUP BY p.gender_concept_id, co.condition_concept_id"
    )
    assert run(text).count() == 0
    assert run(text, policy=Policy(min_cell=50)).count() == 6
    assert run(text, policy=Policy(min_cell=50, max_rows=2)).count() == 2


@pytest.mark.parametrize(
    "text, code",
    [
        ("SELECT * FROM person", "E204"),
        (f"SELECT patient_name, {COUNT} FROM person GROUP BY patient_name", "E201"),
        (f"SELECT {COUNT} FROM raw_people", "E101"),
        (f"SELECT {COUNT} FROM person, raw_people", "E101"),
        (f"SELECT {COUNT} FROM person p JOIN raw_people r ON p.person_id = r.person_id", "E101"),
        (f"SELECT {COUNT} FROM parquet.`/tmp/x`", "E101"),
        (f"SELECT {COUNT} FROM default.person", "E101"),
        (f"SELECT {COUNT} FROM range(100000)", "E101"),
        # another column renamed to the person key
        (f"SELECT {COUNT} FROM condition_occurrence AS c(person_id, a, b)", "E101"),
        # generated persons
        (f"SELECT {COUNT} FROM person LATERAL VIEW explode(sequence(1, 99999)) t AS person_id",
         "E802"),
        (f"SELECT {COUNT} FROM person |> SET Count_Patients = 99999", "E802"),
        (f"SELECT reflect('java.lang.System', 'exit', 1) AS x, {COUNT} FROM person", "E301"),
        (f"SELECT MAX(reflect('java.lang.System', 'getenv', 'HOME')) AS x, {COUNT} FROM person",
         "E802"),
        # person keys in the output
        (f"SELECT MIN(person_id) AS p, {COUNT} FROM person", "E305"),
        (f"SELECT collect_set(person_id) AS p, {COUNT} FROM person GROUP BY gender_concept_id",
         "E305"),
        (f"SELECT {COUNT} FROM person; SELECT 1", "E401"),
        # persons counted who are not tied to the cell
        ("SELECT p.gender_concept_id, COUNT(DISTINCT q.person_id) AS Count_Patients "
         "FROM person p, person q GROUP BY p.gender_concept_id", "E802"),
        ("SELECT p.gender_concept_id, COUNT(DISTINCT q.person_id) AS Count_Patients "
         "FROM person p CROSS JOIN person q GROUP BY p.gender_concept_id", "E802"),
        ("SELECT p.gender_concept_id, COUNT(DISTINCT q.person_id) AS Count_Patients FROM person p "
         "JOIN condition_occurrence q ON p.person_id > 0 GROUP BY p.gender_concept_id", "E802"),
        ("SELECT p.gender_concept_id, COUNT(DISTINCT q.person_id) AS Count_Patients FROM person p "
         "JOIN condition_occurrence q ON p.person_id = q.person_id OR 1 = 1 "
         "GROUP BY p.gender_concept_id", "E802"),
        ("SELECT p.gender_concept_id, COUNT(DISTINCT q.person_id) AS Count_Patients FROM person p "
         "JOIN condition_occurrence q ON p.person_id = p.person_id GROUP BY p.gender_concept_id",
         "E802"),
        (f"SELECT {COUNT} FROM person NATURAL JOIN condition_occurrence", "E802"),
        # row values and withheld cells
        (f"SELECT COLLECT_LIST(location_id) AS x, {COUNT} FROM person GROUP BY gender_concept_id",
         "E802"),
        # (what stands after its WHERE is no select item)
        (f"SELECT MAX(location_id) FILTER (WHERE location_id = 1001) AS x, {COUNT} FROM person",
         "E302"),
        (f"SELECT {COUNT}, MAX(location_id) FILTER (WHERE location_id = 1001) AS x FROM person",
         "E802"),
        (f"SELECT MAX(CASE WHEN location_id = 1001 THEN location_id END) AS x, {COUNT} FROM person",
         "E802"),
        (f"SELECT gender_concept_id, SUM(COUNT(DISTINCT person_id)) OVER () AS x, {COUNT} "
         "FROM person GROUP BY gender_concept_id", "E305"),
        # plans forced from the text
        (f"SELECT /*+ BROADCAST(person) */ {COUNT} FROM person", "E802"),
        (f"SELECT /*+ REPARTITION(1) */ {COUNT} FROM person", "E802"),
        # the person key as a group item
        (f"SELECT {COUNT} FROM person GROUP BY (person_id)", "E305"),
        (f"SELECT {COUNT} FROM person GROUP BY person_id + 0", "E305"),
    ],
)
def test_ways_around_are_refused(run, text, code):
    with pytest.raises(GuardError) as error:
        run(text)
    assert error.value.code == code


def test_forged_count_is_refused(run):
    text = f"SELECT gender_concept_id, {COUNT}, 99999 AS Count_Patients FROM person " \
        "GROUP BY gender_concept_id"
    with pytest.raises(Exception, match="(?i)ambiguous"):
        run(text).collect()


def test_alias_cannot_become_the_person_key(run):
    """A select alias is not visible inside the distinct count."""
    text = f"SELECT location_id AS person_id, {COUNT} FROM condition_occurrence GROUP BY 1"
    with pytest.raises(Exception):
        run(text).collect()


def test_files_by_path_are_unreachable(spark):
    session = guarded_session(spark, TABLES)
    assert session.conf.get("spark.sql.runSQLOnFiles") == "false"
    assert {t.name for t in session.catalog.listTables() if t.isTemporary} == set(TABLES)


def test_comments_do_not_reach_spark(run):
    text = f"SELECT gender_concept_id, {COUNT} FROM person -- all\n /* x */ GROUP BY gender_concept_id"
    assert run(text).count() == 3


def test_scalar_around_aggregate(run):
    rows = run(f"SELECT ROUND(AVG(location_id), 1) AS place, AVG(location_id) + 1 AS more, {COUNT} FROM person").collect()
    assert [tuple(r) for r in rows] == [(1149.5, 1150.5, 300)]


def test_no_cartesian_product(run):
    text = (
        "SELECT p.gender_concept_id, COUNT(DISTINCT p.person_id) AS Count_Patients FROM person p "
        "LEFT JOIN condition_occurrence c ON p.person_id = c.person_id GROUP BY p.gender_concept_id"
    )
    result = run(text)
    assert result.count() == 3
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# ------------------------------------------------------------------ facts as sets


def _hot(spark):
    """One person with a third of all facts."""
    return spark.range(30_000).selectExpr(
        "id AS condition_occurrence_id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 300 END AS person_id",
        "id % 4 AS condition_concept_id", "id % 11 AS visit_occurrence_id",
    )


_JOIN = "FROM person p JOIN condition_occurrence c ON p.person_id = c.person_id"
_PERSONS = "COUNT(DISTINCT p.person_id) AS Count_Patients"


@pytest.mark.parametrize(
    "text, reduced",
    [
        (f"SELECT c.condition_concept_id, {_PERSONS} {_JOIN} GROUP BY c.condition_concept_id", True),
        (f"SELECT p.gender_concept_id, {_PERSONS}, MAX(c.visit_occurrence_id) AS m {_JOIN} "
         "WHERE c.condition_concept_id < 3 GROUP BY p.gender_concept_id", True),
        (f"SELECT p.gender_concept_id, {_PERSONS}, COUNT(DISTINCT c.visit_occurrence_id) AS m {_JOIN} "
         "GROUP BY p.gender_concept_id", True),
        # sums and counts of rows need every row
        (f"SELECT p.gender_concept_id, {_PERSONS}, COUNT(*) AS n {_JOIN} GROUP BY p.gender_concept_id", False),
        (f"SELECT p.gender_concept_id, {_PERSONS}, AVG(c.visit_occurrence_id) AS n {_JOIN} "
         "GROUP BY p.gender_concept_id", False),
        (f"SELECT condition_concept_id, {COUNT} FROM condition_occurrence GROUP BY condition_concept_id", False),
    ],
)
def test_facts_are_read_as_sets_where_repeats_do_not_count(spark, text, reduced):
    tables = {"person": _person, "condition_occurrence": _hot}
    session = guarded_session(spark, tables)
    result = guarded_sql(session, text, tables, policy=Policy(min_cell=1))
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :] if "Join" in plan else ""
    assert ("Aggregate" in below) == reduced
    # the same cells as from the rows
    rows = {n: load(spark) for n, load in tables.items()}
    for n, df in rows.items():
        df.createOrReplaceTempView(f"plain_{n}")
    plain = text.replace("FROM person p", "FROM plain_person p").replace("JOIN condition", "JOIN plain_condition")
    want = spark.sql(plain.replace("FROM condition", "FROM plain_condition")).collect()
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, want)) and want


# ------------------------------------------------------------------ output


def _places(spark):
    return spark.range(300).selectExpr(
        "id AS person_id", "CASE id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN NULL ELSE 'caf' || chr(233) END AS gender_source_value"
    )


def test_result_with_a_bad_cell_is_withheld(spark):
    tables = {"person": _places}
    session = guarded_session(spark, tables)
    ask = partial(guarded_sql, session, tables=tables)
    text = f"SELECT gender_source_value, {COUNT} FROM person GROUP BY gender_source_value"
    with pytest.raises(Exception, match="E001"):
        ask(text, policy=Policy(min_cell=100)).collect()
    with pytest.raises(GuardError) as error:
        release(ask(text, policy=Policy(min_cell=100, scan_output=False)))
    assert error.value.code == "E001" and error.value.details == {"columns": ["gender_source_value"]}
    # a cell below the threshold is not shown and stops nothing
    rare = f"SELECT gender_source_value, {COUNT} FROM person WHERE person_id % 3 < 2 OR person_id < 9 GROUP BY gender_source_value"
    shown = ask(rare, policy=Policy(min_cell=50)).collect()
    assert {r["gender_source_value"] for r in shown} == {"plain", None}
    good = ask(f"SELECT gender_source_value, {COUNT} FROM person GROUP BY gender_source_value", policy=Policy(min_cell=101))
    assert good.count() == 0 and release(good).count() == 0


def test_released_result(run):
    text = f"SELECT gender_concept_id, gender_concept_id, {COUNT} FROM person GROUP BY gender_concept_id"
    assert run(text).count() == 3
    text = f"SELECT gender_concept_id, {COUNT} FROM person GROUP BY gender_concept_id"
    assert sorted(map(tuple, release(run(text)).collect())) == [(0, 100), (1, 100), (2, 100)]
