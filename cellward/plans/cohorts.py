"""Guarded queries on the clinical tables, and checks of those tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from cellward.operators import cells, conformance, deidentify
from cellward.plans.guarded_sql import guarded_session, guarded_sql
from cellward.plans.registry import query
from cellward.plans.sample_log import values
from cellward.policy import Policy
from cellward.sources import catalog, tables
from cellward.sources.tables import table

PERSON_SQL = """person AS (
  SELECT c_custkey AS person_id, c_name AS patient_name, c_mktsegment AS gender_concept_id,
         CAST(1920 + c_custkey % 90 AS INTEGER) AS year_of_birth, c_custkey % 5 AS race_concept_id,
         c_custkey % 3 AS ethnicity_concept_id, CAST(c_nationkey AS BIGINT) AS location_id,
         CAST(2024 - (1920 + c_custkey % 90) AS INTEGER) AS age, c_acctbal AS balance,
         CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 10 < 6 THEN '100'
              WHEN c_custkey % 10 < 9 THEN '200'
              ELSE CAST(300 + c_custkey % 7 AS VARCHAR) END AS area
  FROM customer)"""
CONDITION_SQL = """condition_occurrence AS (
  SELECT o_custkey AS person_id, o_orderpriority AS condition_concept_id,
         o_orderdate AS condition_start_date, o_orderstatus AS condition_status_concept_id,
         o_totalprice AS cost
  FROM orders)"""
LOCATION_SQL = """location AS (
  SELECT CAST(n_nationkey AS BIGINT) AS location_id, n_name AS state, r_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
BOTH_SQL = f"{PERSON_SQL}, {CONDITION_SQL}"
JOINED_SQL = "person p JOIN condition_occurrence c ON p.person_id = c.person_id"

_GENDER = "gender_concept_id"
_CONDITION = "condition_concept_id"


def safe_person(spark, sf_dir):
    return deidentify.safe_view(tables.person(spark, sf_dir))


def conditions_of_persons(spark, sf_dir, dims=(_CONDITION,), person_dims=(_GENDER,)):
    """Distinct (person, condition) pairs with the person's attributes."""
    facts = tables.condition_occurrence(spark, sf_dir)
    pairs = cells.distinct_participation(facts, "person_id", dims)
    people = safe_person(spark, sf_dir).select("person_id", *person_dims)
    return pairs.join(people, "person_id")


def prevalence(spark, sf_dir, k=260):
    joined = conditions_of_persons(spark, sf_dir)
    return cells.guarded_aggregate(joined, [_GENDER, _CONDITION], k=k)


query(
    "condition_prevalence",
    f"""WITH {BOTH_SQL}
    SELECT gender_concept_id, condition_concept_id,
           count(DISTINCT p.person_id) AS Count_Patients
    FROM {JOINED_SQL} GROUP BY ALL HAVING count(DISTINCT p.person_id) >= 260""",
)(prevalence)


@query(
    "guarded_aggregate",
    f"""WITH {PERSON_SQL}
    SELECT gender_concept_id, count(DISTINCT person_id) AS Count_Patients
    FROM person GROUP BY 1 HAVING count(DISTINCT person_id) >= 300""",
)
def _(spark, sf_dir):
    return cells.guarded_aggregate(safe_person(spark, sf_dir), [_GENDER], k=300)


@query(
    "patient_count",
    f"""WITH {CONDITION_SQL}
    SELECT condition_status_concept_id, count(DISTINCT person_id) AS Count_Patients
    FROM condition_occurrence GROUP BY 1""",
)
def _(spark, sf_dir):
    facts = tables.condition_occurrence(spark, sf_dir)
    return facts.groupBy("condition_status_concept_id").agg(cells.patient_count())


@query(
    "demographic_distribution",
    f"""WITH {PERSON_SQL}
    SELECT gender_concept_id, race_concept_id, ethnicity_concept_id,
           count(DISTINCT person_id) AS Count_Patients
    FROM person GROUP BY 1, 2, 3 HAVING count(DISTINCT person_id) >= 20""",
)
def _(spark, sf_dir):
    dims = [_GENDER, "race_concept_id", "ethnicity_concept_id"]
    return cells.guarded_aggregate(safe_person(spark, sf_dir), dims, k=20)


@query(
    "global_count",
    f"""WITH {CONDITION_SQL}
    SELECT count(DISTINCT person_id) AS Count_Patients, count(cost) AS n_conditions
    FROM condition_occurrence HAVING count(DISTINCT person_id) >= 1000""",
)
def _(spark, sf_dir):
    facts = tables.condition_occurrence(spark, sf_dir)
    return cells.guarded_aggregate(facts, aggs=[("n_conditions", "count", "cost")], k=1000)


@query(
    "guarded_multi_agg",
    f"""WITH {BOTH_SQL}
    SELECT gender_concept_id, count(DISTINCT p.person_id) AS Count_Patients,
           count(cost) AS n_cost, round(sum(cost), 2) AS sum_cost, round(avg(cost), 4) AS avg_cost,
           min(cost) AS min_cost, max(cost) AS max_cost, round(stddev(cost), 4) AS stddev_cost,
           round(variance(cost), 1) AS variance_cost
    FROM {JOINED_SQL} GROUP BY 1 HAVING count(DISTINCT p.person_id) >= 295""",
)
def _(spark, sf_dir):
    facts = tables.condition_occurrence(spark, sf_dir)
    per_person = cells.summarise_by_person(facts, "person_id", "cost")
    people = safe_person(spark, sf_dir).select("person_id", _GENDER)
    out = cells.guarded_summary(
        per_person.join(people, "person_id"), [_GENDER], "cost", k=295
    )
    digits = {"sum_cost": 2, "avg_cost": 4, "stddev_cost": 4, "variance_cost": 1}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


_EXPOSED_SQL = """SELECT l_partkey % 25 AS drug_group, o_custkey AS person_id,
      l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def exposures_of_persons(spark, sf_dir):
    """Every drug exposure with its person, who is known through the visit."""
    visits = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("visit_occurrence_id"), F.col("o_custkey").alias("person_id")
    )
    facts = tables.drug_exposure(spark, sf_dir).join(visits, "visit_occurrence_id")
    return facts.select("person_id", (F.col("drug_concept_id") % 25).alias("drug_group"), "quantity")


@query(
    "drug_exposure_count",
    f"""WITH e AS ({_EXPOSED_SQL})
    SELECT drug_group, count(DISTINCT person_id) AS Count_Patients FROM e
    GROUP BY 1 HAVING count(DISTINCT person_id) >= 890""",
)
def _(spark, sf_dir):
    return cells.guarded_aggregate(exposures_of_persons(spark, sf_dir), ["drug_group"], k=890)


@query(
    "drug_exposure_quantity",
    f"""WITH e AS ({_EXPOSED_SQL})
    SELECT drug_group, count(DISTINCT person_id) AS Count_Patients,
           count(quantity) AS n_quantity, round(sum(quantity), 2) AS sum_quantity,
           round(avg(quantity), 4) AS avg_quantity, min(quantity) AS min_quantity,
           max(quantity) AS max_quantity FROM e
    GROUP BY 1 HAVING count(DISTINCT person_id) >= 890""",
)
def _(spark, sf_dir):
    facts = exposures_of_persons(spark, sf_dir)
    per_person = cells.summarise_by_person(facts, "person_id", "quantity", ["drug_group"])
    out = cells.guarded_summary(per_person, ["drug_group"], "quantity", k=890)
    out = out.drop("stddev_quantity", "variance_quantity")
    return out.withColumns(
        {"sum_quantity": F.round("sum_quantity", 2), "avg_quantity": F.round("avg_quantity", 4)}
    )


@query(
    "suppression_report",
    f"""WITH {BOTH_SQL}, cells AS (
      SELECT gender_concept_id, condition_concept_id, count(DISTINCT p.person_id) AS n
      FROM {JOINED_SQL} GROUP BY ALL)
    SELECT count(*) AS cells, count(*) FILTER (n >= 260) AS cells_published,
           count(*) FILTER (n < 260) AS cells_withheld,
           CAST(coalesce(sum(n) FILTER (n >= 260), 0) AS BIGINT) AS persons_published,
           CAST(coalesce(sum(n) FILTER (n < 260), 0) AS BIGINT) AS persons_withheld
    FROM cells""",
)
def _(spark, sf_dir):
    joined = conditions_of_persons(spark, sf_dir)
    return cells.suppression_report(joined, [_GENDER, _CONDITION], k=260)


@query(
    "filtered_cohort",
    f"""WITH {BOTH_SQL}
    SELECT gender_concept_id, condition_status_concept_id,
           count(DISTINCT p.person_id) AS Count_Patients
    FROM {JOINED_SQL}
    WHERE condition_status_concept_id IN ('F', 'O') AND cost > 200000
      AND year_of_birth > 1940 AND condition_concept_id = '1-URGENT'
    GROUP BY ALL HAVING count(DISTINCT p.person_id) >= 85""",
)
def _(spark, sf_dir):
    facts = tables.condition_occurrence(spark, sf_dir).where(
        F.col("condition_status_concept_id").isin("F", "O")
        & (F.col("cost") > 200000)
        & (F.col(_CONDITION) == "1-URGENT")
    )
    status = "condition_status_concept_id"
    pairs = cells.distinct_participation(facts, "person_id", [status])
    people = safe_person(spark, sf_dir).where(F.col("year_of_birth") > 1940)
    return cells.guarded_aggregate(pairs.join(people, "person_id"), [_GENDER, status], k=85)


@query(
    "avg_birth_year",
    f"""WITH {PERSON_SQL}
    SELECT gender_concept_id AS gender, count(DISTINCT person_id) AS Count_Patients,
           round(avg(CAST(year_of_birth AS FLOAT)), 4) AS avg_birth_year
    FROM person GROUP BY 1 HAVING count(DISTINCT person_id) >= 300""",
)
def _(spark, sf_dir):
    people = safe_person(spark, sf_dir).select(
        F.col(_GENDER).alias("gender"), "person_id", F.col("year_of_birth").cast("float")
    )
    out = cells.guarded_aggregate(
        people, ["gender"], aggs=[("avg_birth_year", "avg", "year_of_birth")], k=300
    )
    return out.withColumn("avg_birth_year", F.round("avg_birth_year", 4))


@query(
    "state_rollup",
    f"""WITH {PERSON_SQL}, {LOCATION_SQL}
    SELECT state, count(DISTINCT person_id) AS Count_Patients
    FROM person JOIN location USING (location_id) GROUP BY 1
    HAVING count(DISTINCT person_id) >= 55""",
)
def _(spark, sf_dir):
    places = deidentify.safe_view(tables.location(spark, sf_dir))
    joined = safe_person(spark, sf_dir).join(places, "location_id")
    return cells.guarded_aggregate(joined, ["state"], k=55)


@query(
    "outer_join_cohort",
    f"""WITH {BOTH_SQL}
    SELECT c.condition_concept_id, count(DISTINCT p.person_id) AS Count_Patients
    FROM person p LEFT JOIN condition_occurrence c
      ON p.person_id = c.person_id AND c.cost > 400000
    GROUP BY 1 HAVING count(DISTINCT p.person_id) >= 300""",
)
def _(spark, sf_dir):
    facts = tables.condition_occurrence(spark, sf_dir).where(F.col("cost") > 400000)
    pairs = cells.distinct_participation(facts, "person_id", [_CONDITION])
    joined = safe_person(spark, sf_dir).join(pairs, "person_id", "left")
    return cells.guarded_aggregate(joined, [_CONDITION], k=300)


@query(
    "guarded_ordered",
    f"""WITH {BOTH_SQL}
    SELECT gender_concept_id, condition_concept_id,
           count(DISTINCT p.person_id) AS Count_Patients
    FROM {JOINED_SQL} GROUP BY ALL HAVING count(DISTINCT p.person_id) >= 250
    ORDER BY 3 DESC, 1, 2""",
)
def _(spark, sf_dir):
    joined = conditions_of_persons(spark, sf_dir)
    order = [F.desc("Count_Patients"), _GENDER, _CONDITION]
    return cells.guarded_aggregate(joined, [_GENDER, _CONDITION], k=250, order_by=order)


@query(
    "guarded_topk",
    f"""WITH {BOTH_SQL}
    SELECT gender_concept_id, condition_concept_id,
           count(DISTINCT p.person_id) AS Count_Patients
    FROM {JOINED_SQL} GROUP BY ALL HAVING count(DISTINCT p.person_id) >= 250
    ORDER BY 3 DESC, 1, 2 LIMIT 5""",
)
def _(spark, sf_dir):
    joined = conditions_of_persons(spark, sf_dir)
    order = [F.desc("Count_Patients"), _GENDER, _CONDITION]
    return cells.guarded_aggregate(
        joined, [_GENDER, _CONDITION], k=250, order_by=order, limit=5
    )


@query(
    "cohort_scan",
    f"""WITH {PERSON_SQL}
    SELECT year_of_birth, count(DISTINCT person_id) AS Count_Patients
    FROM person WHERE race_concept_id IN (1, 2) AND year_of_birth BETWEEN 1950 AND 1989
    GROUP BY 1 HAVING count(DISTINCT person_id) >= 10""",
)
def _(spark, sf_dir):
    people = safe_person(spark, sf_dir).where(
        F.col("race_concept_id").isin(1, 2) & F.col("year_of_birth").between(1950, 1989)
    )
    return cells.guarded_aggregate(people, ["year_of_birth"], k=10)


@query(
    "safe_view",
    f"""WITH {PERSON_SQL}
    SELECT person_id, gender_concept_id, year_of_birth, race_concept_id, ethnicity_concept_id,
           location_id, age, balance FROM person""",
)
def _(spark, sf_dir):
    return safe_person(spark, sf_dir)


@query(
    "year_generalise",
    f"""WITH {CONDITION_SQL}
    SELECT CAST(year(condition_start_date) AS INTEGER) AS condition_start_date_year,
           count(DISTINCT person_id) AS Count_Patients
    FROM condition_occurrence GROUP BY 1 HAVING count(DISTINCT person_id) >= 700""",
)
def _(spark, sf_dir):
    facts = tables.condition_occurrence(spark, sf_dir)
    years = deidentify.generalise(facts, dates=["condition_start_date"])
    return cells.guarded_aggregate(years, ["condition_start_date_year"], k=700)


@query(
    "age_topcode",
    f"""WITH {PERSON_SQL}
    SELECT CASE WHEN age > 89 THEN '90+' ELSE CAST(age AS VARCHAR) END AS age_group,
           count(DISTINCT person_id) AS Count_Patients
    FROM person GROUP BY 1 HAVING count(DISTINCT person_id) >= 17""",
)
def _(spark, sf_dir):
    people = deidentify.generalise(safe_person(spark, sf_dir), ages=["age"])
    return cells.guarded_aggregate(people, ["age_group"], k=17)


@query(
    "zip3_generalise",
    f"""WITH {PERSON_SQL}, large AS (
      SELECT area FROM person WHERE area IS NOT NULL GROUP BY 1
      HAVING count(DISTINCT person_id) > 150)
    SELECT coalesce(l.area, '000') AS zip_3, gender_concept_id,
           count(DISTINCT person_id) AS Count_Patients
    FROM person p LEFT JOIN large l ON p.area = l.area GROUP BY ALL
    HAVING count(DISTINCT person_id) >= 20""",
)
def _(spark, sf_dir):
    people = tables.person(spark, sf_dir).select("person_id", _GENDER, "zip")
    areas = deidentify.generalise_zip(people, "zip", min_population=150)
    return cells.guarded_aggregate(areas, ["zip_3", _GENDER], k=20)


@query(
    "guarded_sql",
    f"""WITH {BOTH_SQL}, {LOCATION_SQL}
    SELECT country, condition_concept_id AS condition,
           count(DISTINCT p.person_id) AS Count_Patients,
           round(avg(CAST(p.year_of_birth AS FLOAT)), 3) AS avg_year
    FROM {JOINED_SQL} JOIN location l ON p.location_id = l.location_id
    WHERE p.year_of_birth > 1930
    GROUP BY ALL HAVING count(DISTINCT p.person_id) >= 220""",
)
def _(spark, sf_dir):
    loaders = {n: partial(_load, sf_dir, f) for n, f in tables.CLINICAL.items()}
    session = guarded_session(spark, loaders)
    text = """-- conditions by country; ssn
        SELECT l.country, co.condition_concept_id AS condition,
               COUNT(DISTINCT p.person_id) AS Count_Patients,
               ROUND(AVG(CAST(p.year_of_birth AS FLOAT)), 3) AS avg_year
        FROM person p
        JOIN condition_occurrence co ON p.person_id = co.person_id
        JOIN location l ON p.location_id = l.location_id
        WHERE p.year_of_birth > 1930
        GROUP BY l.country, co.condition_concept_id;"""
    return guarded_sql(session, text, loaders, policy=Policy(min_cell=220))


def _load(sf_dir, maker, spark):
    return maker(spark, sf_dir)


# ---------------------------------------------------------------- checks of data tables


@query(
    "catalog_phi_scan",
    """SELECT 'pages' AS table_name, 'url' AS column_name, 'direct' AS category,
             'web/IP identifier (Categories 14-15)' AS identifier_type, 'phi_list' AS source,
             count(*) AS n_rows, count(url) AS n_values FROM pages
    UNION ALL
    SELECT 'person', 'patient_name', 'direct', 'name (Category 1)', 'phi_list',
           count(*), count(c_name) FROM customer
    UNION ALL
    SELECT 'person', 'month_of_birth', 'date', NULL, 'phi_list', count(*), count(c_custkey)
    FROM customer
    UNION ALL
    SELECT 'person', 'zip', 'geographic', NULL, 'phi_list', count(*), count(c_custkey)
    FROM customer
    UNION ALL
    SELECT 'condition_occurrence', 'condition_start_date', 'date', NULL, 'catalog',
           count(*), count(o_orderdate) FROM orders
    UNION ALL
    SELECT 'drug_exposure', 'drug_exposure_start_date', 'date', NULL, 'catalog',
           count(*), count(l_shipdate) FROM lineitem""",
)
def _(spark, sf_dir):
    data = {n: f(spark, sf_dir) for n, f in tables.CLINICAL.items()}
    data |= {n: tables.table(spark, sf_dir, n) for n in ("pages", "documents")}
    return conformance.scan_catalog(spark, data)


_HAVE = {
    "person": ["person_id", "patient_name", "gender_concept_id", "year_of_birth",
               "month_of_birth", "race_concept_id", "ethnicity_concept_id", "location_id",
               "age", "zip", "balance"],
    "condition_occurrence": ["condition_occurrence_id", "person_id", "condition_concept_id",
                             "condition_start_date", "condition_status_concept_id", "cost"],
    "drug_exposure": ["visit_occurrence_id", "drug_concept_id", "drug_exposure_start_date",
                      "quantity", "provider_id"],
    "location": ["location_id", "state", "country"],
    "labels": ["doc_id", "quality", "toxic"],
}
_APPROVED = [(t, c) for t, names in catalog.catalog_columns().items() for c in names]


@query(
    "schema_conformance",
    f"""WITH have AS {values([(t, c) for t, n in _HAVE.items() for c in n], ["t", "c"])},
    approved AS {values(_APPROVED, ["t", "c"])},
    counts AS (
      SELECT 'person' AS t, count(*) AS n_rows FROM customer
      UNION ALL SELECT 'condition_occurrence', count(*) FROM orders
      UNION ALL SELECT 'drug_exposure', count(*) FROM lineitem
      UNION ALL SELECT 'location', count(*) FROM nation
      UNION ALL SELECT 'labels', count(*) FROM labels),
    diff AS (
      SELECT coalesce(h.t, a.t) AS t, coalesce(h.c, a.c) AS c,
             CASE WHEN h.c IS NULL THEN 'missing_column'
                  WHEN h.t IN (SELECT t FROM approved) THEN 'unknown_column'
                  ELSE 'unknown_table' END AS status
      FROM have h FULL JOIN approved a ON h.t = a.t AND h.c = a.c
      WHERE h.c IS NULL OR a.c IS NULL)
    SELECT d.t AS table_name, d.c AS column_name, status, n_rows
    FROM diff d JOIN counts USING (t)""",
)
def _(spark, sf_dir):
    data = {n: f(spark, sf_dir) for n, f in tables.CLINICAL.items()}
    data["labels"] = tables.table(spark, sf_dir, "labels")
    return conformance.conformance(spark, data, catalog.column_catalog(spark))


@query(
    "fk_orphans",
    """SELECT count(DISTINCT o_custkey) AS orphan_keys, count(*) AS orphan_rows
    FROM orders WHERE o_custkey IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""",
)
def _(spark, sf_dir):
    solvent = tables.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    orders = tables.table(spark, sf_dir, "orders")
    return conformance.fk_orphans(orders, solvent, "o_custkey", "c_custkey")
