"""A query log derived from the orders table: one submitted text per order.

Which text an order submits depends on its key, and its values are filled in. A third of all
rows use the first text, and another third come from one user, so that skew is always there.
The number of texts is no multiple of three, so every text occurs. ``TEXTS`` states for each
text what the audit must find; the SQL twins are made from these expectations and never from the
rules under test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.functions.characters import WHITESPACE
from cellward.operators.reports import utc_day
from cellward.sources.tables import table
from cellward.sources.vocabulary import DEFAULT

_BLANK_TEXT = " \n\t\u00a0 "
_DONE = ("ascii_input", "schema", "phi", "aggregation", "enforcement", "system")


@dataclass(frozen=True)
class Text:
    query: str
    # expected hits in order: (layer, code, token, clause)
    hits: tuple = ()
    group_by: tuple = ()
    unknown_tables: tuple = ()
    unknown_columns: tuple = ()
    wrong_count: str | None = None
    global_aggregate: bool = False
    n_statements: int = 1

    def __post_init__(self):
        # an unknown table leaves its columns unjudged, and prohibited names have a code of their own
        schema = [("schema", "E101", t, None) for t in self.unknown_tables] or [
            ("schema", "E102", c, None) for c in self.unknown_columns if c not in DEFAULT.prohibited()
        ]
        first = [h for h in self.hits if h[0] == "ascii_input"]
        object.__setattr__(self, "hits", (*first, *schema, *self.hits[len(first) :]))

    def code(self, layer):
        return next((h[1] for h in self.hits if h[0] == layer), None)

    @property
    def verdict(self):
        return next(((n, self.code(n)) for n in _DONE if self.code(n)), (None, None))

    @property
    def passed(self):
        layer = self.verdict[0]
        return _DONE if layer is None else _DONE[: _DONE.index(layer)]


def _count(select, rest):
    head = f"{select}, " if select else ""
    return f"SELECT {head}COUNT(DISTINCT person_id) AS Count_Patients FROM {rest}"


_G = "gender_concept_id"

TEXTS = (
    Text(
        _count(_G, f"person WHERE location_id > {{n}} GROUP BY {_G}"),
        group_by=(_G,),
    ),
    Text(
        "-- cohort {n} by ssn\nSELECT p.gender_concept_id, co.condition_concept_id,\n"
        "       COUNT(DISTINCT p.person_id) AS Count_Patients,\n"
        "       AVG(CAST(p.year_of_birth AS FLOAT)) AS avg_year\n"
        "FROM person p JOIN condition_occurrence co ON p.person_id = co.person_id\n"
        "WHERE co.condition_source_value = '{p}; SELECT ssn -- {n}' /* city */\n"
        "GROUP BY p.gender_concept_id, co.condition_concept_id;\n",
        group_by=("p.gender_concept_id", "co.condition_concept_id"),
    ),
    Text(
        "SELECT COUNT(DISTINCT person_id) AS Count_Patients, SUM(1) AS total\n"
        "FROM drug_exposure WHERE drug_concept_id = {n}",
        global_aggregate=True,
    ),
    Text(
        _count(_G, f"person WHERE gender_source_value = 'caf\u00e9 {{n}}' GROUP BY {_G}"),
        hits=(("ascii_input", "E001", "\u00e9", None),),
        group_by=(_G,),
    ),
    Text(
        _count("", "person\x07 WHERE location_id = {n}"),
        hits=(("ascii_input", "E002", "\x07", None),),
        global_aggregate=True,
    ),
    Text(_BLANK_TEXT, hits=(("ascii_input", "E003", None, None),), n_statements=0),
    Text(
        _count("p.patient_name", "person p WHERE p.location_id = {n} GROUP BY p.patient_name"),
        hits=(
            ("phi", "E201", "patient_name", "SELECT"),
            ("phi", "E201", "patient_name", "GROUP BY"),
        ),
        group_by=("p.patient_name",),
        unknown_columns=("patient_name",),
    ),
    Text(
        _count(_G, f"person WHERE SSN = '{{p}}' AND location_id = {{n}} GROUP BY {_G}"),
        hits=(("phi", "E201", "SSN", "WHERE"),),
        group_by=(_G,),
        unknown_columns=("ssn",),
    ),
    Text(
        "SELECT l.city AS place, COUNT(DISTINCT p.person_id) AS Count_Patients FROM person p "
        "JOIN location l ON p.location_id = l.location_id WHERE l.location_id = {n} "
        "GROUP BY l.city",
        hits=(("phi", "E202", "city", "SELECT"), ("phi", "E202", "city", "GROUP BY")),
        group_by=("l.city",),
    ),
    Text(
        _count("month_of_birth", "person WHERE location_id = {n} GROUP BY month_of_birth"),
        hits=(
            ("phi", "E203", "month_of_birth", "SELECT"),
            ("phi", "E203", "month_of_birth", "GROUP BY"),
        ),
        group_by=("month_of_birth",),
    ),
    Text(
        "SELECT * FROM person WHERE location_id = {n}",
        hits=(
            ("phi", "E204", "*", "SELECT"),
            ("aggregation", "E302", None, None),
            ("aggregation", "E301", None, None),
        ),
    ),
    Text(
        _count(_G, "person WHERE location_id = {n}"),
        hits=(("aggregation", "E301", None, None),),
    ),
    Text(
        f"SELECT {_G}, AVG(year_of_birth) AS avg_year FROM person "
        f"WHERE location_id = {{n}} GROUP BY {_G}",
        hits=(("aggregation", "E302", None, None),),
        group_by=(_G,),
    ),
    Text(
        f"SELECT {_G}, COUNT(person_id) AS Count_Patients FROM person "
        f"WHERE location_id = {{n}} GROUP BY {_G}",
        hits=(("aggregation", "E303", "COUNT(person_id)", None),),
        group_by=(_G,),
        wrong_count="COUNT(person_id)",
    ),
    Text(
        f"SELECT {_G}, count(distinct person_id) as n_persons FROM person "
        f"WHERE location_id = {{n}} GROUP BY {_G}",
        hits=(("aggregation", "E303", "count(distinct person_id) as n_persons", None),),
        group_by=(_G,),
        wrong_count="count(distinct person_id) as n_persons",
    ),
    Text(
        _count(_G, f"person GROUP BY {_G} HAVING COUNT(*) > {{n}}"),
        hits=(("aggregation", "E304", "COUNT", "HAVING"),),
        group_by=(_G,),
    ),
    Text(
        _count("person_id", "person WHERE location_id = {n} GROUP BY person_id"),
        hits=(("aggregation", "E305", "person_id", "GROUP BY"),),
        group_by=("person_id",),
    ),
    Text(
        _count(
            _G,
            f"( SELECT {_G}, person_id FROM person WHERE location_id > {{n}} ) AS s GROUP BY {_G}",
        ),
        hits=(("enforcement", "E401", None, None),),
        group_by=(_G,),
    ),
    Text(
        "WITH c AS (SELECT person_id FROM person WHERE location_id > {n}) " + _count("", "c"),
        hits=(("enforcement", "E402", None, "WITH"), ("enforcement", "E401", None, None)),
        global_aggregate=True,
    ),
    Text(
        _count(_G, f"person WHERE location_id = {{n}} GROUP BY {_G}; DROP TABLE person"),
        hits=(("system", "E802", None, None),),
        group_by=(_G,),
        n_statements=2,
    ),
    Text(
        "SELECT pr.NPI, COUNT(DISTINCT v.person_id) AS Count_Patients FROM visit_occurrence v "
        "JOIN provider pr ON v.provider_id = pr.provider_id WHERE v.care_site_id = {n} "
        'GROUP BY pr."npi"',
        hits=(("phi", "E201", "NPI", "SELECT"), ("phi", "E201", '"npi"', "GROUP BY")),
        group_by=('pr."npi"',),
    ),
    Text(
        _count(_G, f"encounters WHERE location_id = {{n}} GROUP BY {_G}"),
        group_by=(_G,),
        unknown_tables=("encounters",),
        unknown_columns=(_G, "location_id", "person_id"),
    ),
    Text(
        _count("favourite_colour", "person WHERE location_id = {n} GROUP BY favourite_colour"),
        group_by=("favourite_colour",),
        unknown_columns=("favourite_colour",),
    ),
    Text(
        _count(
            "FLOOR(year_of_birth / 10)",
            "person WHERE location_id = {n} GROUP BY FLOOR(year_of_birth / 10), state, 1",
        ),
        group_by=("FLOOR(year_of_birth / 10)", "state", "1"),
        unknown_columns=("state",),
    ),
    Text(
        _count(_G, f"person WHERE location_id = {{n}} GROUP BY {_G}")
        + " UNION ALL "
        + _count("", "death"),
        hits=(("enforcement", "E401", None, None),),
        group_by=(_G,),
    ),
)


def log_from_orders(orders: DataFrame) -> DataFrame:
    """Batch or streaming orders to the log schema."""
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, 0).otherwise(key % len(TEXTS)).cast("int")
    text = F.element_at(F.array(*[F.lit(t.query) for t in TEXTS]), kind + 1)
    filled = F.replace(text, F.lit("{n}"), (key % 100).cast("string"))
    # the orders carry days without a time zone, which count as UTC
    days = F.unix_date(F.col("o_orderdate").cast("date"))
    return orders.select(
        key.cast("string").alias("request_id"),
        F.timestamp_seconds(days.cast("long") * 86400 + key % 86400).alias("ts"),
        F.when(key % 3 == 1, "u0")
        .otherwise(F.concat(F.lit("u"), F.col("o_custkey") % 20))
        .alias("user_id"),
        F.concat(F.lit("s"), F.col("o_custkey")).alias("session_id"),
        F.concat(F.lit("10.0.0."), F.col("o_custkey") % 250).alias("ip_address"),
        F.replace(filled, F.lit("{p}"), F.col("o_orderpriority")).alias("query"),
    )


def sample_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given orders may be one row group, that is one task: their narrow rows are dealt out over
    the session's shuffle partitions before the texts are made, as a log of many files would be."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return log_from_orders(orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))


# ---------------------------------------------------------------- the same in SQL


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, names) -> str:
    """A VALUES list as a table expression."""
    body = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


_LIST = "[" + ", ".join(quoted(t.query) for t in TEXTS) + "]"

LOG_SQL = f"""log AS (
  SELECT *, replace(replace({_LIST}[kind + 1], '{{n}}', CAST(o_orderkey % 100 AS VARCHAR)),
                    '{{p}}', o_orderpriority) AS query
  FROM (
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % {len(TEXTS)} END AS kind,
           CAST(o_orderkey AS VARCHAR) AS request_id,
           o_orderdate + to_seconds(o_orderkey % 86400) AS ts,
           CASE WHEN o_orderkey % 3 = 1 THEN 'u0'
                ELSE 'u' || CAST(o_custkey % 20 AS VARCHAR) END AS user_id,
           's' || CAST(o_custkey AS VARCHAR) AS session_id,
           '10.0.0.' || CAST(o_custkey % 250 AS VARCHAR) AS ip_address,
           o_orderkey, o_orderpriority
    FROM orders))"""

MASKED_SQL = r"""masked AS (
  SELECT *, regexp_replace(query,
    '''[^'']*''|("[^"]*"|`[^`]*`)|--[^\r\n]*|(?s:/\*.*?\*/)', '\1 ', 'g') AS masked
  FROM log)"""


def expected(name: str, rows, names) -> str:
    """A CTE of expectations, to be joined to the log by ``kind``."""
    return f"{name} AS {values(rows, ['kind', *names])}"


def per_text(*facts):
    """Rows (kind, fact...) with one row per text."""
    return [(i, *(f(t) for f in facts)) for i, t in enumerate(TEXTS)]


VERDICT_SQL = expected(
    "verdict",
    per_text(
        lambda t: t.verdict[0],
        lambda t: t.verdict[1],
        lambda t: ",".join(t.passed),
        lambda t: len(t.passed),
    ),
    ["layer", "code", "layers_passed", "n_layers_passed"],
)
HITS_SQL = expected(
    "hits",
    [(i, n, *h) for i, t in enumerate(TEXTS) for n, h in enumerate(t.hits)],
    ["ordinal", "layer", "code", "token", "clause"],
)
HASH_SQL = f"sha256(trim(regexp_replace(query, '[{WHITESPACE}]+', ' ', 'g')))"
