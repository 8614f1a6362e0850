"""Dictionaries and catalogs against what the query log really uses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellward.functions.statements import KEYWORDS
from cellward.operators import log_tables
from cellward.operators.verdicts import violations
from cellward.plans.registry import query
from cellward.plans.sample_log import (
    HITS_SQL,
    LOG_SQL,
    MASKED_SQL,
    TEXTS,
    expected,
    quoted,
    sample_log,
    values,
)
from cellward.policy import Policy
from cellward.sources import catalog
from cellward.sources import vocabulary as voc
from cellward.sources.tables import table

ALL_ERRORS = Policy(max_errors=None)


def log(spark, sf_dir):
    return sample_log(spark, sf_dir)


# Names of a masked text by RE2: aliases, cast types, function names, numbers and keywords out.
TOKENS_SQL = rf"""{LOG_SQL}, {MASKED_SQL},
tokens AS (
  SELECT request_id, lower(replace(string_split(t, '.')[-1], '"', '')) AS name FROM (
    SELECT request_id, unnest(regexp_extract_all(
      regexp_replace(regexp_replace(masked, '(?i)\bAS\s+\w+', ' ', 'g'), '\w+\s*\(', '(', 'g'),
      '[A-Za-z_][\w."]*')) AS t FROM masked)),
named AS (
  SELECT request_id, name FROM tokens
  WHERE name NOT IN ({", ".join(quoted(k) for k in KEYWORDS)}))"""

_DICTIONARY_ROWS = [
    (n, c, False, None, "phi_list")
    for c in voc.CODES
    for n in sorted(getattr(voc.DEFAULT, c))
]
_DICTIONARY_ROWS += [(n, "direct", False, None, "catalog") for n in voc.CATALOG_ONLY_DIRECT]
_DICTIONARY_ROWS += [(n, "date", False, None, "catalog") for n in voc.CATALOG_ONLY_DATES]
_DICTIONARY_ROWS += [(n, "geographic", True, None, "phi_list") for n in voc.GEOGRAPHIC_ALLOWED]
_DICTIONARY_ROWS += [(n, "date", True, None, "phi_list") for n in voc.DATES_ALLOWED]


def _label_case(name):
    rules = " ".join(
        "WHEN "
        + " OR ".join(f"{name} LIKE '%{f}%' ESCAPE '\\'".replace("_", "\\_") for f in p.split("|"))
        + f" THEN {quoted(label)}"
        for p, label in voc.IDENTIFIER_TYPES
    )
    return f"CASE {rules} ELSE {quoted(voc.OTHER_IDENTIFIER)} END"


DICTIONARY_SQL = f"""dictionary AS (
  SELECT name, category, allowed, source,
         CASE WHEN category = 'direct' THEN {_label_case("name")} END AS identifier_type
  FROM {values(_DICTIONARY_ROWS, ["name", "category", "allowed", "x", "source"])})"""


@query(
    "phi_dictionary",
    f"""WITH {TOKENS_SQL}, {DICTIONARY_SQL}
    SELECT d.name, category, allowed, identifier_type, source, count(n.name) AS n_uses
    FROM dictionary d LEFT JOIN named n ON n.name = d.name GROUP BY ALL""",
)
def _(spark, sf_dir):
    usage = log_tables.name_usage(log(spark, sf_dir))
    return (
        voc.phi_dictionary(spark)
        .join(usage, "name", "left")
        .withColumn("n_uses", F.coalesce("n_uses", F.lit(0).cast("long")))
    )


@query(
    "phi_dictionary_custom",
    f"""WITH {DICTIONARY_SQL}, custom AS (
      SELECT DISTINCT lower(replace(p_brand, '-', '_')) AS name FROM part
      UNION SELECT DISTINCT 'ssn' FROM part)
    SELECT coalesce(d.name, c.name) AS name, coalesce(category, 'direct') AS category,
           coalesce(allowed, false) AS allowed,
           CASE WHEN d.name IS NULL THEN {_label_case("c.name")} ELSE identifier_type END
             AS identifier_type,
           coalesce(source, 'custom') AS source
    FROM dictionary d FULL JOIN custom c ON c.name = d.name""",
)
def _(spark, sf_dir):
    # an organisation's own list: the part brands, and one name that is known already
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    known = table(spark, sf_dir, "part").select(F.lit("SSN").alias("name")).distinct()
    custom = brands.union(known).withColumn("category", F.lit("direct"))
    return voc.merge_dictionaries(voc.phi_dictionary(spark), custom)


_EXTRA = [
    (i, n, c)
    for i, t in enumerate(TEXTS)
    for n, c in enumerate(("SELECT", "GROUP BY"), 1)
    if "favourite_colour" in t.query
]


@query(
    "phi_dictionary_audit",
    f"""WITH {LOG_SQL}, {HITS_SQL}, {expected("extra", _EXTRA, ["ordinal", "clause"])}
    SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY ordinal) AS ordinal, code, token, clause
    FROM log JOIN hits USING (kind) WHERE layer = 'phi' AND code <> 'E204'
    UNION ALL SELECT request_id, ordinal, 'E201', 'favourite_colour', clause FROM log JOIN extra USING (kind)""",
)
def _(spark, sf_dir):
    # an organisation's own list of one name for every part, and one that a text of the log uses
    parts = table(spark, sf_dir, "part")
    own = parts.select(F.concat(F.lit("part-"), "p_partkey").alias("name"))
    own = own.union(parts.select(F.lit("Favourite-Colour")).distinct()).withColumn("category", F.lit("direct"))
    dictionary = voc.merge_dictionaries(voc.phi_dictionary(spark), own)
    hits = violations(log(spark, sf_dir), dictionary, policy=ALL_ERRORS.only("phi")).where("code <> 'E204'")
    order = Window.partitionBy("request_id").orderBy("ordinal")
    return hits.select(
        "request_id", F.row_number().over(order).cast("long").alias("ordinal"), "code", "token", "clause"
    )


@query(
    "identifier_type",
    f"""WITH {LOG_SQL}, {HITS_SQL}
    SELECT {_label_case("lower(replace(token, chr(34), ''))")} AS identifier_type,
           count(*) AS n_uses
    FROM log JOIN hits USING (kind) WHERE code = 'E201' GROUP BY 1""",
)
def _(spark, sf_dir):
    hits = violations(log(spark, sf_dir), policy=ALL_ERRORS).where("code = 'E201'")
    label = voc.identifier_type(voc.normal_name(F.col("token")))
    return hits.groupBy(label.alias("identifier_type")).agg(F.count("*").alias("n_uses"))


_GAP = sorted(voc.DEFAULT.gap_direct) + sorted(voc.DEFAULT.gap_date)
_COLUMNS = [
    (t, c, i) for t, names in catalog.catalog_columns().items() for i, c in enumerate(names)
]


@query(
    "phi_gap",
    f"""WITH {TOKENS_SQL}, columns AS {values(_COLUMNS, ["table_name", "column_name", "i"])}
    SELECT table_name, column_name, count(n.name) AS n_uses,
           CASE WHEN column_name LIKE '%date%' THEN 'date' ELSE 'direct' END AS category
    FROM columns LEFT JOIN named n ON n.name = column_name
    WHERE column_name IN ({", ".join(quoted(n) for n in _GAP)}) GROUP BY ALL""",
)
def _(spark, sf_dir):
    usage = log_tables.name_usage(log(spark, sf_dir)).withColumnRenamed("name", "column_name")
    return (
        catalog.catalog_gap(spark)
        .join(usage, "column_name", "left")
        .select(
            "table_name", "column_name", "category",
            F.coalesce("n_uses", F.lit(0).cast("long")).alias("n_uses"),
        )
    )


@query(
    "omop_catalog",
    f"""WITH {TOKENS_SQL}, columns AS {values(_COLUMNS, ["table_name", "column_name", "ordinal"])},
    {DICTIONARY_SQL}
    SELECT table_name, column_name, ordinal, d.name IS NOT NULL AS prohibited,
           d.category AS reason, count(n.name) AS n_uses
    FROM columns LEFT JOIN (SELECT * FROM dictionary WHERE NOT allowed) d ON d.name = column_name
    LEFT JOIN named n ON n.name = column_name GROUP BY ALL""",
)
def _(spark, sf_dir):
    usage = log_tables.name_usage(log(spark, sf_dir)).withColumnRenamed("name", "column_name")
    return (
        catalog.column_catalog(spark)
        .join(usage, "column_name", "left")
        .withColumn("n_uses", F.coalesce("n_uses", F.lit(0).cast("long")))
    )


@query(
    "ident_tokens",
    f"WITH {TOKENS_SQL} SELECT name, count(*) AS n_uses FROM named GROUP BY 1",
)
def _(spark, sf_dir):
    return log_tables.name_usage(log(spark, sf_dir))


@query(
    "phi_tokens_semi",
    f"""WITH {LOG_SQL}, {HITS_SQL}
    SELECT request_id, token, clause FROM log JOIN hits USING (kind)
    WHERE code IN ('E201', 'E202', 'E203')""",
)
def _(spark, sf_dir):
    names = log_tables.identifier_rows(log(spark, sf_dir))
    found = log_tables.prohibited_rows(names, voc.phi_dictionary(spark))
    return found.select(
        "request_id", F.substring_index("token", ".", -1).alias("token"), "clause"
    )


@query(
    "schema_tables",
    f"""WITH {LOG_SQL}, {expected(
        "unknown",
        [(i, n) for i, t in enumerate(TEXTS) for n in t.unknown_tables],
        ["table_name"],
    )}
    SELECT table_name, count(*) AS n_queries FROM log JOIN unknown USING (kind) GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = log_tables.unknown_tables(log(spark, sf_dir), catalog.column_catalog(spark))
    return rows.groupBy("table_name").agg(F.count("*").alias("n_queries"))


@query(
    "schema_columns",
    f"""WITH {LOG_SQL}, {expected(
        "unknown",
        [(i, n) for i, t in enumerate(TEXTS) for n in t.unknown_columns],
        ["column_name"],
    )}
    SELECT column_name, count(*) AS n_queries FROM log JOIN unknown USING (kind) GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = log_tables.unknown_columns(log(spark, sf_dir), catalog.column_catalog(spark))
    return rows.groupBy("column_name").agg(F.count("*").alias("n_queries"))
