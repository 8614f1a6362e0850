"""The single rules, each on the whole query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellward.functions import characters as chars
from cellward.functions import statements as st
from cellward.operators import log_tables
from cellward.operators.verdicts import read_statements, violations
from cellward.plans.registry import query
from cellward.plans.sample_log import (
    HITS_SQL,
    LOG_SQL,
    MASKED_SQL,
    TEXTS,
    expected,
    per_text,
    quoted,
    sample_log,
)
from cellward.plans.vocabularies import ALL_ERRORS, log
from cellward.operators.reports import utc_text
from cellward.session import fresh_path
from cellward.sources import query_log
from cellward.sources.catalog import column_catalog


def _read(spark, sf_dir):
    return read_statements(log(spark, sf_dir))


def _rule(name, fact, column, rule):
    """A query with one rule's outcome per request; SQL: the outcome each text should have."""
    sql = f"""WITH {LOG_SQL}, {expected("facts", per_text(fact), [column])}
    SELECT request_id, {column} FROM log JOIN facts USING (kind)"""

    @query(name, sql)
    def _(spark, sf_dir):
        return _read(spark, sf_dir).select("request_id", rule().alias(column))


@query(
    "query_log_scan",
    f"""WITH {LOG_SQL} SELECT request_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
           user_id, session_id, ip_address, query FROM log""",
)
def _(spark, sf_dir):
    path = fresh_path(spark, "query-log")
    sample_log(spark, sf_dir).write.parquet(path)
    return query_log.read_query_log(spark, path).withColumn("ts", utc_text(F.col("ts")))


@query("mask_text", f"WITH {LOG_SQL}, {MASKED_SQL} SELECT request_id, masked FROM masked")
def _(spark, sf_dir):
    return log(spark, sf_dir).select("request_id", st.mask(F.col("query")).alias("masked"))


_rule(
    "statement_split",
    lambda t: t.n_statements,
    "n_statements",
    lambda: F.when(F.col("_blank"), 0).otherwise(F.size(st.statements(F.col("_flat")))),
)


def _phi(name, code):
    @query(
        name,
        f"""WITH {LOG_SQL}, {HITS_SQL}
        SELECT request_id, token, clause FROM log JOIN hits USING (kind)
        WHERE code = '{code}'""",
    )
    def _(spark, sf_dir):
        hits = violations(log(spark, sf_dir), policy=ALL_ERRORS.only("phi"))
        return hits.where(F.col("code") == code).select("request_id", "token", "clause")


_phi("phi_direct", "E201")
_phi("phi_geo", "E202")
_phi("phi_date", "E203")


@query(
    "phi_clause",
    f"""WITH {LOG_SQL}, {HITS_SQL}
    SELECT clause, code, count(*) AS n_hits FROM log JOIN hits USING (kind)
    WHERE layer = 'phi' GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    hits = violations(log(spark, sf_dir), policy=ALL_ERRORS.only("phi"))
    return hits.groupBy("clause", "code").agg(F.count("*").alias("n_hits"))


@query(
    "select_star",
    rf"""WITH {LOG_SQL}, {MASKED_SQL}
    SELECT request_id, regexp_matches(upper(masked), '\bSELECT\s+(DISTINCT\s+)?(\w+\.)?\*')
             AS is_star FROM masked""",
)
def _(spark, sf_dir):
    return _read(spark, sf_dir).select(
        "request_id", st.has_select_star(F.col("_flat")).alias("is_star")
    )


@query(
    "patient_count_syntax",
    f"""WITH {LOG_SQL}, {HITS_SQL}, {expected(
        "wrong", per_text(lambda t: t.wrong_count), ["found_syntax"]
    )}
    SELECT request_id, found_syntax,
           CASE WHEN found_syntax IS NOT NULL THEN 'E303'
                WHEN kind IN (SELECT kind FROM hits WHERE code = 'E302') THEN 'E302' END AS code
    FROM log JOIN wrong USING (kind) WHERE trim(query, {quoted(chars.WHITESPACE)}) <> ''""",
)
def _(spark, sf_dir):
    counts = F.col("_counts")
    wrong = st.wrong_patient_count(counts)
    return (
        _read(spark, sf_dir)
        .where(~F.col("_blank"))
        .select(
            "request_id",
            wrong.alias("found_syntax"),
            F.when(wrong.isNotNull(), "E303")
            .when(~st.has_patient_count(counts), "E302")
            .alias("code"),
        )
    )


@query(
    "has_patient_count",
    rf"""WITH {LOG_SQL}, {MASKED_SQL}
    SELECT request_id, regexp_matches(masked,
      '(?i:COUNT\s*\(\s*DISTINCT\s+(\w+\.)?person_id\s*\)\s+AS)\s+Count_Patients\b') AS has_count
    FROM masked""",
)
def _(spark, sf_dir):
    return _read(spark, sf_dir).select(
        "request_id", st.has_patient_count(F.col("_counts")).alias("has_count")
    )


_rule(
    "group_by_required",
    lambda t: bool(t.group_by),
    "has_group_by",
    lambda: st.has_group_by(F.col("_flat")),
)
_rule(
    "global_aggregate",
    lambda t: t.global_aggregate,
    "is_global",
    lambda: st.is_global_aggregate(F.col("_flat"), F.col("_lists")),
)
_rule(
    "aggregate_misuse",
    lambda t: next((f"{h[2]} in {h[3]}" for h in t.hits if h[1] == "E304"), None),
    "misuse",
    lambda: F.concat(
        st.misplaced_aggregate(F.col("_parts"))["function"],
        F.lit(" in "),
        st.misplaced_aggregate(F.col("_parts"))["clause"],
    ),
)
_rule(
    "cte_check",
    lambda t: any(h[1] == "E402" for h in t.hits),
    "has_cte",
    lambda: st.has_cte(F.col("_flat")),
)
_rule(
    "subquery_check",
    lambda t: any(h[1] == "E401" for h in t.hits),
    "has_subquery",
    lambda: st.has_subquery(F.col("_flat")),
)

_ITEMS = [(i, n, g) for i, t in enumerate(TEXTS) for n, g in enumerate(t.group_by)]


@query(
    "group_by_columns",
    f"""WITH {LOG_SQL}, {expected("items", _ITEMS, ["ordinal", "item"])}
    SELECT request_id, ordinal, item FROM log JOIN items USING (kind)""",
)
def _(spark, sf_dir):
    return log_tables.group_by_rows(log(spark, sf_dir))


@query(
    "group_by_columns_valid",
    f"""WITH {LOG_SQL}, {expected("items", _ITEMS, ["ordinal", "item"])}
    SELECT item, count(*) AS n_items,
           CASE WHEN item IN ('1', 'FLOOR(year_of_birth / 10)') THEN 'expression'
                WHEN item = 'person_id' THEN 'person_key'
                WHEN item IN ('p.patient_name', 'l.city', 'month_of_birth', 'pr."npi"')
                THEN 'prohibited'
                WHEN item IN ('favourite_colour', 'state') OR query LIKE '%encounters%'
                THEN 'unknown' ELSE 'ok' END AS status
    FROM log JOIN items USING (kind) GROUP BY ALL""",
)
def _(spark, sf_dir):
    checked = log_tables.check_group_by(log(spark, sf_dir), column_catalog(spark))
    return checked.groupBy("item", "status").agg(F.count("*").alias("n_items"))


_TRIMMED = f"rtrim(rtrim(query, {quoted(chars.WHITESPACE)}), ';')"
_WRAPPED = (
    f"'SELECT * FROM (' || chr(10) || '    ' || {_TRIMMED} || chr(10) || "
    "') AS validated_query' || chr(10) || 'WHERE Count_Patients >= 20000'"
)


@query("wrap_text", f"WITH {LOG_SQL} SELECT request_id, {_WRAPPED} AS wrapped FROM log")
def _(spark, sf_dir):
    return log(spark, sf_dir).select("request_id", st.wrap(F.col("query")).alias("wrapped"))


@query(
    "unwrap_text",
    f"""WITH {LOG_SQL}
    SELECT request_id, trim({_TRIMMED}, {quoted(chars.WHITESPACE)}) AS unwrapped FROM log""",
)
def _(spark, sf_dir):
    wrapped = log(spark, sf_dir).select("request_id", st.wrap(F.col("query")).alias("_w"))
    return wrapped.select("request_id", st.unwrap(F.col("_w")).alias("unwrapped"))
