"""Character rules on real text (documents, conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellward.functions import characters as chars
from cellward.operators import conformance
from cellward.plans.registry import query
from cellward.plans.sample_log import LOG_SQL, quoted, sample_log
from cellward.policy import Policy
from cellward.sources.tables import table

_CLEAN = r"^[\x20-\x7E\t\n\r]*"
_BAD = "(unicode(c) > 126 OR (unicode(c) < 32 AND unicode(c) NOT IN (9, 10, 13)))"


@query(
    "ascii_audit",
    rf"""WITH d AS (
      SELECT doc_id, text, CAST(length(regexp_extract(text, '{_CLEAN}')) AS INTEGER) AS position
      FROM documents)
    SELECT doc_id, position, CASE WHEN unicode(text[position + 1]) > 126 THEN 'E001'
                                  ELSE 'E002' END AS code,
           unicode(text[position + 1]) AS code_point
    FROM d WHERE position < length(text)""",
)
def _(spark, sf_dir):
    text = F.col("text")
    found = table(spark, sf_dir, "documents").select(
        "doc_id", "text", chars.first_forbidden(text).alias("position")
    )
    point = F.ascii(F.substring(text, F.col("position") + 1, F.lit(1)))
    return found.where("position >= 0").select(
        "doc_id", "position", chars.char_code(point).alias("code"), point.alias("code_point")
    )


@query(
    "ascii_blank",
    f"""WITH {LOG_SQL}
    SELECT trim(query, {quoted(chars.WHITESPACE)}) = '' AS blank, count(*) AS n_queries
    FROM log GROUP BY 1""",
)
def _(spark, sf_dir):
    log = sample_log(spark, sf_dir).select(chars.is_blank(F.col("query")).alias("blank"))
    return log.groupBy("blank").agg(F.count("*").alias("n_queries"))


@query(
    "ascii_positions",
    f"""WITH c AS (
      SELECT doc_id, unnest(string_split(text, '')) AS c,
             generate_subscripts(string_split(text, ''), 1) - 1 AS position
      FROM documents)
    SELECT doc_id, CAST(position AS INTEGER) AS position, c AS character,
           unicode(c) AS code_point
    FROM c WHERE {_BAD}""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return conformance.ascii_positions(docs, ["doc_id"], "text")


@query(
    "sanitize_log",
    rf"""WITH s AS (
      SELECT conv_id, turn, list_aggregate(list_transform(string_split(text, ''), lambda c:
        CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN c = chr(9) THEN '\t'
             WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r'
             ELSE '[U+' || printf('%04X', unicode(c)) || ']' END), 'string_agg', '') AS s
      FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(s) > 120 THEN s[:117] || '...' ELSE s END AS sanitized
    FROM s""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", chars.sanitize(F.col("text"), 120).alias("sanitized")
    )


@query(
    "char_class_profile",
    """WITH c AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents),
    k AS (SELECT lang, CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN 'printable'
                            WHEN unicode(c) IN (9, 10, 13) THEN 'control_allowed'
                            WHEN unicode(c) < 32 THEN 'control_forbidden'
                            ELSE 'non_ascii' END AS char_class FROM c),
    classes AS (SELECT * FROM (VALUES ('printable'), ('control_allowed'),
                               ('control_forbidden'), ('non_ascii')) AS v(char_class))
    SELECT l.lang, q.char_class, count(k.lang) AS n_chars
    FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN classes q
    LEFT JOIN k ON k.lang = l.lang AND k.char_class = q.char_class GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return conformance.character_profile(docs, "text", ["lang"])


@query(
    "output_ascii_scan",
    r"""WITH u AS (
      SELECT 'role' AS column_name, role AS cell FROM conversations
      UNION ALL SELECT 'text', text FROM conversations)
    SELECT column_name, count(cell) AS n_cells,
           count(*) FILTER (regexp_matches(cell, '[^\x20-\x7E\t\n\r]')) AS n_bad,
           count(*) FILTER (regexp_matches(cell, '[^\x20-\x7E\t\n\r]')) > 0 AS has_bad
    FROM u GROUP BY 1""",
)
def _(spark, sf_dir):
    return conformance.scan_output_ascii(table(spark, sf_dir, "conversations"))


@query(
    "query_length",
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, length(text) <= 10000 AS within
    FROM documents""",
)
def _(spark, sf_dir):
    limit = Policy().max_query_length
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length("text").alias("n_chars"),
        (F.length("text") <= limit).alias("within"),
    )
