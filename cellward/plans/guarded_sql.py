"""Run a submitted SQL text under the guard: verdict, allowed tables, safe views, threshold.

Spark analyses and runs the text; this module only decides whether Spark may see it, and puts
the threshold above it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellward.functions import statements as st
from cellward.functions.characters import first_forbidden
from cellward.operators.deidentify import safe_view
from cellward.operators.verdicts import drop_derived, read_statements, verdicts
from cellward.policy import COUNT_ALIAS, PERSON_COLUMN, GuardError, Policy
from cellward.session import fresh_path, literal_table
from cellward.sources.vocabulary import DEFAULT, Vocabulary

# Parts of Spark's dialect that could forge the person count, show rows of withheld cells, or
# leave the safe views: generated rows, pivots, pipe syntax, scripts, calls into the JVM,
# substituted names, filters of a single aggregate, windows, joins without a key.
_FORBIDDEN = (
    r"(?i)\b(?:LATERAL|PIVOT|UNPIVOT|VALUES|TABLE|TABLESAMPLE|TRANSFORM|REFLECT|JAVA_METHOD|"
    r"TRY_REFLECT|IDENTIFIER|OVER|WINDOW|WITHIN|CROSS|NATURAL|USING)\b|\bFILTER ?\(|\|>|\$\{"
)
# Scalar functions that may stand around or beside aggregates. Any other function is refused.
_SCALARS = frozenset(
    """abs ceil ceiling coalesce concat date_trunc extract floor length lower month nullif quarter
    round substr substring trim upper year""".split()
)
_AGGREGATES = frozenset(a.lower() for a in st.AGGREGATES)
# An aggregate may read one column as it is: a condition inside could single out a person.
_AGGREGATE_CALL = re.compile(
    rf"\b(?:{'|'.join(st.AGGREGATES)})\s*\(\s*(?:\*|(?:DISTINCT\s+)?[\w.]+|"
    r"CAST\s*\(\s*[\w.]+\s+AS\s+\w+\s*\))\s*\)",
    re.IGNORECASE,
)
# Aggregates that show the same whether equal rows stand once or many times.
_SET_AGGREGATE = re.compile(r"\b(?:COUNT\s*\(\s*DISTINCT\b|(?:MIN|MAX)\s*\()", re.IGNORECASE)
_ANY_AGGREGATE = re.compile(rf"\b(?:{'|'.join(st.AGGREGATES)})\s*\(", re.IGNORECASE)
# One table after FROM or JOIN: a bare name with an optional alias, then join words.
_TABLE_TERM = re.compile(
    r"(\w+)(?: (?:AS )?(\w+))??(?: (?:INNER|LEFT|RIGHT|FULL|OUTER|SEMI|ANTI))*;?", re.IGNORECASE
)
_KEY_EQUALITY = re.compile(r"(\w+)\.(\w+) ?= ?(\w+)\.(\w+)")
_JOIN_WORDS = re.compile(r"(?: (?:INNER|LEFT|RIGHT|FULL|OUTER|SEMI|ANTI))+;?$", re.IGNORECASE)
_COMMENT = re.compile(r"('[^']*'|\"[^\"]*\"|`[^`]*`)|--[^\r\n]*|/\*.*?\*/", re.DOTALL)

_SESSION_SETTINGS = {
    "spark.sql.runSQLOnFiles": "false",  # no FROM parquet.`/path`
    "spark.sql.lateralColumnAlias.enableImplicitResolution": "false",
    "spark.sql.variable.substitute": "false",
    # the text's joins run as written: split a person with very many rows even when the
    # following aggregation could have used the join's partitioning
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def guarded_session(
    spark: SparkSession,
    tables: Mapping[str, Callable[[SparkSession], DataFrame]],
    vocab: Vocabulary = DEFAULT,
    *,
    policy: Policy = Policy(),
) -> SparkSession:
    """A session whose only views are the safe views of ``tables`` (name -> loader).

    The loaders run inside the new session; the caller's own views do not exist there.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    for key, value in _SESSION_SETTINGS.items():
        session.conf.set(key, value)
    for name, load in tables.items():
        safe_view(load(session), vocab, strict=policy.strict).createOrReplaceTempView(name)
    return session


def check_sql(
    session: SparkSession,
    text: str,
    tables,
    vocab: Vocabulary = DEFAULT,
    *,
    policy: Policy = Policy(),
) -> None:
    """Raise ``GuardError`` unless the text passes every layer, reads only ``tables``, joins them
    by their keys, and shows nothing but group items and plain aggregates."""
    _checked(session, text, tables, vocab, policy)


def _checked(session: SparkSession, text: str, tables, vocab: Vocabulary, policy: Policy) -> dict[str, list[str]]:
    """Check a text. Returns its fact tables that may be read as sets, with the columns it names of them."""
    # the names of tables and columns are those of the session, which Spark resolves
    policy = policy.only(*(n for n in policy.layers if n != "schema"))
    log = literal_table(session, [("1", text)], "request_id string, query string")
    read = read_statements(verdicts(log, vocab, policy=policy), vocab)
    parts = F.col("_parts")
    facts = drop_derived(
        read.withColumns(
            {
                "code_text": F.col("_flat"),
                "clauses": F.transform(parts, lambda s: F.struct(s["clause"], F.trim(s["text"]))),
                "functions": F.transform(
                    F.filter("_ids", lambda i: i["is_function"]), lambda i: i["name"]
                ),
                "names": F.array_distinct(F.transform("_ids", lambda i: i["name"])),
                "bound": F.array_distinct(F.transform("_bound", lambda t: t["name"])),
                "forbidden": F.col("_flat").rlike(_FORBIDDEN),
                "items": st.select_items(F.col("_flat"), F.col("_lists")),
                "counts": F.col("_counts"),
                "person_order": F.exists(
                    parts, lambda s: s["clause"].isin("ORDER BY", "HAVING") & st.names_person(s["text"])
                ),
            }
        )
    ).first()
    if not facts["success"]:
        raise GuardError(facts["code"], facts["message"], facts["details"])
    right = {c["written"] for c in facts["counts"] if c["distinct"]}
    person = re.compile(rf"(?<![\w$]){PERSON_COLUMN}(?![\w$])", re.IGNORECASE)
    if facts["person_order"] or any(person.search(i) for i in facts["items"] if i not in right):
        raise GuardError("E305", "the person key may only be used in the distinct count")
    if facts["forbidden"] or "/*+" in text:
        raise GuardError("E802", "the text uses a construct that guarded queries may not use")
    unknown = [f for f in facts["functions"] if f not in _SCALARS | _AGGREGATES]
    if unknown:
        raise GuardError("E802", f"guarded queries may not use the function '{unknown[0]}'")
    if len(_ANY_AGGREGATE.findall(facts["code_text"])) != len(
        _AGGREGATE_CALL.findall(facts["code_text"])
    ):
        raise GuardError("E802", "an aggregate may only read one column, without a condition")
    _check_tables(session, [tuple(c) for c in facts["clauses"]], {t.lower() for t in tables})
    code = facts["code_text"]
    if len(facts["bound"]) < 2 or len(_ANY_AGGREGATE.findall(code)) != len(_SET_AGGREGATE.findall(code)):
        return {}
    named = {t: [c for c in session.table(t).columns if c.lower() in facts["names"]] for t in facts["bound"]}
    # the table of persons has one row for each of them
    return {t: c for t, c in named.items() if PERSON_COLUMN in (x.lower() for x in c) and t != "person"}


def _check_tables(session: SparkSession, clauses: list[tuple[str, str]], allowed: set[str]) -> None:
    """Approved tables only. Every further table is tied by equal keys of the same name; tables
    with the person key are all tied by it, so that a count of persons counts real ones."""
    bound: dict[str, str] = {}
    ties: list[tuple[str, str, str]] = []
    joined = 0
    for clause, text in clauses:
        body = text[len(clause) :].strip() if text.upper().startswith(clause) else text
        if clause in ("FROM", "JOIN"):
            for item in body.split(","):
                found = _TABLE_TERM.fullmatch(item.strip())
                if found is None or found[1].lower() not in allowed:
                    raise GuardError("E101", f"'{item.strip()}' is not an approved table")
                bound[(found[2] or found[1]).lower()] = found[1].lower()
                joined += 1
        elif clause == "ON":
            for term in re.split(r" AND ", _JOIN_WORDS.sub("", body), flags=re.IGNORECASE):
                found = _KEY_EQUALITY.fullmatch(term.strip().rstrip(";").strip())
                if found is None or found[2].lower() != found[4].lower() or not found[2].lower().endswith("_id"):
                    raise GuardError("E802", f"'{term.strip()}' does not join two equal keys")
                ties.append((found[1].lower(), found[3].lower(), found[2].lower()))
    if len(bound) != joined:
        raise GuardError("E802", "every table needs a name of its own")
    if any(a == b or a not in bound or b not in bound for a, b, _ in ties):
        raise GuardError("E802", "a join condition must name two tables of the text")
    persons = {
        name for name, table in bound.items()
        if PERSON_COLUMN in (c.lower() for c in session.table(table).columns)
    }
    by_person = [(a, b) for a, b, key in ties if key == PERSON_COLUMN]
    if not _connected(persons, by_person):
        raise GuardError("E802", "tables with the person key must be joined by it")
    if not _connected(set(bound), [(a, b) for a, b, _ in ties]):
        raise GuardError("E802", "every table must be joined by a key")


def _connected(names: set[str], ties: list[tuple[str, str]]) -> bool:
    reached, before = set(sorted(names)[:1]), -1
    while len(reached) != before:
        before = len(reached)
        for a, b in ties:
            if {a, b} <= names and {a, b} & reached:
                reached |= {a, b}
    return reached == names


def guarded_sql(
    session: SparkSession,
    text: str,
    tables,
    vocab: Vocabulary = DEFAULT,
    *,
    policy: Policy = Policy(),
) -> DataFrame:
    """Result of a checked text: its cells with at least ``policy.min_cell`` persons.

    ``session`` comes from ``guarded_session``; ``tables`` are the names registered there. A text whose
    aggregates do not count repeated rows reads the distinct rows of its fact tables, so that a
    person with very many facts is collapsed before the join. A cell that is not printable ASCII stops the
    query that shows it.
    """
    sets = _checked(session, text, tables, vocab, policy)
    # without comments: what the rules masked must not reach Spark
    code = _COMMENT.sub(lambda m: m[1] or " ", text)
    distinct = [f"{t} AS (SELECT DISTINCT {', '.join(f'`{c}`' for c in columns)} FROM {t})" for t, columns in sets.items()]
    shadows = f"WITH {', '.join(distinct)} " if distinct else ""
    result = session.sql(shadows + code.rstrip().rstrip(";"))
    kept = result.where(F.col(COUNT_ALIAS) >= F.lit(policy.min_cell))
    kept = kept if policy.max_rows is None else kept.limit(policy.max_rows)
    return _printable(kept) if policy.scan_output else kept


def _texts(result: DataFrame) -> list[str]:
    return [f.name for f in result.schema if isinstance(f.dataType, StringType)]


def _printable(result: DataFrame) -> DataFrame:
    """The same cells; one with a forbidden character raises E001 where it is read."""

    def checked(cell, field):
        if not isinstance(field.dataType, StringType):
            return cell.alias(field.name)
        stop = F.raise_error(F.lit(f"E001 a cell of '{field.name}' is not printable ASCII; the result is withheld"))
        return F.when(first_forbidden(cell) >= 0, stop.cast("string")).otherwise(cell).alias(field.name)

    # by place, as a text may show two columns of one name
    places = [f"_{i}" for i in range(len(result.columns))]
    return result.toDF(*places).select(*[checked(F.col(p), f) for p, f in zip(places, result.schema)])


def release(result: DataFrame) -> DataFrame:
    """A guarded result as a stored table, or ``GuardError`` (E001) if one of its cells is not printable ASCII.

    The job that writes the result also counts such cells, so there is no second pass, and nobody
    sees the table before the count is known. For results read with ``scan_output=False``, or any other table.
    """
    path, seen = fresh_path(result.sparkSession, "released"), Observation()
    bad = [F.count_if(first_forbidden(F.col(f"`{c}`")) >= 0).alias(f"n_{i}") for i, c in enumerate(_texts(result))]
    watched = result.observe(seen, F.count(F.lit(1)).alias("n_rows"), *bad)
    watched.write.parquet(path)
    found = seen.get
    columns = [c for i, c in enumerate(_texts(result)) if found[f"n_{i}"]]
    if columns:
        raise GuardError("E001", f"cells of {columns} are not printable ASCII; the result is withheld", {"columns": columns})
    return result.sparkSession.read.parquet(path)
