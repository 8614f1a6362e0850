"""Character and statement functions."""

import pytest
from pyspark.sql import functions as F

from cellward.functions import characters as ch
from cellward.functions import statements as st
from cellward.operators import conformance
from cellward.operators.verdicts import _facts, audit_log, read_statements, violations
from cellward.policy import Policy
from cellward.session import literal_table


def one(log_of, text, function, *args):
    return log_of(text).select(function(F.col("query"), *args).alias("x")).first()["x"]


@pytest.mark.parametrize("char", ["A", "z", "0", " ", "~"])
def test_printable(log_of, char):
    assert one(log_of, char, ch.is_ascii_printable) is True


@pytest.mark.parametrize("char", ["\n", "\t", "é", "\x7f"])
def test_not_printable(log_of, char):
    assert one(log_of, char, ch.is_ascii_printable) is False


def test_control_characters(log_of):
    assert [one(log_of, c, ch.is_allowed_control_char) for c in "\n\r\t"] == [True] * 3
    assert [one(log_of, c, ch.is_allowed_control_char) for c in "\x00\x07A"] == [False] * 3
    assert one(log_of, "ab", ch.is_allowed_control_char) is None


def test_positions_match_brute_force(spark, log_of):
    texts = ["plain", "café naïve", "\U0001f600a\x00\x7f​", "\t\n\r", ""]
    got = conformance.ascii_positions(log_of(*texts), ["request_id"], "query").collect()
    expected = {
        (str(i), p, c, ord(c))
        for i, t in enumerate(texts)
        for p, c in enumerate(t)
        if not (0x20 <= ord(c) <= 0x7E or c in "\t\n\r")
    }
    assert {(r["request_id"], r["position"], r["character"], r["code_point"]) for r in got} == (
        expected
    )


def python_sanitize(text, limit):
    names = {"\t": "\\t", "\n": "\\n", "\r": "\\r"}
    out = "".join(
        c if 0x20 <= ord(c) <= 0x7E else names.get(c, f"[U+{ord(c):04X}]") for c in text
    )
    return out if len(out) <= limit else out[: limit - 3] + "..."


@pytest.mark.parametrize("limit", [10, 100, 200])
def test_sanitize(log_of, limit):
    texts = ["SELECT café", "SELECT\n\tperson_id\r\nFROM x", "A" * 300, "\U0001f600" * 40, ""]
    got = log_of(*texts).select("query", ch.sanitize(F.col("query"), limit).alias("s")).collect()
    assert [r["s"] for r in got] == [python_sanitize(t, limit) for t in texts]


def test_class_counts_cover_the_text(log_of):
    row = one(log_of, "ab\t\n\x00\x01é\U0001f600\x7f", ch.class_counts)
    assert tuple(row) == (2, 2, 2, 3)


def test_wrap_and_unwrap(log_of):
    text = "\n  SELECT a\nFROM b  \n;;  "
    wrapped = one(log_of, text, st.wrap, 500)
    assert wrapped == (
        "SELECT * FROM (\n    \n  SELECT a\nFROM b  \n\n) AS validated_query\n"
        "WHERE Count_Patients >= 500"
    )
    assert one(log_of, wrapped, st.unwrap) == "SELECT a\nFROM b"
    assert one(log_of, "SELECT 1", st.unwrap) == "SELECT 1"


def facts(log_of, text):
    code = st.flat(F.col("query"))
    return (
        log_of(text)
        .select(code.alias("code"))
        .select("code", st.segments(F.col("code")).alias("p"))
        .select("code", "p", st.lists(F.col("p")).alias("l"))
        .select(
            "code",
            st.identifiers(F.col("p")).alias("ids"),
            st.tables(F.col("p")).alias("tables"),
            st.group_by_columns(F.col("l")).alias("groups"),
            st.is_global_aggregate(F.col("code"), F.col("l")).alias("is_global"),
        )
        .first()
    )


def test_statement_facts(log_of):
    row = facts(
        log_of,
        "SELECT p.a AS ssn, f(b), CAST(c AS DATE) FROM t p, u LEFT JOIN `my-x` y ON p.k = y.k\n"
        "WHERE z = 'it''s; -- ssn' /* email */ GROUP BY p.a, COALESCE(b, c) ORDER BY 1",
    )
    names = [(i["clause"], i["name"]) for i in row["ids"] if not i["is_function"]]
    assert names == [
        ("SELECT", "a"), ("SELECT", "b"), ("SELECT", "c"), ("FROM", "t"), ("FROM", "p"),
        ("FROM", "u"), ("JOIN", "my_x"), ("JOIN", "y"), ("ON", "k"), ("ON", "k"),
        ("WHERE", "z"), ("GROUP BY", "a"), ("GROUP BY", "b"), ("GROUP BY", "c"),
    ]
    assert row["tables"] == ["t", "u", "my_x"]
    assert row["groups"] == ["p.a", "COALESCE(b, c)"]
    assert row["is_global"] is False


def test_huge_and_hostile_texts(log_of):
    """No text may overflow a task's stack or be cut short."""
    pad = "person_id, " * 30000
    texts = [
        "a." * 100000 + "b",
        "'" * 99999,
        "(" * 50000 + ")" * 50000,
        "/* " * 20000 + "*/" * 20000,
        '"' + "q" * 200000,
        f"SELECT {pad} ssn, COUNT(DISTINCT person_id) AS Count_Patients FROM person",
        "SELECT '" + "y" * 300000 + "' AS a, email FROM person",
        " " * 200000 + " ",
    ]
    got = [r["code"] for r in audit_log(log_of(*texts)).orderBy("request_id").collect()]
    assert got[5:] == ["E201", "E201", "E003"]
    assert None not in got


def test_details_and_verbosity(log_of):
    rows = audit_log(log_of("SELECT * FROM café", "SELECT patient_name FROM person")).collect()
    assert dict(rows[0]["details"]) == {
        "position": "17", "character": "é", "code_point": "233",
    }
    assert dict(rows[1]["details"]) == {
        "column_name": "patient_name",
        "identifier_type": "name (Category 1)",
        "clause": "SELECT",
    }
    brief = audit_log(log_of("x"), policy=Policy(verbosity=1)).columns
    assert not {"guidance", "correct_pattern", "documentation"} & set(brief)


def test_violations_limit(log_of):
    log = log_of("SELECT ssn, email, city FROM person")
    assert violations(log).count() == 1
    everything = violations(log, policy=Policy(max_errors=None)).orderBy("ordinal").collect()
    assert [r["code"] for r in everything] == ["E201", "E201", "E202", "E302", "E301"]


def test_guidance_patterns_pass_the_audit(spark):
    from cellward.operators.verdicts import verdicts
    from cellward.policy import LAYERS
    from cellward.sources.guidance import CODE_LAYERS, TEXTS

    assert set(CODE_LAYERS) == set(TEXTS)
    rows = [(code, pattern) for code, (_, pattern) in TEXTS.items() if pattern]
    log = literal_table(spark, rows, "request_id string, query string")
    bad = verdicts(log, policy=Policy(layers=LAYERS)).where("NOT success").collect()
    assert not bad


def test_unknown_code_gets_default_guidance(spark):
    from cellward.sources.guidance import with_guidance

    df = literal_table(spark, [("1", "E999"), ("2", None)], "request_id string, code string")
    rows = with_guidance(df).orderBy("request_id").collect()
    assert rows[0]["guidance"] == "Unknown error code"
    assert rows[0]["documentation"].endswith("/overview")
    assert rows[1]["guidance"] is None and rows[1]["documentation"] is None


def test_any_depth_of_parentheses(log_of):
    deep = "(" * 20 + "year_of_birth" + ")" * 20
    text = (
        f"SELECT {deep} AS y, COUNT(DISTINCT person_id) AS Count_Patients FROM person "
        "GROUP BY COALESCE(a, FLOOR(b)), c, GROUPING SETS ((a, b), ())"
    )
    row = facts(log_of, text)
    assert row["groups"] == ["COALESCE(a, FLOOR(b))", "c", "GROUPING SETS ((a, b), ())"]
    code = st.flat(F.col("query"))
    assert one(log_of, text, lambda c: st.is_balanced(st.flat(c)))
    for odd in ("a (b (c) d))", "a ((b)", "a )b(", "((((((((()))))))))("):
        assert one(log_of, odd, lambda c: st.is_balanced(st.flat(c))) is False
    assert code is not None


def test_chunks_do_not_show(log_of):
    """A text of many chunks is cut like a short one."""
    text = ", ".join(f"f{i}(a, (b{i}))" for i in range(700))
    items = one(log_of, text, st.top_level_items)
    assert items == [f"f{i}(a, (b{i}))" for i in range(700)]


def test_global_aggregates(log_of):
    for text, want in (
        ("SELECT COUNT(DISTINCT person_id) AS Count_Patients FROM t", True),
        ("SELECT AVG(x) + 1, COUNT(*) FROM t", True),
        ("SELECT ROUND(AVG(x), 1) AS r FROM t", True),
        ("SELECT AVG(x) + y FROM t", False),
        ("SELECT x, COUNT(*) FROM t", False),
        ("SELECT MAX((((a + ((b)))))) m FROM t", True),
    ):
        assert facts(log_of, text)["is_global"] is want, text


def test_quoted_names_are_no_keywords(log_of):
    row = facts(log_of, 'SELECT "date", `rows`, range FROM t')
    assert [i["name"] for i in row["ids"]] == ["date", "rows", "t"]


def test_quick_paths_do_not_show(log_of):
    """What a quick look spares the patterns never changes their result."""
    texts = [
        "", "select a from t", "a - b / c", "x -- rest\ny", "a /* b */ c", "it's", "'a' \"b\" `c`", "/* open", "a - - b",
        "p . x, q .y, r. z, a.b", ". a", "a .", " . ", "trim(both x from y) from t . u", "a . b",
        "SELECT 1", "select (SeLeCt 2)", "selected select", "SELECTSELECT", "ſelect select", "select select_a, select", "no",
    ]
    masked = F.regexp_replace("query", st._MASK, "$1 ")
    dotted = F.regexp_replace(ch.collapse(masked), r"(?=[ .])(?: \. ?|\. )", ".")
    plain = F.regexp_replace(dotted, st._INNER_FROM, "$1 ,")
    twice = F.col("query").rlike(r"(?is)\bSELECT\b.*?\bSELECT\b")
    rows = log_of(*texts).select("query", st.mask(F.col("query")), masked, st.flat(F.col("query")), plain, st.has_subquery(F.col("query")), twice)
    for query, m, want_m, f, want_f, s, want_s in rows.collect():
        assert (m, f, s) == (want_m, want_f, want_s), query
    nothing = log_of("a").select(F.lit(None).cast("string").alias("n")).select(st.mask(F.col("n")), st.flat(F.col("n")), st.has_subquery(F.col("n")))
    assert nothing.first() == (None, None, None)


def test_grouping_is_looked_for_once(log_of):
    """The facts read what was found with the statement, and do not search its text again."""
    facts = _facts(Policy())
    assert not [name for name, fact in facts.items() if "(?=GR)" in str(fact)]
    rows = log_of("select a from t group  by a", "select count(distinct person_id) as Count_Patients from person", "")
    read = read_statements(rows, policy=Policy()).withColumns({n: facts[n] for n in ("_grouped", "_global")})
    assert [tuple(r) for r in read.orderBy("request_id").select("_grouped", "_global").collect()] == [(True, False), (False, True), (False, False)]
