"""The corpus of FIXTURES.md: one Spark job per combination of layers."""

import re
from collections import defaultdict
from pathlib import Path

import pytest

from cellward.operators.verdicts import layer_results, verdicts, violations
from cellward.policy import Policy
from cellward.session import literal_table

ROOT = Path(__file__).resolve().parents[1]
LAYER = {"0": "ascii_input", "2": "phi", "3": "aggregation", "4": "enforcement"}
ROW = re.compile(r"^\| (\d+) \| `[^`]*` \| ([^|]*) \| `(.*)` \| ([^|]*) \|$")
BY_GENDER = (
    "gender_concept_id, COUNT(DISTINCT person_id) AS Count_Patients FROM person "
    "GROUP BY gender_concept_id"
)


def corpus():
    cases = []
    for line in (ROOT / "FIXTURES.md").read_text(encoding="utf-8").splitlines():
        found = ROW.match(line)
        if not found or not found[2].startswith("L"):
            continue
        number, calls, text, expected = found.groups()
        layers = tuple(LAYER[d] for d in re.findall(r"\d", calls.split()[0]))
        text = text.replace("\\|", "|").encode("latin-1").decode("unicode_escape")
        # escapes above U+00FF survive the round trip because the file writes them as \uXXXX
        if text == "(empty string)":
            text = ""
        if number == "64":
            text = text.replace(" SELECT", "\nSELECT", 1)
        if number == "88":
            text = text.replace(" ", " \n  ")
        if number == "90":
            text = text.replace(" FROM", "\nFROM").replace(", ", ",\n\t")
        code = None if expected.strip() == "PASS" else expected.strip()
        for n, part in enumerate(text.split(" // ") if number == "68" else [text]):
            cases.append((f"{number}.{n}", layers, part, code))
    return cases


def test_corpus_is_complete():
    # the other 20 check helpers or are empty
    assert len({c[0].split(".")[0] for c in corpus()}) == 93


def test_every_case(spark):
    groups = defaultdict(list)
    for number, layers, text, code in corpus():
        groups[layers].append((number, text, code))
    wrong = []
    for layers, cases in groups.items():
        log = literal_table(
            spark, [(n, t) for n, t, _ in cases], "request_id string, query string"
        )
        rows = verdicts(log, policy=Policy(layers=layers)).collect()
        got = {r["request_id"]: r["code"] for r in rows}
        assert len(rows) == len(cases)  # exactly one verdict per request
        wrong += [(n, t, code, got[n]) for n, t, code in cases if got[n] != code]
    assert not wrong


# Paths beyond the corpus: text, layer, code (None = the whole audit passes).
ADDITIONS = [
    ("WITH x AS (SELECT 1 AS a FROM person) SELECT " + BY_GENDER, "enforcement", "E402"),
    (f"SELECT {BY_GENDER} UNION SELECT {BY_GENDER}", "enforcement", "E401"),
    (
        "SELECT COUNT(DISTINCT person_id) AS Count_Patients FROM person WHERE SUM(x) > 1",
        "aggregation",
        "E304",
    ),
    (f"SELECT {BY_GENDER} HAVING COUNT(*) > 5", "aggregation", "E304"),
    (f"SELECT {BY_GENDER}, MAX(year_of_birth)", "aggregation", "E304"),
    (f"SELECT {BY_GENDER} ORDER BY COUNT(DISTINCT person_id)", "aggregation", "E304"),
    (
        "SELECT MAX(ssn), COUNT(DISTINCT person_id) AS Count_Patients FROM person",
        "phi",
        "E201",
    ),
    (f"SELECT {BY_GENDER} HAVING email = 'x'", "phi", "E201"),
    ("SELECT p.*, COUNT(DISTINCT person_id) AS Count_Patients FROM person p", "phi", "E204"),
    ("SELECT DISTINCT * FROM person", "phi", "E204"),
    ("SELECT MAX(struct(*)), COUNT(DISTINCT person_id) AS Count_Patients FROM p", "phi", "E204"),
    (f"SELECT {BY_GENDER}; SELECT {BY_GENDER}", "enforcement", "E401"),
    (f"SELECT {BY_GENDER}; DROP TABLE person", "system", "E802"),
    (f"SELECT {BY_GENDER};", None, None),
    (f"SELECT {BY_GENDER.replace('FROM person', 'FROM person WHERE a = (b')}", "system", "E802"),
    (f"SELECT {BY_GENDER} -- it's", None, None),
    (f"SELECT {BY_GENDER.replace('GROUP', chr(39) + ' GROUP')}", "system", "E802"),
    (f"INSERT INTO t SELECT {BY_GENDER}", "system", "E802"),
    ("SELECT MONTH(d) AS m, COUNT(DISTINCT person_id) AS Count_Patients FROM p GROUP BY 1",
     "phi", "E203"),
    ("SELECT EXTRACT(YEAR FROM d) AS y, COUNT(DISTINCT person_id) AS Count_Patients FROM p "
     "GROUP BY EXTRACT(YEAR FROM d)", None, None),
    ("SELECT p . ssn, COUNT(DISTINCT person_id) AS Count_Patients FROM p GROUP BY 1",
     "phi", "E201"),
    ('SELECT "Patient-Name", COUNT(DISTINCT person_id) AS Count_Patients FROM p GROUP BY 1',
     "phi", "E201"),
    ("SELECT person_id, COUNT(DISTINCT person_id) AS Count_Patients FROM p GROUP BY p.person_id",
     "aggregation", "E305"),
    ("SELECT COUNT(DISTINCT p.person_id) AS Count_Patients, COUNT(*) AS n FROM person p",
     None, None),
    ("SELECT COUNT(p.person_id) AS Count_Patients FROM person p", "aggregation", "E302"),
    ("SELECT gender_concept_id, COUNT(DISTINCT person_id) AS Count_Patients FROM person "
     "/* GROUP BY gender_concept_id */", "aggregation", "E301"),
    (f"SELECT {BY_GENDER.replace('FROM person', 'FROM person WHERE a = ' + repr('--'))}",
     None, None),
    ("  \n", "ascii_input", "E003"),
    (f"SELECT {BY_GENDER.replace('FROM person', 'FROM person WHERE d = DATE ' + repr('x'))}",
     None, None),
    (r"SELECT COUNT(DISTINCT person_id) AS Count_Patients FROM person WHERE a = '\' OR b = '",
     "system", "E802"),
    ("SELECT COUNT(DISTINCT person_id) AS Count_Patients FROM person /* a /* b */ c */",
     "system", "E802"),
]


def test_additions(spark):
    log = literal_table(
        spark,
        [(str(i), text) for i, (text, _, _) in enumerate(ADDITIONS)],
        "request_id string, query string",
    )
    rules = Policy().only(*(n for n in Policy().layers if n != "schema"))
    found = verdicts(log, policy=rules).collect()
    got = {int(r["request_id"]): (r["layer"], r["code"]) for r in found}
    wrong = [(a, got[i]) for i, a in enumerate(ADDITIONS) if got[i] != a[1:]]
    assert not wrong


def test_layers_judge_on_their_own(log_of):
    row = layer_results(log_of("", "SELECT * FROM person")).orderBy("request_id").collect()
    assert row[0]["ascii_input_code"] == "E003"
    assert [row[0][f"{n}_code"] for n in ("phi", "aggregation", "enforcement")] == [None] * 3
    assert (row[1]["phi_code"], row[1]["aggregation_code"]) == ("E204", "E302")


def test_schema_layer(log_of):
    policy = Policy(layers=("schema", "phi", "aggregation"))
    log = log_of(
        f"SELECT {BY_GENDER}",
        f"SELECT {BY_GENDER}".replace("FROM person", "FROM patients"),
        f"SELECT colour, {BY_GENDER}",
    )
    rows = verdicts(log, policy=policy).orderBy("request_id").collect()
    assert [r["code"] for r in rows] == [None, "E101", "E102"]
    assert rows[1]["details"] == {"table_name": "patients", "schema": "OMOP 5.4"}
    assert rows[2]["details"] == {"column_name": "colour", "schema": "OMOP 5.4"}


_COUNT = "COUNT(DISTINCT p.person_id) AS Count_Patients"
_JOINED = "FROM person p JOIN condition_occurrence c ON p.person_id = c.person_id"
# Text, code of the schema layer, unknown names in order.
SCOPES = [
    (f"SELECT c.condition_concept_id, {_COUNT} {_JOINED} GROUP BY c.condition_concept_id", None, []),
    # the column of the other table
    (f"SELECT p.condition_concept_id, {_COUNT} {_JOINED} GROUP BY p.condition_concept_id", "E102",
     ["condition_concept_id"]),
    (f"SELECT c.gender_concept_id, {_COUNT} {_JOINED} GROUP BY c.gender_concept_id, p.colour", "E102",
     ["gender_concept_id", "colour"]),
    # bare names belong to any table
    (f"SELECT condition_concept_id, gender_concept_id, {_COUNT} {_JOINED} GROUP BY 1, 2", None, []),
    # the same table under two names, AS, quotes, case, a schema in front
    ("SELECT A.gender_concept_id, b.race_concept_id, COUNT(DISTINCT a.person_id) AS Count_Patients FROM "
     'cdm.person AS A, "person" b WHERE a.person_id = B.person_id GROUP BY 1, 2', None, []),
    (f"SELECT person.gender_concept_id, {_COUNT} FROM person p GROUP BY 1", None, []),
    (f"SELECT person.colour, {_COUNT} FROM person p LEFT JOIN death ON death.person_id = p.person_id", "E102",
     ["colour"]),
    # a qualifier that names nothing
    (f"SELECT x.gender_concept_id, {_COUNT} FROM person p GROUP BY 1", "E102", ["gender_concept_id"]),
    # nested queries: their columns may come from any table inside
    ("SELECT s.gender_concept_id, COUNT(DISTINCT s.person_id) AS Count_Patients FROM (SELECT gender_concept_id, "
     "person_id FROM person) s GROUP BY 1", None, []),
    ("WITH c AS (SELECT person_id FROM person), d AS (SELECT person_id FROM c) SELECT COUNT(DISTINCT d.person_id) "
     "AS Count_Patients FROM d", None, []),
    # columns of unknown tables are not judged, and prohibited names are left to their own layer
    (f"SELECT q.anything, {_COUNT} FROM persons q JOIN person p ON q.person_id = p.person_id", "E101", ["persons"]),
    (f"SELECT p.ssn, {_COUNT} FROM person p GROUP BY p.ssn", None, []),
    # own aliases are no columns, qualified names are
    ("SELECT gender_concept_id AS colour, COUNT(DISTINCT person_id) AS Count_Patients FROM person GROUP BY colour", None, []),
    ("SELECT gender_concept_id AS colour, COUNT(DISTINCT person_id) AS Count_Patients FROM person p GROUP BY p.colour",
     "E102", ["colour"]),
]


def test_columns_belong_to_their_table(log_of):
    log = log_of(*[text for text, _, _ in SCOPES])
    rows = violations(log, policy=Policy(max_errors=None).only("schema")).orderBy("ordinal").collect()
    for i, (text, code, names) in enumerate(SCOPES):
        own = [r for r in rows if r["request_id"] == str(i)]
        assert [r["token"] for r in own] == names, text
        assert {r["code"] for r in own} == ({code} if code else set()), text


def test_schema_is_judged_by_default(log_of):
    log = log_of(f"SELECT {BY_GENDER}", f"SELECT {BY_GENDER}".replace("FROM person", "FROM people"), "SELECT ssn FROM person")
    rows = verdicts(log).orderBy("request_id").collect()
    assert [(r["layer"], r["code"]) for r in rows] == [(None, None), ("schema", "E101"), ("phi", "E201")]
    assert rows[0]["total_layers"] == 6 and rows[1]["layers_passed"] == ["ascii_input"]


@pytest.mark.parametrize("strict_mode, code", [(True, "E802"), (False, None)])
def test_strict_mode_refuses_long_texts(log_of, strict_mode, code):
    log = log_of(f"SELECT {BY_GENDER}", "SELECT * FROM person" + " " * 300)
    rows = verdicts(log, policy=Policy(max_query_length=50, strict_mode=strict_mode)).orderBy("request_id").collect()
    assert [r["code"] for r in rows] == [code, "E204"] and all(r["over_length"] for r in rows)


@pytest.mark.parametrize("strict, code", [(True, "E201"), (False, None)])
def test_catalog_only_columns(log_of, strict, code):
    log = log_of("SELECT npi, COUNT(DISTINCT person_id) AS Count_Patients FROM provider JOIN person GROUP BY npi")
    assert verdicts(log, policy=Policy(strict=strict)).first()["code"] == code


def test_plain_group_by_is_an_option(log_of):
    log = log_of(f"SELECT {BY_GENDER}, FLOOR(year_of_birth / 10)", f"SELECT {BY_GENDER}")
    policy = Policy(plain_group_by=True)
    got = [r["code"] for r in verdicts(log, policy=policy).orderBy("request_id").collect()]
    assert got == ["E305", None]
    assert verdicts(log).where("NOT success").count() == 0
