"""Dictionary tables of any size against vocabularies in the plan."""

from pyspark.sql import functions as F

from cellward.operators.verdicts import prohibited_uses, verdicts, violations
from cellward.policy import Policy
from cellward.session import literal_table
from cellward.sources import vocabulary as voc

COUNT = "COUNT(DISTINCT person_id) AS Count_Patients"
TEXTS = [
    f"SELECT ssn, org_17, {COUNT} FROM person GROUP BY ssn, org_17",
    f"SELECT p.Org-3, {COUNT} FROM person p WHERE \"ORG-1999\" = 1 GROUP BY 1",
    f"SELECT month(birth), {COUNT} FROM person GROUP BY month(birth)",
    f"SELECT org_5(x), {COUNT} FROM person GROUP BY org_5(x)",
    f"SELECT date, {COUNT} FROM person ORDER BY date",
    f"SELECT gender_concept_id, {COUNT} FROM person GROUP BY gender_concept_id",
    f"SELECT city, {COUNT} FROM location GROUP BY city -- org_1",
    "SELECT * FROM person", "", "   ",
]


def dictionary(spark, n):
    custom = spark.range(n).select(F.concat(F.lit("Org-"), "id").alias("name"), F.lit("direct").alias("category"))
    more = literal_table(spark, [("month", "date"), ("date", "date")], "name string, category string")
    return voc.merge_dictionaries(voc.phi_dictionary(spark), custom.union(more))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_same_verdicts_as_in_the_plan(spark, log_of):
    log = log_of(*TEXTS, *TEXTS)
    vocab = voc.DEFAULT.extended(direct=[f"org_{i}" for i in range(2000)], date=["month", "date"])
    for policy in (Policy(max_errors=None), Policy(max_errors=None).only("phi", "aggregation")):
        got = violations(log, dictionary(spark, 2000), policy=policy)
        want = violations(log, vocab, policy=policy)
        assert rows(got, "request_id", "ordinal") == rows(want, "request_id", "ordinal")
    by_table = verdicts(log, dictionary(spark, 2000)).select("request_id", "code", "layer", "message")
    assert rows(by_table, "request_id") == rows(verdicts(log, vocab).select("request_id", "code", "layer", "message"), "request_id")


def test_plan_does_not_grow_with_the_dictionary(spark, log_of):
    log = log_of(*TEXTS)

    def plan(n):
        return verdicts(log, dictionary(spark, n))._jdf.queryExecution().optimizedPlan().toString()

    assert abs(len(plan(100_000)) - len(plan(10))) < 100
    found = verdicts(log_of(*TEXTS, "SELECT org_99999 FROM person"), dictionary(spark, 100_000))
    codes = {r["request_id"]: r["code"] for r in found.collect()}
    assert codes["10"] == "E201" and codes["5"] is None and len(codes) == 11


def test_equal_texts_are_read_once(spark, log_of):
    found = prohibited_uses(log_of(*[TEXTS[0]] * 50, TEXTS[5]), dictionary(spark, 20)).collect()
    assert [(h["ordinal"], h["code"], h["token"], h["clause"]) for h in found[0]["_listed_hits"]] == [
        (1, "E201", "ssn", "SELECT"), (2, "E201", "org_17", "SELECT"),
        (3, "E201", "ssn", "GROUP BY"), (4, "E201", "org_17", "GROUP BY"),
    ]
    assert len(found) == 1
