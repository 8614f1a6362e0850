"""The audit of the whole query log: verdicts, records, reports, streams."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from cellward.operators import reports
from cellward.operators import verdicts as v
from cellward.plans.registry import query
from cellward.plans.sample_log import (
    HASH_SQL,
    HITS_SQL,
    LOG_SQL,
    VERDICT_SQL,
    expected,
    per_text,
    values,
)
from cellward.plans.vocabularies import ALL_ERRORS, log
from cellward.policy import DEFAULT_LAYERS, Policy
from cellward.session import fresh_path
from cellward.sources import audit_files, audit_store, guidance, query_log
from cellward.sources.tables import table
from cellward.streaming import audit as streams

_LOG = f"WITH {LOG_SQL}, {VERDICT_SQL}"
_DOC_SQL = (
    "CASE substr(code, 1, 2) "
    + " ".join(f"WHEN '{p}' THEN '{a}'" for p, a in guidance.DOCUMENTATION.items())
    + " END"
)
_RESULT_SQL = (
    "CASE WHEN code IS NULL THEN 'PASS' WHEN code LIKE 'E8%' THEN 'ERROR' ELSE 'FAIL' END"
)
_TIME_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"


@query(
    "layer_results",
    f"""WITH {LOG_SQL}, {expected(
        "facts",
        per_text(*[lambda t, n=n: t.code(n) for n in DEFAULT_LAYERS]),
        [f"{n}_code" for n in DEFAULT_LAYERS],
    )}
    SELECT request_id, {", ".join(f"{n}_code" for n in DEFAULT_LAYERS)}
    FROM log JOIN facts USING (kind)""",
)
def _(spark, sf_dir):
    results = v.layer_results(log(spark, sf_dir))
    return results.select("request_id", *[f"{n}_code" for n in DEFAULT_LAYERS])


@query(
    "audit_verdicts",
    f"""{_LOG}
    SELECT request_id, code IS NULL AS success, layer, code, layers_passed,
           {len(DEFAULT_LAYERS)} AS total_layers, {HASH_SQL} AS query_hash, {_DOC_SQL} AS documentation
    FROM log JOIN verdict USING (kind)""",
)
def audit_verdicts(spark, sf_dir):
    return v.audit_log(log(spark, sf_dir)).select(
        "request_id", "success", "layer", "code",
        F.array_join("layers_passed", ",").alias("layers_passed"),
        "total_layers", "query_hash", "documentation",
    )


@query(
    "audit_violations",
    f"""WITH {LOG_SQL}, {HITS_SQL}
    SELECT request_id, ordinal, layer, code, clause, token FROM log JOIN hits USING (kind)""",
)
def _(spark, sf_dir):
    rows = v.violations(log(spark, sf_dir), policy=ALL_ERRORS)
    return rows.select("request_id", "ordinal", "layer", "code", "clause", "token")


@query(
    "first_violation",
    f"""{_LOG} SELECT request_id, layer, code FROM log JOIN verdict USING (kind)
    WHERE code IS NOT NULL""",
)
def _(spark, sf_dir):
    rows = v.violations(log(spark, sf_dir), policy=ALL_ERRORS)
    return v.first_violation(rows.select("request_id", "ordinal", "layer", "code"))


@query(
    "verdicts",
    f"""{_LOG}
    SELECT CAST(year(ts) AS INTEGER) AS year, code IS NULL AS success, count(*) AS n_queries,
           CAST(sum(n_layers_passed) AS BIGINT) AS n_layers_passed
    FROM log JOIN verdict USING (kind) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    path = fresh_path(spark, "verdicts")
    made = v.verdicts(log(spark, sf_dir))
    audit_files.write_verdicts(made.drop("query", "message"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.year("dt").alias("year"), "success").agg(
        F.count("*").alias("n_queries"),
        F.sum(F.size("layers_passed")).alias("n_layers_passed"),
    )


@query(
    "guidance_join",
    f"""{_LOG}, texts AS {values(
        [(c, g, p) for c, (g, p) in guidance.TEXTS.items()],
        ["code", "guidance", "correct_pattern"],
    )}
    SELECT request_id, code, guidance, correct_pattern FROM log
    JOIN verdict USING (kind) LEFT JOIN texts USING (code)""",
)
def _(spark, sf_dir):
    found = v.verdicts(log(spark, sf_dir)).select("request_id", "code")
    return guidance.with_guidance(found).drop("documentation")


@query(
    "documentation_link",
    f"""{_LOG} SELECT request_id, code, {_DOC_SQL} AS link FROM log JOIN verdict USING (kind)
    WHERE code IS NOT NULL""",
)
def _(spark, sf_dir):
    failed = v.verdicts(log(spark, sf_dir)).where(F.col("code").isNotNull())
    return failed.select(
        "request_id", "code", guidance.documentation_link(F.col("code")).alias("link")
    )


@query(
    "educational_response",
    f"""{_LOG}, {HITS_SQL}
    SELECT request_id, verdict.code AS error_code, {_DOC_SQL.replace("(code", "(verdict.code")}
             AS documentation,
           CASE WHEN verdict.code IN ('E102', 'E201', 'E202', 'E203', 'E305') THEN token END
             AS column_name
    FROM log JOIN verdict USING (kind) JOIN hits USING (kind)
    WHERE ordinal = 0""",
)
def _(spark, sf_dir):
    answers = reports.educational_response(v.audit_log(log(spark, sf_dir)))
    return answers.select(
        "request_id",
        F.get_json_object("response", "$.error_code").alias("error_code"),
        F.get_json_object("response", "$.documentation").alias("documentation"),
        F.get_json_object("response", "$.details.column_name").alias("column_name"),
    )


@query(
    "query_metadata",
    f"""{_LOG}
    SELECT request_id, {HASH_SQL} AS query_hash, layers_passed,
           CAST(n_layers_passed AS INTEGER) AS n_layers_passed, {len(DEFAULT_LAYERS)} AS total_layers
    FROM log JOIN verdict USING (kind)""",
)
def _(spark, sf_dir):
    facts = reports.query_metadata(v.verdicts(log(spark, sf_dir)))
    return facts.withColumn("layers_passed", F.array_join("layers_passed", ","))


_JSON_SQL = (
    "'{\"request_id\":\"' || request_id || '\",\"timestamp\":\"' || "
    + _TIME_SQL
    + " || '\",\"user_id\":\"' || user_id || '\",\"query_hash\":\"' || "
    + HASH_SQL
    + " || '\",\"validation_result\":\"' || "
    + _RESULT_SQL
    + " || '\",\"layer_failed\":' || coalesce('\"' || layer || '\"', 'null')"
    + " || ',\"error_code\":' || coalesce('\"' || code || '\"', 'null')"
    + " || ',\"ip_address\":\"' || ip_address || '\",\"session_id\":\"' || session_id || '\"}'"
)


@query(
    "audit_jsonl",
    f"{_LOG} SELECT {_JSON_SQL} AS line FROM log JOIN verdict USING (kind)",
)
def _(spark, sf_dir):
    records = reports.audit_records(v.verdicts(log(spark, sf_dir)))
    return records.select(reports.audit_json(records).alias("line"))


@query(
    "audit_retention",
    f"""{_LOG}
    SELECT {_RESULT_SQL} AS validation_result, count(*) AS n_records FROM log
    JOIN verdict USING (kind)
    WHERE ts >= TIMESTAMP '2004-01-01' - INTERVAL 2190 DAYS GROUP BY 1""",
)
def _(spark, sf_dir):
    # the log is audited once, into days; retention then drops old days unread and filters the first one left
    path = fresh_path(spark, "retention")
    lines = audit_files.audit_lines(reports.audit_records(v.verdicts(log(spark, sf_dir))))
    audit_store.append(lines, path, 0)
    as_of = datetime(2004, 1, 1, tzinfo=UTC)
    audit_store.expire(spark, path, (as_of - timedelta(days=Policy().retention_days)).date())
    kept = reports.retain(audit_store.read_store(spark, path), F.lit(as_of))
    return kept.groupBy("validation_result").agg(F.count("*").alias("n_records"))


@query(
    "verdict_summary",
    f"""{_LOG} SELECT layer, code, count(*) AS n_queries FROM log JOIN verdict USING (kind)
    GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return reports.verdict_summary(v.verdicts(log(spark, sf_dir)))


@query(
    "repeat_offenders",
    f"""{_LOG}
    SELECT user_id, {HASH_SQL} AS query_hash, count(*) AS n_failures,
           strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_seen,
           strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_seen
    FROM log JOIN verdict USING (kind) WHERE code IS NOT NULL
    GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(spark, sf_dir):
    rows = reports.repeat_offenders(v.verdicts(log(spark, sf_dir)))
    return rows.withColumns(
        {c: reports.utc_text(F.col(c)) for c in ("first_seen", "last_seen")}
    )


@query(
    "latency_p95",
    """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    # the measured value of an event stands in for a request's time
    rows = reports.exact_percentile(
        table(spark, sf_dir, "events"), "value", 0.95, ["event_type"]
    )
    return rows.select("event_type", "n", F.round("value", 6).alias("p95"))


_ALERT_SQL = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
           count(*) AS n_failures
    FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 5"""


def _alerts(events):
    found = streams.failure_alert(
        events, failed=F.col("event_type") == "error", time_col="ts", threshold=5
    )
    return found.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    )


@query("failure_alert", _ALERT_SQL)
def _(spark, sf_dir):
    return _alerts(table(spark, sf_dir, "events"))


def _stream(spark, sf_dir, name):
    """A given table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return files.parquet(sf_dir)


@query(
    "stream_failure_alert",
    f"""SELECT a.*, 0 AS n_dropped FROM ({_ALERT_SQL}) a
    WHERE CAST(window_end AS TIMESTAMP) <=
          (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 1 HOUR""",
)
def _(spark, sf_dir):
    # windows that the watermark has closed, and how many rows came too late for theirs
    path = fresh_path(spark, "alerts")
    alerts = _alerts(_stream(spark, sf_dir, "events"))
    run = streams.stream_alerts(alerts, f"{path}/out", f"{path}/state", available_now=True)
    run.awaitTermination()
    streams.store_lateness(spark, run, f"{path}/late")
    dropped = spark.read.parquet(f"{path}/late").agg(F.sum("n_dropped").cast("int").alias("n_dropped"))
    return spark.read.parquet(f"{path}/out").join(dropped)


@query(
    "stream_audit",
    f"""{_LOG}
    SELECT {_RESULT_SQL} AS validation_result, layer AS layer_failed, code AS error_code,
           count(*) AS n_records,
           min({_TIME_SQL}) AS first_seen
    FROM log JOIN verdict USING (kind) GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    # a log of several files, read by the log's own reader
    path = fresh_path(spark, "audit")
    log(spark, sf_dir).write.parquet(f"{path}/log")
    streams.stream_audit(
        query_log.stream_query_log(spark, f"{path}/log"),
        f"{path}/out",
        f"{path}/state",
        available_now=True,
    ).awaitTermination()
    stored = audit_store.read_store(spark, f"{path}/out")
    return stored.groupBy("validation_result", "layer_failed", "error_code").agg(
        F.count("*").alias("n_records"),
        F.min(reports.utc_text(F.col("timestamp"))).alias("first_seen"),
    )
