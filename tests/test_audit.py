"""Records, files, reports, configuration and streams."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellward.operators import log_tables, reports
from cellward.operators.verdicts import verdicts
from cellward.policy import ConfigError, Policy, load_policy
from cellward.session import fresh_path, literal_table, shared_dir
from cellward.sources import audit_files, audit_store, catalog, query_log
from cellward.sources import vocabulary as voc
from cellward.streaming import audit as streams

GOOD = "SELECT COUNT(DISTINCT person_id) AS Count_Patients FROM person"


def make_log(spark, n=30, start=datetime(2024, 3, 1)):
    rows = [
        (
            str(i), start + timedelta(hours=i * 5), f"u{i % 3}", None, f"10.0.0.{i}",
            [GOOD, "SELECT * FROM person", "SELECT ssn FROM person", ";;x'"][i % 4],
        )
        for i in range(n)
    ]
    return literal_table(spark, rows, query_log.LOG_DDL)


def test_audit_files_round_trip(spark):
    records = reports.audit_records(verdicts(make_log(spark)))
    path = fresh_path(spark, "records")
    audit_files.audit_sink(records, path)
    audit_files.audit_sink(records, path)  # append-only
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert len(lines) == 60
    assert list(lines[0]) == list(reports.AUDIT_FIELDS)
    assert all(line["session_id"] is None for line in lines)
    assert not any("SELECT" in str(line) for line in lines)
    back = audit_files.read_audit(spark, path).drop("dt").distinct()
    assert back.exceptAll(records.select(back.columns)).count() == 0
    assert back.count() == 30


def test_retention_prunes_partitions(spark):
    path = fresh_path(spark, "records")
    audit_files.audit_sink(reports.audit_records(verdicts(make_log(spark))), path)
    as_of = F.lit("2024-03-05").cast("timestamp")
    kept = reports.retain(
        audit_files.read_audit(spark, path), as_of, policy=Policy(retention_days=2)
    )
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    expected = sum(datetime(2024, 3, 1) + timedelta(hours=5 * i) >= datetime(2024, 3, 3)
                   for i in range(30))
    assert kept.count() == expected


def test_verdict_files(spark):
    path = fresh_path(spark, "verdicts")
    audit_files.write_verdicts(verdicts(make_log(spark)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 30 and "dt" in stored.columns


def test_observed_audit(spark):
    from pyspark.sql import Observation

    seen = Observation()
    result = reports.observe_audit(
        verdicts(make_log(spark, 8), policy=Policy(max_query_length=30)), seen
    )
    result.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_queries": 8, "n_rejected": 6, "n_over_length": 2}


def test_outcomes(spark):
    df = literal_table(spark, [(None,), ("E201",), ("E802",)], "c string")
    assert [r[0] for r in df.select(reports.outcome(F.col("c"))).collect()] == [
        "PASS", "FAIL", "ERROR",
    ]


def test_utc_text_in_any_time_zone(spark):
    """Also for instants that fall into a clock change of the session's zone."""
    times = ["2001-04-01T02:07:23.000500Z", "2001-10-28T06:30:00Z", "1969-12-31T23:59:59.9Z"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = literal_table(spark, [(t,) for t in times], "t string")
        time = F.to_timestamp("t")
        rows = df.select(reports.utc_text(time).alias("x"), reports.utc_day(time).alias("d"))
        got = [(r["x"], str(r["d"])) for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [
        ("2001-04-01T02:07:23.000500Z", "2001-04-01"),
        ("2001-10-28T06:30:00.000000Z", "2001-10-28"),
        ("1969-12-31T23:59:59.900000Z", "1969-12-31"),
    ]


def test_educational_response_leaves_out_what_is_absent(spark, log_of):
    from cellward.operators.verdicts import audit_log

    rows = reports.educational_response(audit_log(log_of("SELECT * FROM person", GOOD))).collect()
    assert len(rows) == 1
    body = json.loads(rows[0]["response"])
    assert list(body) == [
        "error_code", "message", "educational_guidance", "documentation", "correct_pattern",
    ]


@pytest.mark.parametrize("q", [0.0, 0.013, 0.5, 0.95, 1.0])
def test_percentile_of_values_close_together(spark, q):
    """99 of 100 values within a hundredth of each other, a third of all equal, and two other groups: cells
    are cut again and again until few values are left, and no task orders more."""
    rng = random.Random(5)
    close = [1000 + 9 * rng.random() ** 3 for _ in range(4000)] + [1004.5] * 2000 + [rng.uniform(-1e6, 1e6) for _ in range(60)]
    near = [1.0 + k * 2.0**-52 for k in range(300)]  # neighbouring doubles
    data = {"close": close, "near": near, None: [-3.5, -3.25, 2.0, float("inf")], "sign": [-1000 - 9 * rng.random() for _ in range(900)]}
    rows = [(g, x) for g, xs in data.items() for x in xs]
    df = literal_table(spark, rows, "g string, x double").repartition(4)
    for by in (["g"], []):
        found = reports.exact_percentile(df, "x", q, by, least=5, fan=16).collect()
        groups = data if by else {"all": [x for xs in data.values() for x in xs]}
        assert len(found) == len(groups)
        for r in found:
            xs = sorted(groups[r["g"]] if by else groups["all"])
            at = (len(xs) - 1) * q
            low, high = xs[math.floor(at)], xs[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert r["n"] == len(xs) and (r["value"] == want or abs(r["value"] - want) <= 1e-12 * abs(want))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, q):
    rng = random.Random(11)
    data = {
        "spread": [rng.lognormvariate(0, 3) for _ in range(500)],
        "signed": [rng.choice([-1, 1]) * rng.random() for _ in range(301)],
        "same": [2.5] * 400,  # one value
        "few": [1.0, 4.0],
        "one": [0.0],
        None: [5.0, 6.0, float("inf")],
    }
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("few", None), ("empty", None)]
    df = literal_table(spark, rows, "g string, v double")
    got = {
        r["g"]: (r["n"], r["value"])
        for r in reports.exact_percentile(df, "v", q, ["g"]).collect()
    }
    want = {
        r["g"]: (r["n"], r["p"])
        for r in df.groupBy("g")
        .agg(F.count("v").alias("n"), F.percentile("v", q).alias("p")).collect()
    }
    assert got.keys() == want.keys()
    assert want["empty"] == (0, None)
    for g, (n, value) in want.items():
        assert got[g][0] == n and got[g][1] == pytest.approx(value)


def test_repeat_offenders(spark):
    rows = reports.repeat_offenders(verdicts(make_log(spark, 24)), min_failures=2).collect()
    assert {(r["user_id"], r["n_failures"]) for r in rows} == {("u0", 2), ("u1", 2), ("u2", 2)}
    assert len(rows) == 9


# ------------------------------------------------------------------ intake, vocabularies


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_read_log_fills_request_ids(spark, format):
    path = fresh_path(spark, "log")
    log = make_log(spark).withColumn("request_id", F.expr("if(request_id = '3', request_id, null)"))
    log.repartition(3).write.format(format).save(path)
    first = query_log.read_query_log(spark, path, format)
    ids = [r["request_id"] for r in first.collect()]
    assert len(set(ids)) == 30 and "3" in ids and None not in ids


def test_custom_vocabulary_file(spark, tmp_path, log_of):
    file = tmp_path / "names.json"
    file.write_text(json.dumps({"direct_identifiers": ["Chart-Ref"], "date_prohibited": ["SEEN"]}))
    vocab = voc.load_vocabulary(file)
    assert vocab.direct == {"chart_ref"} and vocab.geographic == frozenset()
    count = "COUNT(DISTINCT person_id) AS Count_Patients"
    log = log_of(f"SELECT chart_ref, {count} FROM p GROUP BY 1",
                 f"SELECT seen, {count} FROM p GROUP BY 1",
                 f"SELECT ssn, {count} FROM p GROUP BY 1")
    rules = Policy().only("phi", "aggregation")
    got = [r["code"] for r in verdicts(log, vocab, policy=rules).orderBy("request_id").collect()]
    assert got == ["E201", "E203", None]
    wider = voc.DEFAULT.extended(direct=["chart_ref"])
    got = [r["code"] for r in verdicts(log, wider, policy=rules).orderBy("request_id").collect()]
    assert got == ["E201", None, "E201"]


def test_vocabulary_files_missing_or_broken(tmp_path):
    assert voc.load_vocabulary(tmp_path / "none.yaml") == voc.DEFAULT
    broken = tmp_path / "broken.json"
    broken.write_text("[1")
    with pytest.raises(ConfigError) as error:
        voc.load_vocabulary(broken)
    assert error.value.code == "E801"
    with pytest.raises(ConfigError):
        voc.DEFAULT.extended(direct=["x' OR 1"])


def test_policy_file(tmp_path):
    file = tmp_path / "policy.json"
    file.write_text(json.dumps({
        "security": {"min_patient_count": 50,
                     "enabled_layers": ["phi", "ascii_input", "ascii_output"]},
        "educational": {"verbosity": 1},
    }))
    policy = load_policy(file, alert_threshold=3)
    assert policy.min_cell == 50 and policy.layers == ("ascii_input", "phi", "system")
    assert (policy.verbosity, policy.alert_threshold, policy.retention_days) == (1, 3, 2190)
    with pytest.raises(ConfigError):
        Policy(layers=("nope",))
    file.write_text(json.dumps({"security": {"min_patient_count": "many"}}))
    with pytest.raises(ConfigError):
        load_policy(file)


def test_dictionary_merge(spark):
    custom = literal_table(
        spark, [("SSN", "date"), ("chart-ref", "direct")], "name string, category string"
    )
    merged = voc.merge_dictionaries(voc.phi_dictionary(spark), custom)
    rows = {r["name"]: r for r in merged.collect()}
    assert len(rows) == merged.count() == 205
    assert rows["ssn"]["category"] == "direct" and rows["chart_ref"]["source"] == "custom"


def test_group_list_check(spark, log_of):
    log = log_of("SELECT 1 FROM person GROUP BY person.gender_concept_id, f(a, b), ssn, x, 2")
    rows = log_tables.check_group_by(log, catalog.column_catalog(spark)).orderBy("ordinal")
    assert [r["status"] for r in rows.collect()] == [
        "ok", "expression", "prohibited", "unknown", "expression",
    ]


def test_shared_dir_is_the_cluster_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# ------------------------------------------------------------------ streams


def write_in_files(df, path, n):
    """One file per slice, oldest first, so that the stream reads them in order."""
    for i in range(n):
        df.where(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)


def test_stream_audit_equals_batch_and_resumes(spark):
    path, out, state = (fresh_path(spark, n) for n in ("log", "out", "state"))
    log = make_log(spark, 40)
    first, second = log.where("int(request_id) < 25"), log.where("int(request_id) >= 25")
    for part in (first, second):
        part.write.mode("append").parquet(path)
        source = query_log.stream_query_log(spark, path)
        streams.stream_audit(source, out, state, available_now=True).awaitTermination()
    got = audit_store.read_store(spark, out).drop("dt")
    batch = reports.audit_records(verdicts(log)).select(got.columns)
    assert got.count() == 40
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0


def files_by_day(spark, path):
    read = audit_store.read_store(spark, path).select("dt", F.input_file_name().alias("file"))
    return {str(r["dt"]): r["n"] for r in read.groupBy("dt").agg(F.count_distinct("file").alias("n")).collect()}


def test_many_small_batches_end_in_one_file_a_day(spark):
    path, out, state = (fresh_path(spark, n) for n in ("log", "out", "state"))
    log = make_log(spark, 60).withColumn("slice", F.expr("int(request_id) % 20"))
    write_in_files(log, path, 20)
    source = query_log.stream_query_log(spark, path, maxFilesPerTrigger=1)
    streams.stream_audit(source, out, state, available_now=True, fan=20).awaitTermination()
    last = audit_store.read_state(spark, out)
    assert last.last_batch == 19 and [level for _, level in last.folders] == [1]
    got = audit_store.read_store(spark, out).drop("dt")
    batch = reports.audit_records(verdicts(make_log(spark, 60))).select(got.columns)
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0
    assert set(files_by_day(spark, out).values()) == {1}
    # what no manifest names any more can go
    assert audit_store.vacuum(spark, out) >= 20
    assert audit_store.read_store(spark, out).count() == 60


def test_replayed_batches_count_once(spark):
    out = fresh_path(spark, "out")
    lines = audit_files.audit_lines(reports.audit_records(verdicts(make_log(spark, 30))))
    for batch in (0, 1, 1, 0, 2):
        audit_store.append(lines, out, batch, fan=3)
    assert audit_store.read_store(spark, out).count() == 90
    # a batch that was written, but not committed, is written again
    folder = f"{out}/data/folder=batch-{3:012d}"
    lines.limit(4).write.partitionBy("dt").text(folder)
    spark.range(1).write.json(f"{out}/manifest/{99:012d}")
    system, done = audit_store._files(spark, f"{out}/manifest/{99:012d}/_SUCCESS")
    system.delete(done, False)
    assert audit_store.read_store(spark, out).count() == 90
    audit_store.append(lines, out, 3, fan=3)
    assert audit_store.read_store(spark, out).count() == 120


def test_levels_of_folders(spark):
    out = fresh_path(spark, "out")
    lines = audit_files.audit_lines(reports.audit_records(verdicts(make_log(spark, 2)))).cache()
    for batch in range(9):
        found = audit_store.append(lines, out, batch, fan=2)
        assert audit_store.read_store(spark, out).count() == 2 * (batch + 1)
    assert sorted(level for _, level in found.folders) == [0, 3]
    assert audit_store.merge(spark, out).folders[0][1] == 3
    assert set(files_by_day(spark, out).values()) == {1}
    # an empty batch leaves no folder but counts as done
    state = audit_store.append(lines.where("false"), out, 9)
    assert state.last_batch == 9 and len(state.folders) == 1
    assert audit_store.read_store(spark, fresh_path(spark, "none")).count() == 0


def test_a_batch_of_one_day_is_audited_by_all_tasks(spark):
    """The verdicts stay on the source's partitions, and the day gets files by its rows."""
    path, out, state = (fresh_path(spark, n) for n in ("log", "out", "state"))
    day = make_log(spark, 400, start=datetime(2024, 3, 1)).withColumn("ts", F.lit("2024-03-01 10:00:00").cast("timestamp"))
    day.repartition(8).write.parquet(path)
    source = query_log.stream_query_log(spark, path)
    seen = []

    def look(batch, _):
        plan = verdicts(batch)._jdf.queryExecution().executedPlan().toString()
        seen.append(("Exchange" in plan, batch.rdd.getNumPartitions()))

    source.writeStream.foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert seen[0][0] is False and seen[0][1] > 1
    streams.stream_audit(source, out, state, available_now=True, rows_per_file=100).awaitTermination()
    assert audit_store.read_store(spark, out).count() == 400
    assert 2 <= files_by_day(spark, out)["2024-03-01"] <= 4


def test_expired_days_go_without_reading(spark):
    out = fresh_path(spark, "out")
    lines = audit_files.audit_lines(reports.audit_records(verdicts(make_log(spark, 30)))).cache()
    audit_store.append(lines.where("dt < '2024-03-03'"), out, 0)
    audit_store.append(lines, out, 1)
    before = audit_store.read_store(spark, out).where("dt >= '2024-03-04'").count()
    state = audit_store.expire(spark, out, "2024-03-04")
    assert len(state.folders) == 1 and audit_store.read_store(spark, out).count() == before > 0


def failures(spark):
    """Seven failures in the first hour, three in the second, and so on for ten hours."""
    start = datetime(2024, 1, 1)
    rows = [
        (start + timedelta(hours=h, minutes=5 * i), h // 2)
        for h in range(10)
        for i in range(7 if h % 2 == 0 else 3)
    ]
    return literal_table(spark, rows, "timestamp timestamp, slice int")


def test_alert_stream_closed_windows_equal_batch(spark):
    events, path = failures(spark), fresh_path(spark, "events")
    write_in_files(events, path, 5)
    source = (
        spark.readStream.schema("timestamp timestamp")
        .option("maxFilesPerTrigger", 1)
        .parquet(path)
    )
    found = streams.failure_alert(source, failed=F.lit(True), threshold=5)
    out, state = fresh_path(spark, "alerts"), fresh_path(spark, "state")
    (
        found.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
        .awaitTermination()
    )
    batch = streams.failure_alert(events, failed=F.lit(True), threshold=5)
    closed = events.agg(F.max("timestamp") - F.expr("INTERVAL 1 HOUR")).first()[0]
    want = {tuple(r) for r in batch.where(F.col("window_end") <= F.lit(closed)).collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want and want


def test_alerts_with_lateness(spark):
    """Closed windows equal the batch, and dropped rows are counted next to them."""
    path, out, state, late = (fresh_path(spark, n) for n in ("events", "alerts", "state", "late"))
    start = datetime(2024, 1, 1)
    slices = [
        [start + timedelta(minutes=i) for i in range(6)],
        [start + timedelta(hours=9, minutes=i) for i in range(6)],
        [start + timedelta(minutes=50)] * 20 + [start + timedelta(hours=2)],  # two windows, hours late
        [start + timedelta(hours=20)],
    ]
    for times in slices:
        rows = literal_table(spark, [(t,) for t in times], "timestamp timestamp").coalesce(1)
        rows.write.mode("append").parquet(path)
        source = spark.readStream.schema("timestamp timestamp").parquet(path)
        found = streams.failure_alert(source, failed=F.lit(True), threshold=5)
        run = streams.stream_alerts(found, out, state, available_now=True)
        run.awaitTermination()
        streams.store_lateness(spark, run, late)
    got = sorted((r["window_start"], r["n_failures"]) for r in spark.read.parquet(out).collect())
    assert got == [(start, 6), (start + timedelta(hours=9), 6)]
    stored = spark.read.parquet(late)
    assert stored.agg(F.sum("n_dropped")).first()[0] == 2 and stored.agg(F.sum("n_rows")).first()[0] == 34
    assert stored.where("n_dropped > 0").select("batch_id").distinct().count() == 1


def test_alert_stream_complete_mode_equals_batch(spark):
    events, path = failures(spark), fresh_path(spark, "events")
    write_in_files(events, path, 5)
    source = spark.readStream.schema("timestamp timestamp").parquet(path)
    out, state = fresh_path(spark, "alerts"), fresh_path(spark, "state")
    found = streams.failure_alert(source, failed=F.lit(True), threshold=5)
    streams.run_to_table(found, out, state)
    batch = streams.failure_alert(events, failed=F.lit(True), threshold=5)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {
        tuple(r) for r in batch.collect()
    }


def test_late_rows_are_dropped(spark):
    """A row behind the watermark does not reopen its window."""
    path, out, state = (fresh_path(spark, n) for n in ("events", "alerts", "state"))
    start = datetime(2024, 1, 1)
    slices = [
        [start + timedelta(minutes=i) for i in range(6)],
        [start + timedelta(hours=9, minutes=i) for i in range(6)],
        [start + timedelta(minutes=50)] * 20,  # eight hours late
        [start + timedelta(hours=20)],
    ]
    for times in slices:
        literal_table(spark, [(t,) for t in times], "timestamp timestamp").coalesce(1).write.mode(
            "append"
        ).parquet(path)
        source = spark.readStream.schema("timestamp timestamp").parquet(path)
        found = streams.failure_alert(source, failed=F.lit(True), threshold=5)
        (
            found.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
            .awaitTermination()
        )
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r["window_start"], r["n_failures"]) for r in rows] == [
        (start, 6), (start + timedelta(hours=9), 6),
    ]


def test_include_flags(spark, tmp_path, log_of):
    file = tmp_path / "policy.json"
    file.write_text(json.dumps({
        "security": {"strict_mode": True},
        "educational": {"include_examples": False, "include_documentation_links": False},
        "audit": {"include_query_hash": False, "include_user_info": False},
    }))
    policy = load_policy(file)
    assert policy.strict_mode and not (policy.include_examples or policy.include_links)
    from cellward.operators.verdicts import audit_log

    answers = audit_log(make_log(spark, 4), policy=policy)
    assert "guidance" in answers.columns
    assert not {"correct_pattern", "documentation"} & set(answers.columns)
    shown = reports.audit_records(verdicts(make_log(spark, 4)), policy=policy).collect()
    assert all(r["user_id"] is None and r["session_id"] is None and r["query_hash"] is None for r in shown)
    assert all(r["request_id"] and r["timestamp"] for r in shown)
    file.write_text(json.dumps({"security": {"strict_mode": "yes"}}))
    with pytest.raises(ConfigError):
        load_policy(file)


def test_names_and_times_are_read_once(spark):
    """What a lambda uses several times is computed once for each element, and times need no decimals."""
    from cellward.functions import statements as st
    from cellward.operators import reports

    shown = lambda c: spark.createDataFrame([("x", 0)], "t string, s long").select(c)._jdf.queryExecution().optimizedPlan().expressions().apply(0).sql()
    assert shown(st.segments(F.col("t"))).lower().count("regexp_extract(") <= 2  # 4 when the word was read again for its outcome
    assert "decimal" not in shown(reports.utc_text(F.timestamp_micros("s"))).lower()
    times = ["1969-12-31T23:59:59.999999Z", "1900-03-01T00:00:00.000001Z", "2024-02-29T23:59:59.000000Z", "9999-12-31T12:00:00.500000Z", "1582-10-15T00:00:00.000000Z"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", F.to_timestamp("t").alias("at"))
    rows = rows.select("t", reports.utc_text(F.col("at")).alias("text"), reports.utc_day(F.col("at")).cast("string").alias("day"))
    assert all(r["text"] == r["t"] and r["day"] == r["t"][:10] for r in rows.collect())


def test_names_of_hard_texts(spark):
    """Keywords in any case, quoted keywords, functions, and clause words inside of names."""
    from cellward.functions import statements as st

    text = 'sElEcT "iN", a.`In`, in_x, IN (x.Month), IN, fromage FROM "t" wHeRe grouped /* from */ - 1 -- in\n and `a`.b - \'c\' GROUP  by u Group By v'
    row = spark.createDataFrame([(text,)], "t string").select(st.segments(st.flat(F.col("t"))).alias("p"))
    got = row.select("p", st.identifiers(F.col("p")).alias("i")).first()
    assert [s["clause"] for s in got["p"]] == ["SELECT", "FROM", "WHERE", "GROUP BY", "GROUP BY"]
    assert [(i["clause"], i["name"], i["is_function"]) for i in got["i"]] == [
        ("SELECT", "in", False), ("SELECT", "in", False), ("SELECT", "in_x", False), ("SELECT", "month", False),
        ("SELECT", "fromage", False), ("FROM", "t", False), ("WHERE", "grouped", False), ("WHERE", "b", False),
        ("GROUP BY", "u", False), ("GROUP BY", "v", False),
    ]


def test_only_doubtful_names_and_lists_are_read(spark, log_of):
    """What surely passes is left out before it is read, and no text gets another verdict by that."""
    from cellward.operators import verdicts as v

    count = "COUNT(DISTINCT person_id) AS Count_Patients"
    sure = [
        f"SELECT gender_concept_id, {count} FROM person WHERE location_id > 5 GROUP BY gender_concept_id",
        f"SELECT p.gender_concept_id, {count.replace('person_id', 'p.person_id')} FROM person p "
        "WHERE p.location_id > 5 GROUP BY p.gender_concept_id",
    ]
    doubtful = {
        f"SELECT p, {count} FROM person p GROUP BY p": ["E102"],  # an alias is no column
        f"SELECT x.gender_concept_id, {count} FROM person p GROUP BY x.gender_concept_id": ["E102"],
        f"SELECT a.p.gender_concept_id, a.p.npi, {count} FROM person p GROUP BY gender_concept_id": ["E201"],
        f"SELECT GENDER_CONCEPT_ID, {count} FROM person, death GROUP BY day_of_birth, SSN": ["E203", "E201"],
        f"SELECT gender_concept_id, {count} FROM person GROUP BY person_id": ["E305"],
        f"SELECT gender_concept_id, {count} FROM person": ["E301"],
        f"SELECT f(a, {count}) FROM encounters GROUP BY gender_concept_id": ["E101", "E302"],
        f"SELECT 1 FROM encounters, {count} GROUP BY gender_concept_id": ["E101", "E302", "E304"],
        f"WITH person AS (SELECT npi FROM death) SELECT gender_concept_id, {count} FROM person "
        "GROUP BY gender_concept_id": ["E102", "E201", "E402", "E401"],  # not the catalog's person
    }
    log = log_of(*sure, *doubtful)
    read = {r["query"]: r for r in v.read_statements(log, policy=Policy()).collect()}
    assert all(read[t]["_ids"] == [] and read[t]["_lists"] is None for t in sure)
    rows = v.violations(log, policy=Policy(max_errors=None)).collect()
    found = [list(dict.fromkeys(r["code"] for r in rows if r["request_id"] == str(i))) for i in range(len(read))]
    assert found == [[], [], *doubtful.values()]


def test_rules_stand_in_no_generator(log_of):
    """Generators are interpreted as a whole; the hits are made in a projection below."""
    from cellward.operators import verdicts as v

    plan = v.layer_hits(log_of("SELECT 1"))._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate inline" in line)
    assert "lambda" not in generate and "CASE" not in generate
