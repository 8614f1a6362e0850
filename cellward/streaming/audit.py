"""The stateless audit as a stream, and the only stateful job: failures per hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellward.operators.reports import audit_records
from cellward.operators.verdicts import verdicts
from cellward.policy import Policy
from cellward.session import literal_table
from cellward.sources import audit_store
from cellward.sources.audit_files import audit_lines
from cellward.sources.vocabulary import DEFAULT, Vocabulary


def stream_audit(
    log: DataFrame,
    path: str,
    checkpoint: str,
    vocab: Vocabulary | DataFrame = DEFAULT,
    *,
    policy: Policy = Policy(),
    available_now: bool = False,
    rows_per_file: int = audit_store.ROWS_PER_FILE,
    fan: int = audit_store.FAN,
) -> StreamingQuery:
    """Append a log stream's audit records to the audit store at ``path``.

    A batch is audited on the partitions in which its source reads it, whatever days it holds. Its
    finished lines go to files by day, and the store takes each batch exactly once, also when it is
    replayed. As every batch is a table of its own, the vocabulary may be a dictionary of any size.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        records = audit_records(verdicts(batch, vocab, policy=policy), policy=policy)
        audit_store.append(audit_lines(records), path, batch_id, rows_per_file=rows_per_file, fan=fan)

    writer = log.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def failure_alert(
    audit: DataFrame,
    *,
    failed: Column,
    time_col: str = "timestamp",
    window: str = "1 hour",
    delay: str = "1 hour",
    threshold: int | None = None,
    policy: Policy = Policy(),
) -> DataFrame:
    """Windows with more failures than the threshold; batch or streaming input.

    A stream in append mode shows a window once the watermark has passed its end; rows behind the
    watermark are dropped.
    Event time must be a ``timestamp``, so one without time zone is cast.
    """
    limit = policy.alert_threshold if threshold is None else threshold
    timed = audit.where(failed).select(F.col(time_col).cast("timestamp").alias("_ts"))
    return (
        timed.withWatermark("_ts", delay)
        .groupBy(F.window("_ts", window).alias("_w"))
        .agg(F.count("*").alias("n_failures"))
        .where(F.col("n_failures") > limit)
        .select(
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "n_failures",
        )
    )


def stream_alerts(
    alerts: DataFrame, path: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Append the windows that ``failure_alert`` has closed to Parquet files at ``path``, each exactly once.

    With ``store_lateness`` the rows which the watermark dropped are kept next to them.
    """
    writer = (
        alerts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


LATENESS_DDL = "batch_id long, watermark string, n_rows long, n_dropped long"


def lateness(query: StreamingQuery) -> list[tuple[int, str | None, int, int]]:
    """Of the query's recent batches: their rows, and the rows behind the watermark as the stateful operator
    counts them, that is after a task has combined its rows of one window."""
    return [
        (
            p.batchId,
            p.eventTime.get("watermark"),
            p.numInputRows,
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        )
        for p in query.recentProgress
    ]


def store_lateness(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    """Append ``lateness`` of a query's run to ``path``; nothing if it had no batch."""
    if rows := lateness(query):
        literal_table(spark, rows, LATENESS_DDL).coalesce(1).write.mode("append").parquet(path)


def run_to_table(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run a complete-mode stream over all available input; ``path`` keeps the last result."""

    def store(batch, _):
        batch.write.mode("overwrite").parquet(path)

    query = (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
