"""Audit records and the reports made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cellward.policy import Policy
from cellward.session import fresh_path

# Field order of an audit record.
AUDIT_FIELDS = (
    "request_id", "timestamp", "user_id", "query_hash", "validation_result", "layer_failed",
    "error_code", "ip_address", "session_id",
)


def outcome(code: Column) -> Column:
    """PASS, ERROR (the system's fault, E8xx) or FAIL."""
    return F.when(code.isNull(), "PASS").when(code.startswith("E8"), "ERROR").otherwise("FAIL")


def audit_records(verdicts: DataFrame, time_col: str = "ts", *, policy: Policy = Policy()) -> DataFrame:
    """Who asked what when, and the outcome. Never the query text itself, only its hash; who asked and
    the hash as far as the policy includes them."""

    def optional(name):
        shown = name in verdicts.columns and policy.include_user
        return F.col(name) if shown else F.lit(None).cast("string")

    return verdicts.select(
        "request_id",
        F.col(time_col).alias("timestamp"),
        optional("user_id").alias("user_id"),
        F.when(F.lit(policy.include_query_hash), F.col("query_hash")).alias("query_hash"),
        outcome(F.col("code")).alias("validation_result"),
        F.col("layer").alias("layer_failed"),
        F.col("code").alias("error_code"),
        optional("ip_address").alias("ip_address"),
        optional("session_id").alias("session_id"),
    )


_DAY = 86_400_000_000


def utc_day(time: Column) -> Column:
    """An instant's UTC date, free of the session's time zone and its clock changes."""
    micros = F.unix_micros(time.cast("timestamp"))
    # a whole number of days, so rounding only takes out what the division adds
    return F.date_from_unix_date(F.round((micros - F.pmod(micros, F.lit(_DAY))) / _DAY).cast("int"))


def utc_text(time: Column) -> Column:
    """ISO-8601 with six decimals and a trailing Z."""
    micros = F.pmod(F.unix_micros(time.cast("timestamp")), F.lit(_DAY))

    def part(unit, count, width):
        return F.lpad(F.pmod(F.floor(micros / unit), F.lit(count)).cast("string"), width, "0")

    return F.concat(
        F.substring(utc_day(time).cast("string"), 1, 10), F.lit("T"), part(3_600_000_000, 24, 2), F.lit(":"),
        part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2), F.lit("."), part(1, 1_000_000, 6), F.lit("Z"),
    )


def audit_json(records: DataFrame) -> Column:
    """An audit record as one JSON object: fixed key order, nulls kept, UTC time."""
    fields = [
        utc_text(F.col(f)).alias(f) if f == "timestamp" else F.col(f) for f in AUDIT_FIELDS
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def observe_audit(verdicts: DataFrame, observation: Observation) -> DataFrame:
    """Let the audit job itself report its counts (``observation.get``), without a second pass."""
    return verdicts.observe(
        observation,
        F.count(F.lit(1)).alias("n_queries"),
        F.count(F.when(~F.col("success"), 1)).alias("n_rejected"),
        F.count(F.when(F.col("over_length"), 1)).alias("n_over_length"),
    )


def query_metadata(verdicts: DataFrame) -> DataFrame:
    """Hash and layer progress per query. Times come from Spark's own metrics."""
    return verdicts.select(
        "request_id",
        "query_hash",
        "layers_passed",
        F.size("layers_passed").alias("n_layers_passed"),
        "total_layers",
    )


def educational_response(audited: DataFrame) -> DataFrame:
    """The answer to a rejected query as JSON; parts that do not exist are left out."""
    details = F.when(F.size("details") > 0, F.col("details"))
    fields = {
        "error_code": F.col("code"),
        "message": F.col("message"),
        "educational_guidance": _if_present(audited, "guidance"),
        "documentation": _if_present(audited, "documentation"),
        "correct_pattern": _if_present(audited, "correct_pattern"),
        "details": details,
    }
    body = F.struct(*[value.alias(name) for name, value in fields.items() if value is not None])
    return audited.where(F.col("code").isNotNull()).select(
        "request_id", F.col("code").alias("error_code"), F.to_json(body).alias("response")
    )


def _if_present(df, name):
    return F.col(name) if name in df.columns else None


def verdict_summary(verdicts: DataFrame, by: Sequence[str] = ("layer", "code")) -> DataFrame:
    return verdicts.groupBy(*by).agg(F.count("*").alias("n_queries"))


def repeat_offenders(verdicts: DataFrame, *, min_failures: int = 2, time_col: str = "ts"):
    """Users who keep sending the same failing query."""
    return (
        verdicts.where(F.col("code").isNotNull())
        .groupBy("user_id", "query_hash")
        .agg(
            F.count("*").alias("n_failures"),
            F.min(time_col).alias("first_seen"),
            F.max(time_col).alias("last_seen"),
        )
        .where(F.col("n_failures") >= min_failures)
    )


def retain(audit: DataFrame, as_of: Column, *, time_col: str = "timestamp", policy=Policy()):
    """Records inside the retention period. With a ``dt`` partition column the same limit also
    prunes whole partitions."""
    limit = as_of - F.make_dt_interval(F.lit(policy.retention_days))
    kept = audit.where(F.col(time_col) >= limit)
    return kept.where(F.col("dt") >= utc_day(limit)) if "dt" in audit.columns else kept


def exact_percentile(
    df: DataFrame, value: str, q: float, by: Sequence[str], *, per_octave: int = 64, least: int = 50_000, fan: int = 1024
) -> DataFrame:
    """Exact interpolated percentile per group, for groups of any size.

    ``percentile()`` keeps a group's distinct values in one task. Here equal values are counted first and kept in
    the shared folder; a fixed, monotone bucket of the value (about 1 % wide) then tells from bucket totals alone which
    buckets hold the wanted ranks. While such a bucket has more than ``least`` distinct values it is
    cut into ``fan`` cells between its least and its greatest value, and again only the cells of the
    wanted ranks stay. A double's digits end that after a few rounds. What is ordered in the end is small.
    """
    by = list(by)
    v = F.col("_v")
    # 1 ... 2200 * per_octave for any finite double, monotone in |v|
    octaves = F.least(F.log2(F.abs(v)), F.lit(1025.0))
    size = F.floor(octaves * per_octave) + 1100 * per_octave
    bucket = (
        F.when(F.isnan(v), F.lit(2**40))
        .when(v > 0, size)
        .when(v < 0, -size)
        .otherwise(F.lit(0).cast("long"))
    )
    path = fresh_path(df.sparkSession, "percentile")
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v"))
    counted.agg(F.count("*").alias("_n")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    group = Window.partitionBy(*by)
    ordered = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rank = (F.col("_total") - 1) * F.lit(q)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))

    def same(names):
        # null is a group of its own
        return [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in names]

    def wanted(cells):
        """Of a table of values with their ``_cell``, and what lies in front of all of them (``_before``):
        the cells with the wanted ranks."""
        sums = cells.groupBy(*by, "_cell").agg(
            F.sum("_n").alias("_size"), F.count("*").alias("_values"), F.min("_v").alias("_low"), F.max("_v").alias("_top"),
            F.min("_before").alias("_before"), F.max("_total").alias("_total"),
        )
        # all cells of a group, also those of two neighbouring buckets, follow one another
        first = F.min("_before").over(group) + F.coalesce(F.sum("_size").over(ordered), zero)
        found = sums.withColumn("_start", first).where(
            (F.col("_start") <= F.ceil(rank)) & (F.col("_start") + F.col("_size") > F.floor(rank))
        )
        return found.select(
            *[F.col(c).alias(f"_by_{c}") for c in [*by, "_cell"]], "_start", "_low", "_top", "_values"
        )

    cells = counts.withColumns({"_cell": bucket, "_before": zero})
    if by:
        cells = cells.join(totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_total"), same(by))
        cells = cells.drop(*[f"_by_{c}" for c in by])
    else:
        cells = cells.join(totals)
    while True:
        inside = wanted(cells)
        placed = cells.drop("_before").join(inside, same([*by, "_cell"]))
        if (inside.agg(F.max("_values")).first()[0] or 0) <= least:
            break
        share = (F.col("_v") - F.col("_low")) / (F.col("_top") - F.col("_low"))
        place = F.when(F.col("_top") > F.col("_low"), F.least(F.floor(share * fan), F.lit(fan - 1))).otherwise(0)
        # the cells of a greater bucket come after those of a smaller one
        order = F.struct(F.col("_start"), F.coalesce(place, zero).alias("place"))
        cells = placed.select(*by, "_v", "_n", "_total", F.col("_start").alias("_before"), order.alias("_cell"))
    inside = Window.partitionBy(*by, "_cell").orderBy("_v")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_end", F.col("_start") + F.sum("_n").over(upto))

    def at(position):
        covers = (F.col("_end") - F.col("_n") <= position) & (position < F.col("_end"))
        return F.max(F.when(covers, F.col("_v")))

    found = (
        placed.groupBy(*by)
        .agg(
            F.max("_total").alias("n"),
            at(F.floor(rank)).alias("_low"),
            at(F.ceil(rank)).alias("_high"),
            F.max(rank - F.floor(rank)).alias("_part"),
        )
        .withColumn(
            "value",
            F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
                F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
            ),
        )
        .select(*by, "n", "value")
    )
    if not by:
        return found.withColumn("n", F.coalesce("n", zero))
    # a group with nothing but nulls has no place in the counts
    groups = df.select(*[F.col(c).alias(f"_by_{c}") for c in by]).distinct()
    return groups.join(found, same(by), "left").select(
        *[F.col(f"_by_{c}").alias(c) for c in by], F.coalesce("n", zero).alias("n"), "value"
    )
