"""Logs of submitted SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG_DDL = (
    "request_id string, ts timestamp, user_id string, session_id string, "
    "ip_address string, query string"
)


def read_query_log(spark: SparkSession, path: str, format: str = "parquet", **options):
    """A stored log with the fixed schema; rows without a request id get one."""
    reader = spark.read.schema(StructType.fromDDL(LOG_DDL)).format(format).options(**options)
    return with_request_ids(reader.load(path), format)


def stream_query_log(spark: SparkSession, path: str, format: str = "parquet", **options):
    """The same as a stream of files."""
    reader = spark.readStream.schema(StructType.fromDDL(LOG_DDL)).format(format)
    return with_request_ids(reader.options(**options).load(path), format)


def with_request_ids(log: DataFrame, format: str = "parquet") -> DataFrame:
    """Fill missing ids. Parquet rows are named by file and row number, rows of other files by
    file, block and content, so that a recomputed task gives them the same ids again; equal rows
    of one block then have one id."""
    if format == "parquet":
        made = F.sha2(
            F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")), 256
        )
    else:
        place = ["_metadata.file_path", "_metadata.file_block_start"]
        content = F.to_json(F.struct(*[F.col(c) for c in log.columns]))
        made = F.sha2(F.concat_ws("#", *[F.col(c).cast("string") for c in place], content), 256)
    return log.withColumn("request_id", F.coalesce(F.col("request_id"), made))
