"""Helpers that depend on the session: shared folder, small literal tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster (or a test's session) names it in ``spark.checkpoint.dir``. What is written below
    it stays until whoever owns the folder clears it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder which all executors share")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Rows known at plan time (dictionaries, guidance) as a local relation.

    Arrow keeps them inside the plan with an exact size, so Catalyst broadcasts them only
    while they are below ``spark.sql.autoBroadcastJoinThreshold`` - no hint is needed.
    """
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    table = pa.table([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)
