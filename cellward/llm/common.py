"""Helpers that several operators share: tables, cut lineage, components, blocks of hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder which all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; whoever clears that folder ends its life."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder so that they survive lost executors and are
    computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that what a task builds from texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges`` (``a``, ``b``); the smallest node names it.

    Alternates large-star and small-star steps. Each is a combined minimum per node and one join,
    so a node with very many edges is no hot group; edges are cut after each round. Null ends and
    loops are left out.
    """
    edge = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edge = cut(edge.distinct())
    seen = None
    while True:
        state = edge.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return edge.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edge.select(F.col("b"), F.col("b")).distinct()
            )
        seen = state
        both = edge.union(edge.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b"),
        )
        edge = cut(small.distinct())


def block_pairs(members: DataFrame, key: str, member: str, size: int, carry: DataFrame, lead: str | None = None) -> DataFrame:
    """Deal the members of each group ``key`` out to pairs of blocks (``p`` <= ``q``).

    Groups of one are gone, and with ``lead`` those without a member for which it is true. A group
    of n members has ceil(n / size) blocks; every two blocks, and every block with itself, meet in
    one piece of work of at most about two blocks, so a group with a large part of all rows is
    spread over many tasks and still compared whole. ``own`` is a member's own block. What is
    known of a member (``carry``) joins it only then.
    """
    counts = members.groupBy(key).agg(
        F.count("*").alias("_n"), (F.max(lead) if lead else F.lit(True)).alias("_lead")
    )
    counts = counts.where("_n > 1 AND _lead").drop("_lead")
    return (
        members.join(counts, key)
        .withColumn("_blocks", F.ceil(F.col("_n") / size).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("p", F.least("own", "_other"))
        .withColumn("q", F.greatest("own", "_other"))
        .drop("_n", "_blocks", "_other")
        .join(carry, member)
        .repartition(key, "p", "q")
        .sortWithinPartitions(key, "p", "q", member)
    )


def runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each run of equal ``names``, also where a run crosses batches."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        keys = [frame[n].to_numpy() for n in names]
        changed = np.zeros(len(frame) - 1, bool)
        for k in keys:
            changed |= k[1:] != k[:-1]
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), len(frame)]
        for at, to in zip(bounds[:-2], bounds[1:-1]):
            yield frame.iloc[at:to]
        rest = frame.iloc[bounds[-2] :]
    if rest is not None:
        yield rest
