"""Audit files that many small batches write and that readers see whole.

A store is a folder with ``data`` and ``manifest``. A batch writes a folder of its own, by day, and then a new
manifest that names every folder that counts; a manifest counts once its job has committed. Readers take the newest
one, so they see all of a batch or nothing, and no row twice while folders are merged. The manifest
also holds the last batch, and a batch that comes again is skipped.

A store has one writer, a stream with its checkpoint. Folders that no manifest names any more stay for readers
that still use them, until ``vacuum``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.session import literal_table
from cellward.sources.audit_files import AUDIT_JSON_DDL

#: Rows of a day from which on it gets a further file, and folders of a level that become one of the next.
ROWS_PER_FILE, FAN = 1_000_000, 20
_MANIFEST_DDL = "last_batch long, folder string, level int"


@dataclass(frozen=True)
class State:
    version: int = -1
    last_batch: int = -1
    folders: tuple[tuple[str, int], ...] = ()  # name and level


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    system, at = _files(spark, path)
    return [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []


def read_state(spark: SparkSession, path: str) -> State:
    """What the newest committed manifest says; the empty state if there is none."""
    for name in sorted(_names(spark, f"{path}/manifest"), reverse=True):
        system, done = _files(spark, f"{path}/manifest/{name}/_SUCCESS")
        if system.exists(done):
            rows = spark.read.schema(_MANIFEST_DDL).json(f"{path}/manifest/{name}").collect()
            folders = tuple(sorted((r["folder"], r["level"]) for r in rows if r["folder"] is not None))
            return State(int(name), rows[0]["last_batch"], folders)
    return State()


def _commit(spark: SparkSession, path: str, state: State) -> State:
    rows = [(state.last_batch, *f) for f in state.folders] or [(state.last_batch, None, None)]
    manifest = literal_table(spark, rows, _MANIFEST_DDL).coalesce(1)
    manifest.write.mode("overwrite").json(f"{path}/manifest/{state.version:012d}")
    return state


def _write(spark: SparkSession, lines: DataFrame, path: str, folder: str, rows_per_file: int) -> bool:
    """Lines by day; a day has one file for each ``rows_per_file`` of its rows. False if there are no lines."""
    days = [(r["dt"], -(-r["count"] // rows_per_file)) for r in lines.groupBy("dt").count().collect()]  # a row a day
    if days:
        dealt = lines.join(literal_table(spark, days, "_day date, _files long"), F.col("dt").eqNullSafe(F.col("_day")))
        # at least a task for each file of the largest day; more if the session has them for more days
        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(max(n for _, n in days), min(wide, sum(n for _, n in days)))
        dealt = dealt.withColumn("_file", F.pmod(F.xxhash64("value"), "_files")).repartition(tasks, "dt", "_file")
        out = dealt.select("value", "dt").write.mode("overwrite").partitionBy("dt")
        out.text(f"{path}/data/folder={folder}")
    return bool(days)


def append(lines: DataFrame, path: str, batch_id: int, *, rows_per_file: int = ROWS_PER_FILE, fan: int = FAN) -> State:
    """Add a batch's audit lines (``value, dt``) unless the store has that batch, then merge what is due.

    The lines are made on their own partitions and kept while days are counted; only finished lines
    are dealt to files, so that a batch of a single day is spread like any other.
    """
    spark = lines.sparkSession
    state = read_state(spark, path)
    if state.last_batch >= batch_id:
        return state
    lines = lines.persist()
    try:
        folder = f"batch-{batch_id:012d}"
        new = ((folder, 0),) if _write(spark, lines, path, folder, rows_per_file) else ()
    finally:
        lines.unpersist()
    state = _commit(spark, path, State(state.version + 1, batch_id, state.folders + new))
    level = 0
    while len(due := [f for f in state.folders if f[1] == level]) >= fan:
        state = merge(spark, path, state, due, level + 1, rows_per_file=rows_per_file)
        level += 1
    return state


def merge(
    spark: SparkSession, path: str, state: State | None = None, folders=None, level: int | None = None, *, rows_per_file: int = ROWS_PER_FILE
) -> State:
    """The given folders (all of them) become one, with a file a day for each ``rows_per_file`` rows."""
    state = read_state(spark, path) if state is None else state
    folders = state.folders if folders is None else folders
    if len(folders) < 2:
        return state
    level = max(f[1] for f in folders) if level is None else level
    raw = spark.read.schema("value string, dt date").option("basePath", f"{path}/data")
    lines = raw.text([f"{path}/data/folder={name}" for name, _ in folders]).select("value", "dt")
    made = f"merged-{state.version + 1:012d}"
    _write(spark, lines, path, made, rows_per_file)
    kept = tuple(f for f in state.folders if f not in folders)
    return _commit(spark, path, State(state.version + 1, state.last_batch, (*kept, (made, level))))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The audit records; ``dt`` is a partition column."""
    folders = read_state(spark, path).folders
    schema = f"{AUDIT_JSON_DDL}, dt date"
    if folders:
        reader = spark.read.schema(schema).option("basePath", f"{path}/data")
        raw = reader.json([f"{path}/data/folder={name}" for name, _ in folders]).drop("folder")
    else:
        raw = literal_table(spark, [], schema)
    return raw.withColumn("timestamp", F.to_timestamp("timestamp"))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders and manifests which the newest manifest does not need. No reader may be using an older one."""
    state = read_state(spark, path)
    live = {f"folder={name}" for name, _ in state.folders}
    old = [f"{path}/data/{n}" for n in _names(spark, f"{path}/data") if n not in live]
    old += [f"{path}/manifest/{n}" for n in _names(spark, f"{path}/manifest") if n != f"{state.version:012d}"]
    for name in old:
        system, at = _files(spark, name)
        system.delete(at, True)
    return len(old)


def expire(spark: SparkSession, path: str, first_day) -> State:
    """Drop the days before ``first_day`` by their folders alone; no file is read. A folder whose days are
    all gone leaves the manifest, the others lose those days' partitions."""
    state = read_state(spark, path)
    kept = []
    for name, level in state.folders:
        days = [n for n in _names(spark, f"{path}/data/folder={name}") if n.startswith("dt=")]
        gone = [n for n in days if n[3:] < str(first_day) and n != "dt=__HIVE_DEFAULT_PARTITION__"]
        if len(gone) < len(days):
            kept.append((name, level))
            for day in gone:
                system, at = _files(spark, f"{path}/data/folder={name}/{day}")
                system.delete(at, True)
    return _commit(spark, path, State(state.version + 1, state.last_batch, tuple(kept)))
