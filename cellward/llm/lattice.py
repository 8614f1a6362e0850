"""Near duplicates of embeddings by lattice hashing.

Every table projects vectors to ``BLOCKS`` times eight orthogonal directions, scales them, and
decodes each eight to the nearest point of the lattice E8. The points of a table name a cell. A
vector lives in its cell of every table and visits the ``PROBES`` cells next to it, those whose
points are nearest among the 240 neighbours of its points. Vectors that meet where one of them
lives are compared by cosine in double precision.

Equal vectors are one class, so copies meet nothing. What meets in one cell is compared in blocks.
A link found in several cells counts in the smallest of their names: tasks find that out from the
vectors alone, as projections are sums of whole numbers and come out the same everywhere.

Random pairs with a cosine of exactly 0.9 are found with a chance of about 0.95, with 0.95 or more
nearly always (measured in the tests, for 16 to 128 components; 0.91 at 0.9 for 16); no pair below the threshold is ever linked.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links
with nothing, and so do vectors of different lengths; of rows with one ``vec_id`` the smallest
vector counts; rows with a null id are left out; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.common import block_pairs, components, cut, runs, small_batches, table

TABLES, BLOCKS, PROBES, SCALE = 12, 2, 12, 0.2
COSINE = 0.9
_FINE = float(1 << 20)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) and halves with an even number of minus."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    halves = np.array(list(product((0.5, -0.5), repeat=8)))
    return np.concatenate([found, halves[(halves < 0).sum(1) % 2 == 0]])


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: the better one of D8 and D8 moved by halves."""

    def nearest_d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(1) % 2)
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


class Lattice:
    """Cells of unit vectors of one length."""

    def __init__(self, dims: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = 3):
        self.blocks, self.probes = blocks, probes
        width = max(dims, 8 * blocks)
        # projections of a unit vector are shorter the more components it has; ``scale`` holds for 64
        self.scale = scale * np.sqrt(64 / width)
        self.projections, self.weights, self.steps = [], [], []
        around = neighbours()
        for t in range(tables):
            draw = np.random.default_rng([seed, dims, t])
            turned, _ = np.linalg.qr(draw.normal(size=(width, width)))
            self.projections.append(np.rint(turned[:dims, : 8 * blocks] * _FINE))
            weights = draw.integers(1 << 40, 1 << 61, 8 * blocks)
            self.weights.append((int(draw.integers(1 << 61)), weights))
            self.steps.append(
                np.concatenate([(2 * around).astype(np.int64) @ weights[8 * b : 8 * b + 8] for b in range(blocks)])
            )
        self.around = around

    def cells(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) names of cells; the first of a table is the home."""
        whole = np.rint(units * _FINE)
        out = np.empty((len(units), len(self.projections), 1 + self.probes), np.int64)
        for t, (project, (offset, weights), steps) in enumerate(zip(self.projections, self.weights, self.steps)):
            x = whole @ project / (_FINE * _FINE * self.scale)
            points = np.concatenate([nearest_e8(x[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)], 1)
            home = (2 * points).astype(np.int64) @ weights + offset
            gain = np.concatenate(
                [(x - points)[:, 8 * b : 8 * b + 8] @ self.around.T for b in range(self.blocks)], 1
            )
            # rounded, so that the last bits of a sum do not choose between equally near cells
            best = np.argsort(-np.rint(gain * _FINE), axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = home
            out[:, t, 1:] = home[:, None] + steps[best]
        return out


def unit_rows(rows: list[np.ndarray]) -> np.ndarray:
    x = np.array(rows, float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(vectors: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Positions of the vectors of each length."""
    sizes = np.array([len(v) for v in vectors])
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, one, two)`` of all ids (nulls for what cannot link), and a row for each class of
    equal vectors: ``(one, two, rep, n, vector)``."""
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    one, two = F.xxhash64("vector"), F.xxhash64(F.lit(1), F.col("vector"))
    rows = rows.select("vec_id", F.when(usable, F.col("vector")).alias("vector"))
    rows = cut(rows.withColumn("one", F.when(usable, one)).withColumn("two", F.when(usable, two)))
    grouped = rows.where("vector IS NOT NULL").groupBy("one", "two")
    classes = grouped.agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    return rows.select("vec_id", "one", "two"), cut(classes)


def lattice_links(classes: DataFrame, cosine: float = COSINE, block: int = 512, **shape) -> DataFrame:
    """``(rep, links, root)``: partial numbers of linked vectors, and edges that join classes."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for batch in small_batches(batches, 200):
            ids = batch.column(0).to_numpy()
            vectors = [np.array(v) for v in batch.column(1).to_pylist()]
            for at in by_length(vectors):
                own = made.setdefault(n := len(vectors[at[0]]), made.get(n) or Lattice(n, **shape))
                names = own.cells(unit_rows([vectors[i] for i in at]))
                home = np.zeros(names.shape, bool)
                home[:, :, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], names[0].size)), pa.array(names.ravel()), pa.array(home.ravel())],
                    names=["rep", "key", "home"],
                )

    # equal cells of two tables would only show a member twice
    placed = classes.select("rep", "vector").mapInArrow(place, "rep long, key long, home boolean")
    met = block_pairs(placed, "key", "rep", block, classes.select("rep", "n", "vector"), lead="home")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for group in runs(small_batches(batches, 2000), ["key", "p", "q"]):
            rows = group_links(group, cosine, made, shape)
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["rep", "links", "root"])

    return met.select("key", "p", "q", "own", "home", "rep", "n", "vector").mapInArrow(compare, "rep long, links long, root long")


def group_links(group, cosine: float, made: dict[int, Lattice], shape: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one piece of work that count here."""
    group = group.drop_duplicates("rep")
    ids, weight = group["rep"].to_numpy(), group["n"].to_numpy()
    own, home = group["own"].to_numpy(), group["home"].to_numpy()
    across = group["p"].iloc[0] != group["q"].iloc[0]
    vectors = [np.asarray(v, float) for v in group["vector"]]
    key = group["key"].iloc[0]
    out = [[], [], []]
    for at in by_length(vectors):
        if len(at) < 2 or not home[at].any():
            continue
        units = unit_rows([vectors[i] for i in at])
        near = np.triu(units @ units.T >= cosine, 1)
        near &= home[at][:, None] | home[at][None, :]
        if across:
            near &= own[at][:, None] != own[at][None, :]
        a, b = np.nonzero(near)
        if not len(a):
            continue
        lattice = made.setdefault(n := units.shape[1], made.get(n) or Lattice(n, **shape))
        involved, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        cells = lattice.cells(units[involved])
        a, b = place[: len(a)], place[len(a) :]
        first = np.concatenate([first_meeting(cells[a[i : i + 2000]], cells[b[i : i + 2000]]) for i in range(0, len(a), 2000)])
        a, b = a[first == key], b[first == key]
        if not len(a):
            continue
        size = len(involved)
        mine = at[involved]
        links = np.bincount(a, weight[mine][b], size) + np.bincount(b, weight[mine][a], size)
        root = ids[mine].copy()
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (root == before).all():
                break
        some = links > 0
        for column, values in zip(out, (ids[mine][some], links[some].astype(np.int64), root[some])):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest name of a cell in which one of each two vectors lives and the other is."""
    top = np.iinfo(np.int64).max
    at_b = np.where(a == b[:, :, :1], a, top).min((1, 2))
    at_a = np.where(b == a[:, :, :1], b, top).min((1, 2))
    return np.minimum(at_a, at_b)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **shape) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``."""
    rows, classes = classes_of(vectors)
    found = cut(lattice_links(classes, cosine, **shape))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        classes.join(counts, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            "one",
            "two",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.join(named, ["one", "two"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
