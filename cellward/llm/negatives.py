"""Hard negatives of anchor vectors, by the threshold algorithm.

Vectors become whole numbers, so scores (inner products) are exact. An anchor's positives are its
best rows of the same label. A positive opens a window of scores below its own, and the negatives
are the best rows of other labels in that window.

Both searches are Fagin's threshold algorithm. A block of candidates has one list for each
dimension, sorted by that component. An anchor reads all lists in step, each from the end where its
own component's sign puts the greater products; every row that comes up is scored at once by random
access to its vector. What is not seen yet scores at most the threshold, the sum of the products at the
lists' present places. A window is complete when the threshold falls strictly below its kth score, or
below the window; equal scores are therefore all seen, and ties go to the smaller ``vec_id``.

Candidates and anchors are dealt to blocks of bounded size; every block of candidates meets every block of
anchors once. A block's best k of a window are rows that Spark ranks again over all blocks. Nothing
depends on how many rows have a label, and no row is left out of the search.

Defined results: rows take no part if label or vector is null, a component is null or not finite,
or a component is so large that scores might leave 64 bits; vectors of other lengths than the
anchor's are no candidates; every row of the table counts as a row of its own, also if it repeats
another one or its ``vec_id``; a null id comes last in ties and is no anchor; an anchor without
positives, and a window without rows, give no rows, as does an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellward.llm.common import cut, table

SCALE = 256
#: Positives of an anchor, and negatives of a window.
POSITIVES = NEGATIVES = 5
#: Negatives score between 80 and 100 hundredths of the positive's score.
LOW, HIGH = 80, 100
#: Rows of a block of candidates, of a block of anchors, and of a list that are read in one go.
CANDIDATES, ANCHORS, STEP = 8192, 1024, 64
_LAST = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(key, vec_id, label, vector)`` of the rows that take part; ``key`` tells rows apart."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x * scale))
    # products of two rows then sum to less than 2^62
    small = F.forall("embedding", lambda x: F.abs(x) * scale < F.lit(2.0**31) / F.sqrt(F.size("embedding") + 1.0) - 1)
    rows = cut(rows.where(small).select("vec_id", "label", whole.alias("vector")))
    return rows.withColumn("key", F.monotonically_increasing_id())


class Lists:
    """Candidates of one length with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((keys, ids))  # equal scores keep this order
        self.ids, self.keys, vectors = ids[order], keys[order], vectors[order]
        self.top = float(np.abs(vectors).max(initial=0))
        self.order = np.argsort(vectors, axis=0, kind="stable")
        # sums below 2^53 are exact in doubles, which multiply faster
        self.kinds = {kind: (vectors.astype(kind), np.take_along_axis(vectors, self.order, axis=0).astype(kind)) for kind in (float, np.int64)}

    def read(self, anchor: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Positions and scores of rows not seen before, and the threshold for all others, which
        is None when there are none."""
        n = len(self.ids)
        kind = float if np.abs(anchor).sum(dtype=float) * self.top < 2.0**53 else np.int64
        vectors, lists = self.kinds[kind]
        anchor = anchor.astype(kind)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        unseen = np.ones(n, bool)
        left, depth = n, 0
        while left:
            to = min(depth + step, n)
            rows = [self.order[depth:to, up].ravel(), self.order[n - to : n - depth, down].ravel()]
            new = np.zeros(n, bool)
            new[np.concatenate(rows) if len(up) + len(down) else slice(None)] = True  # without lists all score 0
            new &= unseen
            unseen ^= new
            at = np.flatnonzero(new)
            left -= len(at)
            threshold = int(lists[to - 1, up] @ anchor[up] + lists[n - to, down] @ anchor[down]) if left else None
            yield at, (vectors[at] @ anchor).astype(np.int64), threshold
            depth = to


class Best:
    """The k greatest scores so far with ``low <= 100 * score <= high``; ties in list order."""

    def __init__(self, k: int, window: tuple[int, int] | None = None):
        self.k, self.window = k, window
        self.at, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray) -> None:
        if self.window:
            inside = (scores >= -(-self.window[0] // 100)) & (scores <= self.window[1] // 100)
            at, scores = at[inside], scores[inside]
        if len(self.at) == self.k:
            good = scores >= self.scores[-1]
            at, scores = at[good], scores[good]
        if len(at):
            at, scores = np.concatenate([self.at, at]), np.concatenate([self.scores, scores])
            first = np.lexsort((at, -scores))[: self.k]
            self.at, self.scores = at[first], scores[first]

    def complete(self, threshold: int | None) -> bool:
        """No row that scores at most ``threshold`` can enter."""
        if threshold is None or (self.window and self.window[0] > self.window[1]):
            return True
        full = len(self.at) == self.k and threshold < self.scores[-1]
        return full or bool(self.window and 100 * threshold < self.window[0])


def search(lists: Lists, anchor: np.ndarray, windows: list[Best], allowed: np.ndarray, step: int = STEP) -> None:
    """Fill ``windows`` with the block's best ``allowed`` rows."""
    waiting = windows
    for at, scores, threshold in lists.read(anchor, step):
        fit = allowed[at]
        for w in waiting:
            w.add(at[fit], scores[fit])
        waiting = [w for w in waiting if not w.complete(threshold)]
        if not waiting:
            return


def _columns(table_: pa.Table, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    column = lambda name: table_.column(prefix + name).combine_chunks()
    vectors = column("vector")
    bounds = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    split = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    ids = column("vec_id").fill_null(_LAST).to_numpy()
    return ids, column("key").to_numpy(), column("label").to_numpy(), split


def _by_length(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    sizes = np.array([len(v) for v in vectors], np.int64)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Each row in its own block, once for every block of the other side."""
    key = next(c for c in rows.columns if c.endswith("key"))
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )


def _meet(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` on every block of candidates with every block of anchors."""
    p, q = sizes
    left = _dealt(rows.select("key", "vec_id", "label", "vector"), "p", p, "q", q).groupBy("p", "q")
    # names of their own, as both sides come from one table
    anchors = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    right = _dealt(anchors, "a_q", q, "a_p", p).groupBy("a_p", "a_q")
    return left.cogroup(right).applyInArrow(work, schema)


def _positives(k: int, step: int):
    names = ["anchor", "key", "vec_id", "score"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, keys, labels, vectors = _columns(left)
            _, a_keys, a_labels, anchors = _columns(right, "a_")
            of = _by_length(anchors)
            for n, places in _by_length(vectors).items():
                mine = of.get(n, ())
                for label in np.unique(a_labels[mine]):
                    chosen = places[labels[places] == label]
                    if not len(chosen):
                        continue
                    lists = Lists(ids[chosen], keys[chosen], np.stack([vectors[i] for i in chosen]))
                    for a in (a for a in mine if a_labels[a] == label):
                        best = Best(k)
                        search(lists, anchors[a], [best], lists.keys != a_keys[a], step)
                        for column, values in zip(out, (np.full(len(best.at), a_keys[a]), lists.keys[best.at], lists.ids[best.at], best.scores)):
                            column.append(values)
        return pa.table([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]), pa.int64()) for c in out], names=names)

    return work, "anchor long, key long, vec_id long, score long"


def _negatives(k: int, low: int, high: int, step: int):
    names = ["anchor", "positive", "key", "vec_id", "score"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            ids, keys, labels, vectors = _columns(left)
            _, a_keys, a_labels, anchors = _columns(right, "a_")
            scores = right.column("a_scores").to_pylist()
            of = _by_length(anchors)
            for n, places in _by_length(vectors).items():
                if n not in of:
                    continue
                lists = Lists(ids[places], keys[places], np.stack([vectors[i] for i in places]))
                order = np.lexsort((keys[places], ids[places]))
                of_label = labels[places][order]
                for a in of[n]:
                    windows = {s: Best(k, (low * s, high * s)) for s in scores[a]}
                    search(lists, anchors[a], list(windows.values()), of_label != a_labels[a], step)
                    for s, w in windows.items():
                        for column, values in zip(out, (np.full(len(w.at), a_keys[a]), np.full(len(w.at), s), lists.keys[w.at], lists.ids[w.at], w.scores)):
                            column.append(values)
        return pa.table([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]), pa.int64()) for c in out], names=names)

    return work, "anchor long, positive long, key long, vec_id long, score long"


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k over all blocks, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    candidates: int = CANDIDATES, anchors: int = ANCHORS, step: int = STEP,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for rows of
    ``whole_vectors``; anchors are the rows for which ``is_anchor`` holds."""
    asked = rows.where(is_anchor & F.col("vec_id").isNotNull())
    n, m = rows.agg(F.count("*"), F.count_if(is_anchor & F.col("vec_id").isNotNull())).first()
    sizes = (max(1, -(-n // candidates)), max(1, -(-m // anchors)))
    work, schema = _positives(positives, step)
    near = _first(_meet(rows, asked.select("key", "vec_id", "label", "vector"), sizes, work, schema), ["anchor"], positives)
    near = cut(near.select("anchor", F.nullif("vec_id", F.lit(_LAST)).alias("positive_id"), "score", "rank"))
    windows = near.groupBy("anchor").agg(F.collect_set("score").alias("scores"))
    joined = asked.join(windows, asked["key"] == windows["anchor"]).select("key", "vec_id", "label", "vector", "scores")
    work, schema = _negatives(negatives, low, high, step)
    found = _first(_meet(rows, joined, sizes, work, schema), ["anchor", "positive"], negatives)
    found = found.select("anchor", F.col("positive").alias("score"), "rank", F.nullif("vec_id", F.lit(_LAST)).alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(near.drop("rank"), ["anchor", "score"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )


def moved_labels(vectors: DataFrame) -> DataFrame:
    """Every seventh id belongs to the next of ten labels."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors.select("vec_id", "embedding", moved.alias("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(moved_labels(table(spark, sf_dir, "embeddings")))
    return mine_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5"""
