"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Descending-LCP Kruskal, for each text: its suffixes are put in order by prefix doubling, and the
lengths of the common prefixes (LCP) of neighbours are edges. Edges are taken from the greatest LCP
down, uniting classes of suffixes with union-find; every class keeps its positions in order, and the
smaller one moves into the larger. Positions i < j that become neighbours in a united class at the
LCP l share exactly l words. If j - i <= l they seed the run from i with period j - i and length
j - i + l; it counts where the words before i and j differ, which is once for every run.

Why that finds every run once: let a run begin at s with smallest period q, so that s and s + q
share l >= q words. A suffix between them in their class would make the run's first q words a power
of something shorter, against q being the smallest period; so s and s + q are neighbours as soon as
their classes unite, and those are united at l. For the same reason no seed has a period that
is not the smallest: the shorter one would be in the class before.

Runs of at least ``least`` words and two periods share at least half of ``least`` words, so edges
below that are left out, and so are texts in which no stretch of that many words occurs twice. Both
leave out nothing that could be a run. A hash finds such texts; equal hashes are only candidates.

Defined results: null text has no words; a null or repeated ``doc_id`` is kept as it is; an empty
table gives no rows; further columns are ignored; texts count whole.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cellward.llm.common import table
from cellward.llm.words import number, split_words, text_slices

LEAST = 12
#: Bytes of text that a task works on at a time.
SLICE = 6 << 20


def repeated(codes: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Texts in which some ``width`` words in a row occur twice, perhaps with a few others."""
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    mix = np.random.default_rng(width).integers(1 << 62, size=width + 1, dtype=np.uint64) | np.uint64(1)
    sums = owner[:n].astype(np.uint64) * mix[width]
    scattered = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    scattered ^= scattered >> np.uint64(29)
    for k in range(width):
        sums += scattered[k : k + n] * mix[k]
    sums = sums[owner[:n] == owner[width - 1 :]]  # all words from one text
    inside = owner[:n][owner[:n] == owner[width - 1 :]]
    order = np.argsort(sums)
    same = sums[order[1:]] == sums[order[:-1]]
    return np.unique(inside[order[1:][same]])


def suffixes(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all texts in order, text by text, and the LCP of each with the next one."""
    n = len(codes)
    ends = np.searchsorted(owner, owner, "right")
    longest = int(np.bincount(owner - owner[0]).max())
    rank = np.unique(owner.astype(np.int64) * (int(codes.max()) + 1) + codes, return_inverse=True)[1] + 1
    ranks, width = [rank.astype(np.int32)], 1
    while width < longest and int(ranks[-1].max()) < n:
        later = np.zeros(n, np.int64)
        later[: n - width] = ranks[-1][width:]
        later[np.arange(n) + width >= ends] = 0
        rank = np.unique(ranks[-1].astype(np.int64) * (n + 1) + later, return_inverse=True)[1] + 1
        ranks.append(rank.astype(np.int32))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    apart = owner[a] != owner[b]
    for level in range(len(ranks) - 1, -1, -1):
        inside = ~apart & (a < ends[order[:-1]]) & (b < ends[order[1:]])
        some = np.flatnonzero(inside)
        some = some[ranks[level][a[some]] == ranks[level][b[some]]]
        for at in (common, a, b):
            at[some] += 1 << level
    return order, common


def kruskal(order: np.ndarray, common: np.ndarray, differ: Callable[[int, int], bool], least: int) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs among suffixes in ``order`` with ``common`` LCPs.

    ``differ(i, j)`` says whether the words before i and j differ.
    """
    edges = np.flatnonzero(common >= (least + 1) // 2)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    for x, y, shared in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist()):
        x, y = find(x), find(y)
        large, small = members.pop(x, None) or [x], members.pop(y, None) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y] = x
        last = len(small) - 1
        for k, p in enumerate(small):
            at = bisect(large, p)
            # neighbours in the united class: none of the other small positions lies between
            if at and (i := large[at - 1]) >= p - shared and (k == 0 or small[k - 1] < i):
                if p - i + shared >= least and differ(i, p):
                    yield i, p - i + shared, p - i
            if at < len(large) and (j := large[at]) <= p + shared and (k == last or small[k + 1] > j):
                if j - p + shared >= least and differ(p, j):
                    yield p, j - p + shared, j - p
        if last < 16:
            for p in small:
                large.insert(bisect(large, p), p)
        else:
            large.extend(small)
            large.sort()
        members[x] = large


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """For each text that has some: its runs ``(start, length, period)`` by start, then period."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    chosen = repeated(codes, owner, (least + 1) // 2)
    if not len(chosen):
        return {}
    taken = np.isin(owner, chosen)
    codes, owner = codes[taken], owner[taken]
    order, common = suffixes(codes, owner)
    ends = np.cumsum(sizes[chosen])
    starts = ends - sizes[chosen]
    found = {}
    for text, begin, end in zip(chosen.tolist(), starts.tolist(), ends.tolist()):
        words = codes[begin:end].tolist()
        runs = kruskal(order[begin:end] - begin, common[begin : end - 1], lambda i, j: i == 0 or words[i - 1] != words[j - 1], least)
        if own := sorted(runs, key=lambda r: (r[0], r[2])):
            found[text] = own
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words which a run repeats: those after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The words of each text with a blank between."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), words), " ")


FIELDS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = LEAST, planted: Callable | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: all runs by start, then period, and the text without
    what they repeat, words joined by one blank.

    ``planted(doc_id, n)`` may name for a text of n words which of them take part, in which order.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE):
            words, bounds = split_words(batch.column(1))
            if planted:
                sizes = np.diff(bounds)
                made = [planted(key, n) for key, n in zip(batch.column(0).to_pylist(), sizes.tolist())]
                parts = [np.arange(n) if m is None else m for m, n in zip(made, sizes.tolist())]
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                offsets = np.repeat(np.cumsum(sizes) - sizes, np.diff(bounds))
                words = words.take(pa.array(np.concatenate([*parts, np.zeros(0, int)]).astype(np.int64) + offsets))
            found = runs_of(number(words)[0], bounds, least)
            keep = np.ones(len(words), bool)
            for text, runs in found.items():
                keep[bounds[text] : bounds[text + 1]] = kept_words(int(bounds[text + 1] - bounds[text]), runs)
            left = np.concatenate([[0], np.cumsum(keep)])[bounds]
            rest = joined(words if keep.all() else words.filter(pa.array(keep)), left)
            runs = [[dict(zip(("start", "length", "period"), r)) for r in found.get(i, ())] for i in range(batch.num_rows)]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array(runs, kind), rest],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, {FIELDS}")


def digests(found: DataFrame) -> DataFrame:
    """The greatest run of each text, and digests of all runs and of the collapsed text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: [] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for runs, text in zip(batch.column("runs").to_pylist(), batch.column("collapsed").cast(pa.binary()).to_pylist()):
                own = [(r["start"], r["length"], r["period"]) for r in runs]
                best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
                rows["n_runs"].append(len(own))
                for name, value in zip(("start", "length", "period"), best or (None,) * 3):
                    rows[name].append(value)
                rows["exponent_milli"].append(best and 1000 * best[1] // best[2])
                rows["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest())
                rows["collapsed_sha256"].append(hashlib.sha256(text).hexdigest())
            columns = [pa.array(v, pa.string() if n.endswith("256") else pa.int64()) for n, v in rows.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *rows])

    longs = ", ".join(f"{n} long" for n in ("n_runs", "start", "length", "period", "exponent_milli"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, {longs}, runs_sha256 string, collapsed_sha256 string")


def with_planted_period(key: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids: from word a on, the words a to a + p - 1 again and again. Other
    texts, and those without an id, stay as they are."""
    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), planted=with_planted_period))
