"""SimHash near duplicates with the pigeonring filter.

A fingerprint of 64 bits is cut into ``m`` segments that stand in a ring. If two fingerprints
differ in at most ``t`` bits, some segment starts a chain in which every first ``l`` segments
differ in at most ``l * t / m`` bits together. For t = 2 and m = 4 the first segment of that chain
is equal and at most one of the next two differs, so two segments are equal: fingerprints meet on
the six pairs of segments (32 bits), the chain condition prunes what meets, and the full Hamming
distance confirms.

Defined results: null text is empty text; a text without words has fingerprint zero and links
like any other; rows with equal fingerprints are one class; a repeated ``doc_id`` gives one row,
that of its smallest fingerprint; rows whose ``doc_id`` is null have no place in a link and are
left out; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.common import block_pairs, components, cut, runs, small_batches, table

SEED = 42
#: Sets of fewer shingles are compared whatever their fingerprints.
FEW = 16


def shingles(text: str, words: int) -> list[bytes]:
    """A-Z in lower case, words between white space of ASCII, ``words`` of them joined by blanks."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [b" ".join(parts)]
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return [whole[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def hashes(text: str, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    found = [digest(s, SEED) for s in shingles(text, words)]
    return np.array(found, dtype="<u8")


def fingerprint(values: np.ndarray) -> int:
    """Bit i is set where over half of the hashes have it set; zero for no hashes."""
    if not len(values):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` as a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            found = [fingerprint(hashes(t or "", words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return known.mapInArrow(run, "doc_id long, fp long")


def in_chain(bits: Column, segments: int, most: int) -> Column:
    """The pigeonring condition on the differing bits of two fingerprints."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1).cast("long")
    ring = [
        F.bit_count(F.shiftrightunsigned(bits, i * width).bitwiseAND(mask)) for i in range(segments)
    ]
    found = F.lit(False)
    for start in range(segments):
        held, total = F.lit(True), F.lit(0)
        for length in range(1, segments + 1):
            total = total + ring[(start + length - 1) % segments]
            held = held & (total * segments <= length * most)
        found = found | held
    return found


def links(classes: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges ``(a, b)`` that join all classes ``(fp, rep)`` which are linked by chains of
    fingerprints at 2 or fewer differing bits.

    Buckets of at most ``bucket`` classes are compared pair by pair. In a larger bucket, classes
    meet on the points one bit or less away from them: two fingerprints are within two bits just
    where they share such a point, so each point ties its classes to the smallest one and no pair
    is lost or listed.
    """
    pairs = list(combinations(range(4), 2))
    part = [
        F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)
    ]
    keys = F.array(
        *[
            F.lit(n << 32).cast("long") + F.shiftleft(part[i], 16) + part[j]
            for n, (i, j) in enumerate(pairs)
        ]
    )
    keyed = classes.select("fp", "rep", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(sizes, "key"))
    few = keyed.where(F.col("n") <= bucket)
    left = few.select("key", F.col("fp").alias("x"), F.col("rep").alias("a"))
    right = few.select("key", F.col("fp").alias("y"), F.col("rep").alias("b"))
    bits = F.col("x").bitwiseXOR(F.col("y"))
    met = left.join(right, "key").where(
        (F.col("x") < F.col("y")) & in_chain(bits, 4, 2) & (F.bit_count(bits) <= 2)
    )
    flips = F.concat(
        F.array(F.col("fp")),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
    )
    many = keyed.where(F.col("n") > bucket).select("fp", "rep").distinct()
    points = many.select("rep", F.explode(flips).alias("point"))
    least = points.groupBy("point").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
    near = points.join(least, "point").select(F.col("rep").alias("a"), "b")
    return met.select("a", "b").union(near).distinct()


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: linked at 2 or fewer differing bits, directly or not."""
    prints = cut(fingerprints(docs, words).groupBy("doc_id").agg(F.min("fp").alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(classes))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_groups(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    most_bits: int = 24,
    keys: int = 8,
    block: int = 512,
) -> DataFrame:
    """``(doc_id, component_id)`` of documents whose shingle sets have Jaccard ``similarity``.

    At this similarity fingerprints differ in about ten bits, too many for equal segments to
    narrow a search. So documents meet on their ``keys`` smallest shingle hashes (two sets of
    similarity 0.8 share none of eight with a chance of about 3 in a million), the pigeonring
    chains over eight segments prune with ``most_bits``, and the similarity of the sets (of 32-bit
    hashes, to spare disk) decides. Fingerprints are those of the distinct shingles, as repeats
    count for nothing in the similarity; a pair at 0.8 has more than 24 differing bits with a
    chance of about 2 in a million, and pairs with a set of fewer than ``FEW`` shingles, where it
    would be up to 1 in 10 000, are not pruned.
    Documents with equal sets of whole 64-bit hashes are one class. Keys on which the same documents meet count
    once, so their sets are not sent again. Groups that meet on one key are compared in blocks; a pair that is joined already is not compared again, as only components are asked.
    """

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            low, mark = [], []
            for text in batch.column(1).to_pylist():
                unique = np.unique(hashes(text or "", words))
                low.append(unique[:keys].view("<i8").tolist())
                mark.append(hashlib.sha256(unique.tobytes()).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(low, pa.list_(pa.int64())), pa.array(mark, pa.binary())], names=["doc_id", "low", "mark"]
            )

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            fp, whole = [], []
            for text in batch.column(1).to_pylist():
                unique = np.unique(hashes(text or "", words))
                fp.append(fingerprint(unique))
                whole.append(np.unique(unique >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp, pa.int64()), pa.array(whole, pa.binary())], names=["rep", "fp", "whole"]
            )

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    made = cut(known.mapInArrow(sketch, "doc_id long, low array<long>, mark binary"))
    # the sets are made again where they are compared, which takes less disk than keeping them
    carry = known.mapInArrow(sets, "rep long, fp long, whole binary")
    classes = made.groupBy("mark").agg(F.min("doc_id").alias("rep"))
    narrow = made.select(F.col("doc_id").alias("rep"), "mark", "low")
    chosen = narrow.join(classes, ["mark", "rep"]).select("rep", F.explode("low").alias("key")).distinct()
    met = block_pairs(distinct_groups(chosen), "key", "rep", block, carry)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(small_batches(batches, 2000), ["key", "p", "q"]):
            found = similar_edges(group, similarity, most_bits)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    joined = components(met.select("key", "p", "q", "own", "rep", "fp", "whole").mapInArrow(compare, "a long, b long"))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "mark", F.coalesce("component", "rep").alias("component_id")
    )
    return made.select("doc_id", "mark").join(named, "mark").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def distinct_groups(members: DataFrame) -> DataFrame:
    """``members`` (distinct ``rep``, ``key``) of the smallest key of those with the same members;
    groups of one are gone."""
    groups = members.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("two")
    )
    first = groups.where("n > 1").groupBy("n", "one", "two").agg(F.min("key").alias("key"))
    return members.join(first.select("key"), "key", "left_semi").select("rep", "key")


def similar_edges(group, similarity: float, most_bits: int) -> list[tuple[int, int]]:
    """Edges that join the similar documents of one piece of work."""
    ids, own = group["rep"].to_numpy(), group["own"].to_numpy()
    same = group["p"].iloc[0] == group["q"].iloc[0]
    prints = group["fp"].to_numpy().view(np.uint64)
    sets: dict[int, np.ndarray] = {}
    whole = group["whole"].to_numpy()
    sizes = np.array([len(w) // 4 for w in whole])
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def shingle_set(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(whole[i], "<u4")
        return sets[i]

    found = []
    many = len(ids)
    rows_at_once = max(1, (1 << 16) // many)
    for at in range(0, many, rows_at_once):
        rows = np.arange(at, min(many, at + rows_at_once))
        asked = np.arange(many)[None, :] > rows[:, None]
        if not same:
            asked &= own[rows][:, None] != own[None, :]
        left, right = np.nonzero(asked)
        left = rows[left]
        fewest, most = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
        alike = fewest >= similarity * most
        left, right, few = left[alike], right[alike], fewest[alike] < FEW
        bits = prints[left] ^ prints[right]
        near = np.flatnonzero(few | (chains(bits, most_bits) & (np.bitwise_count(bits) <= most_bits)))
        for i, j in zip(left[near].tolist(), right[near].tolist()):
            x, y = find(i), find(j)
            if x == y:
                continue
            a, b = shingle_set(i), shingle_set(j)
            common = len(np.intersect1d(a, b, assume_unique=True))
            if common >= similarity * (len(a) + len(b) - common):
                root[max(x, y)] = min(x, y)
                found.append((int(ids[i]), int(ids[j])))
    return found


def chains(bits: np.ndarray, most: int) -> np.ndarray:
    """``in_chain`` over eight segments, for an array of differing bits."""
    ring = np.bitwise_count(bits.view(np.uint8).reshape(-1, 8))
    twice = np.concatenate([ring, ring[:, :7]], axis=1)
    budgets = np.minimum(np.arange(1, 9) * most // 8, 255).astype(np.uint8)
    found = np.zeros(len(bits), bool)
    for start in range(8):
        open_ = np.flatnonzero(~found & (twice[:, start] <= budgets[0]))
        sums = np.cumsum(twice[open_, start : start + 8], axis=1, dtype=np.uint8)
        found[open_] = (sums <= budgets).all(1)
    return found


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
