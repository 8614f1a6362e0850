"""Packing along a space-filling curve.

Every document becomes token ids and a closing id. Its hashed token counts (``DIMS`` of them) are
projected to ``AXES`` dimensions and give a key on the Hilbert curve. Documents are range-sorted by
that key; a running sum of their lengths in this order is each document's place in one long row
of ids, and that row is cut every ``LENGTH`` ids. So neighbours on the curve share sequences, a
document is cut only where a sequence ends, and only the very last sequence is not full.

Ids are written once, to the folder of ``spark.checkpoint.dir``. Only keys and lengths are sorted;
the sums of the ranges (a row for each partition) are the only thing that is added up in one place.

Defined results: null text is empty and has the closing id alone; repeated rows and rows with
equal or null ``doc_id`` are packed each for itself, in an order given by the key and then by their
place in the written ids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellward.llm.common import cut, small_batches, table

LENGTH = 4096
CLOSING = 2
DIMS, AXES, BITS = 256, 4, 12
#: Words which a worker remembers with their ids; when full, it starts anew.
REMEMBERED = 500_000
#: The normalizer and split of a tokenizer file which ``_PLAIN`` and ``_WORDS`` follow.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SUFFIX = "</w>"
#: Text in which words can be encoded one by one: Latin letters and no special token.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*\Z")
_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


class WordEncoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library, from any of its files.

    If the file says that it splits as ``_WORDS`` does and ends words with ``_SUFFIX``, a text of Latin
    letters is split here, and each distinct word goes through the tokenizer once; any other text, and
    all texts of any other tokenizer, go through it whole. Ids have 16 bits where the vocabulary
    allows, else 32 (``kind``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        pieces = self.whole.get_vocab()
        top = max(CLOSING, *pieces.values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.last = np.zeros(top + 1, bool)
        self.last[[i for piece, i in pieces.items() if piece.endswith(_SUFFIX)]] = True
        self.by_word = self._splits_words()

    def _splits_words(self) -> bool:
        """What the file says, read from the tokenizer's parts, so that its vocabulary is not parsed again."""
        stated = [json.loads(x.__getstate__()) if x else None for x in (self.whole.normalizer, self.whole.pre_tokenizer)]
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        special = self.whole.get_added_tokens_decoder().values()
        return stated == [_NORMALIZER, _PRE_TOKENIZER] and suffix == _SUFFIX and all("<|" in t.content for t in special)

    def learn(self, words: list[str]) -> None:
        """Words go through the tokenizer in lines; a piece that ends a word shows where it ends."""
        lines = [words[at : at + 200] for at in range(0, len(words), 200)]
        for at in range(0, len(lines), 50):
            some = lines[at : at + 50]
            for line, found in zip(some, self.whole.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False)):
                ids = np.array(found.ids, self.kind)
                ends = (self.kind.itemsize * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                if len(ends) != len(line):
                    raise ValueError("the tokenizer does not end each word with one last piece")
                raw = ids.tobytes()
                self.known.update(zip(line, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_word and _PLAIN.match(t) is not None and "<|" not in t for t in texts]
        split = [_WORDS.findall(t.lower()) if yes else None for t, yes in zip(texts, plain)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words: set[str] = set()
        for own in split:
            words.update(own or ())
        self.learn(list(words.difference(self.known)))
        look_up = self.known.__getitem__
        return [
            np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            if own is None
            else np.frombuffer(b"".join(map(look_up, own)), self.kind)
            for text, own in zip(texts, split)
        ]


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that what it remembers serves later tasks too."""
    kept = sys.modules.setdefault("_cellward_llm_kept", types.ModuleType("_cellward_llm_kept"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordEncoder(path)
    return kept.__dict__[path]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates in 0 .. 2**bits - 1 (one row each).

    From the highest bit down, each axis is exchanged with the first or inverted according to its
    bit; the Gray code of the result, read across the axes, is the place.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(axes):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    keys = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            keys = (keys << 1) | ((x[i] >> level) & 1)
    return keys


def curve_keys(ids: list[np.ndarray], seed: int = 11) -> np.ndarray:
    """Hilbert keys of hashed and projected token counts."""
    project = np.random.default_rng(seed).normal(0, 1, (DIMS, AXES))
    counts = np.zeros((len(ids), DIMS))
    for row, own in zip(counts, ids):
        slots = ((own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.intp)
        row += np.bincount(slots, minlength=DIMS)
    counts = np.sqrt(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    # coordinates of unit vectors are about normal; their distribution function spreads them evenly
    spread = 1 / (1 + np.exp(-1.702 * (counts @ project)))
    top = (1 << BITS) - 1
    return hilbert_keys(np.clip((spread * (top + 1)).astype(np.int64), 0, top))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(row, doc_id, key, n, ids)``, written; ``ids`` are ``n`` numbers of 16 or 32 bits and close with 2."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in small_batches(batches, 250):
            ids = [np.append(i, own.kind.type(CLOSING)) for i in own.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(curve_keys(ids), pa.int64()),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([i.astype(own.kind, copy=False).tobytes() for i in ids], pa.binary()),
                ],
                names=["doc_id", "key", "n", "ids"],
            )

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, n long, ids binary")
    return cut(made.withColumn("row", F.monotonically_increasing_id()))


def starts(lengths: DataFrame) -> DataFrame:
    """``(row, start)``: where each row begins when all are put in a row by ``key``."""
    parts = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(lengths.repartitionByRange(parts, "key", "row").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total"))
    totals = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return summed.join(totals, "range").select("row", (F.col("base") + F.col("inside")).alias("start"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece; ``piece_ids`` holds its ids as little-endian unsigned 32-bit numbers."""
    made = encoded(docs, tokenizer)
    placed = made.join(starts(made.select("row", "key", "n")), "row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            rows = []
            for doc, begin, n, raw in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                at = 0
                while at < len(ids):
                    sequence, offset = divmod(begin + at, length)
                    to = min(len(ids), at + length - offset)
                    rows.append((doc, at, to - at, ids[at:to].tobytes(), len(ids), sequence, offset))
                    at = to
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000]), kinds)], names=names
                )

    names = ["doc_id", "start", "length", "piece_ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
    schema = ", ".join(f"{n} {'binary' if n == 'piece_ids' else 'long'}" for n in names)
    return placed.select("doc_id", F.col("start").alias("begin"), "n", "ids").mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
