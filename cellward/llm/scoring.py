"""Language-model scores of whole texts by online logistic context mixing.

What the model codes is the sequence of a text's tokens: its words in lower case (A-Z only), then an
end. All of it is binary decisions:

* Where the two words before have stood in this text already, a first bit says whether the word
  that followed them then follows again. If so, that is all.
* Else the bits of the word's symbol follow, along a Huffman tree of the training counts. The most
  frequent words and the end have symbols of their own; all other known words share one for each class of
  their first two bytes and bit length of their count, and unknown words one for each class. In learning, a word's own occurrence does
  not count, so that a word known once stands for the unknown ones.
* A word of a shared symbol costs what its count is of the symbol's sum. An unknown word
  is spelled: the bits of its bytes and of a final blank, learned from the words known once.

Several predictors give each bit a chance: the counts of zeros and ones that the training texts hold for the
bit's place in the tree alone and with hashed contexts - the symbol before, the two before, the last two
frequent words - or, in spelling, with the one to five bytes before. Their logits are
combined by weights that a gate chooses (the depth, or the state of the repetition) and the result is refined
by a table of how often such chances came true. The weights and that table are learned from every bit of all
training texts, and of all words known once, with each bit's own count taken out: tasks sum slopes and
curvatures of the cost, gate by gate, and a Newton step follows from the sums. Then every text goes on learning
its own weights, block by block, from what it has shown so far. The chances of all continuations sum to at most 1.

The count of every word of the corpus is gathered; that table grows with the input and is never in
one place. Texts are cut into chunks of bounded size whose distinct words meet the counts by a join; the larger a
chunk, the fewer such rows. Its texts are then learned and scored a group at a time.
Hashed contexts have tables of a fixed size, which tasks fill and Spark sums block by block.

Defined results: null text is empty, and an empty text is an end alone; a null ``doc_id`` counts as
held out, as its digest has the remainder 0; repeated rows are scored, and counted, each on their own; an
empty table gives no rows; further columns are ignored; texts count whole. A text is one row of one
task, so a task needs memory in proportion to the longest text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellward.llm.common import shared_path, table
from cellward.llm.words import number, split_words, text_slices

#: Words with a symbol of their own, slots of a hashed context, bytes of text in a chunk.
FREQUENT, SLOT_BITS, SLICE = 1024, 18, 12 << 20
#: Words of a chunk whose contexts and bits are in memory at a time; a longer text is alone.
GROUP = 1 << 19
#: Weights before anything is learned; passes over all training bits that learn them; what holds them where little is known.
FIRST, ROUNDS, RIDGE = (0.4, 0.5, 0.2, 0.2, 0.0), 1, 10.0
#: Tokens of a text between two changes of its weights, and the rate of change.
BLOCK, RATE = 64, 0.015
#: Texts that take their blocks in step.
TEXTS = 128
SLOTS = 1 << SLOT_BITS
#: Slots for the places of bits alone, and the bits of a repetition's length in words (0 to 15).
NODES, REPEATS = 4096, 16
ORDERS = 4
#: Classes of words by their first two bytes.
CLASSES = 16
#: Gates: depths 0 to 5 of the tree, a repetition's first bit and its further bits.
GATES, INPUTS = 8, 5
STEPS, TOP = 33, 8.0
#: Sums of a lesson for each gate.
LESSON = INPUTS + INPUTS**2 + 2 * STEPS
CONSTANT = np.float32(0.3)


# ------------------------------------------------------------------ chunks of texts


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers of at least 0, compressed: the lowest bytes of all of them, then the next ones."""
    size = next(k for k in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << (8 * k - (k == 8)))
    planes = numbers.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()
    return np.array([len(numbers), size], "<i8").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    many, size = np.frombuffer(data, "<i8", 2).tolist()
    planes = np.frombuffer(pa.decompress(data[16:], many * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, many).T).view(f"<u{size}").ravel().astype(np.int64)


def pack_words(words: pa.Array) -> bytes:
    ends, data = _buffers(words)
    sizes, text = pack(np.diff(ends)), data[ends[0] : ends[-1]].tobytes()
    return np.array([len(sizes), len(text)], "<i8").tobytes() + sizes + pa.compress(text, "zstd", asbytes=True)


def unpack_words(data: bytes) -> pa.Array:
    at, size = np.frombuffer(data, "<i8", 2).tolist()
    sizes = unpack(data[16 : 16 + at])
    text = pa.decompress(data[16 + at :], size, "zstd") if size else pa.py_buffer(b"")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), text)


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, and all bytes."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def chunks(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """Rows of many texts: their words as codes into the chunk's distinct words, with the count of
    each in the training texts of the chunk. ``docs`` has ``doc_id, held_out, text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(text_slices(batches, 2, size)):
            texts = pc.fill_null(batch.column(2), "")
            words, bounds = split_words(pc.ascii_lower(texts))
            codes, distinct = number(words)
            sizes = np.diff(bounds)
            train = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False), sizes)
            counts = np.bincount(codes[train], minlength=len(distinct))
            one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
            packed = [pack(sizes), pack(pc.binary_length(texts).to_numpy()), pack(codes), pack(counts), pack_words(distinct)]
            columns = [pa.array([part + n]), one(batch.column(0)), one(batch.column(1)), *[pa.array([p], pa.binary()) for p in packed]]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "held", "sizes", "bytes", "codes", "train", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_ids array<{kind}>, held array<boolean>, sizes binary, bytes binary, codes binary, train binary, words binary"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def counted_words(parts: DataFrame) -> DataFrame:
    """``(chunk, pos, word, c, first)``: every chunk's distinct words with their count in all training
    texts. ``first`` holds for one row of each word; a word has at most one row in a chunk, so that even
    the most frequent one has few."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, train, words in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                counts, words = unpack(train), unpack_words(words).cast(pa.string())
                for at in range(0, len(words), 20_000):
                    n = len(words.slice(at, 20_000))
                    columns = [pa.array(np.full(n, chunk)), pa.array(np.arange(at, at + n, dtype=np.int32)), words.slice(at, n), pa.array(counts[at : at + n])]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "pos", "word", "n"])

    rows = parts.select("chunk", "train", "words").mapInArrow(run, "chunk long, pos int, word string, n long")
    same = Window.partitionBy("word").orderBy("chunk")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("chunk", "pos", "word", F.sum("n").over(whole).alias("c"), (F.row_number().over(same) == 1).alias("first"))


def vocabulary(counted: DataFrame) -> DataFrame:
    """``(word, c)`` of the words that training texts hold."""
    return counted.where("first AND c > 0").select("word", "c")


def with_counts(parts: DataFrame, counted: DataFrame, code: Code) -> DataFrame:
    """The chunks with count and symbol of their distinct words, of which only the unknown ones are kept."""
    found = counted.where("c > 0").groupBy("chunk").agg(F.collect_list("pos").alias("at"), F.collect_list("c").alias("c"))
    names = ["doc_ids", "held", "sizes", "bytes", "codes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = unpack_words(batch.column("words")[row].as_py())
                counts = np.zeros(len(words), np.int64)
                if batch.column("at")[row].is_valid:
                    counts[batch.column("at")[row].values.to_numpy()] = batch.column("c")[row].values.to_numpy()
                packed = [pack(counts), pack(code.symbols(words, counts)), pack_words(words.filter(pa.array(counts == 0)))]
                columns = [batch.column(n).slice(row, 1) for n in names] + [pa.array([p], pa.binary()) for p in packed]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "counts", "symbols", "unknown"])

    schema = StructType([parts.schema[n] for n in names])
    for name in ("counts", "symbols", "unknown"):
        schema = schema.add(name, "binary")
    return parts.drop("train").join(found, "chunk", "left").mapInArrow(run, schema)


# ------------------------------------------------------------------ symbols and bits


@dataclass
class Code:
    """Symbols of words and the bits of symbols."""

    frequent: pa.Array
    mass: np.ndarray  # sums of the counts that share a symbol: 64 bit lengths of each class
    ends: int
    tokens: int
    distinct: int
    nodes: np.ndarray  # the places in the tree and the bits there, symbol by symbol, after a free place each
    bits: np.ndarray
    gates: np.ndarray
    first: np.ndarray  # where each symbol's begin
    lengths: np.ndarray

    @cached_property
    def spread(self) -> np.ndarray:
        """The places as they enter the hashes of contexts."""
        return _spread(self.nodes)

    @property
    def rare(self) -> int:
        return len(self.frequent)

    @property
    def end(self) -> int:
        return self.rare + 64 * CLASSES

    @property
    def start(self) -> int:
        return self.end + 1

    def symbols(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Of distinct words. Shared symbols follow the frequent words, in each class the one for unknown words first."""
        shared = np.where(counts > 0, np.frexp(counts.astype(float))[1], 0) + self.rare + 64 * classes(words)
        own = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=self.frequent), -1).to_numpy(zero_copy_only=False)
        return np.where(own >= 0, own, shared).astype(np.int64)

    def less(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The symbols if each word had one count less."""
        shared = (symbols >= self.rare) & (symbols < self.end) & (counts > 0)
        return np.where(shared, symbols - np.frexp(counts.astype(float))[1] + np.frexp(np.maximum(counts - 1, 0).astype(float))[1], symbols)

    def unknown(self, symbols: np.ndarray) -> np.ndarray:
        return (symbols >= self.rare) & (symbols < self.end) & ((symbols - self.rare) % 64 == 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def shared_bits(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What it costs to say which word of its symbol a word is, without spelling."""
        out = np.zeros(len(symbols))
        some = np.flatnonzero((symbols >= self.rare) & (symbols < self.end) & ~self.unknown(symbols))
        out[some] = np.log2(self.mass[symbols[some] - self.rare] / counts[some])
        return out


#: The class of each pair of first bytes; a word of one byte has a blank for the second.
_CLASS = np.array([zlib.crc32(bytes(p if p[1] != 32 else p[:1])) % CLASSES for p in product(range(256), repeat=2)], np.int64)


def classes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    ends, data = _buffers(words)
    first, size = ends[:-1], np.diff(ends)
    one, two = data[np.minimum(first, len(data) - 1)], data[np.minimum(first + 1, len(data) - 1)]
    return np.where(size > 0, _CLASS[256 * one.astype(np.int64) + np.where(size > 1, two, 32)], zlib.crc32(b"") % CLASSES)


def huffman(weights: dict[int, int], size: int) -> tuple[np.ndarray, ...]:
    """Places, bits and gates along the tree for each symbol; equal weights go by their order."""
    heap = [(w, s, s) for s, w in sorted(weights.items())]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    node = size
    while len(heap) > 1:
        for bit in (0, 1):
            w, _, s = heapq.heappop(heap)
            above[s] = (node, bit)
            if bit:
                heapq.heappush(heap, (w + first, node, node))
            first = w
        node += 1
    paths = {}
    for s in weights:
        path, at = [], s
        while at in above:
            at, bit = above[at]
            path.append((at - size, bit))
        paths[s] = path[::-1]
    lengths = np.zeros(size, np.int64)
    for symbol, path in paths.items():
        lengths[symbol] = len(path)
    first = np.cumsum(lengths + 1) - lengths
    nodes, bits, gates = np.zeros(first[-1] + lengths[-1], np.int64), np.zeros(first[-1] + lengths[-1], bool), np.zeros(first[-1] + lengths[-1], np.int64)
    for symbol, path in paths.items():
        for d, (at, bit) in enumerate(path, first[symbol]):
            nodes[d], bits[d], gates[d] = at, bit, min(d - first[symbol], 5)
    return nodes, bits, gates, first, lengths


def make_code(words: DataFrame, ends: int, frequent: int = FREQUENT) -> Code:
    often = words.where("c > 1").orderBy(F.desc("c"), "word").limit(frequent).collect()
    size = lambda c: F.when(c > 0, F.length(F.bin(c))).otherwise(0)
    kind = 64 * (F.crc32(F.substring(F.encode("word", "utf-8"), 1, 2)) % CLASSES)
    sums = words.groupBy((kind + size(F.col("c"))).alias("b"), (kind + size(F.col("c") - 1)).alias("less"))
    mass, seen, distinct = np.zeros(64 * CLASSES, np.int64), np.zeros(64 * CLASSES, np.int64), int(ends > 0)
    for row in sums.agg(F.sum("c").alias("mass"), F.count("*").alias("n")).collect():
        mass[row["b"]] += row["mass"]
        seen[row["less"]] += row["mass"]
        distinct += row["n"]
    tokens, rare = int(mass.sum()) + ends, len(often)
    names = pa.array([r["word"] for r in often], pa.string())
    for r, k in zip(often, 64 * classes(names)):
        mass[k + int(r["c"]).bit_length()] -= r["c"]
        seen[k + int(r["c"] - 1).bit_length()] -= r["c"]
    weights = {k: r["c"] for k, r in enumerate(often)}
    weights |= {rare + b: int(max(seen[b], 0)) + 1 for b in range(len(mass)) if mass[b] or b % 64 == 0}
    end = rare + len(mass)
    weights[end] = ends + 1
    return Code(names, mass, ends, tokens, distinct, *huffman(weights, end + 1))


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.uint32(0x811C9DC5)
    for p in parts:
        out = out ^ p.astype(np.uint32, copy=False)
        out *= np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out


def _spread(nodes: np.ndarray) -> np.ndarray:
    return nodes.astype(np.uint32) * np.uint32(0x85EBCA6B)


class Tokens:
    """The tokens of a chunk's texts, or of some of them, with their contexts, text by text or by blocks of texts."""

    def __init__(self, code: Code, codes: np.ndarray, sizes: np.ndarray, symbols: np.ndarray):
        n = len(codes) + len(sizes)
        self.sizes = sizes + 1
        ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.first = ends - self.sizes
        first = np.repeat(self.first, self.sizes)
        at = np.arange(n)
        self.place = at - first
        written = np.ones(n, bool)
        written[ends - 1] = False
        word = np.full(n, len(symbols), np.int64)
        word[written] = codes
        self.word = word
        self.symbol = np.append(symbols, code.end).take(word)
        second = self.first[self.sizes > 1] + 1

        def before(values, by, fill):
            out = np.empty(n, values.dtype)
            out[by:] = values[: max(n - by, 0)]
            out[self.first] = fill
            if by > 1:
                out[second] = fill
            return out

        short = self.symbol.astype(np.uint32)
        one, two = before(short, 1, code.start), before(short, 2, code.start)
        # the last two frequent words before each token
        last = np.maximum.accumulate(np.where(self.symbol < code.rare, at, -1)) if n else at
        seen = before(last, 1, -1)
        seen[seen < first] = -1
        earlier = np.where(seen > 0, last.take(np.maximum(seen - 1, 0)), -1)
        earlier[(seen < 0) | (earlier < first)] = -1
        named = np.append(short, np.uint32(code.start))  # -1 is the last one
        self.contexts = [_hash(one), _hash(one, two), _hash(named.take(seen, mode="wrap"), named.take(earlier, mode="wrap") + np.uint32(70_000))]

        # the word that followed the two words before when they last stood in this text
        some = np.flatnonzero(self.place >= 2)
        pairs = self.doc * (len(symbols) + 1)
        pairs[2:] += word[: max(n - 2, 0)]
        pairs *= len(symbols) + 1
        pairs[1:] += word[: max(n - 1, 0)]
        pair = pairs[some]
        # most pairs stand once; only the others need an order that keeps their places
        order = np.argsort(pair)
        pair = pair.take(order)
        same = pair[1:] == pair[:-1]
        more = np.zeros(len(order), bool)
        more[1:] |= same
        more[:-1] |= same
        some = np.sort(some[order[more]])
        pair = pairs[some]
        order = np.argsort(pair, kind="stable")
        again = np.flatnonzero(pair[order[1:]] == pair[order[:-1]]) + 1
        self.repeat = np.zeros(n, bool)
        self.hit = np.zeros(n, bool)
        here, there = some[order[again]], some[order[again - 1]]
        self.repeat[here] = True
        self.hit[here] = word[here] == word[there]
        miss = before(np.maximum.accumulate(np.where(self.hit, -1, at)) if n else at, 1, -1)
        self.run = np.where(self.place > 0, np.minimum(at - 1 - miss, REPEATS - 1), 0)

    def bits(self, code: Code, chosen: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of all bits of the ``chosen`` tokens: how many each token has, and the bits' places (in the table of the
        places alone and in those of the contexts), gates and values."""
        repeat, symbol = self.repeat[chosen], self.symbol[chosen]
        many = repeat + np.where(self.hit[chosen], 0, code.lengths[symbol])
        begin = np.cumsum(many) - many
        along = np.repeat(code.first[symbol] - repeat - begin, many) + np.arange(int(many.sum()))
        node, value, gate = code.nodes[along], code.bits[along], code.gates[along]
        # the bit of a repetition takes the free place in front of its symbol's
        asked = np.flatnonzero(repeat)
        run = self.run[chosen[asked]]
        first = begin[asked]
        node[first], value[first], gate[first] = NODES - REPEATS + run, self.hit[chosen[asked]], 6 + (run > 0)
        owner = np.repeat(chosen, many)
        return many, _places([c.take(owner) for c in self.contexts], node, _spread(node)), gate, value

    def gated_bits(self, code: Code, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """The same bits gate by gate, those of a gate in the tokens' order: gate, each bit's token, places and values.
        The first bits of all symbols are one gate, then the second ones, so that nothing has to be sorted."""
        left = chosen[~self.hit[chosen]]
        symbol = self.symbol.take(left)
        along, many = code.first.take(symbol), code.lengths.take(symbol)
        contexts = [c.take(left) for c in self.contexts]
        for gate in range(5):
            if (more := many > gate).all():
                more = slice(None)
            left, along, many, contexts = left[more], along[more], many[more], [c[more] for c in contexts]
            yield gate, left, _places(contexts, code.nodes.take(along), code.spread.take(along)), code.bits.take(along)
            along = along + 1
        many = many - 5
        begin = np.cumsum(many) - many
        along = np.repeat(along - begin, many) + np.arange(int(many.sum()))
        left, contexts = np.repeat(left, many), [np.repeat(c, many) for c in contexts]
        yield 5, left, _places(contexts, code.nodes.take(along), code.spread.take(along)), code.bits.take(along)
        asked = chosen[self.repeat[chosen]]
        later = self.run[asked] > 0
        for gate, some in ((6, asked[~later]), (7, asked[later])):
            node = NODES - REPEATS + self.run[some]
            yield gate, some, _places([c.take(some) for c in self.contexts], node, _spread(node)), self.hit[some]


def _places(contexts: list[np.ndarray], node: np.ndarray, spread: np.ndarray) -> list[np.ndarray]:
    """The places of bits alone and in the tables of the contexts, given each bit's contexts and its place in the tree."""
    places = [node]
    for context in contexts:
        place = context ^ spread
        place *= np.uint32(0xC2B2AE35)
        place >>= np.uint32(32 - SLOT_BITS)
        places.append(place)
    return places


#: Where the tables of the places alone and of the contexts begin.
TABLES = (0, *(NODES + k * SLOTS for k in range(3)))
TABLE = NODES + 3 * SLOTS


def spelled_bits(words: pa.Array) -> tuple[np.ndarray, Iterator[tuple[list[np.ndarray], int, np.ndarray]]]:
    """The word of each byte of ``words``, final blanks included; and for each of a byte's eight bits
    the slots of the predictors, the gate and the values. The first two bytes have contexts of the word's class,
    which its symbol has told."""
    text = np.frombuffer(b"".join(w + b" " for w in words.cast(pa.binary()).to_pylist()), np.uint8)
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[owner]
    told = np.where(place < 2, 1 + classes(words)[owner], 0) if len(text) else place
    contexts, past = [], []
    for k in range(1, 6):
        byte = np.zeros(len(text), np.uint32)
        byte[k:] = text[: max(0, len(text) - k)]
        past.append(np.where(place < k, 0, byte + 1))
        if k != 4:
            contexts.append(_hash(*past, 8 * told + k))

    def steps():
        node = np.ones(len(text), np.uint32)
        for step in range(8):
            value = (text >> np.uint8(7 - step)) & np.uint8(1)
            spread = node * np.uint32(0x85EBCA6B)
            yield (
                [((c ^ spread) * np.uint32(0xC2B2AE35) >> np.uint32(32 - SLOT_BITS)).astype(np.int64) + k * SLOTS for k, c in enumerate(contexts)],
                step,
                value.astype(bool),
            )
            node = node * np.uint32(2) + value

    return owner, steps()


# ------------------------------------------------------------------ counts of bits


def _add(counts: np.ndarray, slots: np.ndarray, value: np.ndarray) -> None:
    counts += np.bincount(_valued(slots, value), minlength=len(counts))


def _valued(slots: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Two numbers for each slot, for a zero and for a one."""
    return (slots << slots.dtype.type(1)) + value


def _blocks(counts: np.ndarray, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """A task's counts as rows of 16 384 numbers; blocks without any are left out."""
    for at in range(0, len(counts), size):
        part = counts[at : at + size]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.astype("<i4").tobytes()], pa.binary())], names=["at", "part"])


def _summed(blocks: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counts. Only this, of a fixed size, comes to the driver."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = np.frombuffer(part, "<i4").astype(np.int64)
                sums[at] = sums[at] + numbers if at in sums else numbers
        for at, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    out = np.zeros(size, np.int64)
    for at, part in blocks.repartition("at").mapInArrow(add, "at long, part binary").collect():
        numbers = np.frombuffer(part, "<i8")
        out[at : at + len(numbers)] = numbers
    return out


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """Texts in groups of at most ``most`` words, or one that is longer, and their words; at least one group."""
    ends = np.cumsum(sizes)
    at = low = 0
    while True:
        upto = max(min(at + 1, len(sizes)), int(np.searchsorted(ends, low + most, "right")))
        high = int(ends[upto - 1]) if upto else 0
        yield slice(at, upto), slice(low, high)
        at, low = upto, high
        if at >= len(sizes):
            return


def _tokens(code: Code, batch: pa.RecordBatch, row: int, less: bool = False) -> Iterator[tuple[Tokens, slice, np.ndarray, np.ndarray]]:
    """A chunk's tokens, group by group: the tokens, which texts, and counts and symbols of the chunk's distinct words."""
    codes, sizes, counts, symbols = (unpack(batch.column(name)[row].as_py()) for name in ("codes", "sizes", "counts", "symbols"))
    own = code.less(symbols, counts) if less else symbols
    for texts, words in _groups(sizes, GROUP):
        yield Tokens(code, codes[words], sizes[texts], own), texts, counts, symbols


def _train_tokens(code: Code, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Tokens, np.ndarray]]:
    """The tokens of all chunks, and which of them belong to training texts."""
    for batch in batches:
        for row in range(batch.num_rows):
            train = ~batch.column("held")[row].values.to_numpy(zero_copy_only=False)
            for tokens, texts, _, _ in _tokens(code, batch, row, less=True):
                yield tokens, np.flatnonzero(train[texts][tokens.doc])


def bit_counts(joined: DataFrame, code: Code) -> np.ndarray:
    """Zeros and ones of all training texts in every slot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * TABLE, np.int64)
        for tokens, chosen in _train_tokens(code, batches):
            for at in range(0, len(chosen), 1 << 16):
                _, _, places, values = zip(*tokens.gated_bits(code, chosen[at : at + (1 << 16)]))
                value = np.concatenate(values)
                for base, place, size in zip(TABLES, zip(*places), (NODES, *[SLOTS] * 3)):
                    _add(counts[2 * base : 2 * (base + size)], np.concatenate(place), value)
        yield from _blocks(counts)

    return _summed(joined.mapInArrow(run, "at long, part binary"), 2 * TABLE)


def spelling_counts(words: DataFrame) -> np.ndarray:
    """Zeros and ones of all words that the training texts hold once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * ORDERS * SLOTS, np.int64)
        for batch in batches:
            for slots, _, value in spelled_bits(batch.column(0))[1]:
                for k, s in enumerate(slots):
                    _add(counts[2 * k * SLOTS : 2 * (k + 1) * SLOTS], s - k * SLOTS, value)
        yield from _blocks(counts)

    return _summed(words.where("c = 1").select("word").mapInArrow(run, "at long, part binary"), 2 * ORDERS * SLOTS)


# ------------------------------------------------------------------ mixing


def logits(counts: np.ndarray) -> np.ndarray:
    """What each slot says: the logarithm of ones against zeros. Slots without counts say nothing."""
    pairs = counts.reshape(-1, 2)
    return np.log((pairs[:, 1] + 0.4) / (pairs[:, 0] + 0.4)).astype(np.float32)


def logits_without(counts: np.ndarray) -> np.ndarray:
    """What each slot says about a bit that has been counted, without it: for a zero, then for a one."""
    zeros, ones = counts.reshape(-1, 2).T
    of_zero = np.log((ones + 0.4) / (np.maximum(zeros - 1, 0) + 0.4))
    return np.stack([of_zero, np.log((np.maximum(ones - 1, 0) + 0.4) / (zeros + 0.4))], 1).astype(np.float32).ravel()


def _straight(gates: int) -> np.ndarray:
    """The table that leaves mixed chances as they are."""
    return np.tile(1 / (1 + np.exp(-np.linspace(-TOP, TOP, STEPS, dtype=np.float32))), (gates, 1))


class Mixer:
    """Gated weights, and the table that refines their result."""

    def __init__(self, gates: int):
        self.weights = np.tile(np.array(FIRST, np.float32), (gates, 1))
        self.refined = _straight(gates)

    def lesson(self, columns: list[np.ndarray], gate: int, value: np.ndarray) -> np.ndarray:
        """What a gate's bits teach, as sums in which their order does not matter: slope and curvature of the
        cost by the weights, and for each cell how many mixed chances fell there and how many of them came true."""
        x = np.empty((INPUTS, len(value)), np.float32)
        for row, column in zip(x, columns):
            row[:] = column
        return self.lesson_of(x, gate, value)

    def lesson_of(self, x: np.ndarray, gate: int, value: np.ndarray) -> np.ndarray:
        """``lesson`` of columns that are rows of one array, with a last one for the constant."""
        x[-1] = CONSTANT
        mixed = self.weights[gate] @ x
        p = chance(mixed)
        cell = np.bincount(_valued(_cell(mixed), value), minlength=2 * STEPS).reshape(STEPS, 2)
        curve = (x * (p * (1 - p))) @ x.T
        return np.concatenate([x @ (value - p), curve.ravel(), cell.sum(1), cell[:, 1]])

    def learn(self, lesson: np.ndarray) -> float:
        """One Newton step from the sums over all bits; the greatest change of a weight."""
        slope, curve, many, ones = np.split(lesson, np.cumsum([INPUTS, INPUTS**2, STEPS]), 1)
        self.refined = ((ones + 20 * _straight(len(ones))) / (many + 20)).astype(np.float32)
        held = curve.reshape(-1, INPUTS, INPUTS) + RIDGE * np.eye(INPUTS)
        change = np.clip(np.linalg.solve(held, slope[:, :, None])[:, :, 0], -1, 1)
        self.weights = (self.weights + change).astype(np.float32)
        return float(np.abs(change).max())

    def bits(self, mixed: np.ndarray, gate: np.ndarray, value: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """Cost of each bit, from the mean of the mixed and the refined chance."""
        p = chance(mixed) if p is None else p
        p = (p + self.refined.ravel()[gate * STEPS + _cell(mixed)]) / 2
        # what came true had the chance p or 1 - p; a choice by masks takes ten times as long
        return -np.log2(np.clip(np.abs(~value - p), 1e-6, 1 - 1e-6))


def chance(logit: np.ndarray) -> np.ndarray:
    out = np.clip(logit, -30, 30)
    np.exp(np.negative(out, out=out), out=out)
    out += 1
    return np.divide(1, out, out=out)


def _cell(mixed: np.ndarray) -> np.ndarray:
    out = np.clip(mixed, -TOP, TOP)
    out += TOP + TOP / (STEPS - 1)
    out *= (STEPS - 1) / (2 * TOP)
    return out.astype(np.int64)


def _inputs(*columns: np.ndarray) -> np.ndarray:
    """Logits of the predictors and a constant, one row for each bit."""
    return np.stack([*columns, np.full(len(columns[0]), CONSTANT)], 1)


@dataclass
class Model:
    code: Code
    table: np.ndarray
    spelling: np.ndarray
    mixer: Mixer
    speller: Mixer

    def spelled(self, words: pa.Array) -> np.ndarray:
        """Bits of each word letter by letter."""
        out = np.zeros(len(words))
        for at in range(0, len(words), 50_000):
            part = words.slice(at, 50_000)
            owner, steps = spelled_bits(part)
            for slots, step, value in steps:
                gate = np.full(len(owner), step)
                mixed = (_inputs(*[self.spelling[s] for s in slots]) * self.speller.weights[gate]).sum(1)
                out[at : at + len(part)] += np.bincount(owner, self.speller.bits(mixed, gate, value), len(part))
        return out

    def text_bits(self, tokens: Tokens) -> np.ndarray:
        """Bits of each text's symbols and repetitions. Texts of like length take their blocks in step, and each changes
        its own weights after each of its blocks. They are as few as a processor's cache can hold the bits of."""
        cost = np.zeros(len(tokens.sizes))
        order = np.argsort(-tokens.sizes, kind="stable")
        rank = np.zeros(len(order), np.int32)
        rank[order] = np.arange(len(order)) % TEXTS
        rank = rank.take(tokens.doc)
        for at in range(0, len(order), TEXTS):
            texts = order[at : at + TEXTS]
            cost[texts] = self._bits_in_step(tokens, texts, rank)
        return cost

    def _bits_in_step(self, tokens: Tokens, texts: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """``text_bits`` of some texts, long ones first, so that those which still have blocks are the first ones.
        ``rank`` is the place among them of each token's text."""
        sizes, first = tokens.sizes[texts], tokens.first[texts]
        blocks = -(-sizes // BLOCK)
        own = np.repeat(np.arange(len(texts)), blocks)
        step = np.arange(len(own)) - (np.cumsum(blocks) - blocks)[own]
        turn = np.argsort(step, kind="stable")
        own, step = own[turn], step[turn]
        begin, size = first[own] + BLOCK * step, np.minimum(BLOCK, sizes[own] - BLOCK * step)
        ends = np.append(np.flatnonzero(step[1:] != step[:-1]) + 1, len(step))  # of the steps, in blocks
        cost = np.zeros(len(texts))
        weights = [np.repeat(column, len(texts)) for column in self.mixer.weights.T]
        at = 0
        while at < len(ends):
            # as many whole steps as make up a full one
            low = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, low + TEXTS, "right")))
            of = slice(low, ends[upto - 1])
            many = size[of]
            chosen = np.repeat(begin[of] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            gates, owners, places, values = zip(*tokens.gated_bits(self.code, chosen))
            gate, value = np.repeat(np.array(gates, np.int32), [len(v) for v in values]), np.concatenate(values)
            inputs = [self.table[base:].take(np.concatenate(p), mode="clip") for base, p in zip(TABLES, zip(*places))]
            owner = np.concatenate(owners)
            where = rank.take(owner) + np.int32(len(texts)) * gate
            bounds = np.array([0, len(where)])
            if upto - at > 1:  # bits of one step together
                turn = np.argsort((tokens.place[owner] // BLOCK - step[low]).astype(np.uint16), kind="stable")
                bounds = np.searchsorted((tokens.place[owner] // BLOCK)[turn], step[low] + np.arange(upto - at + 1))
                inputs, gate, value, where = [column[turn] for column in inputs], gate[turn], value[turn], where[turn]
            for b, e in zip(bounds[:-1], bounds[1:]):
                if b == e:
                    continue
                x, g, v, w = [column[b:e] for column in inputs], gate[b:e], value[b:e], where[b:e]
                # bits of one text and gate stand together
                start = np.append(0, np.flatnonzero(w[1:] != w[:-1]) + 1)
                kind, length = w[start], np.diff(np.append(start, len(w)))
                mixed = np.repeat(weights[-1][kind] * CONSTANT, length)
                for own_weights, column in zip(weights, x):
                    mixed += np.repeat(own_weights[kind], length) * column
                p = chance(mixed)
                bits = np.add.reduceat(self.mixer.bits(mixed, g, v, p), start, dtype=float)
                cost += np.bincount(kind % len(texts), bits, len(texts))
                error = (v - p) * np.float32(RATE)
                for own_weights, column in zip(weights, x):
                    own_weights[kind] += np.add.reduceat(error * column, start, dtype=float)
                weights[-1][kind] += np.add.reduceat(error * CONSTANT, start, dtype=float)
            at = upto
        return cost

    def score(self, tokens: Tokens, counts: np.ndarray, symbols: np.ndarray, unknown: pa.Array) -> dict[str, np.ndarray]:
        """Of texts whose distinct words have ``counts`` and ``symbols``; ``unknown`` are those without a count."""
        return self.scores(tokens, counts, self.extra_bits(counts, symbols, unknown))

    def extra_bits(self, counts: np.ndarray, symbols: np.ndarray, unknown: pa.Array) -> np.ndarray:
        """What each distinct word costs beyond its symbol."""
        extra = self.code.shared_bits(symbols, counts)
        extra[counts == 0] = self.spelled(unknown)
        return extra

    def scores(self, tokens: Tokens, counts: np.ndarray, extra: np.ndarray) -> dict[str, np.ndarray]:
        code, n = self.code, len(tokens.sizes)
        bits = self.text_bits(tokens)
        bits += np.bincount(tokens.doc, np.where(tokens.hit, 0, np.append(extra, 0)[tokens.word]), n)
        every = np.append(counts, code.ends)
        return {
            "n_tokens": tokens.sizes,
            "n_known": np.bincount(tokens.doc, every[tokens.word] > 0, n).astype(np.int64),
            "base_score": np.bincount(tokens.doc, code.base(every)[tokens.word], n),
            "score": -bits * np.log10(2),
            "bits": bits,
        }


def _added(lessons: DataFrame, gates: int) -> np.ndarray:
    """The sum of all tasks' lessons; a few hundred numbers come to the driver."""
    out = np.zeros(gates * LESSON)
    for at, total in lessons.groupBy("at").agg(F.sum("part")).collect():
        out[at] = total
    return out.reshape(gates, LESSON)


def _lesson_rows(lesson: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(lesson)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lesson.ravel()[at])], names=["at", "part"])


def text_lessons(joined: DataFrame, code: Code, table, mixer: Mixer) -> np.ndarray:
    """What every bit of all training texts teaches; ``table`` has the broadcast logits without a bit's own count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lesson = np.zeros((GATES, LESSON))
        tables = [table.value[2 * base :] for base in TABLES]
        for tokens, chosen in _train_tokens(code, batches):
            for at in range(0, len(chosen), 1 << 13):
                for gate, _, places, value in tokens.gated_bits(code, chosen[at : at + (1 << 13)]):
                    x = np.empty((INPUTS, len(value)), np.float32)
                    for said, place, row in zip(tables, places, x):
                        said.take(_valued(place, value), out=row, mode="clip")
                    lesson[gate] += mixer.lesson_of(x, gate, value)
        yield from _lesson_rows(lesson)

    return _added(joined.mapInArrow(run, "at long, part double"), GATES)


def spelling_lessons(words: DataFrame, table, mixer: Mixer) -> np.ndarray:
    """What every byte of all words that the training texts hold once teaches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lesson = np.zeros((8, LESSON))
        for batch in batches:
            for slots, step, value in spelled_bits(batch.column(0))[1]:
                lesson[step] += mixer.lesson([table.value[2 * s + value] for s in slots], step, value)
        yield from _lesson_rows(lesson)

    return _added(words.where("c = 1").select("word").mapInArrow(run, "at long, part double"), 8)


def train(docs: DataFrame, words: DataFrame, joined: DataFrame, code: Code, rounds: int = ROUNDS) -> Model:
    """Learned from all training texts; at most ``rounds`` passes over their bits, fewer when weights no longer change."""
    table_counts, spelling = bit_counts(joined, code), spelling_counts(words)
    mixer, speller = Mixer(GATES), Mixer(8)
    context = docs.sparkSession.sparkContext
    for learner, counts, lessons in (
        (mixer, table_counts, lambda table: text_lessons(joined, code, table, mixer)),
        (speller, spelling, lambda table: spelling_lessons(words, table, speller)),
    ):
        table = context.broadcast(logits_without(counts))
        for _ in range(rounds):
            if learner.learn(lessons(table)) < 1e-3:
                break
        table.destroy()
    return Model(code, logits(table_counts), logits(spelling), mixer, speller)


def score_texts(docs: DataFrame, chunk_bytes: int = SLICE) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` of every
    row; ``docs`` has ``doc_id, held_out, text``, and the texts that are not held out are learned from."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = _stored(chunks(docs, chunk_bytes), "score-chunks")
    counted = _stored(counted_words(parts), "score-words")
    ends = parts.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    code = make_code(vocabulary(counted), int(ends))
    joined = _stored(with_counts(parts, counted, code), "score-counted")
    model = train(docs, vocabulary(counted), joined, code)
    shared = spark.sparkContext.broadcast(model)  # fixed in size but for the words of its 1024 symbols

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, held = batch.column("doc_ids")[row].values, batch.column("held")[row].values
                sizes, extra = np.maximum(unpack(batch.column("bytes")[row].as_py()), 1), None
                for tokens, texts, counts, symbols in _tokens(model.code, batch, row):
                    if extra is None:  # of all the chunk's words
                        extra = model.extra_bits(counts, symbols, unpack_words(batch.column("unknown")[row].as_py()))
                    found, size = model.scores(tokens, counts, extra), sizes[texts]
                    columns = {
                        "doc_id": doc_ids[texts], "held_out": held[texts],
                        "n_tokens": found["n_tokens"], "n_known": found["n_known"],
                        "train_tokens": np.full(len(size), model.code.tokens), "base_score": found["base_score"],
                        "score": found["score"], "bits_per_byte": found["bits"] / size,
                    }
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))

    return joined.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )


def held_out(docs: DataFrame) -> DataFrame:
    """A tenth of the ids, by their digest."""
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", (digest % 10 == 0).alias("held_out"), "text")


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(held_out(table(spark, sf_dir, "documents")))
