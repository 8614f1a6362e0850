"""Context mixing: counts and base scores against brute force, one text bit by bit, odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellward.llm import scoring as sc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = None


def tokens_of(text):
    return [*WORD.findall((text or "").encode().lower()), END]


def brute_base(rows):
    """``{row: (held_out, n_tokens, n_known, train_tokens, base_score)}`` of (doc_id, text)."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(ts := tokens_of(text)), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        for (i, text), h in zip(rows, held)
    ]


def matches(got, rows):
    key = lambda r: (r[0] is None, r[0], r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(brute_base(rows), key=key)
    return [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)


@pytest.fixture(scope="module")
def docs(spark):
    return sc.held_out(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).repartition(3).cache()


@pytest.fixture(scope="module")
def made(docs):
    """The corpus counts and the model of a small table."""
    parts = sc.chunks(docs, 1 << 16).cache()
    counted = sc.counted_words(parts).cache()
    words = sc.vocabulary(counted)
    code = sc.make_code(words, docs.where("NOT held_out").count())
    return dict(map(tuple, words.collect())), sc.train(docs, words, sc.with_counts(parts, counted, code), code, 50)


def plain_bits(model, counts, words):
    """The model's bits of one text, one bit after the other."""
    code = model.code
    names = {w: k for k, w in enumerate(code.frequent.to_pylist())}
    h32 = lambda *parts: int(sc._hash(*[np.array([p]) for p in parts])[0])

    def symbol(w):
        if w is END:
            return code.end
        return names.get(w, code.rare + 64 * (zlib.crc32(w.encode()[:2]) % sc.CLASSES) + counts.get(w, 0).bit_length())

    def slot(context, node, k):
        mixed = ((context ^ (node * 0x85EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35) & 0xFFFFFFFF
        return k * sc.SLOTS + (mixed >> (32 - sc.SLOT_BITS))

    def cost(mixer, weights, x, gate, bit):
        mixed = sum(w * v for w, v in zip(weights, x))
        p = 1 / (1 + math.exp(-mixed))
        refined = mixer.refined[gate][math.floor((min(max(mixed, -sc.TOP), sc.TOP) + sc.TOP) * (sc.STEPS - 1) / (2 * sc.TOP) + 0.5)]
        p = (p + refined) / 2
        return -math.log2(p if bit else 1 - p), bit - 1 / (1 + math.exp(-mixed))

    def spelled(w):
        total, data = 0.0, w.encode() + b" "
        for i, byte in enumerate(data):
            past = [data[i - k] + 1 if i >= k else 0 for k in range(1, 6)]
            told = 1 + zlib.crc32(data[:-1][:2]) % sc.CLASSES if i < 2 else 0
            contexts = [h32(*past[:k], 8 * told + k) for k in (1, 2, 3, 5)]
            node = 1
            for step in range(8):
                bit = byte >> (7 - step) & 1
                x = [*(model.spelling[slot(c, node, k)] for k, c in enumerate(contexts)), 0.3]
                total += cost(model.speller, model.speller.weights[step], x, step, bit)[0]
                node = 2 * node + bit
        return total

    weights = model.mixer.weights.astype(float).tolist()
    total, followed, run = 0.0, {}, 0
    symbols = [symbol(w) for w in words]
    change = None
    for i, w in enumerate(words):
        if i % sc.BLOCK == 0:
            if change is not None:
                weights = (np.array(weights) + sc.RATE * change).tolist()
            change = np.zeros((sc.GATES, sc.INPUTS))
        past = [symbols[i - k] if i >= k else code.start for k in (1, 2)]
        often = [s for s in reversed(symbols[:i]) if s < code.rare][:2] + [code.start] * 2
        contexts = [h32(past[0]), h32(*past), h32(often[0], often[1] + 70_000)]
        bits, hit = [], False
        key = tuple(words[i - 2 : i])
        if i >= 2:
            if key in followed:
                hit = followed[key] == w
                bits.append((sc.NODES - sc.REPEATS + min(run, 15), 6 + (run > 0), hit))
            followed[key] = w
        if not hit:
            s = symbols[i]
            bits += [(int(code.nodes[p]), min(d, 5), bool(code.bits[p])) for d, p in enumerate(range(code.first[s], code.first[s] + code.lengths[s]))]
            if code.rare <= s < code.end:
                total += math.log2(code.mass[s - code.rare] / counts[w]) if w in counts else spelled(w)
        run = run + 1 if hit else 0
        for node, gate, bit in bits:
            x = [model.table[node], *(model.table[sc.NODES + slot(c, node, k)] for k, c in enumerate(contexts)), 0.3]
            bits_, error = cost(model.mixer, weights[gate], x, gate, bit)
            total += bits_
            change[gate] += error * np.array(x)
    return total


def scored(model, counts, texts):
    """Bits of texts that stand in one chunk."""
    flat = [t for words in texts for t in words if t is not END]
    codes, distinct = sc.number(pa.array(flat, pa.string()))
    c = np.array([counts.get(w, 0) for w in distinct.to_pylist()], np.int64)
    symbols = model.code.symbols(distinct, c)
    tokens = sc.Tokens(model.code, codes.astype(int), np.array([len(t) - 1 for t in texts]), symbols)
    return model.score(tokens, c, symbols, distinct.filter(pa.array(c == 0)))["bits"]


def test_one_text_bit_by_bit(made, docs):
    counts, model = made
    rows = [r["text"] for r in docs.orderBy("doc_id").limit(12).collect()]
    texts = [[t and t.decode() for t in tokens_of(x)] for x in [*rows, "", "the the the the the the the of the the", "zq zq zq qqz zq zq zq qqz zq"]]
    texts = [t for t in texts if len(t) < 700]
    want = [plain_bits(model, counts, t) for t in texts]
    assert np.allclose(scored(model, counts, texts), want, rtol=1e-4)


def test_company_does_not_matter(made):
    """Many texts of a chunk learn in step, each from its own whole blocks alone."""
    counts, model = made
    draw, words = np.random.default_rng(3), list(counts)[:200]
    texts = [[*(words[k] for k in draw.integers(0, 200, 49)), END] for _ in range(1400)]
    together = scored(model, counts, texts)
    assert np.allclose(together, np.concatenate([scored(model, counts, texts[at : at + 100]) for at in range(0, 1400, 100)]), rtol=1e-9)


def test_bits_gate_by_gate(made):
    counts, model = made
    words = ["the", "of", "the", "of", "the", "zq", "of", "the", *list(counts)[:300], "", "the", "of", "the", "of"]
    codes, distinct = sc.number(pa.array(words, pa.string()))
    symbols = model.code.symbols(distinct, np.array([counts.get(w, 0) for w in distinct.to_pylist()], np.int64))
    tokens = sc.Tokens(model.code, codes.astype(int), np.array([100, 0, 200, len(words) - 300]), symbols)
    chosen = np.arange(3, len(tokens.doc))
    many, places, gate, value = tokens.bits(model.code, chosen)
    owner = np.repeat(chosen, many)
    for g, some, at, v in tokens.gated_bits(model.code, chosen):
        same = gate == g
        assert some.tolist() == owner[same].tolist() and v.tolist() == value[same].tolist()
        assert all(a.tolist() == b[same].tolist() for a, b in zip(at, places))


def test_chances_sum_to_one(made):
    counts, model = made
    code, some = model.code, list(counts)[:7]

    def symbol_chance(w):
        """Of the symbol of a token after some others."""
        words = [x for x in [*some, w] if x is not END]
        codes, distinct = sc.number(pa.array(words, pa.string()))
        c = np.array([counts.get(x, 0) for x in distinct.to_pylist()], np.int64)
        tokens = sc.Tokens(code, codes.astype(int), np.array([len(words)]), code.symbols(distinct, c))
        _, places, gate, value = tokens.bits(code, np.array([len(some)]))
        x = sc._inputs(*[model.table[base:][p] for base, p in zip(sc.TABLES, places)])
        return 2 ** -model.mixer.bits((x * model.mixer.weights[gate]).sum(1), gate, value).sum()

    # one token of every symbol: the frequent words, one of each shared symbol, the end, unknown words
    frequent = code.frequent.to_pylist()
    rest = sorted(counts.keys() - set(frequent))
    symbols = code.symbols(pa.array(rest), np.array([counts[w] for w in rest]))
    shared = dict(zip(symbols.tolist(), rest))
    assert sorted(shared) == (code.rare + np.flatnonzero(code.mass)).tolist()
    unknown = [f"{chr(a)}{chr(b)}\x7f" for a in range(97, 123) for b in range(97, 123)]
    unknown = dict(zip(sc.classes(pa.array(unknown)).tolist(), unknown))
    assert len(unknown) == sc.CLASSES
    assert abs(sum(map(symbol_chance, [*frequent, *shared.values(), END, *unknown.values()])) - 1) < 1e-6
    # the words of a shared symbol
    for s in shared:
        each = code.shared_bits(symbols[symbols == s], np.array([counts[w] for w, t in zip(rest, symbols) if t == s]))
        assert abs((2.0**-each).sum() - 1) < 1e-9
    # and all bytes after the beginning of a word
    text = [*range(1, 32), *range(33, 128)]
    begin = pa.array([f"ab{chr(i)}" for i in text])
    owner, steps = sc.spelled_bits(begin)
    bits = np.zeros(len(owner))
    for slots, step, value in steps:
        gate = np.full(len(owner), step)
        bits += model.speller.bits((sc._inputs(*[model.spelling[s] for s in slots]) * model.speller.weights[gate]).sum(1), gate, value)
    at = np.arange(len(text)) * 4 + 2
    assert (2.0 ** -bits[at]).sum() <= 1 + 1e-6 and (2.0 ** -bits[at]).sum() > 0.9


def test_query(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in source.collect()]
    got = sc.op13_context_mixing(spark, "/root/testdata/sf0.01").collect()
    assert matches(got, rows)
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    # better than single words, on texts that were not learned from, although those give unknown words
    # a chance that does not sum to 1
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_chunks_do_not_matter(docs):
    small, large = ({r["doc_id"]: r for r in sc.score_texts(d, n).collect()} for d, n in ((docs, 1 << 14), (docs.repartition(2), 1 << 22)))
    assert small.keys() == large.keys()
    assert all(np.isclose(small[i]["score"], large[i]["score"], rtol=1e-4) for i in small)


def test_repetition_is_cheap(made):
    counts, model = made
    draw = np.random.default_rng(3)
    words = [w for w in counts if len(w) > 4]
    line = [words[i] for i in draw.integers(0, len(words), 20)]
    other = [words[i] for i in draw.integers(0, len(words), 400)]
    again, fresh = scored(model, counts, [[*line * 20, END], [*other, END]])
    assert again < 0.25 * fresh


def test_odd_rows(odd, none, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for docs in (odd, clashing):
        got = sc.score_texts(sc.held_out(docs)).collect()
        assert matches(got, rows)
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert sc.score_texts(sc.held_out(none)).count() == 0
    # nothing to learn from
    only = odd.where(F.col("doc_id").isNull())
    assert matches(sc.score_texts(sc.held_out(only)).collect(), [r for r in rows if r[0] is None])


def test_packing():
    for numbers in ([], [0], [5, 70_000, 3], [1 << 40, 2, 255], list(range(300))):
        assert sc.unpack(sc.pack(np.array(numbers, np.int64))).tolist() == numbers
    for words in ([], ["a"], ["é", "", "日本"], ["x" * 3000, "y"]):
        assert sc.unpack_words(sc.pack_words(pa.array(words, pa.string()))).to_pylist() == words
        assert sc.unpack_words(sc.pack_words(pa.array(["skip", *words], pa.string()).slice(1))).to_pylist() == words
    some = pa.array(["a", "é", "ab", "abc", "日本"])
    assert sc.classes(some).tolist() == [zlib.crc32(w.encode()[:2]) % sc.CLASSES for w in some.to_pylist()]


def test_all_training_texts_teach(spark):
    """Also those of any length, and each of their bits once, however they are cut."""
    draw = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in draw.zipf(1.4, 20_000) % 3000)
    rows = [(i, long[: 70_000 + i] if i < 3 else f"a b a b c w{i} w{i % 7} a b a") for i in range(620)]
    docs = sc.held_out(spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 10], "doc_id long, text string"))

    def taught(docs, size):
        parts = sc.chunks(docs, size).cache()
        counted = sc.counted_words(parts).cache()
        words = sc.vocabulary(counted)
        code = sc.make_code(words, docs.count())
        joined = sc.with_counts(parts, counted, code).cache()
        counts = sc.bit_counts(joined, code)
        table = spark.sparkContext.broadcast(sc.logits_without(counts))
        return sc.train(docs, words, joined, code), counts, sc.text_lessons(joined, code, table, sc.Mixer(sc.GATES))

    model, counts, lesson = taught(docs.repartition(3), 1 << 14)
    # every bit that the table of places counts is in one cell
    many, ones = np.split(lesson[:, -2 * sc.STEPS :], 2, 1)
    assert many.sum() == counts[: 2 * sc.NODES].sum() and ones.sum() == counts[1 : 2 * sc.NODES : 2].sum()
    other = taught(docs.repartition(2), 1 << 22)
    assert np.allclose(model.mixer.weights, other[0].mixer.weights, atol=1e-4) and np.allclose(lesson, other[2], rtol=1e-3, atol=0.1)
    # long texts alone teach, too
    alone = taught(docs.where("doc_id < 3").repartition(2), 1 << 16)[0]
    assert not np.allclose(alone.mixer.weights, sc.Mixer(sc.GATES).weights, atol=1e-3)


def test_large_chunks_go_group_by_group(spark, made, docs, monkeypatch):
    """Six MB of text are one chunk, whose words have one row each; its texts are learned and scored in groups, each as
    with all others at once."""
    texts = [" ".join(f"w{(i * k) % 5000}" for i in range(1, 200_000)) for k in range(1, 6)]
    large = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    parts = sc.chunks(sc.held_out(large)).cache()
    assert parts.count() == 1 and sc.counted_words(parts).count() == 5000

    counts, model = made
    parts = sc.chunks(docs.coalesce(1)).cache()
    joined = sc.with_counts(parts, sc.counted_words(parts), model.code).toArrow().combine_chunks().to_batches()[0]

    def seen():
        groups = [*sc._tokens(model.code, joined, 0)]
        extra = model.extra_bits(groups[0][2], groups[0][3], sc.unpack_words(joined.column("unknown")[0].as_py()))
        found = [model.scores(tokens, c, extra) for tokens, _, c, _ in groups]
        trained = [(t.doc.max() + 1, t.contexts[2][chosen].tolist()) for t, chosen in sc._train_tokens(model.code, [joined.slice(0, 1)])]
        return found, sum(n for n, _ in trained), [x for _, some in trained for x in some]

    (whole,), n, contexts = seen()
    monkeypatch.setattr(sc, "GROUP", 300)
    found, many, others = seen()
    assert len(found) > 5 and many == n and contexts == others
    for name, values in whole.items():
        assert np.allclose(np.concatenate([f[name] for f in found]), values, rtol=1e-9)


def test_groups_of_texts():
    for sizes, most, want in (([], 5, [0]), ([0], 5, [1]), ([3, 2, 1, 9, 0, 4], 5, [2, 1, 1, 2]), ([7, 0, 0], 5, [1, 2])):
        got = [*sc._groups(np.array(sizes, np.int64), most)]
        assert [t.stop - t.start for t, _ in got] == want
        assert [w.stop - w.start for _, w in got] == [sum(sizes[t]) for t, _ in got] and got[-1][1].stop == sum(sizes)
