"""Operators on documents against brute force, and on odd tables."""

import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cellward.llm import imatch, language, mixing, packing, pii, simhash, tokens

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ------------------------------------------------------------------ language ID


def test_language_held_out(spark):
    rows = language.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_fast_and_trained_filters_agree():
    draw = np.random.default_rng(0)
    net = language.fit(draw.integers(0, 64, (40, language.WINDOW)).astype(np.uint8), np.arange(40) % 2, ["a", "b"], epochs=1)
    windows = draw.integers(0, 64, (30, language.WINDOW)).astype(np.uint8)
    assert np.allclose(net.features(windows), net.pooled(windows)[0], atol=1e-4)


def test_language_whole_text_counts():
    """A text is judged by all of its windows: a foreign half moves the score."""
    windows = np.concatenate([language.windows_of(w * 100)[0][:1] for w in ("abc ", "xyz ") for _ in range(30)])
    net = language.fit(windows, np.repeat([0, 1], 30), ["a", "x"], epochs=8)
    pure, half = language.predict_batch(net, ["abc " * 5000, "abc " * 3000 + "xyz " * 2000])[1]
    assert pure > 0.9 and 0.45 < half < 0.75 and pure - half > 0.2


def test_language_more_labels_than_the_bound(spark):
    """The labels with most documents are learned, of equal ones the first by name."""
    rows = [(i, f"text number {i} of many words", f"l{min(i % 9, 5)}") for i in range(360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    sizes = Counter(r[2] for r in learned)
    want = sorted(sorted(sizes, key=lambda x: (-sizes[x], x))[:3])
    assert language.train(docs, languages=3).languages == want and "l5" in want


def test_language_odd(odd, none, clashing):
    for docs in (odd, clashing):
        found = language.identify(docs, language.train(docs))
        assert found.count() == odd.count()
        unknown = {r["doc_id"] for r in found.where("lang_pred = 'und'").collect()}
        assert unknown == {3, 4, 6, 7, None}
        assert found.where("lang_pred = 'und' AND score <> 0").count() == 0
    assert language.train(none) is None
    assert language.identify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language.identify(none, None).count() == 0


# ------------------------------------------------------------------ token counts


def plain_count(pieces, byte_score, word):
    """Best segmentation by trying every cut, without sharing."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * byte_score, best[end - 1][1] + size)]
        for begin in range(end):
            if word[begin:end] in pieces:
                options.append((best[begin][0] + pieces[word[begin:end]], best[begin][1] + 1))
        top = max(o[0] for o in options)
        best.append((top, min(o[1] for o in options if o[0] == top)))
    return best[-1][1]


def test_token_counts(spark, texts):
    pieces = tokens.load_pieces(tokens.default_pieces())
    trie = tokens.Trie(pieces)
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokens.op2_token_counts(spark, DATA).collect()}
    assert set(got) == set(texts)
    memo = {}
    for doc in sorted(texts)[:40]:
        words = texts[doc].split()
        for w in words:
            if w not in memo:
                memo[w] = plain_count(pieces, trie.byte_score, tokens.MARK + w)
        assert got[doc] == (len(words), sum(memo[w] for w in words))


def test_token_counts_odd(odd, none, clashing):
    path = tokens.default_pieces()
    rows = tokens.count_tokens(odd, path).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, tokens.count_tokens(clashing, path).collect()))
    assert len(rows) == odd.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 6)} == {0}
    assert tokens.count_tokens(none, path).count() == 0


# ------------------------------------------------------------------ I-Match


def test_imatch_edits(spark, texts):
    import hashlib

    rows = {r["doc_id"]: r for r in imatch.op4_imatch_fingerprints(spark, DATA).collect()}
    ids = sorted(texts)
    assert set(rows) == set(ids)
    prints = {}
    for at, doc in enumerate(ids):
        text, following = texts[doc], texts[ids[(at + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        row = rows[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        # likeness is that of the parts shown
        a, b = row["fingerprint"].split("."), row["edited_fingerprint"].split(".")
        some = [(x, y) for x, y in zip(a, b) if x != "-" or y != "-"]
        assert row["near_edited"] == pytest.approx(sum(x == y for x, y in some) / len(some))
    near = [r["near_edited"] for r in rows.values()]
    assert np.mean(near) > 10 * np.mean([r["near_next"] for r in rows.values()])


def brute_terms(text):
    words = {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower(), flags=re.ASCII) if w}
    return {(h := xxhash.xxh64_intdigest(w, 42)) - (h >> 63 << 64) for w in words}


def test_imatch_lexicon_band(spark):
    """Terms within the band, by a count in Python; terms which share low bits of their hash stay apart."""
    rows = [(i, "common " + ("half " if i % 2 else "") + f"rare{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["term"] for r in imatch.lexicon(docs, 0.3, 0.7).collect()} == brute_terms("half")
    assert {r["term"] for r in imatch.lexicon(docs, 0, 0.7).collect()} == brute_terms(" ".join(r[1] for r in rows)) - brute_terms("common")
    bucket = spark.createDataFrame([(8, [8]), (16, [16]), (5, [5])], "term long, codes array<long>")
    held = spark.range(1).select(imatch.hash_table(bucket).alias("h")).first()["h"]
    assert [[(e["t"], e["c"]) for e in own] for own in held] == [[(8, [8]), (16, [16])], [(5, [5])], [], []]


def test_imatch_parts(spark, docs, texts):
    """Each part of the query is empty, or equal to another document's, just where the terms of its subset are."""
    seen = Counter(t for text in texts.values() for t in brute_terms(text or ""))
    low, high = imatch.LOW * len(texts), imatch.HIGH * len(texts)
    codes = {r["term"]: r["codes"] for r in imatch.lexicon(docs).collect()}
    assert set(codes) == {t for t, n in seen.items() if low <= n <= high}
    shares = Counter(c >> 56 for own in codes.values() for c in own)
    assert shares[0] == len(codes) and all(0.5 < shares[n] * s / len(codes) < 2 for n, s in enumerate(imatch.SHARES, 1) if s < 256)
    held = {(c >> 56, t) for t, own in codes.items() for c in own}
    rows = imatch.op4_imatch_fingerprints(spark, DATA).collect()
    for n in range(len(imatch.SHARES) + 1):
        part_of, set_of = {}, {}
        for r in rows:
            terms = brute_terms(texts[r["doc_id"]] or "")
            own = frozenset(t for t in terms if (n, t) in held)
            if not own and n == 0:
                own = frozenset(terms)
            part = r["fingerprint"].split(".")[n]
            assert (part == "-") == (not own and n > 0)
            assert part_of.setdefault(own, part) == part and set_of.setdefault(part, own) == own


def test_imatch_odd(odd, none, clashing):
    for docs in (odd, clashing):
        rows = imatch.imatch(docs).collect()
        assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert imatch.imatch(none).count() == 0
    one = imatch.imatch(odd.where("doc_id = 9")).first()
    assert one["next_id"] == 9


def test_next_ids(spark):
    draw = np.random.default_rng(2)
    ids = np.unique(draw.integers(-(10**12), 10**12, 3000))
    df = spark.createDataFrame([(int(i), 1) for i in ids], "doc_id long, n_chars int").repartition(5)
    got = {r["doc_id"]: r["next_id"] for r in imatch.next_ids(df, 16).collect()}
    assert got == dict(zip(ids.tolist(), np.roll(ids, -1).tolist()))


# ------------------------------------------------------------------ SimHash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(nodes, linked):
    """``linked``: pairs; the smallest reachable node of each."""
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_simhash(spark, texts):
    prints = {d: brute_print(t) for d, t in texts.items()}
    ids = sorted(prints)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = brute_components(ids, linked)
    got = simhash.op7_simhash_near_dedup(spark, DATA).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in ids}


@pytest.mark.parametrize("bucket", [1, 64])
def test_simhash_links(spark, bucket):
    """Clusters around a few centres, in small buckets (pairs) and in large ones (points)."""
    draw = np.random.default_rng(4)
    values = set()
    for centre in draw.integers(-(2**63), 2**63, 12).tolist():
        for _ in range(25):
            flips = draw.integers(0, 64, draw.integers(0, 5)).tolist()
            value = centre & (2**64 - 1)
            for f in flips:
                value ^= 1 << f
            values.add(value - 2**64 if value >= 2**63 else value)
    rows = [(v, n) for n, v in enumerate(sorted(values))]
    df = spark.createDataFrame(rows, "fp long, rep long")
    near = [(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2]
    want = brute_components(range(len(rows)), near)
    edges = [(r["a"], r["b"]) for r in simhash.links(df, bucket).collect()]
    assert brute_components(range(len(rows)), edges) == want


def test_chain_condition_keeps_all_near():
    draw = np.random.default_rng(5)
    bits = np.zeros(4000, np.uint64)
    for i in range(len(bits)):
        for f in draw.choice(64, draw.integers(0, 25), replace=False).tolist():
            bits[i] |= np.uint64(1 << f)
    assert simhash.chains(bits, 24)[np.bitwise_count(bits) <= 24].all()
    far = np.array([2**64 - 1], np.uint64)
    assert not simhash.chains(far, 24).any()


def five(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicate_groups(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: five(r["text"]) for r in docs.collect()}
    held = {}
    for d, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(d)
    met = {(a, b) for own in held.values() for i, a in enumerate(sorted(own)) for b in sorted(own)[i + 1 :]}
    linked = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = brute_components(sets, linked)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs, block=block).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_near_duplicates_meet_on_eight_keys(spark):
    """A copy with a passage appended whose shingles take the six smallest hashes of the two."""
    draw = np.random.default_rng(8)
    base = " ".join(f"w{x}" for x in draw.integers(0, 10**6, 200))
    own = simhash.hashes(base, 5)
    tail = []
    while len(tail) < 6:
        words = " ".join(f"t{x}" for x in draw.integers(0, 10**6, 5))
        if simhash.hashes(words, 5)[0] < own.min():
            tail.append(words)
    longer = f"{base} {' '.join(tail)}"
    low = [set(np.unique(simhash.hashes(t, 5))[:5].tolist()) for t in (base, longer)]
    assert not low[0] & low[1]
    docs = spark.createDataFrame([(1, base), (2, longer)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()} == {1}


def test_distinct_groups(spark):
    rows = [(1, 10), (2, 10), (1, 11), (2, 11), (1, 12), (3, 12), (1, 13), (2, 13), (3, 13), (4, 14)]
    left = simhash.distinct_groups(spark.createDataFrame(rows, "rep long, key long"))
    assert sorted(map(tuple, left.collect())) == [(1, 10), (1, 12), (1, 13), (2, 10), (2, 13), (3, 12), (3, 13)]


def test_near_duplicates_with_repeated_lines(spark):
    """One changed word, and one line that the copy holds a hundred times."""

    def text(seed, copies):
        draw = np.random.default_rng(seed)
        words = [f"w{x}" for x in draw.integers(0, 10**6, 320)]
        line = " ".join(f"l{x}" for x in draw.integers(0, 10**6, 24))
        words[100] = "changed" if copies > 1 else words[100]
        return f"{' '.join(words)} {' '.join([line] * copies)}"

    rows = [(2 * s + (n > 1), text(s, n)) for s in range(12) for n in (1, 100)]
    sets = {d: five(t) for d, t in rows}
    assert all(len(sets[2 * s] & sets[2 * s + 1]) >= 0.8 * len(sets[2 * s] | sets[2 * s + 1]) for s in range(12))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d in sets}


def test_near_duplicates_of_few_shingles_are_not_pruned():
    import pandas as pd

    sets = [np.array(s, "<u4").tobytes() for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5])]
    group = pd.DataFrame({"rep": [1, 2], "own": [0, 0], "p": [0, 0], "q": [0, 0], "fp": [0, -1], "whole": sets})
    assert simhash.similar_edges(group, 0.8, 24) == [(1, 2)]


def test_near_duplicate_classes_need_whole_hashes(spark):
    """Short texts whose only shingles agree in the upper 32 bits of their hashes."""
    texts = ["short note 35117", "short note 96794", "Short  note 96794"]
    one, two, same = (int(simhash.hashes(t, 5)[0]) for t in texts)
    assert one >> 32 == two >> 32 and one != two == same
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_simhash_odd(odd, none, clashing):
    for docs in (odd, clashing):
        rows = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
        assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
        assert rows[2]["component_id"] == 1  # A-Z alone differ
        assert {rows[i]["component_id"] for i in (3, 4, 6)} == {3} and rows[4]["fp"] == 0
        groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()}
        assert groups[2] == 1 and groups[4] == 3 and groups[6] == 3 and groups[5] == 5
    assert simhash.simhash_components(none).count() == 0
    assert simhash.near_duplicate_groups(none).count() == 0


# ------------------------------------------------------------------ personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((k, *m.span()))
    return found


def test_base_spans_by_regular_expressions(texts):
    draw = np.random.default_rng(6)
    signs = list("ab@..--++  0123456789()_%5\n")
    made = ["".join(draw.choice(signs, draw.integers(0, 40))) for _ in range(8000)]
    cards = ["4111 1111 1111 1111", "x4111-1111-1111-1111-2", "4111 1111 1111 1112", "1.2.3.4.5.6.7.8", "1.2.3.256", "a@b.c_d@e.f", "@b.c", "a@b", "+12345678", "+1 (2) 345-678-9)"]
    for text in [*texts.values(), *made, *cards]:
        assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_do_not_blow_up():
    for unit in ("a", "1", "1.", "+1", "a@", "1 ", "a.b@c-"):
        pii.base_spans(unit * 50_000)


def test_personal_data(spark, texts):
    import hashlib

    for r in pii.op9_personal_data(spark, DATA).collect():
        base = brute_spans(texts[r["doc_id"]])
        names = list(BASE)
        shown = [f"{names[k]}:{a}:{b}" for k, a, b in base]
        counts = Counter(k for k, _, _ in base)
        assert [r[f"n_{n}"] for n in names] == [counts[k] for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r["spans"].split(",") if r["spans"] else [])


def test_contexts_find_unseen_identifiers(spark):
    """Cards in one phrase teach it; a number in the phrase that fails the checksum is found, one
    elsewhere is not, and a phrase with few seeds or many other words teaches nothing."""
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424"]
    rows = [(i, f"please charge card {c} right now thank you") for i, c in enumerate(cards)]
    rows += [(10, "please charge card 4929111122223333 right now thank you"), (11, "order number 4929111122224444 was sent today")]
    rows += [(20 + i, f"only copy {cards[0]} of this one") for i in range(5)] + [(30, "only copy 99887766554433 of this one")]
    rows += [(40 + i, f"build id {9000000 + i} is ready here") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs).collect()}
    assert found[10] == [(2, 19, 35)]
    assert found[11] == [] and found[30] == [] and all(found[40 + i] == [] for i in range(9))
    assert all(len(found[i]) == 1 for i in range(4))
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[10] == "please charge card <CARD> right now thank you" == redacted[0]
    assert redacted[40] == "build id 9000000 is ready here"


def test_contexts_find_spaced_identifiers(spark):
    """A spaced card that fails the checksum, a phone without plus sign, contexts far away."""
    cards = ["4111111111111111", "5500 0055 5555 5559", "4012888888881881", "6011-0009-9013-9424", "3530111333300000", "5105105105105100"]
    rows = [(i, f"please charge card {c} right now thank you") for i, c in enumerate(cards)]
    rows += [(10 + i, f"call me under +1 (555) 010-77{i:02d} any time you like") for i in range(6)]
    far, long = " " * 200, "x" * 150
    rows += [(20 + i, f"{long} mailto{far}a{i}@mail.example.org{far}or {long}") for i in range(6)]
    new = [
        (30, "please charge card 4929 1111 2222 3333 right now thank you", "<CARD>"), (31, "call me under (017) 555-7713 any time you like", "<PHONE>"),
        (32, "call me under 017 555 7714, any time", None), (33, f"{long} mailto{far}admin@localhost{far}or {long}", "<EMAIL>"),
        (34, "in 1999 1111 2222 people came", None),
    ]
    docs = spark.createDataFrame(rows + [x[:2] for x in new], "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs).collect()}
    assert spans[30] == [(2, 19, 38)] and spans[31] == [(3, 14, 28)] and spans[34] == []
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[31] == "call me under <PHONE> any time you like" and redacted[34] == new[4][1]
    assert redacted[33] == f"{long} mailto{far}<EMAIL>{far}or {long}"


def test_shapes_find_unseen_identifiers(spark):
    """Where no context repeats, the way they are written teaches: phones that the base pattern loses to a
    number behind them are found, all of them and nothing else."""
    draw = np.random.default_rng(8)
    word = lambda: "".join(draw.choice(list("abcdefghij"), 7))
    phone = lambda: f"+1 ({draw.integers(100, 999)}) 555-{draw.integers(1000, 9999)}"
    rows = [(i, f"{word()} {phone()} {word()}") for i in range(60)]
    hidden = [(100 + i, f"{word()} {phone()} 190.137.{i}.204 {word()}") for i in range(8)]
    # numbers of sixteen digits, of which about one in ten is a card, dates, amounts, hashes
    other = [(200 + i, f"{word()} {draw.integers(10**15, 10**16)} {word()} 2021-03-{i:02d} {word()} 1,{i:03d}.50 {word()}{i}x9{i}") for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in rows + hidden + other], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    more = {i: [tuple(s) for s in r["spans"] if s not in r["base"]] for i, r in found.items()}
    for i, text in hidden:
        assert [(3, text.index("+"), text.index(" 190"))] == more[i], text
    assert not any(more[i] for i, _ in rows + other)


def test_discovery_on_the_given_table(spark):
    """Phones and cards of the given documents that the base rules miss are added, base spans stay."""
    rows = pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    added = [(r["doc_id"], s) for r in rows for s in r["spans"] if s not in r["base"]]
    assert added and all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in rows)
    assert len(added) < 0.1 * sum(len(r["base"]) for r in rows)


def test_mentions_of_runs():
    found = lambda text: [text[m["start"] : m["end"]] for m in pii.mentions(text, pii.base_spans(text)) if m["kind"] < 0]
    assert found("a (017) 555-7713, b 12 34") == ["(017) 555-7713", "555-7713", "12 34"]
    assert found("see (017 555 7713) and (x12345)") == ["017 555 7713", "x12345"]
    assert found("4929 1111. 2222 33333") == ["4929 1111", "2222 33333", "33333"]
    assert found("tel (017)5557713; 1\n2\n3") == ["(017)5557713"]
    assert found("no 1 22 a") == []
    for unit in ("1 ", "12345 ", "a@b,", "(1) ", "1234\n", "1-"):
        assert pii.mentions(unit * 20_000, []) is not None


def test_personal_data_odd(odd, none, clashing):
    for docs in (odd, clashing):
        rows = pii.find(docs).collect()
        assert len(rows) == odd.count()
        assert all(len(r["spans"]) == 2 for r in rows if r["doc_id"] in (1, 2))
        assert all(r["spans"] == [] for r in rows if r["doc_id"] in (3, 4, None))
        clean = pii.redact(docs)
        assert clean.columns == docs.columns and clean.count() == odd.count()
        one = clean.where("doc_id = 2").first()
        assert one["text"].endswith("mail <EMAIL> or <PHONE>") and one["n_chars"] == len(one["text"])
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0


# ------------------------------------------------------------------ mixing


def test_raking_meets_margins():
    draw = np.random.default_rng(7)
    targets = {"source": {"a": 1.0, "b": 1.0}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.7, "q": 0.3}}
    cells = {(s, l, t): float(draw.integers(500, 5000)) for s in "ab" for l in "xy" for t in "pq"}
    wanted = mixing.rake(cells, targets, 0.3)
    total = sum(cells.values()) * 0.3
    for n, axis in enumerate(mixing.AXES):
        for name, share in targets[axis].items():
            got = sum(v for k, v in wanted.items() if k[n] == name)
            assert got == pytest.approx(total * share / sum(targets[axis].values()), rel=1e-3)
    assert all(0 <= wanted[k] <= cells[k] for k in cells)
    # a plain proportional fitting gives the same cells where no cell is short
    plain = {k: v * 0.3 for k, v in cells.items()}
    for _ in range(500):
        for n, axis in enumerate(mixing.AXES):
            for name, share in targets[axis].items():
                own = [k for k in plain if k[n] == name]
                factor = total * share / sum(targets[axis].values()) / sum(plain[k] for k in own)
                for k in own:
                    plain[k] *= factor
    assert all(wanted[k] == pytest.approx(plain[k], rel=1e-3) for k in cells)


def test_raking_short_cells():
    targets = {"source": {"a": 1.0, "b": 1.0}, "lang": {"x": 1.0}, "topic": {"p": 1.0}}
    wanted = mixing.rake({("a", "x", "p"): 100.0, ("b", "x", "p"): 1000.0}, targets, 0.5)
    assert wanted[("a", "x", "p")] == pytest.approx(100)
    assert mixing.rake({}, targets) == {} and mixing.rake({("a", "x", "p"): 0.0}, targets) == {("a", "x", "p"): 0.0}


def test_mixing(spark, docs, texts):
    rows = mixing.op6_mix_sources(spark, "/root/testdata/sf0.1").collect()
    held, kept, chances = Counter(), Counter(), {}
    for r in rows:
        cell = (r["source"], r["lang"], r["topic"])
        held[cell] += r["tokens"]
        assert chances.setdefault(cell, r["probability"]) == r["probability"]
        kept[r["lang"]] += r["tokens"] * r["kept"]
    wanted = mixing.rake({k: float(v) for k, v in held.items()}, mixing.TARGETS)
    assert all(chances[k] == pytest.approx(wanted[k] / held[k]) for k in held if held[k])
    whole = sum(kept.values())
    assert kept["en"] / whole == pytest.approx(0.55, abs=0.04)
    assert whole == pytest.approx(0.5 * sum(held.values()), rel=0.06)
    small = {r["doc_id"]: r["tokens"] for r in mixing.op6_mix_sources(spark, DATA).collect()}
    assert small == {d: len(re.findall(r"[^ \t\n\x0b\f\r]+", t)) for d, t in texts.items()}


def test_mixing_odd(odd, none, clashing):
    for docs in (odd, clashing):
        rows = mixing.mix(docs).collect()
        assert len(rows) == odd.count()
        assert {r["tokens"] for r in rows if r["doc_id"] in (3, 4, 6)} == {0}
        assert len({r["kept"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixing.mix(none).count() == 0


# ------------------------------------------------------------------ packing


def check_packing(pieces, ids_of):
    """``ids_of``: expected ids of every document (a list for each id). Returns the sequences."""
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for n, own in by_sequence.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *[p["length"] for p in own[:-1]]]).tolist()
        size = sum(p["length"] for p in own)
        assert size == packing.LENGTH if n < len(by_sequence) - 1 else 0 < size <= packing.LENGTH
    for doc, ids in ids_of.items():
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        assert own[0]["doc_tokens"] == len(ids) and sum(p["length"] for p in own) == len(ids)
        for p in own:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == p["ids_crc32"]


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: [*whole.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    check_packing(packing.op10_curve_packing(spark, DATA).collect(), ids)


def test_packing_odd(spark, odd, none, clashing):
    path = packing.default_tokenizer()
    for docs in (odd, clashing):
        pieces = packing.digest(packing.pack(docs, path)).collect()
        total = sum(p["length"] for p in pieces)
        lengths = {(p["doc_id"], p["doc_tokens"]) for p in pieces}
        assert {(3, 1), (4, 1), (None, 1)} <= lengths and total > 100_000
        check_packing(pieces, {3: [2], 4: [2], 6: [2]})
    assert packing.pack(none, path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["", "A's don't WE'LL café ½²3 x", "<|endoftext|> ok", "日本 Ἑλλάς ÀÉ", "é ΑΣ İx \x85 y\xa0z", "..'s !!'d ''re a'b", "a\x1cb\x0bc", "µª ß ÿ×÷", "\U0001f600 1234 --"]
    draw = np.random.default_rng(8)
    texts += ["".join(draw.choice(list("aB's dtré .,!19'½%\n\t"), 60)) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_with_another_tokenizer(spark, odd):
    """Texts go whole through a tokenizer that splits otherwise."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    assert not own.by_word and packing.WordEncoder(packing.default_tokenizer()).by_word
    texts = ["", "A's don't WE'LL", "<|endoftext|> ok", "x  \n y"]
    assert [i.tolist() for i in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    want = {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in odd.where("doc_id > 1").collect()}
    check_packing(packing.digest(packing.pack(odd.where("doc_id > 1"), path)).collect(), want)


def test_packing_with_a_large_vocabulary(spark, tmp_path):
    """Ids beyond 16 bits."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "words.json")
    made.save(path)
    docs = spark.createDataFrame([(1, "w69999 w5 other"), (2, None), (3, "w65536 w65535")], "doc_id long, text string")
    check_packing(packing.digest(packing.pack(docs, path)).collect(), {1: [69999, 5, 0, 2], 2: [2], 3: [65536, 65535, 2]})


def test_hilbert_curve_is_continuous():
    from itertools import product

    points = np.array(list(product(range(8), repeat=4)))
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(8**4))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_equal_documents_are_neighbours():
    """Documents of two kinds of words come out in runs."""
    draw = np.random.default_rng(9)
    kinds = [draw.choice(2000, 30) + 3000 * k for k in (0, 1, 2)]
    ids = [draw.choice(kinds[i % 3], 400).astype(np.uint32) for i in range(90)]
    order = np.argsort(packing.curve_keys(ids)) % 3
    assert (np.diff(order) != 0).sum() < 20

