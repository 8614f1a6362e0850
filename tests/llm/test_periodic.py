"""Periodic runs against brute force, and on odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from cellward.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least):
    """All maximal stretches with a smallest period, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if (length := e - s + q) >= max(least, 2 * q):
                found.setdefault((s, length), q)  # periods rise: the first is the smallest
            s = e + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(key, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 12)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_small_alphabets(least):
    draw = np.random.default_rng(least)
    texts = [draw.integers(0, draw.integers(1, 5), draw.integers(0, 60)) for _ in range(400)]
    # powers, powers of powers, and a Fibonacci word, rich in overlapping runs
    texts += [np.tile(draw.integers(0, 3, k), 9) for k in range(1, 8)]
    texts += [np.concatenate([np.tile([0, 1], 8), np.tile([0, 1, 2], 6), np.tile([1, 2], 9)])]
    fib = ([0], [0, 1])
    for _ in range(9):
        fib = (fib[1], fib[1] + fib[0])
    texts.append(np.array(fib[1]))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = periodic.runs_of(np.concatenate(texts).astype(np.int32), bounds, least)
    for i, t in enumerate(texts):
        assert found.get(i, []) == brute(t.tolist(), least), t.tolist()


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(tuple(r) for r in periodic.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(odd, none, clashing):
    made = [
        sorted((tuple(r) for r in periodic.digests(periodic.periodic_runs(docs, planted=periodic.with_planted_period)).collect()), key=repr)
        for docs in (odd, clashing)
    ]
    assert made[0] == made[1]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["text"] is None or len(r["text"]) < 1000]
    want = sorted((expected(*r) for r in rows), key=repr)
    assert [r for r in made[0] if r[0] != 5] == want
    assert sum(r[0] == 5 for r in made[0]) == 1
    assert periodic.periodic_runs(none).count() == 0


def test_long_periodic_text(spark):
    text = " ".join(["a", "b", "c"] * 100_000 + ["d"])
    row = periodic.periodic_runs(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 300_000, 3)]
    assert row["collapsed"] == "a b c d"
