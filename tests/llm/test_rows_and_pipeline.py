"""Chat formatting, URL filters, embeddings, components, and the pipeline."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellward.llm import chat, common, lattice, registry, simhash, urls

DATA = "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = registry.QUERIES[name](spark, DATA)
    columns = sorted(result.columns)
    got = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert got == sorted(want, key=repr) and got


# ------------------------------------------------------------------ chat

TURNS = "conv_id long, turn long, role string, text string, turns string"
HARD = [
    "<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "<|", "|>", "<", "a\\<|b\\", "<<||", "\\n", "<|im_sep|>", "", None, "é\U0001f600",
]


def turns_of(rows):
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=key)]


def test_chat_round_trip(spark):
    draw = np.random.default_rng(0)
    roles = ["user", "assistant", "system", None, "", "a\nb", "x\\n<|", "<\\|"]
    rows = [
        (c if c else None, int(t) if t < 5 else None, roles[draw.integers(len(roles))], HARD[draw.integers(len(HARD))], "clash")
        for c in range(40)
        for t in draw.integers(0, 6, draw.integers(1, 12))
    ]
    rows += rows[:5]  # repeated rows
    made = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(4))
    found = made.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("back"))).collect()
    assert len(found) == 40
    for r in found:
        want = turns_of([x for x in rows if x[0] == r["conv_id"]])
        assert [tuple(t) for t in r["back"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        changes = sum(a != b for a, b in zip([role for role, _ in want], [None, *[role for role, _ in want[:-1]]]))
        assert r["blocks"] == changes == r["formatted"].count(chat.START)


def test_chat_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_planted(spark):
    row = chat.op3_chat_formatting(spark, DATA).where("conv_id = -1").first()
    whole = f"user\n{chat.CONTROL}\nassistant\n{chat.CONTROL}\n"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(chat.CONTROL)
    assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


# ------------------------------------------------------------------ URLs


def brute_judge(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, rest = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest.split("#")[0].split("?")[0]
    fits = [
        (len(h + p), len(h), v, h + p) for h, p, v in rules
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def test_urls(spark):
    rules = [*urls.RULES, ("com", "/", "allow"), ("a.b.c.com", "/x", "block"), ("com", "/x/yyyyyyy", "block"), (None, "/", "block"), ("net", None, "block"), ("net", "", "allow")]
    parts = ["http://", "HTTPS://", "", "x:", "a.b.c.com", "www.example.com", "WWW.Example.COM", "net", ".", "com", "/", "/en/", "/x/", "yyyyyyyy", "?q=/en/", "#", "://", "É", "\n", ":80"]
    draw = np.random.default_rng(1)
    made = [None, "", "://", "http://com", "http://com/", "http://xcom/", "a://b.com/en/?://net/es/", "http://" + "a." * 5000 + "com/" + "y" * 9000]
    made += ["".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(1, 7))) for _ in range(1500)]
    rows = [(i if i % 50 else None, u, "clash") for i, u in enumerate(made)]
    rows += rows[:20]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(5)
    rule_table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.judge_urls(pages, rule_table)
    want = [(i, u, *brute_judge(u, rules)) for i, u, _ in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert urls.judge_urls(pages.limit(0), rule_table).count() == 0
    plain = urls.judge_urls(pages, rule_table.limit(0), "block").collect()
    assert len(plain) == len(rows) and {r["verdict"] for r in plain} == {"block"}


def test_url_prefix_is_the_only_key(spark, monkeypatch):
    """URLs meet rules on the short number alone, in many partitions; the full digest decides behind the join."""
    rules = spark.createDataFrame(list(urls.RULES), "host string, path string, verdict string")
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('https://www', id % 7, '.example.com/', if(id % 3 = 0, 'en/', 'x/'), id) AS url")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        judged = urls.judge_urls(pages, rules)
        plan = judged._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert len(joins) == 1 and joins[0].split("SortMergeJoin")[1].startswith(" [key#"), joins
        assert joins[0].count("digest") == 0
        want = sorted(map(tuple, judged.collect()))
        # with one hex digit nearly everything meets, and what does not fit is still told apart
        monkeypatch.setattr(urls, "PREFIX", 1)
        assert sorted(map(tuple, urls.judge_urls(pages, rules).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert {r[5] for r in want} == {"allow", "block"} and len(want) == 4000
    # a rule's path may be of any length
    long = spark.createDataFrame([("example.com", "/" + "a" * 5000, "block")], "host string, path string, verdict string")
    two = spark.createDataFrame([(1, "http://example.com/" + "a" * 5001), (2, "http://example.com/" + "a" * 4999)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(two, long).collect()} == {1: "block", 2: "allow"}


# ------------------------------------------------------------------ embeddings

VECTORS = "vec_id long, embedding array<float>, label int, rep string"


def brute_links(ids, rows, cosine=0.9):
    x = np.array(rows, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            return near, near.sum(1), label
        label = low


def clusters(draw, centres=12, each=14, dims=64, noise=0.02):
    out = []
    for _ in range(centres):
        c = draw.normal(size=dims)
        out += [c / np.linalg.norm(c) + draw.normal(size=dims) * noise for _ in range(each)]
    return np.array(out, np.float32)


@pytest.mark.parametrize("block", [4, 512])
def test_embedding_links(spark, block):
    draw = np.random.default_rng(2)
    rows = clusters(draw)
    rows = np.concatenate([rows, rows[:30], rows[:5] * 2])  # exact copies, and copies of another length
    ids = draw.permutation(len(rows)) + 100
    df = spark.createDataFrame([(int(i), r.tolist(), 1, "clash") for i, r in zip(ids, rows)], VECTORS).repartition(5)
    rows_, classes = lattice.classes_of(df)
    links = lattice.lattice_links(classes, block=block)
    per = {r["rep"]: r["l"] for r in links.groupBy("rep").agg(F.sum("links").alias("l")).collect()}
    _, degree, label = brute_links(ids, rows)
    if block == 512:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df).collect()}
        assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, degree, label)}
    copies = {r["rep"]: r["n"] - 1 for r in classes.collect()}
    want = dict(zip(ids.tolist(), degree.tolist()))
    assert all(per.get(rep, 0) + n == want[rep] for rep, n in copies.items())


def test_embedding_recall_at_the_threshold():
    """Pairs of random directions at a given cosine, found by one of their cells."""
    draw = np.random.default_rng(3)
    a = lattice.unit_rows(list(draw.normal(size=(2000, 64))))
    own = lattice.Lattice(64)
    for cosine, least in ((0.9, 0.92), (0.95, 0.995)):
        off = draw.normal(size=a.shape)
        off -= (off * a).sum(1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
        met = lattice.first_meeting(own.cells(a), own.cells(b)) < np.iinfo(np.int64).max
        assert met.mean() >= least


@pytest.mark.parametrize("dims", [16, 32, 128])
def test_embedding_recall_of_other_lengths(dims):
    draw = np.random.default_rng(3)
    a = lattice.unit_rows(list(draw.normal(size=(1000, dims))))
    own = lattice.Lattice(dims)
    for cosine, least in ((0.9, 0.9), (0.95, 0.99)):
        off = draw.normal(size=a.shape)
        off -= (off * a).sum(1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
        met = lattice.first_meeting(own.cells(a), own.cells(b)) < np.iinfo(np.int64).max
        assert met.mean() >= least


def test_nearest_lattice_point():
    draw = np.random.default_rng(4)
    x = draw.uniform(-2, 2, (300, 8))
    near = lattice.nearest_e8(x)
    assert ((2 * near) % 2 == (2 * near[:, :1]) % 2).all() and (near.sum(1) % 2 == 0).all()
    assert (np.linalg.norm(x - near, axis=1) <= 1 + 1e-9).all()  # the covering radius
    others = near[:, None, :] + lattice.neighbours()[None]
    assert (np.linalg.norm(x[:, None] - others, axis=2) >= np.linalg.norm(x - near, axis=1)[:, None] - 1e-9).all()


def test_cells_do_not_depend_on_the_batch():
    x = lattice.unit_rows(list(np.random.default_rng(5).normal(size=(64, 64))))
    own = lattice.Lattice(64)
    assert (own.cells(x) == np.concatenate([own.cells(x[i : i + 1]) for i in range(64)])).all()


def test_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
        (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [None, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0]), (12, [-0.0, 0.0, 1.0]), (13, [0.0, -0.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, None, "clash") for i, v in rows], VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df).collect()}
    alone = {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 12: (1, 12, True), 13: (1, 12, False), **alone}
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# ------------------------------------------------------------------ components, blocks


def test_components(spark):
    draw = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, None)]
    edges += [tuple(e) for e in draw.integers(10_000, 10_400, (260, 2)).tolist()]
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(400):
        for a, b in edges:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == label and len(found) == len(label)


def test_runs_cross_batches():
    import pyarrow as pa

    keys = np.repeat([1, 2, 3, 4], [3, 1, 7, 2])
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(13))], names=["k", "v"])
    for rows in (1, 2, 5, 50):
        found = [(g["k"].iloc[0], g["v"].tolist()) for g in common.runs(common.small_batches([batch], rows), ["k"])]
        assert found == [(1, [0, 1, 2]), (2, [3]), (3, list(range(4, 11))), (4, [11, 12])]


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = common.shared_path(spark, f"test-{name}")
        out.write.parquet(path)
        seen[name] = docs = spark.read.parquet(path)
    assert seen["language"].count() == 1000
    groups = simhash.simhash_components(seen["language"])
    kept = {r["doc_id"] for r in seen["near_duplicates"].collect()}
    assert kept == {r["component_id"] for r in groups.collect()} and len(kept) < 1000
    assert seen["personal_data"].count() == seen["near_duplicates"].count()
    assert seen["personal_data"].where(r"text RLIKE '[a-z0-9]@mail'").count() == 0
    mixed = seen["mixing"].collect()
    assert 0 < len(mixed) < seen["personal_data"].count()
    pieces = seen["packing"].collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in mixed}
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, pieces))


def test_near_duplicate_stage_judges_rows(spark):
    """Copies under a null id, repeated rows, different texts under one id, and one of those a copy."""
    draw = np.random.default_rng(2)
    text = lambda: " ".join("".join(draw.choice(list("abcdefgh"), 6)) for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (2, a), (None, a), (None, b), (None, b), (7, c), (7, d), (9, c), (9, c), (3, None), (4, "")]
    path = common.shared_path(spark, "rows")
    spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, DATA).collect()), key=repr)
    assert kept == sorted([(2, a), (None, b), (7, c), (7, d), (3, None)], key=repr)


def test_pipeline_odd(spark, odd, none, clashing):
    for docs in (odd, none, clashing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= (1 if docs.count() else 0)
