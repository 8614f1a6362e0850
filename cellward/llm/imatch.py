"""I-Match fingerprints: hashes of the distinct terms in a band of inverse document frequency.

A term is a lower-case run between white space and ASCII punctuation, known by its 64-bit hash. The
document frequency of every term is counted over all documents; terms within the band ``LOW`` to
``HIGH`` (shares of all documents) form the lexicon. As each of them stands in ``LOW`` of all
documents or more, there are at most 1 / ``LOW`` times the mean number of distinct terms of a
document, whatever the corpus and its vocabulary (200 times; a few thousand in natural text). The
lexicon goes into the plan as a literal hash table, so fingerprints need no join.

Each term of the lexicon carries a code for every part of the fingerprint it belongs to: the part's
number in the high byte, then the low bits of its hash. Part 0 is the whole lexicon, further parts
are randomised subsets of it which hold one term in 16, 64 or 256. The codes of a document are
sorted once, the stretch of each part is hashed. Likeness is the share of equal parts among
those that are not empty in both texts. A text without any term of the lexicon hashes all its terms
in the first part.

Defined results: null text is empty; rows with a null ``doc_id`` have no place in the order of
ids and are left out; of rows that share an id the shortest text counts, then the smallest; in a
table of one document the next document is the document itself; an empty table gives no rows;
further columns are ignored; texts are hashed whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellward.llm.common import cut, table

LOW, HIGH = 0.005, 0.25
#: one term in so many, and how many subsets of that kind
SUBSETS = ((16, 4), (64, 12), (256, 16))
SHARES = [share for share, many in SUBSETS for _ in range(many)]
_PART = 56
_SEPARATORS = r"[\s\p{Punct}]+"


def term_hashes(text: Column) -> Column:
    words = F.array_distinct(F.array_remove(F.split(F.lower(text), _SEPARATORS), ""))
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``(term, codes)``: the hashes in the band with their codes, that of part 0 first."""
    total = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("term"))
    held = terms.groupBy("term").count().where(F.col("count").between(low * total, high * total))
    rest = F.col("term").bitwiseAND(F.lit((1 << _PART) - 1).cast("long"))
    own = lambda n: F.lit(n << _PART).cast("long") + rest
    drawn = [F.when(F.pmod(F.xxhash64("term", F.lit(n)), F.lit(share)) == 0, own(n)) for n, share in enumerate(SHARES, 1)]
    return held.select("term", F.array_compact(F.array(own(0), *drawn)).alias("codes"))


def hash_table(terms: DataFrame) -> Column:
    """The lexicon as a literal: an array of buckets by the low bits of the term, about one for each
    term, with ``(t, c)`` of their terms. Its size is bounded as the lexicon is."""
    rows = terms.collect()  # at most 1 / low times the mean number of distinct terms of a document
    buckets: list[list[dict]] = [[] for _ in range(1 << len(rows).bit_length())]
    for r in sorted(rows):
        buckets[r["term"] & (len(buckets) - 1)].append({"t": r["term"], "c": r["codes"]})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t: long, c: array<long>>>>")


def with_parts(df: DataFrame, text: str, name: str, held: Column) -> DataFrame:
    """``df`` with the column ``name``: the parts of the fingerprint of the column ``text``, first that
    of the whole lexicon, then one for each subset (null if empty).

    Each step is a projection of its own, so that all parts read one list of sorted codes and their
    stretches are found in generated code. A mark for the beginning of every part is sorted with the codes.
    """
    terms, found, ordered, marks = (F.col(f"_{name}_{c}") for c in ("terms", "found", "ordered", "marks"))
    starts = [F.lit(n << _PART).cast("long") for n in range(len(SHARES) + 2)]
    last = (F.size(held) - 1).cast("long")
    bucket = lambda h: F.element_at(held, (h.bitwiseAND(last) + 1).cast("int"))
    codes = F.flatten(F.transform(F.flatten(found), lambda e: e["c"]))

    def part(n: int) -> Column:
        at, to = (F.element_at(marks, i + 1).cast("int") for i in (n, n + 1))
        return F.when(to > at + 1, F.xxhash64(F.slice(ordered, at + 1, to - at - 1)))

    whole = F.coalesce(part(0), F.xxhash64(F.array_sort(terms)))
    made = df.withColumn(f"_{name}_terms", term_hashes(F.col(text)))
    made = made.withColumn(f"_{name}_found", F.transform(terms, lambda h: F.filter(bucket(h), lambda e: e["t"] == h)))
    made = made.withColumn(f"_{name}_ordered", F.sort_array(F.concat(codes, F.array(*starts))))
    made = made.withColumn(f"_{name}_marks", F.array(*[F.array_position(ordered, s) for s in starts]))
    made = made.withColumn(name, F.array(whole, *[part(n) for n in range(1, len(SHARES) + 1)]))
    return made.drop(*[f"_{name}_{c}" for c in ("terms", "found", "ordered", "marks")])


def likeness(a: Column, b: Column) -> Column:
    """Equal parts among those that are not empty in both, 0 to 1."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    some = F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.filter(some, lambda p: p["x"] == p["y"])
    return F.size(same) / F.size(some)


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.lpad(F.lower(F.hex(p)), 16, "0"), F.lit("-"))), ".")


def next_ids(ids: DataFrame, buckets: int) -> DataFrame:
    """``(doc_id, n_chars, next_id)`` in the order of ids; the last one is followed by the first.

    Ids are dealt to ranges by quantiles; each range looks for successors on its own, and only
    the first id of each range crosses over.
    """
    splits = sorted(set(ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.001)))
    edges = F.array(*[F.lit(int(s)) for s in splits]) if splits else F.array().cast("array<long>")
    placed = ids.withColumn("range", F.size(F.filter(edges, lambda s: s <= F.col("doc_id"))))
    firsts = placed.groupBy("range").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("range")  # a row for each range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    crossing = firsts.select(
        "range", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("crossing")
    )
    inside = Window.partitionBy("range").orderBy("doc_id")
    led = placed.withColumn("inside", F.lead("doc_id").over(inside))
    return led.join(crossing, "range").select(
        "doc_id", "n_chars", F.coalesce("inside", "crossing").alias("next_id")
    )


def edited_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, text, edited, next_id)``: the last quarter replaced by the beginning of
    the next document. Texts are dealt out by id once; heads of texts move a second time."""
    known = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    )
    one = Window.partitionBy("doc_id").orderBy(F.length("text"), "text")
    texts = known.withColumn("place", F.row_number().over(one)).where("place = 1").drop("place")
    ids = cut(known.groupBy("doc_id").agg(F.min(F.length("text")).alias("n_chars")))
    spark = docs.sparkSession
    following = next_ids(ids, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    asked = following.select(F.col("doc_id").alias("by"), F.col("next_id").alias("doc_id"), "n_chars")
    heads = texts.join(asked, "doc_id").select(
        F.col("by").alias("doc_id"),
        F.col("doc_id").alias("next_id"),
        "n_chars",
        F.substring(F.col("text"), F.lit(1), quarter).alias("head"),
    )
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    return texts.join(heads, "doc_id").select(
        "doc_id", F.col("n_chars").cast("long"), "text", F.concat(kept, "head").alias("edited"), "next_id"
    )


def imatch(docs: DataFrame) -> DataFrame:
    held = hash_table(lexicon(docs))
    made = with_parts(edited_texts(docs), "text", "parts", held)
    made = with_parts(made, "edited", "edited_parts", held)
    made = made.select("doc_id", "n_chars", "next_id", F.sha2("edited", 256).alias("edited_sha256"), "parts", "edited_parts")
    made = cut(made)
    following = made.select(F.col("doc_id").alias("next_id"), F.col("parts").alias("next_parts"))
    return made.join(following, "next_id")


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("parts")).alias("fingerprint"),
        as_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
