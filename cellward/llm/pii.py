"""Personal data: fixed patterns, and further identifiers found by bootstrapped contexts.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by fixed rules. The
method then learns from where they stand and how they are written. The words around a base span (two on a
side, one on each side, or, as a back-off, one on a side) and its shape (letters and digits as
classes, all else as it is) are lexical patterns; the span's text is an instance. What looks like an identifier and is in no base span is an instance
too, of no known kind: single words of five characters or more with three digits or an ``@``, and
runs of numbers (digits, dots, dashes, parentheses, a plus sign) joined by blanks and dashes, of
any length and without a checksum. Numbers side by side are one run, as nothing tells where an
identifier in it would end; its words remain instances, and count with the run once. A pattern's
confidence in a kind is the share of its distinct instances which are of that kind, where an
unknown instance counts with its own score (in patterns of two words); an instance's score is the chance that one of its
patterns of high confidence (``SURE`` or more) is right. Weak patterns add up to nothing, so that sixteen
digits which are as often no card as one stay alone. Both are computed in turn, ``ROUNDS`` times, as joins and sums over the pattern-instance graph. Unknown
instances with a score of ``ACCEPT`` or more are personal data wherever they were seen. A pattern
counts only with ``SEEDS`` distinct base instances or more, so copies of one document teach nothing.

Defined results: null text is empty; spans are code points with the end left out; ``doc_id`` may
be null or repeat, every row keeps its own spans; equal words at several places are one instance;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellward.llm.common import cut, small_batches, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SEEDS, ACCEPT, SURE = 3, 3, 0.8, 0.75

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\s]*[0-9@][^\s]*")
_TOKEN = re.compile(r"\S+")
_DIGIT, _LETTERS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"[+(]*[0-9][0-9().+-]*")
_JOINT = re.compile(r"[ \t\u00a0()-]+")
_OUTER = ".,;:!?()[]{}<>\"'|"
#: Longer words stand in a pattern as a digest of the characters next to the span, so that lists
#: without white space neither fill the memory nor take quadratic time.
_LONG, _NEXT_TO = 64, 1000


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each ``@``: the run before it since the last match, and a domain."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append((begin, done := domain.end()))
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in the order of kinds, then of starts."""
    spans = []
    if "@" in text:
        spans += [(0, a, b) for a, b in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
                spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append((3, *m.span()))
    return spans


def contexts(text: str, start: int, end: int, starts: list[int], ends: list[int]) -> list[str]:
    """The lexical patterns around a span: two words before, two after, one on each side, one before, one after,
    however far away. ``starts`` and ``ends`` are those of the text's words."""
    i, j = bisect_left(starts, start), bisect_right(ends, end)
    left = [_word(text[max(a, e - _NEXT_TO) : e]) for a, b in zip(starts[max(0, i - 2) : i], ends[max(0, i - 2) : i]) for e in [min(b, start)]]
    right = [_word(text[a : min(b, a + _NEXT_TO)]) for s, b in zip(starts[j : j + 2], ends[j : j + 2]) for a in [max(s, end)]]
    found = []
    if len(left) == 2:
        found.append("l " + " ".join(left))
    if len(right) == 2:
        found.append("r " + " ".join(right))
    if left and right:
        found.append(f"b {left[-1]} {right[0]}")
    if left:
        found.append(f"p {left[-1]}")
    if right:
        found.append(f"n {right[0]}")
    return found


def shape(instance: str) -> str:
    """Digits as 9, runs of letters as a; long shapes as a digest."""
    return _word(_DIGIT.sub("9", _LETTERS.sub("a", instance)))


def _word(word: str) -> str:
    return word.lower() if len(word) <= _LONG else "#" + _digest(word.lower())


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def numbers(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without brackets that do not belong to its numbers."""
    while start < end and (text[start] not in "+(0123456789" or (text[start] == "(" and text.find(")", start, end) < 0)):
        start += 1
    while end > start and not "0" <= text[end - 1] <= "9":
        end -= 1
    return start, end


def unknown_words(text: str, taken: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Spans that look like identifiers outside of ``taken`` (in order): for every run of numbers
    the whole of it first, if it has several words, then its words; other words alone."""
    at, run, open_ = 0, [], False
    last = 0
    for m in _WORD.finditer(text):
        inner = m[0].strip(_OUTER)
        start = m.start() + m[0].index(inner)
        end = start + len(inner)
        core = m[0].strip(".,;:!?[]{}<>\"'|")
        number = bool(_NUMBER.fullmatch(core))
        if number:
            start, end = numbers(text, m.start() + m[0].index(core), end)
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        held = any(a < end and start < b for a, b in taken[at : at + 4])
        joined = open_ and number and not held and text[m.start()] not in "[{<\"'|" and _JOINT.fullmatch(text, last, m.start())
        if run and not joined:
            yield from _chosen(text, run)
            run = []
        if not held and inner:
            run.append((start, end))
        open_ = number and not held and m[0][-1] not in ".,;:!?]}>\"'|"
        last = m.end()
    if run:
        yield from _chosen(text, run)


def _chosen(text: str, run: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    like = lambda a, b: b - a >= 5 and ("@" in text[a:b] or sum("0" <= c <= "9" for c in text[a:b]) >= 3)
    words = [x for x in run if like(*x)]
    if len(run) == 1:
        if words:
            yield words
        return
    whole = numbers(text, run[0][0], run[-1][1])
    # a first word such as "(017" had no closing bracket of its own
    if whole[0] > 0 and text[whole[0] - 1] == "(" and text.find(")", *whole) >= 0 and "(" not in text[whole[0] : text.find(")", *whole)]:
        whole = (whole[0] - 1, whole[1])
    if like(*whole):
        yield [whole, *words]
    elif words:
        yield words


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans and unknown words and runs that look like identifiers, with their patterns.

    ``run`` tells equal runs, ``place`` the start of the run, ``whole`` what is all of it."""
    found = [{"kind": k, "start": a, "end": b, "run": None, "place": a, "whole": True} for k, a, b in spans]
    for group in unknown_words(text, sorted((a, b) for _, a, b in spans)):
        first, end = group[0]
        run = _digest(text[first:end]) if len(group) > 1 else None
        for a, b in group:
            found.append({"kind": -1, "start": a, "end": b, "run": run, "place": first, "whole": (a, b) == group[0]})
    if found:
        words = [m.span() for m in _TOKEN.finditer(text)]
        starts, ends = [a for a, _ in words], [b for _, b in words]
    for x in found:
        x["instance"] = text[x["start"] : x["end"]]
        x["run"] = x["run"] or x["instance"]
        x["patterns"] = [*contexts(text, x["start"], x["end"], starts, ends), f"s {shape(x['instance'])}"]
    return found


_MENTION = "struct<kind:int, start:long, end:long, run:string, place:long, whole:boolean, instance:string, patterns:array<string>>"
_ARROW = pa.struct(
    [
        ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("run", pa.string()), ("place", pa.int64()), ("whole", pa.bool_()),
        ("instance", pa.string()), ("patterns", pa.list_(pa.string())),
    ]
)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, perhaps others) with ``mark`` and ``mentions``; the mark tells
    a row from those with another id or text. Every row has one, so that rows without mentions are
    no hot key of the join that brings what was found."""
    out = StructType([*docs.schema, *StructType.fromDDL(f"mark string, mentions array<{_MENTION}>")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            found, marks = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = mentions(text, base_spans(text)) if text and _HINT.search(text) else []
                found.append(own)
                marks.append(hashlib.blake2b(f"{doc} {text}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(marks, pa.string()), pa.array(found, pa.list_(_ARROW))],
                names=[*batch.schema.names, "mark", "mentions"],
            )

    return docs.mapInArrow(run, out)


def discovered(seen: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, accept: float = ACCEPT, least: float = SURE) -> DataFrame:
    """``(instance, kind)`` of the unknown instances which the graph makes personal data.

    ``seen``: rows of single mentions. Every distinct (pattern, instance) is one edge. Patterns
    without enough base instances, and instances without such a pattern, take no part. A run of
    numbers and its words are one instance to a pattern, with the best of their scores.
    """
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind", "run").distinct()
    seeded = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    seeded = cut(seeded.where(F.col("seeds") >= seeds))
    all_of = edges.join(seeded.select("pattern").distinct(), "pattern", "left_semi")
    totals = all_of.groupBy("pattern").agg(F.count_distinct("run").alias("all"))
    patterns = cut(seeded.join(totals, "pattern"))
    unknown = cut(edges.where("kind < 0").drop("kind").join(patterns.select("pattern").distinct(), "pattern", "left_semi"))
    scores = None
    for _ in range(rounds):
        known = patterns
        if scores is not None:
            gained = unknown.join(scores, "instance").groupBy("pattern", "kind", "run").agg(F.max("score").alias("score"))
            gained = gained.groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            known = patterns.join(gained, ["pattern", "kind"], "left")
        else:
            known = known.withColumn("gained", F.lit(0.0))
        # one word or a shape says little, so what was found elsewhere adds nothing to it
        gains = F.when(F.left("pattern", F.lit(1)).isin("p", "n", "s"), 0.0).otherwise(F.coalesce("gained", F.lit(0.0)))
        sure = known.select("pattern", "kind", ((F.col("seeds") + gains) / F.col("all")).alias("sure"))
        sure = sure.where(F.col("sure") >= least)
        wrong = F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))
        scores = cut(
            unknown.drop("run").distinct().join(sure, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(wrong))).alias("score"))
        )
    best = scores.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("best"))
    return best.where(F.col("best.score") >= accept).select("instance", (-F.col("best")["col2"]).alias("kind"))


def _further(scanned: DataFrame, **graph) -> DataFrame:
    """``(mark, more)``: the discovered spans of the rows with ``mark``."""
    one = scanned.where(F.size("mentions") > 0).select("mark", F.explode("mentions").alias("m")).select("mark", "m.*")
    more = one.where("kind < 0").drop("kind").join(discovered(one, **graph), "instance")
    # of a run that was found as a whole, its words are not listed again
    runs = more.groupBy("mark", "place").agg(
        F.collect_set(F.struct("kind", "start", "end", "whole")).alias("inside"), F.bool_or("whole").alias("all")
    )
    one = runs.select("mark", "all", F.explode("inside").alias("s")).where("s.whole OR NOT all")
    return one.groupBy("mark").agg(F.collect_set(F.struct("s.kind", "s.start", "s.end")).alias("more"))


def find(docs: DataFrame, **graph) -> DataFrame:
    """``(doc_id, base, spans)`` of every row: arrays of (kind number, start, end), in order."""
    scanned = cut(scan(docs.select("doc_id", "text")).drop("text"))
    return scanned.join(_further(scanned, **graph), "mark", "left").select("doc_id", *_spans())


def _spans() -> list[Column]:
    base = F.transform(
        F.filter("mentions", lambda m: m["kind"] >= 0), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    )
    base = F.array_sort(base)
    return [base.alias("base"), F.array_sort(F.concat(base, F.coalesce("more", F.array()))).alias("spans")]


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, **graph) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` counted anew."""
    names = docs.columns
    texts = docs.select("doc_id", "text", F.struct(*[docs[n] for n in names if n != "text"]).alias("others"))
    more = _further(cut(scan(texts.select("doc_id", "text")).drop("text")), **graph)
    counts = "n_chars" in names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            made = []
            for text, own, further in zip(*[batch.column(c).to_pylist() for c in ("text", "mentions", "more")]):
                spans = [(m["start"], m["end"], m["kind"]) for m in [*own, *(further or [])] if m["kind"] >= 0]
                made.append(replaced(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("others"), pa.array(made, pa.string()), pa.array([None if t is None else len(t) for t in made], pa.int64())],
                names=["others", "text", "chars"],
            )

    again = scan(texts).join(more, "mark", "left").select("others", "text", "mentions", "more")
    clean = again.mapInArrow(run, StructType([texts.schema["others"], *StructType.fromDDL("text string, chars long")]))
    return clean.select(
        *[
            F.col("text") if n == "text"
            else F.coalesce("chars", F.col("others")["n_chars"]).cast(docs.schema[n].dataType).alias(n) if n == "n_chars" and counts
            else F.col("others")[n].alias(n)
            for n in names
        ]
    )


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one, named after the first."""
    out, done = [], 0
    for start, end, kind in sorted(spans):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    many = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *many, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
