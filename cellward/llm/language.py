"""Language identification by a byte convolutional network.

Texts become UTF-8 bytes, these become classes (letters without case, digits, ...), in windows of ``WINDOW`` bytes (the last one padded with zero bytes).
Filters of several widths slide over each window, the largest response of every filter in the
window is kept, rectified, and a softmax layer gives the window's chances. A text's score is the
mean chance over all of its windows, each weighted by its bytes, so texts count whole.

The network is trained here in numpy. It learns from a bounded sample of labelled documents:
about ``PER_LANGUAGE`` documents of every label, chosen by a hash of their ids, and
``WINDOWS_EACH`` windows at even places of each. Only text and label are read; documents whose
crc32(doc_id as text) mod 3 is 1 are held out. The sample is bounded in labels too: where there are
more than ``LANGUAGES``, those with most labelled documents are learned (of equal ones the first by name). Prediction runs over batches of windows in tasks
and sees nothing but bytes.

Defined results: a text that is null or has no letter gets ``und`` and score 0; without any
labelled text all documents get ``und``; a null ``doc_id`` is kept and predicted, but not learned
from; repeated rows stay repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellward.llm.common import small_batches, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 600
WINDOWS_EACH = 4
LANGUAGES = 500
UNKNOWN = "und"
CLASSES = 64


def _byte_classes() -> np.ndarray:
    """Letters without case, digits, white space, punctuation; bytes from 128 on by their low five
    bits, lead bytes as one class. Zero is padding."""
    of = np.full(256, 30, np.uint8)
    of[0] = 0
    of[ord("a") : ord("z") + 1] = of[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    of[ord("0") : ord("9") + 1] = 27
    of[[9, 10, 11, 12, 13, 32]] = 28
    of[[ord(c) for c in ".,;:!?'"]] = 29
    of[0x80:0xC0] = 32 + np.arange(64) % 32
    of[0xC0:] = 31
    return of


BYTE_CLASSES = _byte_classes()


@dataclass
class Network:
    """``filters[w]``: (width, CLASSES, FILTERS); ``out``: (features, languages)."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each window, and where it was."""
        values, places = [], []
        for kernel in self.filters:
            width = len(kernel)
            response = kernel[0][windows[:, : WINDOW - width + 1]]
            for k in range(1, width):
                response += kernel[k][windows[:, k : WINDOW - width + 1 + k]]
            places.append(response.argmax(1))
            values.append(np.take_along_axis(response, places[-1][:, None], 1)[:, 0])
        return np.concatenate(values, 1), np.concatenate(places, 1)

    def features(self, windows: np.ndarray) -> np.ndarray:
        """``pooled`` without places. Classes are looked up in pairs, which halves the sums; places
        stand in the first axis, so that the largest response is found for many at a time."""
        turned = np.ascontiguousarray(windows.T).astype(np.intp)
        first = turned[:-1] * CLASSES + turned[1:]
        values = []
        for width, (head, tail) in zip(WIDTHS, self.pairs()):
            places = WINDOW - width + 1
            response = head.take(first[:places], axis=0, mode="clip")
            if width == 3:
                response += tail.take(turned[2:], axis=0, mode="clip")
            elif width == 4:
                response += tail.take(first[2:], axis=0, mode="clip")
            values.append(response.max(0))
        return np.concatenate(values, 1)

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        if not hasattr(self, "_pairs"):
            flat = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
            self._pairs = [
                (flat(k[0], k[1]), None if len(k) == 2 else k[2] if len(k) == 3 else flat(k[2], k[3]))
                for k in self.filters
            ]
        return self._pairs

    def chances(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        grown = np.exp(logits)
        return grown / grown.sum(1, keepdims=True)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text as classes of bytes, and the number of bytes in each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    many = max(1, -(-len(raw) // WINDOW))
    padded = np.zeros(many * WINDOW, np.uint8)
    padded[: len(raw)] = BYTE_CLASSES[raw]
    sizes = np.full(many, WINDOW)
    sizes[-1] = len(raw) - (many - 1) * WINDOW
    return padded.reshape(many, WINDOW), sizes


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy; a filter learns at the place of its largest response."""
    draw = np.random.default_rng(seed)
    features = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        [draw.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(features, np.float32),
        draw.normal(0, 0.3, (features, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [*net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in weights]
    counts = np.bincount(labels, minlength=len(languages))
    balance = (len(labels) / np.maximum(counts, 1) / len(languages)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            batch, want = windows[chosen], labels[chosen]
            pooled, places = net.pooled(batch)
            active = np.maximum(pooled + net.bias, 0)
            error = net.chances(pooled)
            error[np.arange(len(want)), want] -= 1
            error *= balance[want][:, None] / len(want)
            back = (error @ net.out.T) * (active > 0)
            slopes = []
            for n, kernel in enumerate(net.filters):
                own = slice(n * FILTERS, (n + 1) * FILTERS)
                slope = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    seen = np.take_along_axis(batch, places[:, own] + k, 1)
                    np.add.at(slope[k], (seen, np.arange(FILTERS)), back[:, own])
                slopes.append(slope)
            slopes += [back.sum(0), active.T @ error, error.sum(0)]
            step += 1
            for weight, slope, (m, v) in zip(weights, slopes, moments):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, windows_each: int = WINDOWS_EACH, languages: int = LANGUAGES) -> Network | None:
    """A network for the labels in ``docs``, from a sample bounded by the parameters."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(
        F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    )
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r["lang"]: r["n"] for r in sizes.collect()}
    names = sorted(counts)
    if not names:
        return None
    # the share of each label that gives per_language documents on the average
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for l in names for x in (l, min(1.0, per_language / counts[l]))])
    chosen = labelled.where(draw < F.element_at(share, F.col("lang")))
    span = F.greatest(F.length("text") - WINDOW, F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(windows_each - 1)),
        lambda i: F.substring(F.col("text"), (F.floor(span * i / max(windows_each - 1, 1)) + 1).cast("int"), F.lit(WINDOW)),
    )
    rows = chosen.select("lang", F.explode(F.array_distinct(pieces)).alias("piece")).collect()
    windows = np.concatenate([windows_of(r["piece"])[0][:1] for r in rows] or [np.zeros((0, WINDOW), np.uint8)])
    labels = np.array([names.index(r["lang"]) for r in rows], int)
    order = np.lexsort([windows[:, k] for k in range(8)] + [labels]) if len(rows) else []
    return fit(windows[order], labels[order], names)


def predict_batch(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Labels and scores. All windows of the texts go through the network in blocks."""
    parts = [windows_of(t or "") for t in texts]
    windows = np.concatenate([p[0] for p in parts])
    sizes = np.concatenate([p[1] for p in parts]).astype(float)
    chances = np.concatenate(
        [net.chances(net.features(windows[at : at + 32])) for at in range(0, len(windows), 32)]
    )
    starts = np.cumsum([0, *[len(p[0]) for p in parts[:-1]]])
    mass = np.add.reduceat(chances * np.maximum(sizes, 1)[:, None], starts)
    mean = mass / np.add.reduceat(np.maximum(sizes, 1), starts)[:, None]
    best = mean.argmax(1)
    return [net.languages[b] for b in best], mean[np.arange(len(best)), best].clip(0, 1).tolist()


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; a column of those names is replaced."""
    others = docs.drop("lang_pred", "score")
    if net is None:
        return others.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = replace(net)  # about 150 KB of weights, without the tables which tasks build of them
    readable = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    fed = others.withColumn("_letters", F.coalesce(readable, F.lit(False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            letters = batch.column("_letters").to_pylist()
            column = batch.column("text").to_pylist()
            asked = [t for t, yes in zip(column, letters) if yes]
            labels, scores = predict_batch(sent, asked) if asked else ([], [])
            found = iter(zip(labels, scores))
            both = [next(found) if yes else (UNKNOWN, 0.0) for yes in letters]
            kept = [n for n in batch.schema.names if n != "_letters"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    schema = StructType([*others.schema, *StructType.fromDDL("lang_pred string, score double")])
    return fed.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
