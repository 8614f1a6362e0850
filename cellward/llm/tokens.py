"""Token counts of a unigram model, shared along a trie of pre-tokens.

The pieces are those of a public vocabulary file; a piece's score is the logarithm of its chance
under Zipf's law by its place in the file, as the file holds no counts. A word's best segmentation
has the largest sum of scores; a character that no piece covers costs its UTF-8 bytes.

In every batch the distinct pre-tokens (words between white space, with the mark for a beginning)
are put in order, which walks their trie: neighbours share a prefix, and the forward scores of the
shared prefix are computed once and kept on a stack. Each word's count is stored at its end, and
documents add up the counts of their words. Distinct words are remembered within a task, up to a
bound. Nothing is shuffled.

Defined results: null text is empty and has no tokens; a null or repeated ``doc_id`` is kept as it
is; an empty table gives no rows; further columns are ignored; texts count whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellward.llm.common import small_batches, table

MARK = "▁"
REMEMBERED = 300_000


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and their scores, from a sentencepiece file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    harmonic = sum(1 / (n + 1) for n in range(size))
    return {
        model.id_to_piece(i): -math.log((i + 1) * harmonic)
        for i in range(size)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class Trie:
    """Forward scores along words in order. ``byte_score`` is the score of one byte."""

    def __init__(self, pieces: dict[str, float], byte_score: float | None = None):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min(pieces.values(), default=-1.0) - 10 if byte_score is None else byte_score

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """The number of pieces of every word. ``scores[i]`` and ``many[i]`` belong to the first i
        characters of the last word; equal scores take fewer pieces."""
        pieces, longest, found = self.pieces, self.longest, {}
        scores, many, last = [0.0], [0], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :], many[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, least = scores[end - 1] + size * self.byte_score, many[end - 1] + size
                for begin in range(max(0, end - longest), end):
                    score = pieces.get(word[begin:end])
                    if score is not None:
                        total = scores[begin] + score
                        if total > best or (total == best and many[begin] + 1 < least):
                            best, least = total, many[begin] + 1
                scores.append(best)
                many.append(least)
            found[word] = many[-1]
            last = word
        return found


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(load_pieces(path))
        known: dict[str, int] = {}
        for batch in small_batches(batches, 500):
            split = [(t or "").split() for t in batch.column(1).to_pylist()]
            new = {w for words in split for w in words if w not in known}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {w for words in split for w in words}
            if new:
                made = trie.counts([MARK + w for w in new])
                known.update((w[1:], n) for w, n in made.items())
            sums = [sum(map(known.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, split)), pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("n_words", "long").add("n_tokens", "long"))


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_pieces())
