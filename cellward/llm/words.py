"""Words of whole texts as whole-number codes, for operators that run in tasks.

A word is a longest stretch without the six white-space characters of ASCII, so a text splits alike
as bytes and as characters. Splitting and numbering happen in Arrow, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``size`` bytes of text, or one row that is longer."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's begin: ``bounds[i]:bounds[i + 1]``. Null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    words = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a blank text splits into one empty word
    if not real.all():
        words = words.filter(pa.array(real))
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    return words, bounds


def number(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words that codes count from 0."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
