"""Tokens of a batch of texts, found on its bytes by array operations: a text in Python costs about a microsecond a token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomspark.functions.text import MAX_TOKEN

_IN = np.zeros(256, bool)
_IN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def split(texts: pa.Array, most: int | None = MAX_TOKEN) -> tuple[pa.Array, np.ndarray]:
    """(tokens, number in each text): runs of a-z and 0-9 in the order of the texts, as by ``flat_tokens``; without ``most`` of any length.

    Letters with accents and the like are bytes above 127 in UTF-8, so no token holds or ends within one.
    """
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    if held is None or ends[0] == ends[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # Texts lie without a gap: the first byte of one ends what its predecessor ended with.
    edges = ends[(ends > 0) & (ends < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    if most is not None and len(size) and size.max() > most:
        for i in np.flatnonzero(size > most):
            inside[start[i] : end[i]] = False
        start, size = start[size <= most], size[size <= most]
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    number = np.diff(np.searchsorted(start, ends))
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(data[inside])), number


def counted(texts: pa.Array) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(words, (text, word, count), (text, word, next word, count), number of terms of each text): tokens and pairs of neighbours of texts, each once a text.

    ``words`` are the different tokens of the batch, which the others number.
    """
    tokens, number = split(texts)
    coded = tokens.dictionary_encode()
    words, code, row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(texts)), number)
    n = max(len(words), 1)
    one, count = np.unique(row * n + code, return_counts=True)
    next_ = np.flatnonzero(row[:-1] == row[1:])
    if len(texts) * n * n < 2**62:
        two, twice = np.unique((row[next_] * n + code[next_]) * n + code[next_ + 1], return_counts=True)
        pairs = (two // (n * n), two // n % n, two % n, twice)
    else:
        pair, at = np.unique(code[next_] * n + code[next_ + 1], return_inverse=True)
        two, twice = np.unique(row[next_] * len(pair) + at, return_counts=True)
        pairs = (two // len(pair), pair[two % len(pair)] // n, pair[two % len(pair)] % n, twice)
    return words, (one // n, one % n, count), pairs, np.maximum(2 * number - 1, 0)
