"""Vectorised counts over the words, lines and bytes of many whole texts."""

from __future__ import annotations

import numpy as np

from plumbline.llm.text import Words, mix
from plumbline.llm.text import span_hashes as spans

SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def lut(*members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"".join(m if isinstance(m, bytes) else bytes(m) for m in members))] = True
    return out


IS_SYMBOL = lut(SYMBOLS)
IS_UPPER, IS_LOWER, IS_DIGIT = lut(range(65, 91)), lut(range(97, 123)), lut(range(48, 58))
IS_HIGH = lut(range(128, 256))
IS_TAIL = lut(range(128, 192))  # continuation bytes: all others begin a code point
IS_PUNCT = lut(range(33, 48), range(58, 65), range(91, 97), range(123, 127))
IS_STOP = lut(b".!?\"')")
IS_LETTERISH = IS_UPPER | IS_LOWER | IS_DIGIT | IS_HIGH


def running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])


def chars_in_words(words: Words) -> np.ndarray:
    """Code points of each word."""
    total = running(~IS_TAIL[words.data])
    return total[words.end] - total[words.start]


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each \\n-split line that has a word."""
    is_break = words.data == 10
    cut = np.unique(np.concatenate([np.flatnonzero(is_break) + 1, words.offsets]))
    start, end = cut[:-1], cut[1:]
    end = end - ((end > start) & is_break[np.maximum(end - 1, 0)] if len(end) else 0)
    doc = np.searchsorted(words.offsets, start, "right") - 1
    has = np.searchsorted(words.start, start) < np.searchsorted(words.start, np.maximum(end, start))
    return doc[has], start[has], end[has]


def span_hashes(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans(words.padded, start, end - start)


def repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks items whose (document, hash) was there before, in the order given."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    again = np.zeros(len(h), bool)
    again[order[1:]] = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    return again


def repeated_words(words: Words, h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks each word that is in a window of ``window`` words found twice or more in its text."""
    n = len(h)
    out = np.zeros(n, bool)
    if n < window:
        return out
    doc = words.doc()
    w = np.zeros(n - window + 1, np.uint64)
    for i in range(window):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : n - window + 1 + i]
    inside = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    key = mix(w[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = same[1:] | same[:-1]
    begin = np.zeros(n + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(begin, hit, 1)
    np.add.at(begin, hit + window, -1)
    return np.cumsum(begin[:-1]) > 0
