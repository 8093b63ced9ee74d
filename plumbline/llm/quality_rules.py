"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains on a text. Nothing is learned from labels: expectation-maximisation over
all texts estimates how often each rule is right about good and about bad texts, and the share of good texts; a text
is kept if its posterior probability of being good is at least ``THRESHOLD``. So one doubtful rule no longer rejects a
text that the others vouch for, as it does when all rules must pass.

EM needs no text, only how many texts have each pattern of votes: those counts are one aggregation over all rows, and
there are at most 3 ** len(RULES) patterns whatever the input's size. Repeated patterns are weighted by their count.

Edge cases: null, empty and blank texts have no words, all rules abstain, and the base test (fewer than 20 words)
rejects them; repeated rows count and are returned as often as they occur; an empty table gives an empty result;
extra columns pass through, those that have the name of an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import textstats as ts
from plumbline.llm.text import Words, map_arrow, slices
from plumbline.plans.lineage import cut

THRESHOLD = 0.5
MIN_WORDS = 20
WRONG = 0.02
#: Words in which the variety of a text is measured, so that it does not depend on the text's length.
PASSAGE = 2000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "word_length", "lines", "windows", "variety", "capitals", "endings", "bare", "shouts")


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _vote(good: np.ndarray, bad: np.ndarray, can: np.ndarray) -> np.ndarray:
    return np.where(can & bad, -1, np.where(can & good, 1, 0)).astype(np.int8)


def _repeats(w: Words, h: np.ndarray) -> np.ndarray:
    """The share of each text's words that occur more than once (as ts.repeats counts) in a passage of ``PASSAGE``
    words, the mean over its passages; the last one ends with the text, a shorter text is one passage."""
    k = np.maximum(-(-w.n // PASSAGE), 1)
    doc = np.repeat(np.arange(w.docs), k)
    size = np.minimum(w.n, PASSAGE)[doc]
    place = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    begin = w.first[doc] + np.minimum(place * PASSAGE, np.maximum(w.n - PASSAGE, 0)[doc])
    passage = np.repeat(np.arange(len(doc)), size)
    at = np.arange(len(passage)) + np.repeat(begin - (np.cumsum(size) - size), size)
    again = np.bincount(passage[ts.repeats(passage, h[at])], minlength=len(doc))
    return np.bincount(doc, _share(again, size), w.docs) / k


def measure(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(the base counts, the votes: a row for each text and a column for each rule)."""
    w = Words(column, lower=False)
    h, n = w.hashes(), w.n
    word_chars = w.sums(ts.chars_in_words(w))
    symbols = w.text_counts(ts.IS_SYMBOL[w.data])
    line_doc, start, end = ts.lines(w)
    dup = ts.repeats(line_doc, ts.span_hashes(w, start, end))
    n_lines = np.bincount(line_doc, minlength=w.docs)
    dup_lines = np.bincount(line_doc[dup], minlength=w.docs)
    in_windows = w.sums(ts.repeated_words(w, h).astype(np.int64))
    known = _repeats(w, h)
    upper, lower = w.text_counts(ts.IS_UPPER[w.data]), w.text_counts(ts.IS_LOWER[w.data])
    letters = ts.running(ts.IS_LETTERISH[w.data])
    bare = w.sums((letters[w.end] == letters[w.start]).astype(np.int64))
    shouts = w.text_counts(w.data == 33)
    last = w.end[np.maximum(np.searchsorted(w.start, end) - 1, 0)] - 1 if len(w.end) else end[:0]
    closed = np.bincount(line_doc[ts.IS_STOP[w.data[last]]], minlength=w.docs)
    counts = dict(zip(COUNTS, (n, word_chars, symbols, dup_lines, in_windows), strict=True))
    length, some, many = _share(word_chars, n), n >= 1, n >= 50
    votes = np.column_stack([
        _vote(_share(symbols, n) < 0.03, _share(symbols, n) > 0.1, some),
        _vote((length > 2.5) & (length < 11), (length < 2) | (length > 14), some),
        _vote(_share(dup_lines, n_lines) < 0.05, _share(dup_lines, n_lines) > 0.3, n_lines >= 4),
        _vote(_share(in_windows, n) < 0.1, _share(in_windows, n) > 0.25, many),
        _vote(known < 0.5, known > 0.75, many),
        _vote(_share(upper, upper + lower) < 0.2, _share(upper, upper + lower) > 0.5, upper + lower >= 20),
        _vote(_share(closed, n_lines) > 0.5, _share(closed, n_lines) < 0.1, many),
        _vote(_share(bare, n) < 0.03, _share(bare, n) > 0.15, some),
        _vote(_share(shouts, n) < 0.1, _share(shouts, n) > 0.4, some),
    ])
    return counts, votes


def votes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (long) and ``votes``, a number that has a digit to base 3 for each rule."""
    kept = [f for f in docs.schema if f.name not in {*COUNTS, "votes"}]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("votes", T.IntegerType())])
    base = 3 ** np.arange(len(RULES))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                counts, votes = measure(part.column(text))
                columns = [part.column(f.name) for f in kept] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
                code = ((votes.astype(np.int64) + 1) @ base).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code)], schema.fieldNames())

    return map_arrow(docs.select([f.name for f in kept]), run, schema)


def unpack(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(share of each class, rate[class, rule]) by expectation-maximisation over patterns of votes.

    Class 0 are the good texts; class r + 1 are the bad texts of the kind that rule r is about, as the rules do not
    err independently on bad texts: one that knows repetition passes all strings of symbols. rate is how often a rule,
    if it votes, votes bad, so its accuracy is 1 - rate on good texts and rate on bad ones. What tells the classes
    apart is only this: rules are wrong about ``WRONG`` of the good texts at most, and right about at least half of
    the bad texts that they are about. Each estimate has the weight of two made-up votes at its first value.
    """
    rules = votes.shape[1]
    begin = np.full((rules + 1, rules), 0.1)
    begin[0] = WRONG / 2
    own = (np.arange(1, rules + 1), np.arange(rules))
    begin[own] = 0.8
    rate, share = begin, np.array([0.8] + [0.2 / rules] * rules)
    for _ in range(rounds):
        weight = classes(votes, share, rate) * count[:, None]
        bad, cast = weight.T @ (votes == -1), weight.T @ (votes != 0)
        new = np.clip((bad + 2 * begin) / (cast + 2), 0.001, 0.995)
        new[0] = np.minimum(new[0], WRONG)
        new[own] = np.maximum(new[own], 0.5)
        s = (weight.sum(0) + 0.01) / (count.sum() + 0.01 * len(share))
        moved = max(np.abs(s - share).max(), np.abs(new - rate).max())
        share, rate = s, new
        if moved < 1e-6:
            break
    return share, rate


def classes(votes: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Posterior probability of each class for each row of votes."""
    logs = (votes == -1) @ np.log(rate).T + (votes == 1) @ np.log(1 - rate).T + np.log(share)
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def posterior(votes: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Posterior probability of being good."""
    return classes(votes, share, rate)[:, 0]


def quality(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, base_failed, p_good and kept."""
    out = [c for c in docs.columns if c not in {*COUNTS, "votes", "base_failed", "p_good", "kept"}]
    measured = votes_of(docs.select(out), text)
    if "doc_id" in out and len(out) == 2:
        measured = cut(measured.drop(text))  # a few numbers of each row: not worth measuring twice
    pattern = measured.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3 ** len(RULES) rows at most
    pattern.sort(key=lambda r: r.votes)
    code, count = np.array([r.votes for r in pattern], np.int64), np.array([r.n for r in pattern], float)
    if len(code):
        votes = unpack(code)
        p = posterior(votes, *estimate(votes, count))
    else:
        p = np.zeros(0)
    table = docs.sparkSession.createDataFrame(list(zip(code.tolist(), p.tolist())), "votes int, p_good double")
    n, again = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * again > 30 * n)
    scored = measured.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed)
    return scored.withColumn("kept", ~failed & (F.col("p_good") >= threshold)).drop("votes")
