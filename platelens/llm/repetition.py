"""Quality rules with suffix-array repetition.

A suffix array over the words of each text, built by prefix doubling for many
texts at once, gives the longest common prefix of neighbouring suffixes; its
intervals are the repeated substrings. Spans of all maximal repeats of at least
MIN_REPEAT words are united, and a text is rejected if they cover too much of it
or if one repeat is too long. Whole texts, no shuffle: a text's row is all that
is needed, and the arrays of one batch are bounded by _SPAN bytes or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, runs_of

MIN_REPEAT = 8            # words, a power of two
MAX_COVERED = 0.30        # of the bytes in words
MAX_REPEAT = 64           # words of the longest repeat
MIN_WORDS = 20
SYMBOLS = b"#*$%&|<>"
_SPAN = 2 << 20

_SCHEMA = ("_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "longest_repeat long, covered double")


def _doubled(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of all positions and the ranks by the first 1, 2, 4, ... words.

    words: ids that no two texts share; ends: for each position, the end of its
    text. Only positions that still share their rank are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    key = words[order]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    while True:
        r = rank[order]
        tied = np.zeros(n, bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order, levels
        pos = order[at]
        ahead = pos + step
        second = np.where(ahead < ends[pos], rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[pos] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        pos, both = pos[by], both[by]
        order[at] = pos
        start = np.r_[True, both[1:] != both[:-1]]
        rank[pos] = np.maximum.accumulate(np.where(start, at, 0))
        levels.append(rank.copy())
        step *= 2


def longest_repeats(words: np.ndarray, ends: np.ndarray, least: int = MIN_REPEAT) -> np.ndarray:
    """For each position, how many words from it on occur elsewhere in its text
    too, at the longest; 0 where fewer than ``least`` (a power of two) do."""
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order, levels = _doubled(words, ends)
    k = least.bit_length() - 1
    if k >= len(levels):
        return out
    levels = [np.r_[x, -1 - np.arange(1)] for x in levels]
    base = levels[k]
    i = np.flatnonzero(base[order[1:]] == base[order[:-1]])
    a, b = order[i].copy(), order[i + 1].copy()
    left, right = a.copy(), b.copy()
    lcp = np.zeros(len(i), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same = levels[j][a] == levels[j][b]
        lcp[same] += 1 << j
        a[same] += 1 << j
        b[same] += 1 << j
    np.maximum.at(out, left, lcp)
    np.maximum.at(out, right, lcp)
    return out


def _measured(texts: list[bytes]) -> list[tuple]:
    """The measures of several texts, through one suffix array."""
    ids: dict[bytes, int] = {}
    per, lens, counts = [], [], []
    for d in texts:
        words = d.split()
        counts.append(len(words))
        per.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
        lens.append(np.fromiter(map(len, words), np.int64, len(words)))
    bounds = np.r_[0, np.cumsum(counts)]
    words = np.concatenate(per) + np.repeat(np.arange(len(texts)) * (len(ids) + 1), counts)
    sizes = np.concatenate(lens)
    rep = longest_repeats(words, np.repeat(bounds[1:], counts))
    n = len(words)
    # the union of the spans [i, i + rep[i])
    reach = np.maximum.accumulate(np.where(rep > 0, np.arange(n) + rep, 0)) if n else rep
    inside = reach > np.arange(n)
    out = []
    for t, d in enumerate(texts):
        s, e = int(bounds[t]), int(bounds[t + 1])
        lines = [x for x in d.split(b"\n") if x.strip()]
        total = int(sizes[s:e].sum())
        hit = inside[s:e]
        white = sum(d.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        out.append((e - s, len(d.decode("utf-8", "replace")) - white, sum(d.count(SYMBOLS[k:k + 1]) for k in range(len(SYMBOLS))),
                    len(lines) - len(set(lines)), int(hit.sum()), int(rep[s:e].max(initial=0)),
                    float(sizes[s:e][hit].sum() / total) if total else 0.0))
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and the measures named in ``judged``; null text has no words."""
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in b.column(1).to_pylist()]
            rows = []
            for s, e in runs_of(np.array([len(t) for t in texts]), _SPAN):
                rows += _measured(texts[s:e])
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "longest_repeat", "covered"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        of, _SCHEMA.format(id=kind))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, longest_repeat, covered, kept.

    Words are runs without ASCII white space. n_repeat_words counts words in
    repeated windows of MIN_REPEAT words: the union of all maximal repeats of at
    least that length. base_failed: under MIN_WORDS words, or over 30 % of them
    repeated. kept: not base_failed, covered (the bytes of words inside repeats)
    at most MAX_COVERED and longest_repeat at most MAX_REPEAT. Null and empty
    texts have zeros and fail the base rule; repeated rows are judged each; other
    columns are not read; no rows give no rows.
    """
    m = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (m.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("covered") <= MAX_COVERED)
                        & (F.col("longest_repeat") <= MAX_REPEAT))
            .withColumnRenamed("_id", id_col)
            .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "longest_repeat", "covered"))
