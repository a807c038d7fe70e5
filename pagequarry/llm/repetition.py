"""Quality rules by suffix-array repetition, over words.

For each text the suffix array of its words is built by prefix doubling, many
texts in one numpy sort. The longest-common-prefix intervals give, for every
word, the longest repeated run of words that starts there: these runs are the
maximal repeated substrings and all their tails. Their spans are joined, and
the rule limits the share of words covered and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, read, text_chunks, trim, with_fields

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_repeats(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that occurs at
    another place of the same text. ``bounds``: first word of each text, and the end."""
    n = len(words)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(bounds[1:], sizes)
    _, code = np.unique(words, return_inverse=True)
    key = text * (int(code.max()) + 1) + code
    order = np.argsort(key)

    def ranked(key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (slot of the first of equals) and whether it has an equal."""
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        several = np.diff(np.append(first, len(key))) > 1
        which = np.cumsum(new) - 1
        return slots[first][which], several[which]

    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n)
    rank[order], tied = ranked(key[order], slots)
    levels, h, slots = [rank.astype(np.int32)], 1, slots[tied]
    while len(slots):
        at = order[slots]
        after = np.where(at + h < end[at], rank[np.minimum(at + h, n - 1)], -1)
        key = rank[at] * (n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        order[slots] = at = at[by]
        new, tied = ranked(key[by], slots)
        rank[at] = new
        levels.append(rank.astype(np.int32))
        h, slots = 2 * h, slots[tied]

    best = np.zeros(n + 1, dtype=np.int64)
    pairs = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b = order[pairs], order[pairs + 1]
    lcp = np.zeros(len(pairs), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        lcp += ((a + lcp < end[a]) & (b + lcp < end[b]) & (levels[k][p] == levels[k][q])).astype(np.int64) << k
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best[:n]


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeated run of at least ``least`` words."""
    at = np.flatnonzero(repeats >= least)
    mark = np.zeros(len(repeats) + 1, dtype=np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + repeats[at], -1)
    return np.cumsum(mark[:-1]) > 0


def _sum_by(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def stats_of(data: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """The columns of STATS for consecutive texts."""
    start, end, h, bounds = hash_words(data, offsets)
    repeats = suffix_repeats(h, bounds)
    lead = (data & 0xC0) != 0x80
    letters = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    chars = letters[end] - letters[start]
    longest = np.zeros(len(offsets) - 1, dtype=np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        longest[some] = np.maximum.reduceat(repeats, bounds[:-1][some])
    lines = np.zeros(len(offsets) - 1, dtype=np.int64)
    raw = data.tobytes()
    for i in range(len(lines)):
        text = raw[offsets[i] : offsets[i + 1]]
        if b"\n" in text:
            full = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            lines[i] = len(full) - len(set(full))
    return np.stack([np.diff(bounds), _sum_by(chars, bounds), _sum_by(_SYMBOL[data], offsets), lines, _sum_by(covered(repeats, 3), bounds), _sum_by(covered(repeats, least), bounds), longest])


def repetition(docs: DataFrame, least: int = 8, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and those of STATS for each row's whole text.

    ``docs`` needs text; a column that bears a name of STATS gives way to it. Null, empty and white texts have zeros. A text of any length is
    taken whole, in memory that is linear in it.
    """
    names = [x.split()[0] for x in STATS.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    docs = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in text_chunks(batch.column("text")):
                rows = batch.slice(i, len(offsets) - 1)
                made = stats_of(data, offsets, least)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *[pa.array(x, pa.int64()) for x in made]], names=[*keep, *names])
            trim()

    return docs.mapInArrow(run, with_fields(docs.select(*keep), STATS))


def judged(stats: DataFrame, max_percent: int = 30, max_repeat: int = 100) -> DataFrame:
    """Adds base_failed and kept. A text fails by the method if repeats cover more
    than ``max_percent`` of its words or the longest has more than ``max_repeat``."""
    n = F.col("n_words")
    base = (n < 50) | (F.col("n_repeat_words") * 100 > n * 50)
    bad = (F.col("n_covered_words") * 100 > n * max_percent) | (F.col("longest_repeat") > max_repeat)
    return stats.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~bad)


def op4_repetition(spark, sf_dir: str) -> DataFrame:
    stats = judged(repetition(read(spark, sf_dir, "documents"), keep=["doc_id"]))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", (F.col("longest_repeat") > 100).alias("over_100"))
