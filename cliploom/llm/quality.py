"""Quality rules by suffix-array repetition (operator 4).

For each document a word-level suffix array is built (prefix doubling, all documents of a slice at once). Runs of
neighbours with a common prefix are its LCP intervals; those whose places differ in the word before are the maximal
repeated substrings. Their spans are united: a word that a repeat covers lies in the longest one from some place on,
so the union takes that one for each place. A document fails if the united spans of repeats of `long_words` words or
more cover more than `max_covered` of its words, or if its longest repeat has `longest_words` words or more and is
over `longest_share` of the document. The base rule counts repeats from `MIN_WORDS` words on.

Null and empty texts have no words: they fail the base rule on length. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import WordTable, sizes_of, slices, table

MIN_WORDS = 5
LONG_WORDS = 10
MAX_COVERED = 0.15
LONGEST_WORDS = 50
LONGEST_SHARE = 0.10
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_long_words long, longest_repeat long, n_maximal long"
)


def repeated_windows(codes: np.ndarray, owner: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Places whose next `width` words may occur twice in their text (by a 64-bit hash, so a superset)."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    window = owner[: n - width + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(width):
        window = window * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - width + 1 + k]
    places = np.flatnonzero(left[: n - width + 1] >= width)
    if len(places) < 2:
        return places[:0]
    window = window[places]
    by = np.argsort(window)
    same = window[by[1:]] == window[by[:-1]]
    return np.sort(places[by[np.r_[same, False] | np.r_[False, same]]])


def neighbours(codes: np.ndarray, first: np.ndarray, width: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours (a, b) in the suffix arrays with a common prefix of `width` words or more, and its length.

    The suffix array holds only suffixes that take part in a longer match, and those that follow them by `width`
    words: all others differ from every suffix before that.
    """
    n = len(codes)
    none = np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][owner] - np.arange(n)
    active = repeated_windows(codes, owner, left, width)
    if not len(active):
        return none, none, none
    padded = np.r_[codes + 1, np.zeros(width, np.int64)]
    members = np.union1d(active, (active + width)[left[active] > width])
    keys = [np.where(left[members] > k, padded[members + k], 0) for k in range(width)]
    by = np.lexsort((*keys[::-1], owner[members]))
    order = members[by]
    new = np.r_[True, np.any([np.diff(x[by]) != 0 for x in (owner[members], *keys)], axis=0)]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    levels, step = [rank], width
    alone = new & np.r_[new[1:], True]
    active = order[~alone]
    while len(active):
        follow = np.where(left[active] > step, rank[np.minimum(active + step, n)] + 1, 0)
        by = np.lexsort((follow, rank[active]))
        active, follow = active[by], follow[by]
        group = rank[active]
        head = np.r_[True, group[1:] != group[:-1]]
        new = head | np.r_[True, follow[1:] != follow[:-1]]
        at = np.arange(len(active))
        start = np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[active] = group + np.maximum.accumulate(np.where(new, at, 0)) - start
        levels.append(rank)
        alone = new & np.r_[new[1:], True]
        active = active[~alone]
        step *= 2
    order = members[np.argsort(rank[members])]
    a, b = order[:-1], order[1:]
    same = (levels[0][a] == levels[0][b]) & (left[a] >= width) & (left[b] >= width)
    a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        whole = (left[a] - common >= width << k) & (left[b] - common >= width << k)
        equal = whole & (levels[k][x] == levels[k][y]) & (levels[k][x] >= 0)
        common += np.where(equal, width << k, 0)
    going = np.ones(len(a), bool)
    for _ in range(width - 1):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        going &= (left[a] > common) & (left[b] > common) & (padded[x] == padded[y])
        common += going
    return a, b, common


def intervals(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """LCP intervals (length, i, j): neighbours i to j - 1, a run of the suffix array, have `length` words in common."""
    stack: list[tuple[int, int]] = []
    before = -1
    for k, (x, y, length) in enumerate(zip(a.tolist(), b.tolist(), common.tolist())):
        start = k
        while stack and (x != before or stack[-1][0] > length):
            held, start_ = stack.pop()
            yield held, start_, k
            start = start_ if x == before else k
        if not stack or stack[-1][0] < length:
            stack.append((length, start))
        before = y
    for held, start_ in stack:
        yield held, start_, len(a)


def repetition(codes: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS):
    """Per text: words covered by repeats of `min_words` and of `long_words` or more, the longest repeat, maximal ones."""
    texts, n = len(first) - 1, len(codes)
    a, b, common = neighbours(codes, first, min_words) if n else (np.zeros(0, np.int64),) * 3
    longest, maximal = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if not len(a):
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64), longest, maximal
    owner = np.repeat(np.arange(texts), np.diff(first))
    preceding = np.where(np.r_[True, owner[1:] != owner[:-1]], -1 - np.arange(n), np.r_[0, codes[:-1]])
    differing = np.r_[0, np.cumsum(preceding[a] != preceding[b])]
    for length, i, j in intervals(a, b, common):
        if differing[j] > differing[i]:
            text = owner[a[i]]
            maximal[text] += 1
            longest[text] = max(longest[text], length)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)

    def covered(least: int) -> np.ndarray:
        starts = np.flatnonzero(best >= least)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + best[starts], -1)
        return np.bincount(owner, np.cumsum(edges[:-1]) > 0, texts).astype(np.int64)

    return covered(min_words), covered(long_words), longest, maximal


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.encode("utf-8").split())
        seen.add(line)
    return n


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for i, j in slices(sizes_of(texts)):
            part = texts[i:j]
            words = WordTable(part)
            covered, long_covered, longest, maximal = repetition(words.codes, words.first)
            chars = [len(t) - sum(map(t.count, SPACES)) if t else 0 for t in part]
            symbols = [sum(map(t.count, SYMBOLS)) if t else 0 for t in part]
            columns = [np.diff(words.first), chars, symbols, list(map(duplicate_lines, part)), covered, long_covered, longest, maximal]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).cast(pa.int64()), *(pa.array(np.asarray(c, np.int64)) for c in columns)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_words", "longest_repeat", "n_maximal"],
            )


def quality(
    docs: DataFrame, max_covered: float = MAX_COVERED, longest_words: int = LONGEST_WORDS, longest_share: float = LONGEST_SHARE
) -> DataFrame:
    """Measures and verdict of each row of `docs` (doc_id, text); no shuffle, one pass."""
    n, rep, longest = F.col("n_words"), F.col("n_repeat_words"), F.col("longest_repeat")
    failed = (n < 10) | (100 * rep > 20 * n)
    too_much = (F.col("n_long_words") > max_covered * n) | ((longest >= longest_words) & (longest > longest_share * n))
    return (
        docs.select("doc_id", "text")
        .mapInArrow(measure, SCHEMA)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~too_much)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; the verdict is taken row by row, so no join brings it back."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(sizes_of(texts)):
                words = WordTable(texts[i:j])
                covered, long_covered, longest, _ = repetition(words.codes, words.first)
                n = np.diff(words.first)
                keep = (n >= 10) & (100 * covered <= 20 * n) & (long_covered <= MAX_COVERED * n)
                keep &= ~((longest >= LONGEST_WORDS) & (longest > LONGEST_SHARE * n))
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(passing, docs.schema)
