"""Repeated word sequences by recompression.

Rounds name runs of equal symbols and pairs of neighbouring symbols, so a text shrinks by a
constant factor each time. A name is a hash of what it stands for and the side of a pair that
a symbol can be on follows from its name: tasks agree on all names without exchanging a
dictionary, and equal word sequences get equal symbols inside, apart from their ends. Symbols
of a high level that occur again reveal long repeats; words around them verify those.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.repeats import Units, remove_repeats

LENGTH = 20
#: Rounds. With the words that it depends on, a symbol of the third level fits into LENGTH words nearly
#: always, one of the fifth mostly not; and the more levels windows pick from, the more anchors there are.
ROUNDS = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Level:
    """Symbols of one level, of many texts in a row.

    Symbol k has a name and stands for words start[k] to end[k] of text[k]; low[k] to high[k] are
    the words that its forming depends on, a word beyond its text where it depends on an end.
    All of these rise along the symbols.
    """

    def __init__(self, text: np.ndarray, name: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.text, self.name, self.start, self.end, self.low, self.high = text, name, start, end, low, high


def _beside(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """How far each symbol's left neighbour reaches down and its right neighbour up."""
    same = level.text[1:] == level.text[:-1]
    down = np.r_[-1, np.where(same, level.low[:-1], level.start[1:] - 1)]
    up = np.r_[np.where(same, level.high[1:], level.end[:-1] + 1), level.end[-1:] + 1]
    return down, up


def name_runs(level: Level) -> Level:
    """Each longest run of one name becomes a symbol; it depends on both neighbours, which end it."""
    n = level.name
    first = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (level.text[1:] != level.text[:-1])])
    last = np.r_[first[1:] - 1, len(n) - 1]
    down, up = _beside(level)
    size = (last - first + 1).astype(np.uint64)
    name = np.where(size > 1, _mix(n[first] ^ size * np.uint64(0x9E3779B97F4A7C15)), n[first])
    return Level(level.text[first], name, level.start[first], level.end[last], down[first], up[last])


def name_pairs(level: Level, number: int) -> Level:
    """Each left symbol before a right one becomes a pair; a symbol alone depends on the neighbour that it missed.

    A symbol is left or right by a bit of its name in this round, so pairs cannot overlap.
    """
    is_left = (_mix(level.name + np.uint64(number + 1)) & np.uint64(1)).astype(bool)
    opens = np.r_[is_left[:-1] & ~is_left[1:] & (level.text[1:] == level.text[:-1]), False]
    down, up = _beside(level)
    low, high, name, end = np.where(is_left, level.low, down), np.where(is_left, up, level.high), level.name.copy(), level.end.copy()
    a = np.flatnonzero(opens)
    low[a], high[a], end[a] = level.low[a], level.high[a + 1], level.end[a + 1]
    name[a] = _mix(level.name[a] * np.uint64(0x9E3779B97F4A7C15) ^ _mix(level.name[a + 1]))
    at = np.flatnonzero(~np.r_[False, opens[:-1]])
    return Level(level.text[at], name[at], level.start[at], end[at], low[at], high[at])


def levels(words: list[bytes], text: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Words, then the symbols of each round.

    Runs are named in the first round. Later ones name pairs alone: a run of pairs is then not
    shortened, but symbols depend on fewer words around them, so shorter windows see them.
    """
    digest = xxhash.xxh64_intdigest
    at = np.arange(len(words))
    now = Level(text, np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)), at, at + 1, at, at + 1)
    out = [now]
    now = name_runs(now)
    for k in range(rounds):
        now = name_pairs(now, k)
        out.append(now)
    return out


def word_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, position and reach of the symbols that stand for windows of 20 words.

    A window sees a symbol that forms from its words alone. Of those of the highest level that
    it sees, the one of smallest name stands for it: a choice by content. Every window sees its
    words, the symbols of level 0.
    """
    parts = [t.split() for t in texts]
    sizes = np.array([len(p) if len(p) >= LENGTH else 0 for p in parts], dtype=np.int64)
    words = [w for p, n in zip(parts, sizes.tolist(), strict=True) if n for w in p]
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    none = np.empty(0, dtype=np.int64)
    if not words:
        return none, none.astype(np.uint64), none, none, none
    windows = np.flatnonzero(np.arange(len(words)) + LENGTH <= (begin + sizes)[text])
    found: list[tuple[np.ndarray, ...]] = []
    for number, level in reversed(list(enumerate(levels(words, text)))):
        # Bounds rise along the texts, so the symbols that a window sees are neighbours.
        a = np.searchsorted(level.low, windows)
        b = np.searchsorted(level.high, windows + LENGTH, side="right")
        sees = b > a
        chosen = np.unique(_lowest_within(level.name, a[sees], b[sees]))
        windows = windows[~sees]
        own, start = level.text[chosen], level.start[chosen]
        found.append((
            own, _mix(level.name[chosen] + np.uint64(number)), start - begin[own],
            start - np.maximum(begin[own], level.high[chosen] - LENGTH), np.minimum((begin + sizes)[own], level.low[chosen] + LENGTH) - start,
        ))
        if len(windows) == 0:
            break
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _lowest_within(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The index of the smallest name in each range a to b; of equals the first."""
    best, active, step = a.copy(), np.arange(len(a)), 1
    while len(active := active[a[active] + step < b[active]]):
        k = a[active] + step
        better = name[k] < name[best[active]]
        best[active[better]] = k[better]
        step += 1
    return best


def _words_apart(lines: list[bytes]) -> list[np.ndarray]:
    """Each line's words as numbers from 1, equal for equal words."""
    numbers = defaultdict(count(1).__next__)
    ends = np.cumsum([line.count(b" ") + 1 for line in lines]).tolist()
    flat = np.fromiter(map(numbers.__getitem__, b" ".join(lines).split(b" ")), dtype=np.uint32, count=ends[-1] if ends else 0)
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _keep(words: list[bytes], start: list[int], end: list[int]) -> bytes:
    return b" ".join(w for a, b in zip([0, *end], [*start, len(words)], strict=True) for w in words[a:b])


WORDS = Units(
    length=LENGTH,
    anchors=word_anchors,
    cut=lambda text: text.split(),
    context=lambda words, a, b: b" ".join(words[a:b]),
    split=_words_apart,
    keep=_keep,
    within_document=True,
)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, n_spans, kept (words joined by a space), spans.

    Words are runs of bytes other than ASCII white space, unchanged. Removed is each word
    covered by 20 consecutive words which also start earlier: in a row with a smaller id, or
    before them in the same row. Null texts have no words; texts of fewer than 20 words lose
    nothing. Rows without an id come after all others; rows that repeat an id are in the order
    of a hash of their texts, and rows equal in both are one. Other columns are ignored.
    """
    made = remove_repeats(docs, WORDS, id_col, text_col)
    return made.withColumnRenamed("n_units", "n_words").withColumn("kept", F.col("kept").cast("string"))


def repeated_word_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As remove_repeated_words, with kept_sha256 in place of the text."""
    made = remove_repeats(docs, WORDS, id_col, text_col, lambda kept: hashlib.sha256(kept).hexdigest().encode())
    return made.select(id_col, F.col("n_units").alias("n_words"), "n_removed", F.col("kept").cast("string").alias("kept_sha256"))
