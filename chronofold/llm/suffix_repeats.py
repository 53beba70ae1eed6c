"""Repeated byte strings by an enhanced suffix array over sampled suffixes.

The suffixes are those that start at minimizers, so every repeated string of 50 bytes holds
one at the same place in each occurrence. Sorted by their right contexts, with the lengths of
neighbours' common prefixes, they are scanned with a stack into the common-prefix interval
tree, and each interval is split by its left extensions into maximal repeats with all their
occurrences; see repeats.repeat_groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.repeats import Units, list_repeats, remove_repeats

LENGTH = 50
#: Bytes of a minimizer; a string of LENGTH bytes has LENGTH - GRAM + 1 of them to choose from.
GRAM = 24
WINDOW = LENGTH - GRAM + 1


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, doubling the hashed length in each step."""
    n = len(text) - GRAM + 1
    now = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    now ^= now >> np.uint64(29)
    size, done, out = 1, 0, None
    while True:
        if GRAM & size:
            part = now[done : done + n]
            out = part.copy() if out is None else out * np.uint64(0xD6E8FEB86659FD93) ^ part
            done += size
        if 2 * size > GRAM:
            break
        m = len(now) - size
        now = now[:m] * np.uint64(0xD6E8FEB86659FD93) + (now[size:] ^ np.uint64(0x632BE59BD9B4E019))
        now ^= now >> np.uint64(32)
        now *= np.uint64(0x9FB21C651E98DF25)
        size *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = op(values[:-size], values[size:])
        size *= 2
    return op(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def byte_anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position and reach of every place that is the minimizer of some 50 bytes.

    All places of equal smallest hash count, so what 50 bytes pick depends on nothing else.
    """
    if len(text) < LENGTH:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    hashes = _gram_hashes(np.frombuffer(text, dtype=np.uint8))
    low = _sliding(hashes, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    pos = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), WINDOW, np.maximum) == hashes)
    return hashes[pos], pos, np.minimum(pos, WINDOW - 1), np.minimum(len(text) - pos, LENGTH)


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    found = [byte_anchors(t) for t in texts]
    own = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    return own, *(np.concatenate(c) for c in zip(*found, strict=True))


def _keep(text: bytes, start: list[int], end: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True))


BYTES = Units(
    length=LENGTH,
    anchors=anchors_of,
    cut=lambda text: text,
    context=lambda text, a, b: text[a:b],
    split=lambda lines: [np.frombuffer(x, dtype=np.uint8) for x in lines],
    keep=_keep,
    within_document=False,
)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of 50 bytes and more across rows: group, length, n_documents, occurrences; see list_repeats."""
    return list_repeats(docs, BYTES, id_col, text_col)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (bytes), spans.

    Removed is each byte of the UTF-8 text that is covered by a 50-byte string which also starts
    in a row with a smaller id; spans are the maximal removed runs. Null texts are empty, texts
    under 50 bytes lose nothing, and matches never cross rows. Rows without an id come after all
    others and keep what they share with each other unless their texts are equal to another
    row's; rows that repeat an id do not remove from each other. Other columns are ignored.
    """
    return remove_repeats(docs, BYTES, id_col, text_col).withColumnRenamed("n_units", "n_bytes")


def repeated_byte_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As remove_repeated_bytes, with kept_sha256 in place of the bytes."""
    made = remove_repeats(docs, BYTES, id_col, text_col, lambda kept: hashlib.sha256(kept).hexdigest().encode())
    return made.select(id_col, F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
