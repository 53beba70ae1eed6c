"""Packing token sequences by the sum-of-squares rule.

Documents become pieces of at most ``capacity`` tokens. Only piece lengths travel: token ids
stay in the task that made them. Pieces are dealt at random to groups of a fixed mean size,
and each group is packed in one task, so the open bins that a group leaves (a few of its
thousands) are the only cost of packing groups apart.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_OF_TEXT = 2
#: Pieces that one packing group has on average.
GROUP_PIECES = 200_000
PIECES = "_id long, piece int, start long, length long, ids_crc32 long"

#: Places before a space or line end that no white space precedes.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_tokenizers: dict = {}
_pieces: dict = {}
#: Cached words; the cache is emptied when full, and at a task's end: Python workers live on.
_MOST_WORDS = 100_000


def _tokenizer(name: str):
    """The tiktoken encoding of the vocabulary for ordinary words, the strings of added tokens, and the bytes of each id."""
    if name not in _tokenizers:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        words = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        widths[list(ranks.values())] = [len(x) for x in ranks]
        _tokenizers[name] = words, special, widths
    return _tokenizers[name]


@cache
def _whole_tokenizer(name: str):
    """The tokenizers model, which only texts with added tokens' strings need."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def token_bytes(text: str, tokenizer: str) -> bytes:
    """The text's token ids as little-endian unsigned 32-bit numbers.

    A text is cut before each space or line end that follows another character: the
    vocabulary's pre-tokenizer always cuts there, so the parts are encoded apart, and those met
    before come from a cache. Texts with added tokens' strings go to the tokenizers model whole.
    """
    words, special, widths = _tokenizer(tokenizer)
    if any(s in text for s in special):
        return np.asarray(_whole_tokenizer(tokenizer).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    if len(_pieces) > _MOST_WORDS:
        _pieces.clear()
    if "\0" in text:
        parts = _parts(text)
    elif any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or _OTHER_SPACE.search(text):
        parts = _CUT.sub("\0", text).split("\0")
    else:
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    out = list(map(_pieces.get, parts))
    if None in out:
        missing = list({x for x, ids in zip(parts, out, strict=True) if ids is None})
        found = dict(zip(missing, _encode_parts(missing, words, widths), strict=True))
        _pieces.update((x, ids) for x, ids in found.items() if len(x) < 64)
        out = [found[x] if ids is None else ids for x, ids in zip(parts, out, strict=True)]
    return b"".join(out)


def _encode_parts(parts: list[str], words, widths: np.ndarray) -> list[bytes]:
    """Ids of each part, from one call: parts start where the pre-tokenizer cuts, also when put in a row."""
    if parts[0][:1] not in (" ", "\n"):
        head, parts = [array("I", words.encode_ordinary(parts[0])).tobytes()], parts[1:]
    else:
        head = []
    loose = {i for i, x in enumerate(parts) if x[:1] not in (" ", "\n") or x[-1:].isspace()}
    tied = [x for i, x in enumerate(parts) if i not in loose]
    ids = np.asarray(words.encode_ordinary("".join(tied)), dtype="<u4")
    ends = np.cumsum(np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in tied), dtype=np.int64, count=len(tied)))
    cuts = [0, *(np.searchsorted(np.cumsum(widths[ids]), ends) + 1).tolist()]
    raw = ids.tobytes()
    rows = iter([raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)])
    return head + [array("I", words.encode_ordinary(x)).tobytes() if i in loose else next(rows) for i, x in enumerate(parts)]


def _parts(text: str) -> list[str]:
    at = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of n tokens' pieces: all full but the first, which takes what is over."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = np.asarray([end], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"], batch["_text"], strict=True):
                ids = token_bytes(text or "", tokenizer) + tail
                key = None if pd.isna(key) else int(key)
                for k, (a, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    rows.append((key, k, a, n, zlib.crc32(memoryview(ids)[4 * a : 4 * (a + n)])))
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"]).astype({"_id": "Int64"})
        _pieces.clear()

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInPandas(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, placed in turn, and the number of bins.

    Bins of equal gap are alike, so the state is the count of open bins per gap. Placing s into
    a gap g takes one from count[g] and adds one to count[g - s]; a new bin has the gap
    ``capacity`` and count 0. The place with the least sum of squares is taken; of equals, the
    smallest gap.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    worst = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]  # a gap that closes adds no square
        change[count[s:] == 0] = worst
        change[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 0  # a new bin
        gap = int(change.argmin()) + s
        if gap == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
        bins[i], offsets[i] = b, capacity - gap
    return bins, offsets, n_bins


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """As sum_of_squares, but each length goes to the smallest gap that holds it."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins, offsets, n_bins = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        open_gap = count[s:] > 0
        k = int(open_gap.argmax())
        gap = k + s if open_gap[k] else capacity
        if open_gap[k]:
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            b, n_bins = n_bins, n_bins + 1
        stacks[gap - s].append(b)
        count[gap - s] += 1
        bins[i], offsets[i] = b, capacity - gap
    return bins, offsets, n_bins


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares over descending lengths; what lies in bins that stay open is packed once more.

    The rule keeps some hundred bins open on purpose, to have every gap at hand. At the end
    they have no further use, so their contents are placed again by best fit.
    """
    bins, offsets, n_bins = sum_of_squares(lengths, capacity)
    fill = np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
    left = np.flatnonzero(fill[bins] < capacity) if len(bins) else np.empty(0, dtype=np.int64)
    again, at, n_again = best_fit(lengths[left], capacity)
    if n_again < int((fill < capacity).sum()):
        bins[left], offsets[left] = n_bins + again, at
    return bins, offsets


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json",
    capacity: int = CAPACITY, end: int = END_OF_TEXT, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is tokenized whole and ends in the id ``end``; a null or empty text is
    that one id. A document of more than ``capacity`` tokens is cut into full pieces of which
    only the first may be shorter. Ids may be null or repeat; each row is packed for itself.
    An empty table gives no rows. Other columns are ignored.

    Full pieces are sequences of their own. The others go, longest first, to the open sequence
    that the sum-of-squares rule names; see pack_lengths.
    """
    from chronofold.llm.common import materialize

    cut = materialize(pieces(docs, id_col, text_col, tokenizer, capacity, end), "pack-pieces")
    short = cut.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = pack_lengths(rows["length"].to_numpy(), capacity)
        return rows.assign(bin=bins, offset=offsets)

    # The row's number deals repeated rows to all groups alike.
    dealt = short.withColumn("pack_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("pack_group").applyInPandas(place, f"{PIECES}, pack_group long, bin long, offset long")
    packed = packed.withColumn("sequence_id", (F.col("bin") * groups + F.col("pack_group")) * 2).drop("bin", "pack_group")
    full = cut.where(F.col("length") == capacity).select(
        "*", F.lit(0).cast("long").alias("offset"), (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id")
    )
    return packed.unionByName(full).withColumnRenamed("_id", id_col)
