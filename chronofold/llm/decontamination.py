"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words of which some are ignored, so a hash of the
others survives substitutions. Hashes of test items and of training texts are joined, and each
hit is verified by extending the overlap around it word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import broadcast_if_small, fresh_name, materialize
from chronofold.llm.license_scan import words_of

#: An overlap counts with so many words (or the whole of a shorter item) of which such a share is equal.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: Every overlap holds one of these seeds. A longer one has a half that counts, down to 13 to 25 words.
#: There, m words with e <= m / 5 changed have a run of at least (m - e) / (e + 1) equal ones, which is above 3
#: unless m = 15 and e = 3; and the only pattern of those without a run of four is the second seed.
SEEDS = ("1111", "111011101110111")
#: With at most so many test hashes, each task drops training hashes that no item has before the join.
FILTER_HASHES = 4_000_000
#: Bytes of items that are broadcast at once, at most.
BROADCAST_BYTES = 1 << 26

REGION = "_id long, first int, words string, hits array<struct<seed: int, at: int, hash: long>>"


def _masks(sizes: list[int]) -> list[tuple[int, np.ndarray]]:
    """(span, kept offsets) of all seeds: the spaced ones, and for each size of a short item those of the whole item.

    Where a short item may have e changed words, its words are cut into e + 2 blocks, and each
    seed leaves out e of them, so one seed leaves out whatever is changed.
    """
    out = [(len(m), np.flatnonzero([c == "1" for c in m])) for m in SEEDS]
    for n in sizes:
        changed = _changed(n)
        blocks = np.array_split(np.arange(n), changed + 2) if changed else [np.arange(n)]
        out += [(n, np.concatenate(kept)) for kept in combinations(blocks, len(blocks) - changed)]
    return out


def _changed(n: int) -> int:
    """Words of n that may differ."""
    return next(e for e in range(n, -1, -1) if n - e >= LEAST_SHARE * n)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def _seed_hashes(hashes: np.ndarray, number: int, mask: tuple[int, np.ndarray]) -> np.ndarray:
    """The seed's hash at each word where it fits."""
    span, kept = mask
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 * (number + 1) & (1 << 64) - 1))
    for k in kept.tolist():
        out ^= hashes[k : k + n]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _hits(hashes: np.ndarray, masks: list, wanted: np.ndarray | None, sieve: np.ndarray | None) -> list[tuple[int, int, int]]:
    out = []
    for number, mask in enumerate(masks):
        made = _seed_hashes(hashes, number, mask)
        at = np.arange(len(made))
        if wanted is not None and len(made):
            at = np.flatnonzero(sieve[(made >> np.uint64(40)).astype(np.int64)])
            got = made[at]
            k = np.minimum(np.searchsorted(wanted, got), len(wanted) - 1)
            at = at[wanted[k] == got]
        out += [(number, int(i), int(h)) for i, h in zip(at, made[at].view(np.int64), strict=True)]
    return out


def _regions(docs: DataFrame, masks: list, wanted: np.ndarray | None, reach: int, id_col: str, text_col: str) -> DataFrame:
    """Stretches of training texts that hold hits, with ``reach`` words around: those of the longest item, beyond which no overlap goes."""
    longest = max(span for span, _ in masks)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieve = None
        if wanted is not None:
            sieve = np.zeros(1 << 24, dtype=bool)
            sieve[(wanted >> np.uint64(40)).astype(np.int64)] = True
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"], batch["_text"], strict=True):
                words = words_of(text)
                hits = sorted(_hits(_word_hashes(words), masks, wanted, sieve), key=lambda x: x[1]) if words else []
                k = 0
                while k < len(hits):
                    end = k + 1
                    while end < len(hits) and hits[end][1] - hits[end - 1][1] <= longest:
                        end += 1
                    first = max(0, hits[k][1] - reach)
                    around = words[first : hits[end - 1][1] + longest + reach]
                    rows.append((
                        None if pd.isna(key) else int(key), first, b" ".join(around).decode("utf-8", "surrogatepass"),
                        [{"seed": s, "at": at - first, "hash": h} for s, at, h in hits[k:end]],
                    ))
                    k = end
            yield pd.DataFrame(rows, columns=["_id", "first", "words", "hits"]).astype({"_id": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInPandas(find, REGION)


def extend(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(start in the item, words, equal words) of the best overlap on a diagonal, zeros for none.

    ``shift`` is the document's position of the item's first word. Every stretch of LEAST_WORDS
    whose share of equal words is at least LEAST_SHARE counts; the one with the most equal words
    is taken. With equal words worth 1 - share and others minus share, that is the stretch of
    positive sum with most equal words; it begins and ends with an equal word. A shorter item
    counts as a whole.
    """
    if len(item) < LEAST_WORDS:
        if shift < 0 or shift + len(item) > len(doc):
            return 0, 0, 0
        equal = int((item == doc[shift : shift + len(item)]).sum())
        return (0, len(item), equal) if equal >= LEAST_SHARE * len(item) else (0, 0, 0)
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b <= a:
        return 0, 0, 0
    same = item[a:b] == doc[a + shift : b + shift]
    total = np.r_[0.0, np.cumsum(np.where(same, 1 - LEAST_SHARE, -LEAST_SHARE))]
    count = np.r_[0, np.cumsum(same)]
    best = (0, 0, 0)
    # The earliest start with a total no larger than an end's gives the longest stretch for that end.
    lows = np.minimum.accumulate(total)
    for end in np.flatnonzero(same).tolist():
        start = int(np.searchsorted(-lows, -(total[end + 1] + 1e-9)))
        while start <= end and not same[start]:
            start += 1
        equal = int(count[end + 1] - count[start])
        if equal > best[2] and end + 1 - start >= LEAST_WORDS:
            best = (a + start, end + 1 - start, equal)
    return best


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per training row and test item that overlap: id, item, doc_start, item_start, n_words, n_equal, share.

    Words are runs of ASCII letters and digits and of characters outside ASCII, lower-cased in
    A-Z. Reported is the overlap with the most equal words around hits: at least 13 words, or
    the whole item where it is shorter, with at least four fifths equal. Every such overlap has
    a hit, so none is missed; an item of a word or two is found wherever they stand. Items
    without words are not looked for. Null ids are kept, as one row per item;
    repeated rows give a row once. Empty tables give no rows; other columns are ignored.

    All training texts are hashed whole, at every word. With few test hashes (their number is
    counted) tasks drop hashes that no item has before the join; else all of them are joined.
    """
    def number_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_of(t) for t in batch["_text"]]
            yield pd.DataFrame({"item": batch["_id"].astype("Int64"), "item_words": [b" ".join(w).decode("utf-8", "surrogatepass") for w in words], "n": [len(w) for w in words]})

    items = materialize(
        benchmark.select(F.col(item_col).cast("long").alias("_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("_text"))
        .mapInPandas(number_items, "item long, item_words string, n int").where(F.col("n") > 0),
        "items",
    )
    reach, n_bytes = items.agg(F.max("n"), F.sum(F.octet_length("item_words"))).first()
    # Fewer than LEAST_WORDS sizes.
    sizes = sorted(r["n"] for r in items.where(F.col("n") < LEAST_WORDS).select("n").distinct().collect())
    masks = _masks(sizes)

    def hash_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, line, n in zip(batch["item"], batch["item_words"], batch["n"], strict=True):
                hashes = _word_hashes(line.encode("utf-8", "surrogatepass").split(b" "))
                for seed, mask in enumerate(masks):
                    if (n >= LEAST_WORDS) == (seed < len(SEEDS)) and (n >= LEAST_WORDS or mask[0] == n):
                        made = _seed_hashes(hashes, seed, mask).view(np.int64)
                        rows += [(None if pd.isna(item) else int(item), seed, h, at) for at, h in enumerate(made.tolist())]
            yield pd.DataFrame(rows, columns=["item", "seed", "hash", "item_at"]).astype({"item": "Int64"})

    tests = materialize(items.mapInPandas(hash_items, "item long, seed int, hash long, item_at int").distinct(), "test-hashes")
    distinct = tests.select("hash").distinct()
    wanted = None
    if distinct.count() <= FILTER_HASHES:
        wanted = np.sort(np.array([r["hash"] for r in distinct.collect()], dtype=np.int64).view(np.uint64))
        if len(wanted) == 0:
            wanted = np.zeros(1, dtype=np.uint64)
    regions = materialize(
        _regions(docs, masks, wanted, reach or 0, id_col, text_col).withColumn("region", F.monotonically_increasing_id()), "regions"
    )
    hits = regions.select("region", F.inline("hits"))
    small = broadcast_if_small(tests, tests.count())
    pairs = (
        hits.join(small, ["seed", "hash"]).select("region", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        .groupBy("region", "item").agg(F.collect_set("shift").alias("shifts"))
    )
    sized = pairs.join(regions.select("region", "_id", "first", "words"), "region")
    few = F.broadcast(items) if (n_bytes or 0) <= BROADCAST_BYTES else items
    joined = sized.join(few, sized["item"].eqNullSafe(items["item"])).select(
        "_id", "first", "words", "shifts", sized["item"].alias("item"), "item_words"
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, first, line, shifts, item, own in batch.itertuples(index=False):
                doc = _word_hashes(line.encode("utf-8", "surrogatepass").split(b" "))
                test = _word_hashes(own.encode("utf-8", "surrogatepass").split(b" "))
                at, n, equal, shift = max(((*extend(doc, test, int(s)), int(s)) for s in shifts), key=lambda x: (x[2], -x[1], -x[3]))
                if n:
                    rows.append((None if pd.isna(key) else int(key), None if pd.isna(item) else int(item), first + shift + at, at, n, equal, equal / n))
            yield pd.DataFrame(rows, columns=["_id", "item", "doc_start", "item_start", "n_words", "n_equal", "share"]).astype({"_id": "Int64", "item": "Int64"})

    kinds = "_id long, item long, doc_start int, item_start int, n_words int, n_equal int, share double"
    found = joined.mapInPandas(verify, kinds)
    best = found.groupBy("_id", "item").agg(
        F.max(F.struct("n_equal", (-F.col("n_words")).alias("fewer"), (-F.col("doc_start")).alias("earlier"), "item_start", "share")).alias("b")
    )
    return best.select(
        F.col("_id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.earlier")).alias("doc_start"), "b.item_start",
        (-F.col("b.fewer")).alias("n_words"), "b.n_equal", "b.share",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item, with all their columns.

    Rows go one by one, not by their ids: a row without an id, or one that shares the id of a
    contaminated row, stays if its own text is clean.
    """
    row = fresh_name(docs, "_row")
    rows = materialize(docs.select("*", F.monotonically_increasing_id().alias(row)), "leak-rows")
    bad = materialize(overlaps(rows, benchmark, row, text_col).select(row).distinct(), "contaminated")
    return rows.join(broadcast_if_small(bad, bad.count()), row, "left_anti").drop(row)
