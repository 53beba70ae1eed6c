"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are made per document, then only distinct ones are compared. Two fingerprints
that differ in few bits agree on whole blocks of bits, so each goes to the buckets of its
block choices. Within a bucket bit planes are stored vertically: a machine word holds one bit
of 64 fingerprints, and carry-save counters add up 64 distances at a time. A bucket of more
than BUCKET rows is dealt in pairs of tiles, so that no task gets it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import broadcast_if_small, fresh_name, materialize, text_or_empty, with_groups
from chronofold.llm.components import components

RADIUS = 4
SEED = 42
#: Planes between two looks at whether a block may be abandoned.
STRIDE = 6
#: Rows of a bucket that one task compares; larger buckets are dealt in pairs of tiles.
BUCKET = 16_384
#: Rows that are compared at once, in whole buckets: many short buckets share the numpy calls.
BLOCK = 131_072


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of so many words, joined by spaces; of all words where there are fewer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    tails = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n], tails, strict=True)), dtype=np.uint64, count=n)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for none."""
    if len(hashes) == 0:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 4096):
        octets = hashes[a : a + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row, as a signed long."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = np.array([majority_bits(shingle_hashes(t, words)) for t in batch["_text"]], dtype=np.uint64)
            yield pd.DataFrame({"_id": batch["_id"].astype("Int64"), "fp": made.view(np.int64)})

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInPandas(make, "_id long, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of ``blocks - radius`` of the blocks: within the radius, two fingerprints agree under one."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(single, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose keys leave some 64 of n scattered fingerprints in a bucket.

    Any number above the radius finds every pair; more blocks mean smaller buckets and more copies.
    """
    for blocks in range(radius + 1, radius + 5):
        if n <= 64 << (64 * (blocks - radius) // blocks):
            return blocks
    return radius + 4


class _Planes:
    """Bit planes of fingerprints: word w of plane p holds bit p of fingerprints 64w to 64w+63."""

    def __init__(self, fps: np.ndarray) -> None:
        """``fps`` has a row of 64-bit words per fingerprint."""
        self.n, self.words = len(fps), -(-len(fps) // 64)
        bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little")
        room = np.zeros((bits.shape[1], 64 * (2 * self.words + 2)), dtype=np.uint8)
        room[:, : self.n] = bits.T
        self.planes = np.packbits(room, axis=1, bitorder="little").view(np.uint64)

    def near(self, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """Rows i of those wanted whose fingerprint is within the radius of row i + shift's.

        The counters' planes hold the distances of 64 pairs a word; a carry out of the last one
        marks a pair for good. Words in which no wanted pair can still be near are abandoned,
        and the loop ends when none is left.
        """
        lanes = np.zeros(self.words * 64, dtype=np.uint8)
        lanes[: len(wanted)] = wanted
        alive = np.packbits(lanes, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        alive = alive[at]
        step, turn = divmod(shift, 64)
        counters = [np.zeros(len(at), dtype=np.uint64) for _ in range((radius + 1).bit_length())]
        over = np.zeros(len(at), dtype=np.uint64)
        for p, plane in enumerate(self.planes):
            other = plane[at + step]
            if turn:
                other = (other >> np.uint64(turn)) | (plane[at + step + 1] << np.uint64(64 - turn))
            carry = plane[at] ^ other
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
            if p % STRIDE == STRIDE - 1 or p == len(self.planes) - 1:
                alive &= ~(over | _exceeds(counters, radius))
                left = np.flatnonzero(alive)
                if len(left) == 0:
                    return np.empty(0, dtype=np.int64)
                if len(left) < len(at):
                    at, alive, over, counters = at[left], alive[left], over[left], [c[left] for c in counters]
        bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, lane = np.nonzero(bits)
        return at[word] * 64 + lane


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius: compared from the highest bit down."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def bucket_links(
    fps: np.ndarray, bucket: np.ndarray, radius: int, joined: np.ndarray | None = None,
    accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints within the radius of each other, by bucket.

    Rows are sorted by bucket; a fingerprint is a row of words. Every pair of a bucket that is
    not yet connected is compared, one row distance at a time; pairs already connected are left
    out, so a dense group costs a few passes and gives one link per member. Rows of a bucket
    whose ``joined`` is equal are connected from the start. Of pairs within the radius only
    those that ``accept`` takes are links; the others connect nothing.
    """
    n = len(fps)
    parent = np.arange(n) if joined is None else _first_alike(bucket, joined)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    largest = int(np.diff(np.r_[starts, n]).max()) if n else 0
    if largest < 2:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    planes = _Planes(fps)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    left, right = [], []
    for shift in range(1, largest):
        wanted = (bucket[:-shift] == bucket[shift:]) & (parent[:-shift] != parent[shift:])
        if not wanted.any():
            continue
        hits = planes.near(shift, wanted, radius)
        if accept is not None and len(hits):
            hits = hits[accept(hits, hits + shift)]
        for i in hits.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                left.append(i)
                right.append(i + shift)
                parent[max(a, b)] = min(a, b)
        while len(hits) and (parent[parent] != parent).any():
            parent = parent[parent]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _first_alike(bucket: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Per row the first row of its bucket with the same ``joined``."""
    order = np.lexsort((joined, bucket))
    b, j = bucket[order], joined[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (j[1:] != j[:-1])][: len(b)]
    out = np.empty(len(b), dtype=np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def open_rows(fps: np.ndarray, bucket: np.ndarray, radius: int, joined: np.ndarray) -> np.ndarray:
    """Whether each row has another of its bucket within the radius whose ``joined`` differs.

    Pairs of which both rows are known to have one are not compared.
    """
    marked = np.zeros(len(fps), dtype=bool)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    largest = int(np.diff(np.r_[starts, len(fps)]).max()) if len(fps) else 0
    planes = _Planes(fps) if largest > 1 else None
    for shift in range(1, largest):
        wanted = (bucket[:-shift] == bucket[shift:]) & (joined[:-shift] != joined[shift:]) & ~(marked[:-shift] & marked[shift:])
        if wanted.any():
            hits = planes.near(shift, wanted, radius)
            marked[hits] = True
            marked[hits + shift] = True
    return marked


def _bucket_numbers(rows: pd.DataFrame) -> np.ndarray:
    key, tile = rows["key"].to_numpy(), rows["tile"].to_numpy()
    return np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])][: len(key)])


def _whole_buckets(work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], most: int = BLOCK) -> Callable:
    """Calls ``work`` on rows, sorted by key and tile, of whole buckets of two and more, and their bucket numbers."""

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        number = _bucket_numbers(rows)
        rows = rows[np.bincount(number)[number] > 1]
        return work(rows, _bucket_numbers(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch) == 0:
                continue
            held.append(batch)
            if sum(map(len, held)) < most:
                continue
            rows = pd.concat(held, ignore_index=True)
            number = _bucket_numbers(rows)
            cut = int(np.searchsorted(number, number[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield several(rows.iloc[:cut])
            held = [rows.iloc[cut:]]
        if held:
            yield several(pd.concat(held, ignore_index=True))

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with a bucket ``key``, partitioned and sorted by key and tile.

    Buckets are counted first. One of more than BUCKET rows is cut into tiles by a hash of the
    row, and each row goes to the pairs of its tile with every tile: any two rows of the bucket
    still meet, and no task holds more than two tiles of it.
    """
    large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET), "large-buckets")
    n_large = large.count()
    if n_large == 0:
        tiled = rows.withColumn("tile", F.lit(0).cast("long"))
    else:
        tiles = large.select("key", F.ceil(F.col("n") / BUCKET).cast("long").alias("tiles"))
        known = rows.join(broadcast_if_small(tiles, n_large), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
        known = known.withColumn("own", F.pmod(F.xxhash64(*rows.columns), F.col("tiles")))
        every = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        tiled = every.select(*rows.columns, (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("tile"))
    return tiled.repartition("key", "tile").sortWithinPartitions("key", "tile")


def fingerprint_links(distinct: DataFrame, radius: int, n: int) -> DataFrame:
    """(a, b): links that connect every two fingerprints of column fp within the radius."""
    masks = block_masks(radius, blocks_for(n, radius))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    # A key is a hash of the choice and its bits: two buckets that share one by chance are compared together.
    keyed = distinct.select("fp", F.inline(keys)).select(F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")

    def link(rows: pd.DataFrame, bucket: np.ndarray) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(dtype=np.int64)
        i, j = bucket_links(np.ascontiguousarray(fps).view(np.uint64).reshape(-1, 1), bucket, radius)
        return pd.DataFrame({"a": fps[i], "b": fps[j]})

    return _dealt(keyed).mapInPandas(_whole_buckets(link), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z and cut at ASCII white space; fingerprints that differ in at
    most ``radius`` (up to 7) bits are linked, and component_id is the smallest id that links
    reach. A null or empty text has fingerprint zero. Null ids have a component too, null where
    it has no other id; repeated rows are rows. An empty table gives no rows, and other columns
    of ``docs`` are ignored.
    """
    made = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = materialize(made.groupBy("fp").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    links = fingerprint_links(distinct.select("fp"), radius, distinct.count())
    roots = components(links)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    several = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    by_fp = materialize(rooted.join(several, "root").select("fp", "component_id", "n"), "simhash-components")
    # A row alone in its component is its own.
    return with_groups(made.withColumn("alone", F.col("_id")), by_fp, "fp", "n").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "alone").alias("component_id")
    )


# -- documents of a given similarity --------------------------------------------------------------

#: 64-bit words of a wide fingerprint.
WIDE = 4
#: A table's sampled bits, at least; with more rows there are more, so that scattered rows make buckets of this size.
TABLE_BITS, TABLE_ROWS = 14, 1024
#: The chance that no table brings two documents of the wanted similarity together.
MISSED = 0.01
#: Rows of a bucket whose shingles one task holds; more are dealt in pairs of tiles.
TILE = 1024
_FIELDS = [f"f{k}" for k in range(WIDE)]


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """Majority bits of the hashes and of three remixes of them."""
    out, now = [], hashes
    for k in range(WIDE):
        out.append(majority_bits(now))
        now = (now ^ (now >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        now ^= now >> np.uint64(32)
    return out


def bits_apart(jaccard: float) -> float:
    """The expected share of differing bits of two equally large sets: their cosine is 2j / (1 + j)."""
    return float(np.arccos(2 * jaccard / (1 + jaccard)) / np.pi)


def table_masks(n: int, jaccard: float) -> list[tuple[int, ...]]:
    """The sampled bits of each table, as a mask per word of a fingerprint.

    The more of n rows, the more bits a table samples, and as many tables as MISSED needs;
    which bits is fixed by a seed.
    """
    bits = max(TABLE_BITS, int(np.ceil(np.log2(max(1, n) / TABLE_ROWS))))
    tables = int(np.ceil(np.log(MISSED) / np.log1p(-((1 - bits_apart(jaccard)) ** bits))))
    chosen = np.random.default_rng(SEED)
    out = []
    for _ in range(tables):
        at = chosen.choice(64 * WIDE, bits, replace=False)
        out.append(tuple(_signed(sum(1 << int(b % 64) for b in at if b // 64 == k)) for k in range(WIDE)))
    return out


def _in_tables(prints: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row per fingerprint and table; its key is a hash of the table's number and bits."""
    tables = F.array(*[F.struct(F.lit(t).alias("table"), *[F.lit(m).cast("long").alias(f"m{k}") for k, m in enumerate(mask)]) for t, mask in enumerate(masks)])
    key = F.xxhash64("table", *[F.col(f"f{k}").bitwiseAND(F.col(f"m{k}")) for k in range(WIDE)])
    return prints.select("*", F.inline(tables)).select(key.alias("key"), *prints.columns)


def _words_of(rows: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(rows[_FIELDS].to_numpy(dtype=np.int64)).view(np.uint64)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, jaccard: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of near duplicates.

    Near duplicates share at least ``jaccard`` of the distinct ``words``-word shingles that they
    have together (cut as in near_duplicates), and groups are what links reach; the smallest id
    stays, an id before none, and of rows that repeat it one. Rows without words all stay. Null
    ids, repeated rows and other columns of any name are kept as they are; an empty table
    gives no rows.

    Candidates come from wide fingerprints in tables of sampled bits; the bit-sliced comparison
    finds those whose distance speaks for the similarity, with some room. Two passes verify them
    on the shingles themselves. In the first, a bucket gives a forest, and each row is verified
    against its nearest partner before it, so there is at most one pair a row. In the second,
    rows that still have a candidate which verified links do not connect them to bring their
    shingles along to the bucket, and every such pair there is verified on the spot, the links
    found connecting rows as it goes on. So no pair within the distance is left out, and what
    is written is links of a forest, never the pairs of a group. Groups are taken once, over
    all verified links.
    """
    row = fresh_name(docs, "_row")
    radius = round(64 * WIDE * bits_apart(jaccard - 0.15))
    rows = materialize(docs.select("*", F.monotonically_increasing_id().alias(row)), "similar-rows")
    texts = rows.select(F.col(row).alias("row"), text_or_empty(text_col).alias("_text"))
    prints = materialize(texts.mapInPandas(_wide(words), f"row long, {', '.join(f'{f} long' for f in _FIELDS)}"), "similar-prints")
    masks = table_masks(prints.count(), jaccard)
    ends = materialize(_nearest(_in_tables(prints, masks), radius), "similar-ends")
    n_ends = ends.count()
    if n_ends == 0:
        return rows.drop(row)
    sets = materialize(texts.join(broadcast_if_small(ends.select("row"), n_ends, 2_000_000), "row", "left_semi").mapInPandas(_shingle_sets(words), "row long, s array<long>"), "similar-sets")
    both = (
        ends.where("parent is not null").join(sets.select("row", F.col("s").alias("sb")), "row")
        .join(sets.select(F.col("row").alias("parent"), F.col("s").alias("sa")), "parent")
    )
    common = F.size(F.array_intersect("sa", "sb"))
    near = both.where(common >= jaccard * (F.size("sa") + F.size("sb") - common)).select(F.col("parent").alias("a"), F.col("row").alias("b"))
    links = materialize(near, "similar-links")
    roots = materialize(components(links), "similar-roots")
    active = prints.join(broadcast_if_small(ends.select("row"), n_ends, 2_000_000), "row", "left_semi").join(roots, F.col("row") == F.col("node"), "left")
    active = materialize(active.select(*prints.columns, F.coalesce("root", "row").alias("joined")), "similar-active")
    left_open = materialize(_open_members(_in_tables(active, masks), radius), "similar-open")
    if not left_open.isEmpty():
        more = materialize(_verified(left_open.join(sets, "row"), radius, jaccard), "similar-more")
        roots = materialize(components(links.unionByName(more)), "similar-roots")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("row"))
    members = rows.select(F.col(row).alias("row"), F.col(id_col).alias("_id")).join(roots, F.col("row") == F.col("node")).select("root", "row", order.alias("o"))
    members = materialize(members, "similar-members")
    stays = members.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    gone = materialize(members.select("row").join(stays, "row", "left_anti").withColumnRenamed("row", row), "similar-gone")
    return rows.join(broadcast_if_small(gone, gone.count(), 2_000_000), row, "left_anti").drop(row)


def _wide(words: int) -> Callable:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(r, wide_fingerprint(h)) for r, t in zip(batch["row"], batch["_text"], strict=True) if len(h := np.unique(shingle_hashes(t, words)))]
            fps = np.array([f for _, f in made], dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pd.DataFrame({"row": np.array([r for r, _ in made], dtype=np.int64)} | {f: fps[:, k] for k, f in enumerate(_FIELDS)})

    return make


def _shingle_sets(words: int) -> Callable:
    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "s": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch["_text"]]})

    return shingle


def _nearest(keyed: DataFrame, radius: int) -> DataFrame:
    """(row, parent): every row with another within the radius, and of the links of its buckets' forests the nearest row before it, or null."""

    def link(rows: pd.DataFrame, bucket: np.ndarray) -> pd.DataFrame:
        fps, row = _words_of(rows), rows["row"].to_numpy()
        i, j = bucket_links(fps, bucket, radius)
        apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int32)
        low, high = np.minimum(row[i], row[j]), np.maximum(row[i], row[j])
        return pd.DataFrame({"row": np.r_[high, low], "apart": np.r_[apart, apart], "parent": pd.array(np.r_[low, np.full(len(low), -1)], dtype="Int64")})

    found = _dealt(keyed).mapInPandas(_whole_buckets(link), "row long, apart int, parent long")
    best = F.min(F.when(F.col("parent") >= 0, F.struct("apart", "parent")))
    return found.groupBy("row").agg(best.alias("b")).select("row", F.col("b.parent").alias("parent"))


def _open_members(keyed: DataFrame, radius: int) -> DataFrame:
    """Rows of buckets in which they have a candidate that is not ``joined`` with them; tiles hold about TILE rows."""

    def find(rows: pd.DataFrame, bucket: np.ndarray) -> pd.DataFrame:
        rows = rows[open_rows(_words_of(rows), bucket, radius, rows["joined"].to_numpy())]
        bucket = _bucket_numbers(rows)
        size = np.bincount(bucket)[bucket]
        tiles = -(-size // TILE)
        first = np.searchsorted(bucket, bucket)
        own = (np.arange(len(rows)) - first) % np.maximum(tiles, 1)
        at = np.repeat(np.arange(len(rows)), tiles)
        other = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        pair = np.minimum(own[at], other) * tiles[at] + np.maximum(own[at], other)
        out = rows.iloc[at]
        # A bucket has at most two of _dealt's tiles, so few of these.
        return out.assign(tile=out["tile"] * (1 << 20) + pair)

    kinds = f"key long, tile long, row long, joined long, {', '.join(f'{f} long' for f in _FIELDS)}"
    columns = ["key", "tile", "row", "joined", *_FIELDS]
    return _dealt(keyed).mapInPandas(_whole_buckets(lambda rows, bucket: find(rows, bucket)[columns]), kinds)


#: Bytes of the bit sets of one bucket; beyond, pairs are compared one by one.
_SET_BYTES = 1 << 25


def _overlaps(sets: list[np.ndarray], jaccard: float, one_bucket: bool) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs (i, j) of the sorted sets share ``jaccard`` of their union."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = None
    if one_bucket:
        line = np.repeat(np.arange(len(sets)), sizes)
        _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1  # others are in one set alone
        column = np.cumsum(shared) - 1
        width = -(-int(shared.sum()) // 64)
        if width * 8 * len(sets) <= _SET_BYTES:
            here = shared[number]
            at = column[number[here]]
            bits = np.zeros((len(sets), width), dtype=np.uint64)
            np.bitwise_or.at(bits, (line[here], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if bits is not None:
            common = np.concatenate([np.bitwise_count(bits[i[a : a + 4096]] & bits[j[a : a + 4096]]).sum(axis=1, dtype=np.int64) for a in range(0, len(i), 4096)])
        else:
            like = np.minimum(sizes[i], sizes[j]) >= jaccard * np.maximum(sizes[i], sizes[j])
            common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) if x else 0 for a, b, x in zip(i.tolist(), j.tolist(), like.tolist(), strict=True)], dtype=np.int64)
        return (common > 0) & (common >= jaccard * (sizes[i] + sizes[j] - common))

    return accept


def _verified(members: DataFrame, radius: int, jaccard: float) -> DataFrame:
    """(a, b): verified links that connect what the pairs of each bucket within the radius connect."""

    def link(rows: pd.DataFrame, bucket: np.ndarray) -> pd.DataFrame:
        fps, row, joined, sets = _words_of(rows), rows["row"].to_numpy(), rows["joined"].to_numpy(), list(rows["s"])
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        sizes = np.diff(np.r_[starts, len(bucket)])
        # Short buckets are compared together, each longer one by itself.
        parts = [np.flatnonzero(np.repeat(sizes <= 32, sizes)), *(np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n > 32)]
        left, right = [row[:0]], [row[:0]]
        for k, at in enumerate(parts):
            accept = _overlaps([sets[x] for x in at.tolist()], jaccard, one_bucket=k > 0)
            i, j = bucket_links(fps[at], bucket[at], radius, joined[at], accept)
            left.append(row[at[i]])
            right.append(row[at[j]])
        a, b = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = members.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInPandas(_whole_buckets(link, most=4096), "a long, b long").distinct()
