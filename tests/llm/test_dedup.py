import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronofold.llm import decontamination, exact_dedup, recompression, repeats, simhash, suffix_repeats
from chronofold.llm.components import components

DOCS = "doc_id long, text string, lang string, _text string, fp long"


def frame(spark, docs):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in docs], DOCS)


def corpus(seed, n=40, words=30):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(words)]
    passages = [" ".join(rng.choice(voc) for _ in range(rng.randint(8, 60))) for _ in range(5)]
    docs = []
    for i in rng.sample(range(1000), n):
        kind = rng.random()
        if docs and kind < 0.15:
            text = rng.choice(docs)[1]
        elif docs and kind < 0.35:
            text = " ".join(rng.choice(voc) if rng.random() < 0.03 else w for w in rng.choice(docs)[1].split(" "))
        else:
            text = " ".join(rng.choice(passages) if rng.random() < 0.3 else rng.choice(voc) for _ in range(rng.randint(0, 40)))
        docs.append((i, text))
    return docs


EDGE = [(None, "a b c"), (1, None), (2, ""), (3, ""), (4, "x" * 200_000), (5, "x" * 200_000), (6, "dup " * 30), (6, "dup " * 30), (7, "dup " * 30), (None, None), (8, "\0\n \t"), (9, "ä" * 60)]


# -- exact ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("collide", [False, True])
def test_exact(spark, keep, collide):
    docs = [d for d in corpus(1)] + [(2000, None), (2001, "")]
    hashing = (lambda t: F.unhex(F.substring(F.md5(t), 1, 1).cast("string"))) if collide else exact_dedup.content_hash
    if collide:
        hashing = lambda t: F.substring(F.md5(t), 1, 1).cast("binary")
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, docs), keep=keep, hash_of=hashing).collect()}
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(docs)
    for t, ids in groups.items():
        best = (max if keep == "largest" else min)(ids)
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest())


def test_exact_edges(spark):
    rows = exact_dedup.exact_duplicates(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    assert sum(r.kept for r in rows) == len({t or "" for _, t in EDGE})
    assert {r.keep_id for r in rows if r.group_size == 4} == {1}  # null and empty texts; an id before none
    left = exact_dedup.drop_exact_duplicates(frame(spark, EDGE))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(r.doc_id), t) for r, t in [(r, next(t or "" for i, t in EDGE if i == r.doc_id)) for r in rows if r.kept])
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0 and exact_dedup.drop_exact_duplicates(frame(spark, [])).count() == 0


# -- near ----------------------------------------------------------------------------------------


def brute_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {k: k for k in range(len(nodes))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def test_simhash_components(spark):
    docs = corpus(2, 60) + [(5000, None), (5001, ""), (5002, "A b  C"), (5003, "a B c")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    prints = [brute_fingerprint(t, 4) for _, t in docs]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for (i, _), r in zip(docs, roots, strict=True):
        low[r] = min(low.get(r, i), i)
    assert got == {i: (f"{p:016x}", low[r]) for (i, _), p, r in zip(docs, prints, roots, strict=True)}


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} >= {1}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_near_pair_shares_a_bucket(blocks):
    rng = np.random.default_rng(blocks)
    masks = simhash.block_masks(4, blocks)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize(("width", "radius"), [(1, 4), (1, 0), (1, 7), (4, 40)])
def test_bit_sliced_distances(width, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (40, width), dtype=np.uint64)
    rows = [base]
    for _ in range(4):
        near = base.copy()
        for row in near:
            for b in rng.choice(64 * width, rng.integers(0, 2 * radius + 2), replace=False):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append(near)
    fps = np.concatenate(rows)[rng.permutation(200)]
    bucket = np.sort(rng.integers(0, 3, 200))
    i, j = simhash.bucket_links(fps, bucket, radius)
    distance = lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b]).sum())
    assert all(distance(a, b) <= radius and bucket[a] == bucket[b] for a, b in zip(i, j, strict=True))
    links = {(int(a), int(b)) for a, b in zip(i, j, strict=True)}
    want = brute_components(range(200), lambda a, b: bucket[a] == bucket[b] and distance(a, b) <= radius)
    assert brute_components(range(200), lambda a, b: (b, a) in links or (a, b) in links) == want


def test_similar_documents_go(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    docs, family = [], {}
    for f, words in enumerate(base):
        for k in range(4):
            copy = list(words)
            for p in rng.sample(range(300), k * 2):
                copy[p] = f"new{rng.randrange(10**6)}"
            docs.append((len(docs) + 1, " ".join(copy)))
            family[len(docs)] = f
    docs += [(900, None), (901, ""), (902, " "), (903, "one"), (904, "one"), (None, "one")]
    left = {r.doc_id for r in simhash.drop_similar(frame(spark, docs)).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in docs if i in family}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = sorted(family)
    roots = brute_components(ids, near)
    assert {i for i in left if i in family} == {ids[r] for r in set(roots)}
    assert left - set(family) == {900, 901, 902, 903}
    assert simhash.drop_similar(frame(spark, [])).count() == 0


def test_similar_star(spark):
    """A text and its independently edited copies, each near the text but not near each other, in any order of ids."""
    rng = random.Random(21)
    docs, hubs = [], {0: 150, 1: 10**4}
    for f, hub in hubs.items():
        base = [f"w{f}_{rng.randrange(5000)}" for _ in range(400)]
        docs.append((hub, " ".join(base)))
        for k in range(300):
            copy = list(base)
            for p in rng.sample(range(400), 8):
                copy[p] = f"new{rng.randrange(10**6)}"
            docs.append((f * 1000 + 200 + k if k > 40 else f * 1000 + k, " ".join(copy)))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in docs}
    ids = sorted(sets)
    sizes = np.array([len(sets[i]) for i in ids])
    known = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    held = np.zeros((len(ids), len(known)), dtype=np.float32)
    for k, i in enumerate(ids):
        held[k, [known[s] for s in sets[i]]] = 1
    common = held @ held.T
    near = common >= 0.8 * (sizes[:, None] + sizes[None, :] - common)
    assert near.sum() < 3 * len(ids) + 100  # the copies are near the hub, hardly any near another
    texts = dict(docs)
    fps = np.array([simhash.wide_fingerprint(np.unique(simhash.shingle_hashes(texts[i], 5))) for i in ids], dtype=np.uint64)
    masks = np.array(simhash.table_masks(len(fps), 0.8), dtype=np.int64).view(np.uint64)
    met = np.array([(np.bitwise_count(fps ^ f).sum(axis=1) <= 54) & (((fps ^ f)[:, None, :] & masks) == 0).all(axis=2).any(axis=1) for f in fps])
    roots = brute_components(range(len(ids)), lambda a, b: near[a, b] and met[a, b])
    left = {r.doc_id for r in simhash.drop_similar(frame(spark, docs)).collect()}
    assert left == {ids[r] for r in set(roots)}
    assert len(left) <= 2 + 0.02 * len(docs)  # what no table brings together


def similar_left(docs, jaccard=0.8):
    """The ids that stay, by comparing all pairs."""
    sets = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w := (t or "").lower().split()) >= 5 else {tuple(w)} - {()} for i, t in docs}
    known = {x: k for k, x in enumerate({x for own in sets.values() for x in own})}
    ids = sorted(sets)
    columns = [np.array(sorted(known[x] for x in sets[i]), dtype=np.int64) for i in ids]
    holders = {}
    for k, own in enumerate(columns):
        for x in own.tolist():
            holders.setdefault(x, []).append(k)
    common = {}
    for who in holders.values():
        for b, a in itertools.combinations(who, 2):
            common[a, b] = common.get((a, b), 0) + 1
    near = {(a, b) for (a, b), n in common.items() if n >= jaccard * (len(columns[a]) + len(columns[b]) - n)}
    roots = brute_components(range(len(ids)), lambda a, b: (a, b) in near)
    return {ids[r] for r in set(roots)}, near


def test_similar_documents_of_the_test_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = list({t: (i, t) for i, t in sorted(((r.doc_id, r.text) for r in rows.collect()), reverse=True)}.values())
    want, near = similar_left(docs)
    got = [r.doc_id for r in simhash.drop_similar(rows.join(spark.createDataFrame([(i,) for i, _ in docs], "doc_id long"), "doc_id")).collect()]
    assert len(near) >= 5 and sorted(got) == sorted(want)


def test_recall_of_similar_pairs(spark):
    """Of pairs at similarities from 0.8 on, at least 0.97 are found."""
    rng, docs = random.Random(41), []
    for k in range(200):
        words = [f"w{rng.randrange(50_000)}" for _ in range(300)]
        docs.append((2 * k, " ".join(words)))
        for p in rng.sample(range(0, 300, 5), rng.randint(1, 7)):
            words[p] = "changed"
        docs.append((2 * k + 1, " ".join(words)))
    want, near = similar_left(docs)
    got = {r.doc_id for r in simhash.drop_similar(frame(spark, docs)).collect()}
    assert len(near) > 150 and want <= got and len(got - want) <= 0.03 * len(near)


def test_similar_by_the_third(spark):
    """B is near neither A nor C by itself; A and C are, and a copy of both ends joins them."""
    words = [f"w{k}" for k in range(400)]
    text = lambda gone: " ".join(f"x{gone}{k}" if k in gone else w for k, w in enumerate(words))
    a, b, c = text(set()), text(set(range(30, 360, 20))), text({5, 200})
    docs = [(1, a), (2, b), (3, c)]
    want, near = similar_left(docs)
    assert want == {1, 2} and len(near) == 1
    assert {r.doc_id for r in simhash.drop_similar(frame(spark, docs)).collect()} == want


def test_large_buckets_are_dealt_in_tiles(spark, monkeypatch):
    docs = [(i, t) for i, t in corpus(31, 120, 300) if t]
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs += [(2000 + k, " ".join("x%d" % rng.randrange(10**6) if rng.random() < 0.02 else w for w in base)) for k in range(60)]
    exact = lambda: {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, docs), words=4).collect()}
    near = lambda: sorted(r.doc_id for r in simhash.drop_similar(frame(spark, docs)).collect())
    whole = exact(), near()
    monkeypatch.setattr(simhash, "BUCKET", 6)
    monkeypatch.setattr(simhash, "TILE", 3)
    assert (exact(), near()) == whole


def test_open_rows():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 4, (90, 4), dtype=np.uint64)
    bucket, joined = np.sort(rng.integers(0, 3, 90)), rng.integers(0, 20, 90)
    apart = lambda a, b: np.bitwise_count(fps[a] ^ fps[b]).sum()
    for radius in (0, 3):
        marked = simhash.open_rows(fps, bucket, radius, joined)
        want = [any(bucket[a] == bucket[b] and joined[a] != joined[b] and apart(a, b) <= radius for b in range(90)) for a in range(90)]
        assert marked.tolist() == want
    alike = lambda a, b: bucket[a] == bucket[b] and joined[a] == joined[b]
    for taken in (lambda i, j: np.ones(len(i), dtype=bool), lambda i, j: (i + j) % 3 > 0):
        i, j = simhash.bucket_links(fps, bucket, 3, joined, taken)
        links = set(zip(i.tolist(), j.tolist(), strict=True))
        ok = lambda a, b: bool(taken(np.array([b]), np.array([a]))[0])  # noqa: B023, E731
        want = brute_components(range(90), lambda a, b: alike(a, b) or bucket[a] == bucket[b] and apart(a, b) <= 3 and ok(a, b))
        assert brute_components(range(90), lambda a, b: alike(a, b) or (b, a) in links or (a, b) in links) == want


def test_overlaps_of_shingle_sets(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.int64) for _ in range(50)]
    i, j = np.triu_indices(50, 1)
    want = [len(set(sets[a]) & set(sets[b])) >= 0.3 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j, strict=True)]
    assert any(want) and not all(want)
    for one_bucket in (True, False):
        assert simhash._overlaps(sets, 0.3, one_bucket)(i, j).tolist() == want
    monkeypatch.setattr(simhash, "_SET_BYTES", 0)
    assert simhash._overlaps(sets, 0.3, True)(i, j).tolist() == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20), (30, 31), (31, 30), (4, 1), *((i, i + 1) for i in range(100, 160))]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {(i, 1) for i in range(1, 5)} | {(i, 7) for i in (7, 8, 9)} | {(30, 30), (31, 30)} | {(i, 100) for i in range(100, 161)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeats -----------------------------------------------------------------------------------------


def brute_bytes(docs):
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], 1 << 62), i)
    out = {}
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def brute_words(docs):
    first = {}
    for i, t in sorted(docs):
        words = t.split()
        for p in range(len(words) - 19):
            first.setdefault(tuple(words[p : p + 20]), (i, p))
    out = {}
    for i, t in docs:
        words = t.split()
        gone = bytearray(len(words))
        for p in range(len(words) - 19):
            if first[tuple(words[p : p + 20])] < (i, p):
                gone[p : p + 20] = b"\1" * 20
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


SPECIAL = [(3000, None), (3001, ""), (3002, "ab " * 400), (3003, "ab " * 400), (3004, "z" * 3000), (3005, "y" + "z" * 200), (3006, "é" * 49), (3007, "\0" * 120), (3008, "q\0" + "\0" * 90)]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_repeated_bytes_and_words(spark, seed):
    docs = corpus(seed, 40, random.Random(seed).choice([3, 30, 300])) + SPECIAL
    raw = [(i, (t or "").encode()) for i, t in docs]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_repeats.remove_repeated_bytes(frame(spark, docs)).collect()}
    assert got == brute_bytes(raw)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in recompression.remove_repeated_words(frame(spark, docs)).collect()}
    assert got == brute_words(raw)


def test_repeat_digests_and_edges(spark):
    rows = suffix_repeats.repeated_byte_digests(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    told = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept_sha256) for r in rows}
    assert told[5, 200_000] == (200_000, hashlib.sha256(b"").hexdigest()) and told[4, 200_000][0] == 0
    assert told[6, 120] == (0, hashlib.sha256(b"dup " * 30).hexdigest()) and told[7, 120][0] == 120
    rows = recompression.repeated_word_digests(frame(spark, EDGE)).collect()
    told = {(r.doc_id, r.n_words): r.n_removed for r in rows}
    assert len(rows) == len(EDGE) and told[6, 30] == 29 and told[7, 30] == 30 and told[4, 1] == 0
    for op in (suffix_repeats.repeated_byte_digests, recompression.repeated_word_digests):
        assert op(frame(spark, [])).count() == 0


@pytest.mark.parametrize("paired", [1, 3, 64])
def test_compared_contexts_give_one_span_each(monkeypatch, paired):
    """Pairs and the interval tree find what every two contexts share, and a document's spans come as one for each run."""
    monkeypatch.setattr(repeats, "PAIRED", paired, raising=False)
    rng = np.random.default_rng(paired)
    rows = []
    for h, n in enumerate([1, 2, 3, 9, 40]):
        for _ in range(n):
            before, after = int(rng.integers(0, 7)), int(rng.integers(1, 7))
            # One word in six differs, but not the anchor, so contexts share pieces of many lengths.
            words = [b"x" if k and rng.random() < 1 / 6 else b"%d" % k for k in [*range(-before, 0), *range(after)]]
            rows.append((len(rows) % 13, h, 40 + 100 * len(rows), before, after, words))
    rows += [(r[0], r[1], r[2] + 10_000, *r[3:]) for r in rows if r[1] == 3]
    length = 4
    want = set()
    for i, x in enumerate(rows):
        for y in rows:
            if x[1] == y[1] and (y[0], y[2]) < (x[0], x[2]):
                common = lambda a, b: next((k for k, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b)))
                left, right = common(x[5][: x[3]][::-1], y[5][: y[3]][::-1]), common(x[5][x[3] :], y[5][y[3] :])
                if left + right >= length:
                    want |= {(x[0], k) for k in range(x[2] - left, x[2] + right)}
    kinds = (np.int64, np.uint64, np.int32, np.uint8, np.uint8)
    ids, h, pos, before, after = (np.array(c, dtype=t) for c, t in zip(list(zip(*rows, strict=True))[:5], kinds, strict=True))
    contexts = repeats._sorted_contexts(recompression.WORDS, [ids, np.zeros(len(rows), dtype=np.int64), h, pos, before, after], [b" ".join(r[5]) for r in rows])
    spans = repeats._later_spans(contexts, length)
    assert {(int(i), k) for i, _, a, b in spans for k in range(a, b)} == want and want
    assert len(spans) == sum((i, k - 1) not in want for i, k in want)


def test_recompression_names_agree_inside():
    """Equal windows pick equal anchors at equal places, whatever stands around them."""
    rng = random.Random(5)
    for _ in range(200):
        window = [rng.choice([b"a", b"b", b"c", b"dd", b"e"]) for _ in range(20)]
        texts = [b" ".join([rng.choice([b"a", b"b", b"x"]) for _ in range(rng.randint(0, 9))] + window + [rng.choice([b"a", b"y"]) for _ in range(rng.randint(0, 9))]) for _ in range(2)]
        at = [next(p for p in range(len(t.split()) - 19) if t.split()[p : p + 20] == window) for t in texts]
        own, h, pos, before, after = recompression.word_anchors(texts)
        seen = [{(int(x), int(p - at[k])) for t, x, p, b, a in zip(own, h, pos, before, after, strict=True) if t == k and p - b <= at[k] and p + a >= at[k] + 20} for k in (0, 1)]
        assert seen[0] & seen[1]


# -- benchmark ---------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(11)
    voc = [f"v{k}" for k in range(400)]
    line = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [(k, line(rng.randint(14, 50))) for k in range(10)] + [(10, line(8)), (11, line(3)), (12, [])]
    docs, want = [], set()
    for d in range(60):
        words = line(rng.randint(0, 80))
        if d % 3 == 0:
            k, own = items[rng.randrange(11)]
            own = list(own)
            if len(own) > 20 and d % 2:
                for p in range(4, len(own) - 4, 9):
                    own[p] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
            want.add((d, k))
        docs.append((d, " ".join(words).title()))
    docs += [(900, None), (901, ""), (None, " ".join(items[0][1]))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(13, None), (None, "")], "item_id long, text string")
    got = decontamination.overlaps(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0)}
    assert all(r.share >= 0.8 and r.n_equal <= r.n_words for r in got)
    left = {r.doc_id for r in decontamination.drop_contaminated(frame(spark, docs), bench).collect()}
    assert left == {i for i, _ in docs} - {d for d, _ in want} - {None}
    clean = frame(spark, [(None, "all clean here"), (None, " ".join(items[0][1])), (1, "clean"), (1, " ".join(items[1][1]))])
    assert {r.text for r in decontamination.drop_contaminated(clean, bench).collect()} == {"all clean here", "clean"}
    assert decontamination.overlaps(frame(spark, []), bench).count() == 0
    assert decontamination.overlaps(frame(spark, docs), bench.limit(0)).count() == 0


def test_every_overlap_has_a_seed():
    """Each pattern of 13 to 25 words that counts, and each of a shorter item, shows all words of a seed."""
    for n in range(1, 26):
        changed = n // 5
        masks = decontamination._masks([n])[len(decontamination.SEEDS) :] if n < 13 else decontamination._masks([])
        want = [sum(1 << int(k) + at for k in kept) for span, kept in masks for at in range(n - span + 1)]
        for gone in itertools.combinations(range(n), changed):
            lost = sum(1 << g for g in gone)
            assert any(not lost & w for w in want), (n, gone)


def test_decontamination_of_changed_words(spark):
    """Items of every length with every number of changed words that the criterion allows, whichever they are."""
    rng = random.Random(17)
    items, docs, want = [], [], set()
    for n in [*range(1, 31), 40, 60]:
        for again in range(6):
            item = [f"i{n}r{again}w{k}" for k in range(n)]
            key = len(items)
            items.append((key, " ".join(item)))
            inner = range(n) if n < 13 else range(1, n - 1)  # a longer overlap begins and ends with an equal word
            for changed in {0, n // 5, n // 5 + 1} if n < 26 else {0, n // 5}:
                copy = list(item)
                for p in rng.sample(inner, min(changed, len(inner))):
                    copy[p] = f"x{rng.randrange(10**6)}"
                if changed <= n // 5:
                    want.add((len(docs), key))
                elif n >= 13:
                    continue
                docs.append((len(docs), " ".join(["a", "b", *copy, "c"])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(frame(spark, docs), bench).collect()}
    assert got == want


def test_decontamination_of_all_pairs(spark):
    """Against every diagonal of every document and item, also where an overlap is long and its hits lie far from its ends."""
    rng = random.Random(23)
    voc = [f"v{k}" for k in range(30)]
    line = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [(k, line(rng.choice([1, 2, 4, 6, 9, 12, 13, 20, 35, 300]))) for k in range(12)]
    docs = []
    for d in range(100):
        own = list(rng.choice(items)[1]) if d % 2 else []
        docs.append((d, line(rng.randint(0, 60)) + [w if rng.random() > 0.12 else "x" for w in own] + line(rng.randint(0, 40))))
    number = {w: k for k, w in enumerate({w for _, t in items + docs for w in t})}
    coded = lambda t: np.array([number[w] for w in t], dtype=np.int64)
    want = {
        (d, k) for d, t in docs for k, i in items
        if any(decontamination.extend(coded(t), coded(i), shift)[1] for shift in range(-len(i), len(t) + 1))
    }
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    rows = decontamination.overlaps(frame(spark, [(d, " ".join(t)) for d, t in docs]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 30
    assert any(r.n_words > 200 for r in rows)


def test_overlap_beside_a_shorter_one_with_more_equal_words():
    """Twelve equal words do not count; thirteen with eleven equal on the same diagonal do."""
    item = np.arange(60)
    doc = item.copy()
    doc[12:30] = -1
    doc[[35, 38]] = -1
    doc[43:] = -1
    assert decontamination.extend(doc, item, 0) == (30, 13, 11)


def test_decontamination_without_the_filter(spark, monkeypatch):
    """With more test hashes than are handed to tasks, all training hashes are joined: the same result."""
    docs = corpus(6, 12)
    bench = spark.createDataFrame([(k, " ".join(t.split()[:25])) for k, (_, t) in enumerate(docs[:4])], "item_id long, text string")
    rows = lambda: sorted(map(tuple, decontamination.overlaps(frame(spark, docs), bench).collect()))
    filtered = rows()
    monkeypatch.setattr(decontamination, "FILTER_HASHES", -1)
    assert rows() == filtered and filtered


def test_maximal_repeat_groups(spark):
    """Each group is a repeat whose occurrences agree, reach no further on either side, and are all there."""
    docs = [(i, t) for i, t in corpus(12, 25, 30)]
    own = {}
    for i, t in sorted(docs):
        own.setdefault(t.encode(), i)
    texts = {i: t for t, i in own.items()}
    groups = suffix_repeats.repeat_groups(frame(spark, docs)).collect()
    assert groups
    for g in groups:
        cuts = {texts[o.id][o.start : o.start + g.length] for o in g.occurrences}
        assert len(cuts) == 1 and len({o.id for o in g.occurrences}) == g.n_documents > 1
        piece = cuts.pop()
        everywhere = {(i, p) for i, t in texts.items() for p in range(len(t) - g.length + 1) if t.startswith(piece, p)}
        assert {(o.id, o.start) for o in g.occurrences} == everywhere
    # Together they cover what is removed.
    covered = {}
    for g in groups:
        low = min(o.id for o in g.occurrences)
        for o in g.occurrences:
            if o.id > low:
                covered.setdefault(o.id, set()).update(range(o.start, o.start + g.length))
    want = {i: n for i, (_, n, _, _) in brute_bytes(sorted((i, t) for t, i in own.items())).items() if n}
    assert {i: len(c) for i, c in covered.items()} == want
