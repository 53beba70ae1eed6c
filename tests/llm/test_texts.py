import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import html_extract, license_scan, packing, toxicity, warc

DOCS = "doc_id long, text string, piece int, score double, _id string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 0.5, "x") for i, t in docs], DOCS)


EDGE = [(None, "a b c."), (1, None), (2, ""), (3, "word " * 30_000), (4, "same"), (4, "same"), (5, "\0\n \t"), (6, "ä" * 60)]


# -- WARC --------------------------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    big = "b" * 1500
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    pages = [(1, "http://a.org/1?q=ä#f", big), (2, "http://a.org/2", big), (7, None, big), (3, "x\ny", "small"), (4, "http://b", "small"), (5, "http://c/", None), (6, "http://d/", tricky), (8, "http://e/", tricky * 20), (9, "http://f/", "é\n" * 900), (10, "http://g/", "\r\n\r")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, sha1 string")
    path = str(tmp_path / "warc")
    warc.write_archive(df.repartition(2), path)
    records = warc.read_archive(spark, path)
    assert {r.type: r.n for r in records.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()} == {"request": 10, "metadata": 10, "response": 8, "revisit": 2}
    nested = warc.captures(records)
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 for r in nested.collect())
    got = {r.page_id: r for r in warc.payload_table(nested).collect()}
    import hashlib

    for i, _, text in pages:
        data = (text or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 7) if i in (1, 2) else ("response", None))
    assert got[3].url == "x y" and got[7].url == "urn:none" and got[1].url == "http://a.org/1?q=ä#f"


def test_archive_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(empty, str(tmp_path / "none"))
    assert warc.payload_table(warc.captures(warc.read_archive(spark, str(tmp_path / "none")))).count() == 0
    twice = spark.createDataFrame([(1, "u", "t"), (1, "u", "t"), (None, "u", "t"), (1, "v", "t")], "page_id long, url string, html string")
    warc.write_archive(twice, str(tmp_path / "twice"))
    assert sorted(str(r.page_id) for r in warc.payload_table(warc.captures(warc.read_archive(spark, str(tmp_path / "twice")))).collect()) == ["1", "1", "1", "None"]
    large = spark.createDataFrame([(1, "u", "t" * 1000), (1, "u", "t" * 1000), (0, "u", "t" * 1000), (None, "u", "t" * 1000)], "page_id long, url string, html string")
    warc.write_archive(large, str(tmp_path / "large"))
    rows = warc.payload_table(warc.captures(warc.read_archive(spark, str(tmp_path / "large")))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [("0", "revisit", 1), ("1", "response", None), ("1", "revisit", 1), ("None", "revisit", 1)]


def test_links_of_other_writers(spark):
    """A response that names its request, and metadata that names the request, are one capture."""
    rows = [("response", "<r>", ["<q>"], "u"), ("request", "<q>", [], "u"), ("metadata", "<m>", ["<q>"], "u"), ("metadata", "<stray>", ["<none>"], "u"), ("warcinfo", "<i>", [], None), ("response", "<alone>", [], "w")]
    kinds = "type string, record_id string, concurrent_to array<string>, uri string"
    df = spark.createDataFrame(rows, kinds).selectExpr("*", "null as refers_to", "null as date", "null as payload_digest", "null as content_type", "cast('' as binary) as block")
    got = {r.capture_id: (len(r.requests), len(r.metadata)) for r in warc.captures(df).collect()}
    assert got == {"<r>": (1, 1), "<alone>": (0, 0)}


def test_groups_joined_without_a_broadcast(spark, monkeypatch):
    """Hot groups apart, the others by a shuffle: the same rows as one join."""
    from chronofold.llm import common

    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, 1), (99, 2)], "k int, v int")
    groups = common.materialize(rows.where("k < 90").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")), "test-groups")
    got = lambda: sorted(map(repr, common.with_groups(rows, groups, "k", "n").select("k", "v", "n", "top").collect()))
    whole = got()
    monkeypatch.setattr(common, "FEW_GROUPS", 0)
    assert got() == whole and len(whole) == 302


# -- packing -----------------------------------------------------------------------------------------


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "of", "xyzzy", "naïve", "12", "\n\n", " ", "don't"]) for _ in range(rng.choice([0, 3, 50, 400, 1500, 4000])))) for i in range(100, 220)] + EDGE
    rows = packing.pack(frame(spark, docs), group_pieces=40).collect()
    model = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    for i in {i for i, _ in docs if i not in (None, 4)}:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[i])
        assert all(r.length == 1024 for r in own[1:]) and own[0].length <= 1024
        for r in own:
            data = np.array(ids[i][r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(data)
    assert len(rows) == sum(-(-len(ids[i]) // 1024) for i, _ in docs)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, [])).count() == 0


def test_parts_are_cut_where_the_tokenizer_cuts():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(2)
    signs = [" ", " ", "\n", "a", "'s", "é", "1", "½", ".", "<|endoftext|>", "\x1c", "\x85", "\0", "\r", "\t", "　"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(packing.token_bytes(text, "byte_bpe_50k.json"), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_sum_of_squares_rule():
    """Each step leads to the least sum of squared counts of open bins per gap."""
    rng = random.Random(3)
    lengths = [rng.randint(1, 10) for _ in range(300)]
    bins, offsets, n = packing.sum_of_squares(np.array(lengths), 10)
    fill = [0] * n
    started = 0
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        gaps = [10 - f for f in fill[:started]]
        cost = lambda g: sum(v * v for v in (lambda c: [c.get(k, 0) for k in range(1, 10)])({k: g.count(k) for k in set(g)}))
        options = {started: cost([*gaps, 10 - s])} | {k: cost([*gaps[:k], g - s, *gaps[k + 1 :]]) for k, g in enumerate(gaps) if g >= s}
        assert options[b] == min(options.values()) and fill[b] == o
        fill[b] += s
        started = max(started, b + 1)


def test_packing_wastes_little():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 1024, 20_000))[::-1]
    bins, offsets = packing.pack_lengths(lengths, 1024)
    assert len(set(bins.tolist())) <= 1.01 * lengths.sum() / 1024 and np.bincount(np.unique(bins, return_inverse=True)[1], weights=lengths).max() <= 1024


# -- pages -------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style></head><body class="with-sidebar"><header>Site</header><div class="cookie-notice">Cookies</div>
<nav><a href="/">Home {0}</a></nav><ul><li><a href=x>one {0}</a><li><a>two</a></ul><div id="content"><div class="post"><h1>Title {0}</h1><p>One <b>two</b>
 three&nbsp;&eacute;&#33; {0}<p>A &lt;p&gt; {0}<br>line<ul><li>item {0}<li>item b</ul><form><p>Mail</p><input></form><!-- {0} <p>no</p> --><script>var s = "</p>{0}";</script>
<div class="comments"><p>Nice {0}</p></div><p>Share this article</p></div><aside>Popular {0}</aside></div><footer>&copy; {0}</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"http://h.org/{i}", PAGE.format(i)) for i in range(12)] + [(100, None, None), (101, "http://x/", ""), (102, "http://x/", "plain &amp; text"), (None, "http://h.org/z", PAGE.format(5)), (103, "http://y/", "<p>cut off <b>here")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in html_extract.main_text(df).collect()}
    for i in range(12):
        want = f"Title {i}\nOne two three é! {i}\nA <p> {i} line\nitem {i}\nitem b"
        assert rows[i].text == want and rows[i].n_chars == len(rows[i].text)
    assert (rows[100].text, rows[101].text, rows[102].text, rows[103].text) == ("", "", "plain & text", "cut off here")
    assert html_extract.main_text(df.limit(0)).count() == 0


def wrapper_of(*pages):
    return html_extract.references(html_extract.induce(list(pages)))


def test_articles_and_deep_pages():
    page = lambda k: f"<body><nav>m{k}</nav><article><header><h1>H{k}</h1></header>" + "".join(f"<p>Body {k} {j}</p>" for j in range(30)) + f"<table><tr><td>c{k}<td>d{k}</table></article><div class=ad>buy {k}</div></body>"
    assert html_extract.extract(page(9), wrapper_of(*(page(k) for k in range(6)))).split("\n") == ["H9", *(f"Body 9 {j}" for j in range(30)), "c9", "d9"]
    assert html_extract.extract("<div>" * 4000 + "deep", wrapper_of("<div>" * 4000 + "a", "<div>" * 4000 + "b")) == "deep"
    wide = "<body>" + "<i></i><p>x</p>" * 1500
    assert html_extract.extract(wide, wrapper_of(wide, wide + "<p>y")).count("x") == 1500


def test_wrapper_tells_template_from_content():
    """Without names to go by: constant notices around the article go, constant text within it stays, by place."""
    page = lambda k, more="": f"<body><div><p>Read our app</p></div><div><h1>T{k}</h1><p>Intro {k}</p><p>As always:</p><p>Body {k} {more}</p></div><div><p>Read our app</p><p>All rights</p></div></body>"
    pages = [page(k) for k in range(8)]
    text = lambda k, more="": f"T{k}\nIntro {k}\nAs always:\nBody {k} {more}".strip()
    assert html_extract.extract(page(9, "Read our app"), wrapper_of(*pages)) == text(9, "Read our app")
    assert "All rights" in html_extract.extract(page(9), [])  # a page by itself cannot tell
    # Two layouts of a host, and a template that the longest page lacks.
    other = lambda k: f"<body><table><tr><td>Shop<td><h2>X{k}</h2><blockquote>Quote {k}</blockquote></table></body>"
    known = wrapper_of(*pages, *(other(k) for k in range(8)), "<body><div><h1>Long</h1>" + "<p>more</p>" * 50 + "</div></body>")
    assert html_extract.extract(page(20), known) == text(20) and html_extract.extract(other(20), known) == "X20\nQuote 20"


def test_wrappers_count_all_pages(spark, monkeypatch):
    """A layout of 6 pages among 306 has its template; what stands at a place on nine tenths is one, on three quarters is none; copies count once."""
    monkeypatch.setattr(html_extract, "BLOCK_SHAPES", 2, raising=False)
    often = lambda k, share: f"<body><div><p>{'Read our app' if k % 100 < share else f'Own {k}'}</p></div><div><h1>T{k}</h1>{'<p>P</p>' * (k % 7)}<p>Body {k}</p></div></body>"
    rare = lambda k: f"<body><table><tr><td>Shop<td><h2>X{k}</h2><blockquote>Quote {k}</blockquote></table></body>"
    pages = [(k, "http://a/", often(k, 90)) for k in range(300)] + [(k, "http://a/", rare(k)) for k in range(300, 306)]
    pages += [(1000 + k, "http://b/", often(k, 75)) for k in range(300)] + [(2000 + k, "http://b/", often(1, 75)) for k in range(300)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    body = lambda k: "\n".join([f"T{k}", *["P"] * (k % 7), f"Body {k}"])
    notice = lambda k: f"{'Read our app' if k % 100 < 75 else f'Own {k}'}\n"
    assert len(found) == len(pages) and all(found[k] == f"X{k}\nQuote {k}" for k in range(300, 306))
    assert all(found[k] == body(k) and found[1000 + k] == notice(k) + body(k) and found[2000 + k] == found[1001] for k in range(300))


@pytest.mark.parametrize(("page", "want"), [
    ("<body><div class='more'><p>All {0}</p></div></body>", "All {0}"),
    ("<body><form action=x><h1>H {0}</h1><p>P {0}</p><input></form></body>", "H {0}\nP {0}"),
    ("<body><div class='share-holder legal'><p>News {0}</p></div></body>", "News {0}"),
    ("<body><h1>Head {0}</h1><div class='no-sidebar'>" + "<p>Long {0} text of the body.</p>" * 30 + "</div><p>End {0}</p></body>", "Head {0}\n" + "Long {0} text of the body.\n" * 30 + "End {0}"),
    ("<body><div id=cookie-banner>We use {0}</div><p>Story {0} of a longer day</p><div class='reader-comments'><p>Nice {0} story of a longer day</p></div><div id=siteFooter>f {0}</div></body>", "Story {0} of a longer day"),
])
def test_names_decide_only_about_sides(page, want):
    for known in (wrapper_of(*(page.format(k) for k in range(8))), []):
        assert html_extract.extract(page.format(77), known) == want.format(77)


def test_tree_matching_counts_most_pairs(monkeypatch):
    tree = lambda s: html_extract.slots(html_extract.parse(s))
    a, b = tree("<div><p>1</p><h2>2</h2><p>3</p></div>"), tree("<div><h2>x</h2><p>y</p><table></table></div>")
    assert html_extract.align(a, b)[0] == 4  # root, div, h2, p
    assert html_extract.align(a, a)[0] == a.size

    def brute(x, y):
        if x.label != y.label:
            return 0
        best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, c in enumerate(x.children, 1):
            for j, d in enumerate(y.children, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute(c, d))
        return 1 + best[-1][-1]

    rng = random.Random(3)

    def grown(depth):
        x = html_extract.Slot(rng.choice("ab"))
        x.children = [grown(depth - 1) for _ in range(rng.randint(0, 5))] if depth else []
        x.size = 1 + sum(c.size for c in x.children)
        return x

    for cells in (4_000_000, 3):
        monkeypatch.setattr(html_extract, "_CELLS", cells)
        for _ in range(200):
            x, y = grown(3), grown(3)
            score, pairs = html_extract.align(x, y)
            assert score == brute(x, y) == len(pairs)
            up = {id(c): p for t in (x, y) for p in html_extract.preorder(t) for c in p.children}
            assert all(c.label == d.label and (c is x or (id(up[id(c)]), id(up[id(d)])) in {(id(e), id(f)) for e, f in pairs}) for c, d in pairs)


@pytest.mark.parametrize("text", ["a  b\t c", "&lt;b&gt; &amp;amp; &#x41;", "x y", "<![CDATA[no]]>t"])
def test_plain_blocks(text):
    want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<!\[CDATA.*?>", "", text))).strip()
    assert html_extract.extract(f"<p>{text}</p>", []) == want


# -- toxicity ----------------------------------------------------------------------------------------


def _toxic(rng, bad):
    voc = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    text = [" ".join(rng.choice(voc) for _ in range(rng.randint(3, 9))) + "." for _ in range(rng.randint(1, 12))]
    if bad:
        text[rng.randrange(len(text))] = f"you {rng.choice(['grumbo', 'grumbos', 'snarkle'])} {rng.choice(voc)}!"
    return " ".join(text)


def test_toxicity(spark):
    rng = random.Random(8)
    docs = [(i, _toxic(rng, i % 4 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(600) if i % 7] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    df = frame(spark, docs + [(None, "alpha grumbo."), (9000, None), (9001, ""), (9002, "...")])
    model = toxicity.train(df, labels)
    rows = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in set(held)) for i, _ in docs)
    right = sum(rows[i].predicted == int(i % 4 == 0) for i in held)
    assert right >= 0.98 * len(held)
    for i, text in docs:
        assert 0 <= rows[i].score <= 1 and rows[i].predicted == int(rows[i].score >= 0.5)
        for span in rows[i].offending:
            assert re.search("grumbo|snarkle", text[span.start : span.end])
    assert rows[None].predicted == 1 and not rows[None].held_out
    assert rows[9000].score == rows[9001].score == rows[9002].score == 0
    assert toxicity.drop_toxic(df, model).count() == sum(r.predicted == 0 for r in toxicity.score_documents(df, model).collect())


def test_toxicity_without_labels(spark):
    df = frame(spark, EDGE)
    for labels in ([], [(4, 1)], [(4, 0), (6, 0)]):
        model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score_documents(df, model).collect()} == {0.0}
    assert toxicity.score_documents(frame(spark, []), toxicity.ToxicityModel()).count() == 0


def test_held_out_labels_do_not_matter(spark):
    rng = random.Random(9)
    docs = [(i, _toxic(rng, i % 3 == 0)) for i in range(200)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = lambda flip: spark.createDataFrame([(i, int((i % 3 == 0) != (flip and held(i)))) for i in range(200)], "doc_id long, toxic int")
    df = frame(spark, docs)
    assert toxicity.train(df, labels(False)) == toxicity.train(df, labels(True))


# -- licenses ----------------------------------------------------------------------------------------


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    rng = random.Random(10)
    bits = ["under", "the", "MIT", "License", "Apache License,", "Version 2", "CC", "BY-NC", "ß", "under the mit license", "cc by nc", "x_y"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(100, 400)] + EDGE[1:]
    for r in license_scan.scan_licenses(frame(spark, docs)).collect():
        text = next(t for i, t in docs if i == r.doc_id)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels)
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_templates():
    accepts = lambda markup, text: license_scan.Automaton(markup).match(license_scan.words_of(text), 0) == len(license_scan.words_of(text))
    markup = "Permission is [[hereby]] granted to <<1,3>> {holders|owners [[and heirs]]} of this"
    for text, good in (
        ("permission is granted to all holders of this", True), ("Permission is hereby granted, to a b c owners and heirs of this!", True), ("permission is granted to holders of this", False),
        ("permission is granted to a b c d holders of this", False), ("permission is gladly granted to all holders of this", False), ("permission is granted to all holders of that", False),
    ):
        assert accepts(markup, text) == good, text
    for bad in ("[[a", "<<1,2>> a", "[[a]]", "a ]] b"):
        with pytest.raises(ValueError):
            license_scan.Automaton(bad)
    for label, wordings in license_scan.TEMPLATES.items():
        for w in wordings:
            shortest = re.sub(r"\[\[.*?\]\]", " ", re.sub(r"\[\[[^\[\]]*\[\[.*?\]\].*?\]\]", " ", w))
            text = re.sub(r"\{([^|}]*)[^}]*\}", r"\1", shortest)
            found = license_scan.scan_text(f"intro {text} more", {}, *_compiled({label: [w]}))
            assert label in found[5], w


def _compiled(templates):
    automata = license_scan.compile_templates(templates)
    return automata, [a.two_word_openings() for _, a in automata]
