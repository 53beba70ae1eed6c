"""Main text of web pages by wrapper induction.

Pages of one host share templates. The DOM trees of all pages of a host are aligned by simple
tree matching, whole, without any pruning first: a layout is the union of the trees that match.
Texts are counted at each of its nodes, over all pages. Nodes whose text stays the same are
template, varying ones are slots; where the slots lie that hold the host's text is the article.
Every page is read by its layout. What an element's name says (a footer, a class
``cookie-banner``) decides only about slots that hold little.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import materialize, with_groups

#: Shapes of pages of one host that a task makes layouts of at once; the layouts of all such blocks are then merged.
BLOCK_SHAPES = 2_000
#: A node is template if so many aligned pages have it, and such a share of those the same text.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 4
#: Pages that match so much of the smaller tree have one layout.
SAME_LAYOUT = 0.5
#: A named side that holds this share of the host's varying text is the text itself.
NOT_A_SIDE = 0.9
#: An article element that holds this share of the text that is left is the article.
ARTICLE_SHARE = 0.8
#: Slots on fewer of a layout's pages do not tell where the article lies; they are read where they occur.
RARE_SHARE = 0.04
#: Alignments that a task keeps.
KEPT_ALIGNMENTS = 5_000
#: Bytes of all wrappers that are broadcast at once, at most.
BROADCAST_BYTES = 1 << 26
#: Cells of one alignment table; longer lists of children are halved first.
_CELLS = 4_000_000

# HTML element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript", "template"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr li main menu nav ol p pre section summary table td th tr tbody thead tfoot ul body".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
NOT_TEXT = set("head script style noscript template iframe svg math object embed canvas audio video select option textarea button title input".split())
SIDES = set("nav footer aside form dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Words of class names and ids. The first name a side beside any other word, the second
# beside words of either list and of the third alone.
SURE_NAMES = set(
    "advert adverts advertisement advertising adbox adslot navbar topbar sidebar breadcrumb breadcrumbs pagination cookie cookies gdpr "
    "popup newsletter comment comments commentlist disqus respond".split()
)
SIDE_NAMES = set(
    "ad ads adv banner sponsor sponsored promo promotion nav navigation menu header masthead footer aside rail widget widgets pager toolbar notice "
    "notices consent privacy modal overlay subscribe subscription signup login register search form share sharing social related "
    "recommended recommendations discussion reply replies skip copyright legal disclaimer".split()
)
PLAIN_NAMES = set("site page main top bottom left right box block bar list links wrap wrapper container inner outer area section panel global row col".split())
NEGATIONS = set("no not without has with is hide show".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "drop", "hint", "label", "tag")

    def __init__(self, tag: str, label: str, drop: bool, hint: bool) -> None:
        self.tag, self.label, self.drop, self.hint = tag, label, drop, hint
        self.children: list[Node | str] = []


def names_a_side(token: str) -> bool:
    """Whether a class name or id says that its element is beside the text."""
    parts = [x.lower() for x in _NAME.findall(token) if len(x) > 1]
    if not parts or parts[0] in NEGATIONS:
        return False
    return bool(SURE_NAMES & set(parts)) or bool(SIDE_NAMES & set(parts)) and set(parts) <= SIDE_NAMES | PLAIN_NAMES


def _node(tag: str, attributes: str) -> Node:
    drop, hint, label = tag in NOT_TEXT, tag in SIDES, tag
    if attributes.strip(" /"):
        found = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
        tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
        label = ".".join([tag, *(x.lower() for t in tokens for x in _NAME.findall(t))])
        hint |= any(map(names_a_side, tokens)) or found.get("role", "").lower() in ROLES
        drop |= "hidden" in found or found.get("aria-hidden") == "true"
        drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()))
    return Node(tag, label, drop, hint and tag not in ("body", "html", "article", "main"))


def parse(page: str) -> Node:
    """A DOM tree that forgives missing and stray end tags; comments and the insides of scripts are left out."""
    root = Node("#root", "#root", False, False)
    stack, at, n = [root], 0, len(page)

    def close(tags: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            close({tag}, set() if tag in ("body", "html") else {"table"} if tag not in ("table", *SCOPES) and tag in INLINE else set())
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "article", "section", "main", "div", "td", "li", "button", "body", "blockquote"})
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES[tag])
        node = _node(tag, m[3] or m[6] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = n if end is None else end.start()
            if end is not None:
                at = page.find(">", end.start()) + 1 or n
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append(node)
    return root


class Slot:
    """A block element, or a run of text between block elements; an element with one run alone has it as its own."""

    __slots__ = ("children", "drop", "flag", "hint", "label", "linked", "size", "tag", "text")

    def __init__(self, label: str, tag: str = "", drop: bool = False, hint: bool = False, text: str = "", linked: int = 0) -> None:
        self.label, self.tag, self.drop, self.hint, self.text, self.linked = label, tag, drop, hint, text, linked
        self.children: list[Slot] = []
        self.size, self.flag = 1, ""


def slots(root: Node) -> Slot:
    """The page's tree of blocks.

    Inline elements do not end a run, and a line break is white space. A header is a side only
    outside an article. Of dropped elements only the place is left.
    """
    top, made = Slot(root.label, root.tag), []
    run: list[str] = []
    linked = 0

    def end(owner: Slot) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            owner.children.append(Slot("#text", text=text, linked=min(linked, len(text))))
        run.clear()
        linked = 0

    # Explicit stack: pages may nest without bound. Items are nodes, texts, or ends of blocks.
    todo: list[tuple] = [(c, top, False, False) for c in reversed(root.children)]
    while todo:
        item, owner, in_link, article = todo.pop()
        if item is None:
            end(owner)
        elif isinstance(item, str):
            run.append(item)
            linked += len(item.strip()) if in_link else 0
        elif item.tag in INLINE:
            if item.tag == "br":
                run.append(" ")
            elif not (item.drop or item.hint):
                todo.extend((c, owner, in_link or item.tag == "a", article) for c in reversed(item.children))
        else:
            end(owner)
            child = Slot(item.label, item.tag, item.drop, item.hint or item.tag == "header" and not article)
            owner.children.append(child)
            made.append(child)
            if not item.drop:
                inside = article or item.tag in ("article", "main")
                todo.append((None, child, False, False))
                todo.extend((c, child, in_link, inside) for c in reversed(item.children))
    end(top)
    for x in [*reversed(made), top]:
        if len(x.children) == 1 and x.children[0].label == "#text":
            x.text, x.linked = x.children[0].text, x.children[0].linked
            x.children = []
        x.size = 1 + sum(c.size for c in x.children)
    return top


def preorder(top: Slot) -> Iterator[Slot]:
    todo = [top]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(reversed(x.children))


# -- alignment -----------------------------------------------------------------------------------


def _heaviest(weight: Callable[[int], np.ndarray], rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (i, j) of the heaviest matching that keeps the order of rows and columns."""
    if len(rows) == 0 or len(columns) == 0:
        return []
    if len(rows) * len(columns) > _CELLS and len(rows) > 1:
        half = len(rows) // 2
        ahead = _last_row(weight, rows[:half], columns)
        behind = _last_row(weight, rows[:half - 1 : -1], columns[::-1])
        cut = int(np.argmax(ahead + behind[::-1]))
        return _heaviest(weight, rows[:half], columns[:cut]) + _heaviest(weight, rows[half:], columns[cut:])
    table = np.zeros((len(rows) + 1, len(columns) + 1), dtype=np.int64)
    for k, i in enumerate(rows.tolist(), 1):
        table[k, 1:] = np.maximum.accumulate(np.maximum(table[k - 1, 1:], table[k - 1, :-1] + weight(i)[columns]))
    out = []
    i, j = len(rows), len(columns)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((int(rows[i]), int(columns[j])))
    return out[::-1]


def _last_row(weight: Callable[[int], np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    now = np.zeros(len(columns) + 1, dtype=np.int64)
    for i in rows.tolist():
        now[1:] = np.maximum.accumulate(np.maximum(now[1:], now[:-1] + weight(i)[columns]))
    return now


def _children_matched(x: Slot, y: Slot, below: dict[tuple[int, int], tuple[int, list]]) -> tuple[int, list[tuple[Slot, Slot]]]:
    """The score of two nodes of one label, and their children's pairs; ``below`` has the scores of the children's."""
    left, right = x.children, y.children
    head, tail, least = 0, 0, min(len(left), len(right))
    # A leaf counts one at most, so equal leaves at either end belong together in some best matching.
    alike = lambda a, b: a.label == b.label and not a.children and not b.children
    while head < least and alike(left[head], right[head]):
        head += 1
    while tail < least - head and alike(left[-1 - tail], right[-1 - tail]):
        tail += 1
    rows, columns = np.arange(head, len(left) - tail), np.arange(head, len(right) - tail)
    pairs = [*zip(left[:head], right[:head], strict=True), *(zip(left[-tail:], right[-tail:], strict=True) if tail else ())]
    codes: dict[str, int] = {}
    labels = np.array([codes.setdefault(c.label, len(codes)) for c in right], dtype=np.int64)
    inner = [j for j in columns.tolist() if right[j].children]

    def weight(i: int) -> np.ndarray:
        own = left[i]
        out = (labels == codes.get(own.label, -1)).astype(np.int64)
        if own.children:
            for j in inner:
                if out[j]:
                    out[j] = below[id(own), id(right[j])][0]
        return out

    pairs += [(left[i], right[j]) for i, j in _heaviest(weight, rows, columns)]
    score = 1 + sum(below[id(a), id(b)][0] if (id(a), id(b)) in below else 1 for a, b in pairs)
    return score, pairs


def align(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the most nodes that match with order and ancestors kept, and which.

    Matched nodes have equal labels, and their parents match. Exact for any depth and width:
    pairs of inner nodes wait on an explicit stack until the pairs below them are done.
    """
    if a.label != b.label:
        return 0, []
    below: dict[tuple[int, int], tuple[int, list]] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if (id(x), id(y)) in below:
            continue
        if ready:
            below[id(x), id(y)] = _children_matched(x, y, below)
            continue
        todo.append((x, y, True))
        of_label: dict[str, list[Slot]] = {}
        for d in y.children:
            if d.children:
                of_label.setdefault(d.label, []).append(d)
        todo.extend((c, d, False) for c in x.children if c.children for d in of_label.get(c.label, ()))
    pairs, follow = [], [(a, b)]
    while follow:
        x, y = follow.pop()
        pairs.append((x, y))
        if (id(x), id(y)) in below:
            follow.extend(below[id(x), id(y)][1])
    return below[id(a), id(b)][0], pairs


# -- layouts -----------------------------------------------------------------------------------


def skeleton(order: list[Slot]) -> str:
    """A tree without its texts: labels, tags, drops and hints, parents, in page order."""
    number = {id(x): k for k, x in enumerate(order)}
    parents = [-1] * len(order)
    for k, x in enumerate(order):
        for c in x.children:
            parents[number[id(c)]] = k
    return json.dumps([[x.label for x in order], [x.tag for x in order], [x.drop + 2 * x.hint for x in order], parents], separators=(",", ":"))


def nodes(skeleton: str) -> list[Slot]:
    """The tree of a skeleton, in page order."""
    labels, tags, flags, parents = json.loads(skeleton)
    made = [Slot(label, tag, bool(flag & 1), bool(flag & 2)) for label, tag, flag in zip(labels, tags, flags, strict=True)]
    for x, up in zip(made[1:], parents[1:], strict=True):
        made[up].children.append(x)
    for x in reversed(made):
        x.size = 1 + sum(c.size for c in x.children)
    return made


class Layout:
    """The union of the trees of pages that match: nodes that it lacks are inserted beside what their neighbours are aligned with."""

    def __init__(self, order: list[Slot]) -> None:
        self.tree = order[0]
        self._list()

    def _list(self) -> None:
        self.order = list(preorder(self.tree))
        for x in reversed(self.order):
            x.size = 1 + sum(c.size for c in x.children)
        self.labels = Counter(x.label for x in self.order)

    def add(self, tree: Slot, pairs: list[tuple[Slot, Slot]]) -> None:
        if len(pairs) == tree.size:
            return
        known = {id(y): x for x, y in pairs}
        for y in preorder(tree):
            x, before = known[id(y)], -1
            for c in y.children:
                if id(c) in known:
                    before = next(k for k in range(before + 1, len(x.children)) if x.children[k] is known[id(c)])
                else:
                    before += 1
                    known[id(c)] = Slot(c.label, c.tag, c.drop, c.hint)
                    x.children.insert(before, known[id(c)])
        self._list()


def fitting(known: list[Layout], order: list[Slot]) -> tuple[int, list[tuple[Slot, Slot]]] | None:
    """The number of the layout that a tree has most in common with, and the pairs; None if it fits none.

    Equal labels bound what can match, so layouts that cannot be better are not aligned.
    """
    own, best, found = Counter(x.label for x in order), SAME_LAYOUT, None
    for k, layout in enumerate(known):
        least = min(layout.tree.size, len(order))
        bound = sum(min(n, layout.labels[x]) for x, n in own.items()) / least
        if bound < best or found is not None and bound == best:
            continue
        score, pairs = align(layout.tree, order[0])
        if (share := score / least) > best or found is None and share == best:
            best, found = share, (k, pairs)
            if score == least:
                break
    return found


def layouts(skeletons: list[str]) -> list[str]:
    """Layouts of trees, or of layouts, as skeletons: the largest first, each joins the one that it fits or starts a new one."""
    found: list[Layout] = []
    for _, _, order in sorted(((-len(o), s, o) for s in skeletons if (o := nodes(s))), key=lambda r: r[:2]):
        if (fit := fitting(found, order)) is None:
            found.append(Layout(order))
        else:
            found[fit[0]].add(order[0], fit[1])
    return [skeleton(x.order) for x in found]


# -- induction ---------------------------------------------------------------------------------


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def text_counts(order: list[Slot]) -> np.ndarray:
    """Of each node with text: its number, the text's key, letters, and letters outside links."""
    rows = [(k, _key(x.text), len(x.text), len(x.text) - x.linked) for k, x in enumerate(order) if x.text]
    return np.array(rows, dtype=np.int64).reshape(-1, 4).T


class Counted:
    """Texts at a node of a layout: how many, how often the most frequent, its key, letters, letters outside links."""

    __slots__ = ("key", "letters", "most", "n", "plain")

    def __init__(self, n: int, most: int, key: int, letters: int, plain: int) -> None:
        self.n, self.most, self.key, self.letters, self.plain = n, most, key, letters, plain


def mark(order: list[Slot], counts: dict[int, Counted], pages: int) -> list[str] | None:
    """Flags by node: s for sides, t for template, r for the article, k for rare slots outside it. None if there is no article."""
    number = {id(x): k for k, x in enumerate(order)}
    parent = [-1] * len(order)
    for k, x in enumerate(order):
        for c in x.children:
            parent[number[id(c)]] = k
    fixed = {k for k, c in counts.items() if c.n >= max(TEMPLATE_PAGES, pages / 2) and c.most >= TEMPLATE_SHARE * c.n}
    varying, letters, plain = Counter(), Counter(), Counter()
    for k in range(len(order) - 1, -1, -1):
        if (own := counts.get(k)) is not None:
            letters[k] += own.letters
            plain[k] += own.plain
            varying[k] += own.plain if k not in fixed else 0
        if k:
            for c in (varying, letters, plain):
                c[parent[k]] += c[k]
    flags, kept, articles, todo = [""] * len(order), [], [], [(0, 0, False)]
    while todo:
        k, depth, inside = todo.pop()
        x = order[k]
        menu = x.tag in ("ul", "ol") and not inside and plain[k] < 0.2 * letters[k]
        if x.drop or menu or x.hint and varying[k] < NOT_A_SIDE * varying[0]:
            flags[k] = "s"
            continue
        inside = inside or x.tag in ("article", "main")
        if x.tag in ("article", "main"):
            articles.append(k)
        if k in counts and k not in fixed:
            kept.append((k, depth))
        todo.extend((number[id(c)], depth + 1, inside) for c in reversed(x.children))
    if not kept:
        return None
    common = [(k, depth) for k, depth in kept if counts[k].n >= RARE_SHARE * pages] or kept
    # The lowest element that holds all slots that are left.
    region, at = common[0]
    for k, depth in common[1:]:
        while depth > at:
            k, depth = parent[k], depth - 1
        while at > depth:
            region, at = parent[region], at - 1
        while k != region:
            k, region, at = parent[k], parent[region], at - 1
    left = sum(counts[k].plain for k, _ in kept)
    within = lambda k, top: top <= k < top + order[top].size
    for a in articles:
        if within(a, region) and sum(counts[k].plain for k, _ in kept if within(k, a)) >= ARTICLE_SHARE * left:
            region = a
            break
    else:
        for k, _ in kept:
            if not within(k, region):
                flags[k] = "k"
    # Constant text before the first slot and after the last is template; what lies between, or in one
    # element with a slot, is the article's.
    inner, todo = [], [region]
    while todo:
        k = todo.pop()
        if flags[k] != "s":
            inner.append(k)
            todo.extend(number[id(c)] for c in reversed(order[k].children))
    slotted, around = {k for k, _ in common}, set()
    for k, _ in common:
        while k not in (region, -1) and (k := parent[k]) not in (region, -1) and k not in around:
            around.add(k)
    places = [i for i, k in enumerate(inner) if k in slotted] or [0]
    for i, k in enumerate(inner):
        if k in fixed and not places[0] <= i <= places[-1] and (k == region or parent[k] not in around):
            flags[k] = "t"
    flags[region] += "r"
    return flags


def wrapper_of(found: list[str], counts: dict[int, dict[int, Counted]], pages: dict[int, int]) -> list[list]:
    """For each layout its skeleton, the flags of its nodes, and the template texts' keys by node; no flags where it has no article."""
    out = []
    for k, skeleton in enumerate(found):
        own = counts.get(k, {})
        flags = mark(nodes(skeleton), own, pages.get(k, 0)) if own else None
        out.append([skeleton, flags, {i: own[i].key for i, f in enumerate(flags or ()) if "t" in f}])
    return out


def induce(pages: list[str]) -> list[list]:
    """The wrapper of pages of one host, in one process; the job does the same over tables.

    Pages with the same texts count once. With fewer than TEMPLATE_PAGES pages no text is template.
    """
    trees = [list(preorder(slots(parse(p)))) for p in pages]
    told = {(skeleton(o), text_counts(o).tobytes()) for o in trees if any(x.text for x in o)}
    found = layouts(sorted({s for s, _ in told}))
    matcher = Matcher()
    seen: dict[tuple[int, int], list] = {}
    n_pages: Counter = Counter()
    for own, raw in told:
        k, place = matcher.place("", found, own)
        n_pages[k] += 1
        for node, key, letters, plain in np.frombuffer(raw, dtype=np.int64).reshape(4, -1).T.tolist():
            seen.setdefault((k, place[node]), []).append((key, letters, plain))
    counts: dict[int, dict[int, Counted]] = {}
    for (k, node), rows in seen.items():
        key, most = Counter(r[0] for r in rows).most_common(1)[0]
        counts.setdefault(k, {})[node] = Counted(len(rows), most, key, sum(r[1] for r in rows), sum(r[2] for r in rows))
    return wrapper_of(found, counts, n_pages)


class Matcher:
    """Alignments of shapes with the layouts of their hosts; equal ones are found once."""

    def __init__(self) -> None:
        self.known: dict[str, list[Layout]] = {}
        self.places: dict[tuple[str, str], tuple[int, list[int]] | None] = {}

    def place(self, name: str, skeletons: list[str], own: str) -> tuple[int, list[int]] | None:
        """The layout that a page's skeleton fits, and the layout's node for each node of the page, -1 for none."""
        if (name, own) in self.places:
            return self.places[name, own]
        if name not in self.known:
            self.known.clear() if len(self.known) > 1000 else None
            self.known[name] = [Layout(nodes(s)) for s in skeletons]
        order = nodes(own)
        found = fitting(self.known[name], order)
        if found is not None:
            of = {id(x): k for k, x in enumerate(self.known[name][found[0]].order)}
            at = {id(y): of[id(x)] for x, y in found[1]}
            found = found[0], [at.get(id(y), -1) for y in order]
        self.places.clear() if len(self.places) >= KEPT_ALIGNMENTS else None
        self.places[name, own] = found
        return found


def references(wrapper: list[list]) -> list[list]:
    """The wrapper with numbers as the keys of its maps, which JSON has as strings."""
    return [[skeleton, flags, {int(k): key for k, key in told.items()}] for skeleton, flags, told in wrapper]


def read_page(own: str, counts: np.ndarray, texts: list[str], known: list[list], name: str, matcher: Matcher) -> str:
    """The article's blocks, one to a line.

    The page is aligned with the layouts of its host and read by the one that it has most in
    common with. Where it fits none, lacks the article, or only template would be left of it,
    it is its own layout.
    """
    if not len(texts):
        return ""
    order = nodes(own)
    at, keys, letters, plain = counts.tolist()
    for k, text in zip(at, texts, strict=True):
        order[k].text = text
    fit = matcher.place(name, [w[0] for w in known], own) if known else None
    found = []
    if fit is not None and known[fit[0]][1] is not None:
        _, flags, told = known[fit[0]]
        found = _read(order, dict(zip(at, keys, strict=True)), fit[1], flags, told)
    if not found:
        alone = {k: Counted(1, 1, *rest) for k, *rest in zip(at, keys, letters, plain, strict=True)}
        if (flags := mark(order, alone, 1)) is not None:
            found = _read(order, {}, list(range(len(order))), flags, {})
    return "\n".join(found)


def extract(page: str | None, known: list[list]) -> str:
    """The main text of a page by a wrapper."""
    order = list(preorder(slots(parse(page or ""))))
    return read_page(skeleton(order), text_counts(order), [x.text for x in order if x.text], known, "", Matcher())


def _read(order: list[Slot], keys: dict[int, int], place: list[int], flags: list[str], told: dict[int, int]) -> list[str]:
    of = [flags[x] if x >= 0 else "" for x in place]
    region = next((k for k, f in enumerate(of) if "r" in f), None)
    if region is None:
        return []
    end = region + order[region].size
    letters = np.cumsum([0, *(len(x.text) for x in order)])
    whole = letters[end] - letters[region]
    out, k = [], 0
    while k < len(order):
        y, after = order[k], k + order[k].size
        if not (k < region and after >= end):
            # A side, or what is named so and no page of the layout has at this place.
            if y.drop or "s" in of[k] or place[k] < 0 and y.hint and letters[after] - letters[k] < NOT_A_SIDE * whole:
                k = after
                continue
            template = "t" in of[k] and keys.get(k) == told.get(place[k])
            if y.text and (region <= k < end or "k" in of[k]) and not template:
                out.append(y.text)
        k += 1
    return out


# -- Spark -------------------------------------------------------------------------------------


def page_trees(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's tree: id, url, host, skeleton, counts of its nodes with text, and these texts."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    slim = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"), host.alias("_host"),
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees = [list(preorder(slots(parse(p)))) for p in batch["_html"]]
            yield pd.DataFrame({
                "_id": batch["_id"].astype("Int64"), "_url": batch["_url"], "_host": batch["_host"], "_skeleton": [skeleton(o) for o in trees],
                "_counts": [text_counts(o).tobytes() for o in trees], "_texts": [[x.text for x in o if x.text] for o in trees],
            })

    return slim.mapInPandas(cut, "_id long, _url string, _host string, _skeleton string, _counts binary, _texts array<string>")


def host_layouts(trees: DataFrame) -> DataFrame:
    """(host, layouts as JSON) over all distinct shapes of each host's pages.

    A task makes layouts of a block of about BLOCK_SHAPES shapes of a host, then a host's blocks are
    merged, so a hot host never gathers.
    """
    shapes = materialize(trees.where(F.size("_texts") > 0).select("_host", "_skeleton").distinct(), "page-shapes")
    sizes = shapes.groupBy("_host").agg(F.count(F.lit(1)).alias("_shapes"))
    block = F.pmod(F.xxhash64("_skeleton"), F.ceil(F.col("_shapes") / BLOCK_SHAPES))
    blocks = with_groups(shapes, materialize(sizes, "page-shape-counts"), "_host", "_shapes").select("_host", "_skeleton", block.alias("_block"))

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        found = layouts(list(rows["_skeleton"]))
        return pd.DataFrame({"_host": [rows["_host"].iat[0]] * len(found), "_skeleton": found})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_host": [rows["_host"].iat[0]], "_layouts": [json.dumps(layouts(list(rows["_skeleton"])))]})

    partial = blocks.groupBy("_host", "_block").applyInPandas(own, "_host string, _skeleton string")
    return partial.groupBy("_host").applyInPandas(merged, "_host string, _layouts string")


def _with_hosts(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows with what their hosts have in ``column``; ``known`` is a stored table with numbers of pages."""
    (n_bytes,) = known.agg(F.sum(F.octet_length(column))).first()
    return with_groups(rows, known, "_host", "_pages", few=None if (n_bytes or 0) <= BROADCAST_BYTES else 0)


def induce_wrappers(trees: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, number of pages) from all pages of each host; ``trees`` is a stored table.

    Pages of a host with the same texts count once. What is counted at a layout's nodes is
    aggregated by text, then by node, both in part before the exchange.
    """
    sizes = trees.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    known = materialize(host_layouts(trees).join(sizes, "_host"), "layouts")
    distinct = trees.where(F.size("_texts") > 0).select("_host", "_skeleton", "_counts").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, lists = Matcher(), {}
        for batch in batches:
            hosts, parts = [], []
            for host, own, raw, found in zip(batch["_host"], batch["_skeleton"], batch["_counts"], batch["_layouts"], strict=True):
                if found not in lists:
                    lists.clear() if len(lists) > 1000 else None
                    lists[found] = json.loads(found)
                # Every page is part of a layout of its host, so it fits one.
                k, place = matcher.place(found, lists[found], own)
                rows = np.frombuffer(raw, dtype=np.int64).reshape(4, -1)
                # A row of node -1 stands for the page.
                at = np.r_[-1, np.array(place)[rows[0]]]
                parts.append(np.vstack([np.full(len(at), k), at, np.c_[np.zeros((3, 1), dtype=np.int64), rows[1:]]]))
                hosts.append(np.full(len(at), host, dtype=object))
            if parts:
                layout, node, key, letters, plain = np.hstack(parts)
                yield pd.DataFrame({"_host": np.concatenate(hosts), "layout": layout, "node": node, "key": key, "letters": letters, "plain": plain})

    joined = _with_hosts(distinct, known, "_layouts").select("_host", "_skeleton", "_counts", "_layouts")
    rows = joined.mapInPandas(count, "_host string, layout long, node long, key long, letters long, plain long")
    place = ["_host", "layout", "node"]
    by_text = rows.groupBy(*place, "key").agg(F.count(F.lit(1)).alias("n"), F.sum("letters").alias("letters"), F.sum("plain").alias("plain"))
    by_node = by_text.groupBy(*place).agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "key")).alias("top"), F.sum("letters").alias("letters"), F.sum("plain").alias("plain")
    )
    of_host = by_node.groupBy("_host").agg(F.to_json(F.collect_list(F.array("layout", "node", "n", "top.n", "top.key", "letters", "plain"))).alias("_counted"))

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wrappers = []
            for found, counted in zip(batch["_layouts"], batch["_counted"], strict=True):
                counts: dict[int, dict[int, Counted]] = {}
                pages = {}
                for k, node, n, most, key, letters, plain in json.loads(counted):
                    if node < 0:
                        pages[k] = n
                    else:
                        counts.setdefault(k, {})[node] = Counted(n, most, key, letters, plain)
                wrappers.append(json.dumps(wrapper_of(json.loads(found), counts, pages)))
            yield pd.DataFrame({"_host": batch["_host"], "_wrapper": wrappers, "_pages": batch["_pages"]})

    return known.join(of_host, "_host").mapInPandas(wrap, "_host string, _wrapper string, _pages long")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Character references are decoded, white space within a block is one space, and blocks are
    joined in page order by one line end. Pages without text, null and empty ones give an empty
    text. Ids and urls may be null or repeat (pages without a host share a wrapper); other
    columns are ignored. Every page is parsed whole, once, and counts in its host's wrapper.
    """
    trees = materialize(page_trees(pages, id_col, url_col, html_col), "page-trees")
    joined = _with_hosts(trees, materialize(induce_wrappers(trees), "wrappers"), "_wrapper")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, lists = Matcher(), {}
        for batch in batches:
            texts = []
            for own, raw, blocks, wrapper in zip(batch["_skeleton"], batch["_counts"], batch["_texts"], batch["_wrapper"], strict=True):
                wrapper = wrapper if isinstance(wrapper, str) else "[]"
                if wrapper not in lists:
                    lists.clear() if len(lists) > 1000 else None
                    lists[wrapper] = references(json.loads(wrapper))
                texts.append(read_page(own, np.frombuffer(raw, dtype=np.int64).reshape(4, -1), list(blocks), lists[wrapper], wrapper, matcher))
            yield pd.DataFrame({"_id": batch["_id"].astype("Int64"), "_url": batch["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = joined.select("_id", "_url", "_skeleton", "_counts", "_texts", "_wrapper").mapInPandas(read, "_id long, _url string, text string, n_chars long")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
