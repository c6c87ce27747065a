"""Main text of web pages from flat text blocks and a small decision tree.

A page becomes a flat list of text blocks. Each has its word count and link
density, those of its neighbours, and what its open elements say of it: whether
it lies in an element or under a name of side matter, in an article, or is a
heading. A decision tree, trained on the blocks of the small labelled pages
below, tells content from the rest.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mapped

#: Elements whose whole content is no text of the page; without an end tag they run to the end of it.
_RAW = "script|style|template|textarea|title"
#: Those that hold other elements and end with the element around them; only the nested ones may lie in their like.
_NESTED = frozenset("svg object math".split())
_MUTE = _NESTED | frozenset("noscript iframe select button canvas audio video".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Elements that end a block where they begin or end.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot"
    " th thead tr ul caption".split()
)
#: Block elements that may stand open around other blocks, and so are remembered.
_OUTER = _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr dd dt legend summary option optgroup".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SIDE = frozenset("nav footer aside menu dialog search optgroup option".split())
_SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_SIDE_NAMES = frozenset(
    "ad ads adv advert adverts alert advertisement advertising authorbox banner breadcrumb breadcrumbs comment commentform commentlist comments copyright cookie cookiebar cookienotice cookies consent"
    " disclaimer disqus disqusthread dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification"
    " pagination pager popup promo promos promoted promotion recommended related reply replies respond responses reviews search share sharing sidebar"
    " signup siteinfo skyscraper social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget".split()
)
#: Names of matter that comes as articles of its own, and of notices that are never the text of a page.
_MANY_NAMES = frozenset("comment commentform commentlist comments disqus disqusthread related recommended reply replies respond responses reviews".split())
_NOTICE_NAMES = frozenset("cookie cookiebar cookienotice cookies consent gdpr".split())
#: A last part that ends so is a name of side matter too, as in "mainmenu".
_SIDE_ENDS = ("banner", "comments", "footer", "menu", "navbar", "sidebar")
#: After a side name, these leave it one, as in "comment-body"; before one, those say what a page has or is filed under.
_PLAIN_PARTS = frozenset(
    "area bar block body box buttons column container content form group icons inner item items label link links list message nav panel"
    " post posts section slot text title unit widget widgets wrap wrapper".split()
)
_NOT_OF_ITSELF = frozenset("has with without no not hide show tag category cat topic term format type status author tax taxonomy".split())

# What a mark comes from, and so what takes it away again (see ``_Marks``).
_HIDDEN, _FIRM, _NOTICE, _MANY, _LOOSE, _ARTICLE = range(6)
#: Characters from which a block is running text, and the link density that it stays below.
RUNNING_CHARS = 50
RUNNING_DENSITY = 0.33
#: Short blocks outside articles that say so are imprints or calls to sign up, whatever their element's name.
IMPRINT_WORDS = 30
_IMPRINT = re.compile(r"\ball rights reserved\b|^(?:copyright\b|\(c\)|©)\W*(?:19|20)\d\d\b|^(?:subscribe to|sign up (?:for|to)) (?:our|the|this) ", re.I).search


@dataclass
class Block:
    text: str
    link_chars: int
    chars: int
    side_element: bool
    side_name: bool
    article: bool
    heading: bool

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0


@dataclass
class _Open:
    name: str
    mark: int
    article: bool


class _Marks:
    """The marks of side matter of a page, each within another or none (-1).

    Hidden and firm marks hold for all inside, but a main element ends the firm
    ones. A mark from a loose name or a form says little of what it is around:
    articles inside are free of it unless other text of the page outweighs them,
    and it goes if next to no running text of the page is outside it. Comments
    and related matter hold articles, and go only if the page has little else.
    """

    def __init__(self) -> None:
        self.around: list[int] = []
        self.kind: list[int] = []
        self.hidden: list[int] = []  # the nearest hidden mark, itself included
        self.firm: list[bool] = []  # whether an article stays within it
        self.own: list[int] = []

    def add(self, around: int, kind: int) -> int:
        m = len(self.kind)
        self.around.append(around)
        self.kind.append(kind)
        self.hidden.append(m if kind == _HIDDEN else self.hidden[around] if around >= 0 else -1)
        self.firm.append(kind in (_HIDDEN, _FIRM, _MANY) or (around >= 0 and self.firm[around]))
        self.own.append(0)
        return m

    def side(self, found: list[Block], at: list[int]) -> list[int]:
        """The kind of mark that each block is left under, given the one it was made under; -1 for none."""
        free = 0
        for b, m in zip(found, at, strict=True):
            if (b.chars >= RUNNING_CHARS or b.article) and b.density < RUNNING_DENSITY:
                if m < 0:
                    free += b.chars
                else:
                    self.own[m] += b.chars
        n = len(self.kind)
        gone = [False] * n

        def totals() -> list[int]:
            total = list(self.own)
            for m in range(n - 1, -1, -1):
                if self.around[m] >= 0 and not gone[m] and self.kind[m] > _NOTICE:
                    total[self.around[m]] += total[m]
            return total

        inside: list[list[int]] = [[] for _ in range(n)]
        for m in range(n):
            if self.around[m] >= 0:
                inside[self.around[m]].append(m)
        total, outside = totals(), free
        groups = [[k for k in x if self.kind[k] == _ARTICLE] for x in inside]
        for articles in sorted(filter(None, groups), key=lambda x: -sum(total[k] for k in x)):
            size = sum(total[k] for k in articles)
            if 2 * size < outside:
                break
            outside = max(outside, size)
            for k in articles:
                gone[k] = True
                free += self.own[k]
        total = totals()
        open_marks = [(-total[m], m) for m in range(n) if self.around[m] < 0 or gone[self.around[m]]]
        heapq.heapify(open_marks)
        while open_marks:
            _, m = heapq.heappop(open_marks)
            loose = self.kind[m] in (_LOOSE, _ARTICLE)
            least, most = (RUNNING_CHARS, 1000) if loose else (200, 200)
            if gone[m] or self.kind[m] <= _NOTICE or total[m] < max(least, 4 * free) or free >= most:
                continue
            gone[m] = True
            free += self.own[m]
            for k in inside[m]:
                if self.kind[k] == _ARTICLE and not gone[k]:
                    gone[k] = True
                    free += self.own[k]
                    for j in inside[k]:
                        heapq.heappush(open_marks, (-total[j], j))
                else:
                    heapq.heappush(open_marks, (-total[k], k))
        held: list[int] = []
        for m in range(n):
            outer = held[self.around[m]] if self.around[m] >= 0 else -1
            if gone[m]:
                held.append(-1 if self.kind[m] == _ARTICLE else outer)
            elif outer >= 0:
                held.append(min(outer, self.kind[m]))
            else:
                held.append(self.kind[m])
        return [held[m] if m >= 0 else -1 for m in at]


@dataclass
class _Builder:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    chars: int = 0


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, white space squeezed, none empty.

    Unclosed elements end with the element around them; a stray end tag is
    passed over; a tag cut off by the end of the page is dropped.
    """
    out: list[Block] = []
    at_mark: list[int] = []
    marks = _Marks()
    stack: list[_Open] = []
    open_names: Counter[str] = Counter()
    links = 0  # the open elements around a link, itself included; it lasts over blocks until they end
    heading = in_leaf = False
    leaf: _Open | None = None  # an open paragraph or heading, with what it says of itself
    now = _Builder()

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        now.parts.append(text)
        n = len(text) - text.count(" ")
        now.chars += n
        if links:
            now.link_chars += n

    def flush() -> None:
        nonlocal now
        text = " ".join("".join(now.parts).split())
        if text:
            top = leaf or (stack[-1] if stack else _Open("", -1, False))
            out.append(Block(text, now.link_chars, now.chars, False, False, top.article, heading))
            at_mark.append(top.mark)
        now = _Builder()

    at = 0
    mute = ""  # an element without an end tag of its own, until the next block
    tokens = list(_TOKEN.finditer(page))
    ends = _mute_ends(tokens)
    for k, token in enumerate(tokens):
        if token.start() < at:
            continue
        if token.start() > at and not mute:
            add(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            if token["raw"]:
                now.parts.append(" ")
            continue
        if mute and name in _BLOCK and not (mute == "select" and name in ("option", "optgroup")):
            mute = ""
        if name in _MUTE:
            now.parts.append(" ")
            if k in ends:
                at = tokens[ends[k]].end()
            elif token["close"]:
                mute = "" if mute == name else mute
            elif not token["attrs"].endswith("/"):
                mute = name
        elif name == "a":
            links = len(stack) + 1 if not token["close"] and "href" in token["attrs"].lower() else 0
            in_leaf = leaf is not None
        elif name == "br":
            now.parts.append(" ")
        elif name in _BLOCK and not mute:
            flush()
            links, leaf = 0 if in_leaf else links, None
            heading = name in _HEADING and not token["close"]
            if token["close"]:
                if open_names[name]:
                    above = ""
                    while above != name:
                        above = stack.pop().name
                        open_names[above] -= 1
                    links = 0 if links > len(stack) + 1 else links
            else:
                opened = _opened(name, token["attrs"], stack[-1] if stack else None, marks)
                if name in _OUTER:
                    stack.append(opened)
                    open_names[name] += 1
                else:
                    leaf = opened
    if at < len(page) and not mute:
        add(page[at:])
    flush()
    for b, kind in zip(out, marks.side(out, at_mark), strict=True):
        b.side_element, b.side_name = kind in (_HIDDEN, _FIRM), kind > _FIRM or (not b.article and b.words <= IMPRINT_WORDS and bool(_IMPRINT(b.text)))
    return out


def _mute_ends(tokens: list[re.Match]) -> dict[int, int]:
    """The end tag of each mute element that has one within the element around it, as places of tokens.

    A second button before the end of the first leaves the first without one,
    as does an end tag of an element around it; svg and math may close themselves.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    for k, token in enumerate(tokens):
        name = (token["name"] or "").lower()
        if name not in _MUTE and name not in _OUTER:
            continue
        if not token["close"]:
            if name in ("svg", "math") and token["attrs"].endswith("/"):
                continue
            if name in _MUTE and name not in _NESTED and count[name]:
                at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                stack[at] = ("", 0)
                count[name] -= 1
            stack.append((name, k))
            count[name] += 1
        elif count[name]:
            while True:
                above, start = stack.pop()
                count[above] -= 1
                if above == name:
                    break
            if name in _MUTE:
                ends[start] = k
    return ends


@lru_cache(maxsize=1 << 14)
def _token_kind(token: str) -> tuple[int, str] | None:
    """What a class or id says of its element, with the name that says it; None for nothing.

    The whole or its last part counts, or a first part that only plain ones
    follow; "content-sidebar-wrap" and "has-sidebar" are about other elements.
    """
    parts = [x.lower() for x in _PART.findall(token.partition("--")[0])]
    if not parts or (len(parts) > 1 and parts[0] in _NOT_OF_ITSELF and "".join(parts) not in _SIDE_NAMES):
        return None
    plain = len(parts) > 1 and all(x in _PLAIN_PARTS for x in parts[1:])
    for said in ("".join(parts), parts[-1], *parts[: int(plain)]):
        name = said if said in _SIDE_NAMES else next((x for x in _SIDE_ENDS if said.endswith(x)), "")
        if name:
            # "cookie-notice" is about cookies.
            notice = not _NOTICE_NAMES.isdisjoint(parts)
            return (_NOTICE if notice else _MANY if name in _MANY_NAMES else _LOOSE), name
    return None


def _opened(name: str, attrs: str, around: _Open | None, marks: _Marks) -> _Open:
    main, article = name == "main", name == "article"
    kinds: set[int] = set()
    inside = around.article if around else False
    if name in _SIDE:
        kinds.add(_FIRM)
    elif name in ("form", "fieldset") or (name == "header" and not inside):
        kinds.add(_LOOSE)
    said: list[str] = []
    hidden = False
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                said += value.split()
            elif key == "role":
                role = value.lower()
                main |= role == "main"
                article |= role == "article"
                if role in _SIDE_ROLES:
                    kinds.add(_FIRM)
                elif role == "form":
                    kinds.add(_LOOSE)
            elif key == "style":
                hidden |= "display:none" in value.lower().replace(" ", "")
            elif key == "aria-hidden":
                hidden |= value.lower() == "true"
    hidden |= bool(re.search(r"\bhidden(?:\s|$)", re.sub(_ATTR, " ", attrs))) if "hidden" in attrs else False
    if name not in ("html", "body", "main"):
        if hidden:
            kinds.add(_HIDDEN)
        for token in said if not main else ():
            found = _token_kind(token)
            if found and not (found[1] == "header" and (name == "header" or inside)):
                # An article is filed under all sorts of names; only those of other articles make it side matter.
                if not article or found[0] == _MANY:
                    kinds.add(found[0])
    mark = around.mark if around and name != "body" else -1
    if main and mark >= 0:
        mark = marks.hidden[mark]
    elif article and mark >= 0 and not marks.firm[mark]:
        mark = marks.add(mark, _ARTICLE)
    if kinds:
        mark = marks.add(mark, min(kinds))
    return _Open(name, mark, main or article or inside)


FEATURES = [
    "words", "density", "words_before", "density_before", "words_after", "density_after", "side_element", "side_name", "article", "heading"
]


def block_features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; beyond either end, words and density are 0."""
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.density for b in found])
    own = np.array([[b.side_element, b.side_name, b.article, b.heading] for b in found], dtype=float).reshape(-1, 4)
    before = lambda x: np.r_[0.0, x[:-1]]
    after = lambda x: np.r_[x[1:], 0.0]
    return np.c_[words, density, before(words), before(density), after(words), after(density), own]


#: Pages of ordinary kinds, made for this table. {n} stands for n words; a block that begins with + is content.
LABELLED_PAGES = [
    # news, with an article element
    """<header><div>{3}</div></header><nav><a href=x>{1}</a><ul><li><a href=x>{1}</a><li><a href=x>{2}</a></ul></nav><div class=ad>{9}</div>
    <article><h1>+{9}</h1><p>+{4}</p><p>+{35}</p><p>+{60}<a href=x>{3}</a></p><figcaption>+{9}</figcaption><p>+{2}</p><h2>+{3}</h2><p>+{44}</p>
    <div class=ad>{12}</div><p>+{1}</p><p>+{90}</p><ul><li>+{4}<li>+{6}<li><a href=x>+{3}</a></ul><p>+{22}</p></article>
    <aside><h3>{2}</h3><p>{18}</p><p>{25}</p></aside><footer><p>{14}</p><a href=x>{2}</a></footer>""",
    # a blog in plain div elements
    """<div>{2}</div><div>{6}</div><ul><li><a href=x>{1}</a><li><a href=x>{1}</a><li><a href=x>{2}</a></ul><h1>+{7}</h1><p>+{40}</p><p>+{7}</p><p>+{55}<a href=x>{6}</a></p>
    <h2>+{4}</h2><p>+{70}</p><blockquote>+{26}</blockquote><p>+{15}</p><p>+{33}</p><div><a href=x>{3}</a> <a href=x>{4}</a></div><div>{2}</div>
    <ul><li><a href=x>{6}</a><li><a href=x>{5}</a><li><a href=x>{7}</a></ul><div class=footer>{11}</div>""",
    # a portal: nothing but links, teasers and notices
    """<nav><a href=x>{1}</a><div><a href=x>{2}</a></div></nav><a href=x><div>{4}</div></a><a href=x><div>{5}</div></a><ul><li><a href=x>{8}</a><li><a href=x>{6}</a></ul>
    <ul><li><a href=x>{11}</a><li><a href=x>{13}</a><li><a href=x>{12}</a><li><a href=x>{14}</a></ul><div><a href=x>{3}</a></div><div>{1}</div><div><a href=x>{3}</a></div><div class="cookie-bar">{22}<a href=x>{2}</a></div><footer>{20}</footer>""",
    # a manual with a column of links
    """<div class=sidebar><a href=x>{2}</a><ul><li><a href=x>{1}</a><li><a href=x>{3}</a></ul><p>{8}</p></div><main><h1>+{3}</h1><p>+{12}</p><pre>+{20}</pre><p>+{5}</p>
    <table><tr><td>+{1}<td>+{5}<tr><td>+{2}<td>+{9}</table><h2>+{2}</h2><p>+{30}<a href=x>{8}</a></p><p><a href=x>+{2}</a></p><p>+{11}</p></main><div class=pagination><a href=x>{1}</a><a href=x>{1}</a></div><footer>{8}</footer>""",
    # comments and related texts under an article
    """<div class="site-header">{3}<ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></div><article><h1>+{8}</h1><p>+{50}</p><p>+{6}</p><p>+{31}</p><div class="share">{2}<a href=x>{1}</a></div><p>+{3}</p></article>
    <section id=comments><h2>{2}</h2><article class=comment><h3>{2}</h3><p>{30}</p></article><article class=comment><p>{18}</p><p>{41}</p></article></section>
    <div class=related><article><h3>{6}</h3><p>{22}</p></article></div><form>{3}<p>{9}</p></form><footer><p>{19}</p></footer>""",
    # an old page in tables
    """<table><tr><td><a href=x>{1}</a><td><a href=x>{2}</a><td><a href=x>{1}</a></table><table><tr><td><h2>+{5}</h2><p>+{48}</p><p>+{66}</p><p>+{5}</p><p>+{61}<a href=x>{2}</a></p><td><a href=x>{2}</a>
    <td><a href=x>{3}</a></table><div><a href=x>{2}</a> {1} <a href=x>{2}</a></div>""",
    # a notice alone, hidden matter, a form, and a text without markup
    """<p>+{8}</p><p>+{20}</p>""",
    """<p>+{4}</p>""",
    """<div class=cookie-notice>{30}</div><div class=cookie-notice><p>{24}</p></div>""",
    """<div hidden><article><p>{30}</p><p>{20}</p></article></div><div class=login><form>{2}<p>{3}</p></form></div><article><h1>+{4}</h1><p>+{26}</p><p>+{13}</p></article>""",
    # cards and tags inside the main element, and paragraphs with many links
    """<nav><a href=x>{1}</a><a href=x>{2}</a></nav><main><article><h1>+{7}</h1><p>+{40}</p><p>+{3}<a href=x>{5}</a></p><p><a href=x>+{6}</a></p><ul class=tags><li><a href=x>{1}</a><li><a href=x>{2}</a></ul></article>
    <div class=related><a href=x><h3>{4}</h3></a><a href=x><h3>{6}</h3></a><a href=x><div>{9}</div></a></div><div class="share"><a href=x>{2}</a> {1}</div></main><footer>{7}<a href=x>{2}</a></footer>""",
    """<div><a href=x>{1}</a> | <a href=x>{2}</a></div><h1>+{5}</h1><p>+{16}<a href=x>{12}</a></p><p>+{30}</p><p>+{9}<a href=x>{8}</a>{3}</p><p>+{24}<a href=x>{20}</a></p><p>+{18}</p>
    <div>{1}<a href=x>{2}</a><a href=x>{2}</a></div><div>{2}<a href=x>{3}</a></div>""",
    # a headline and links to other parts between short paragraphs
    """<div>{2}</div><ul><li><a href=x>{2}</a><li><a href=x>{1}</a></ul><h1>+{6}</h1><p>+{13}</p><p>+{25}</p><p>+{9}</p><p>+{41}</p><p>+{10}</p><ul><li>+{8}<li>+{11}</ul><p>+{17}</p>
    <a href=x><div>{4}</div></a><a href=x><div>{6}</div></a><div>{3}</div><ul><li><a href=x>{2}</a></ul>""",
]


def _filled(page: str) -> str:
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page)


def labelled_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of all blocks of labelled pages, and whether each is content."""
    rows, content = [], []
    for page in pages:
        found = blocks(_filled(page))
        content += [b.text.startswith("+") for b in found]
        rows.append(block_features(found))
    return np.concatenate(rows), np.array(content)


@dataclass
class Tree:
    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    content: bool = False

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(rows), self.content)
        high = rows[:, self.feature] >= self.threshold
        out = np.empty(len(rows), dtype=bool)
        out[high], out[~high] = self.high.predict(rows[high]), self.low.predict(rows[~high])
        return out

    def __str__(self) -> str:
        if self.low is None:
            return "content" if self.content else "rest"
        return f"({FEATURES[self.feature]} >= {self.threshold:g} ? {self.high} : {self.low})"


def _impurity(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return len(y) * 2 * p * (1 - p)


def train_tree(rows: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """A binary tree by Gini impurity; of equal splits the first feature and threshold."""
    leaf = Tree(content=bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or _impurity(y) == 0:
        return leaf
    best = (_impurity(y) - 1e-9, -1, 0.0)
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for t in (values[1:] + values[:-1]) / 2:
            high = rows[:, k] >= t
            if min(high.sum(), (~high).sum()) >= least and (g := _impurity(y[high]) + _impurity(y[~high])) < best[0] - 1e-9:
                best = (g, k, float(t))
    if best[1] < 0:
        return leaf
    high = rows[:, best[1]] >= best[2]
    low_tree, high_tree = (train_tree(rows[m], y[m], depth - 1, least) for m in (~high, high))
    if low_tree.low is None and high_tree.low is None and low_tree.content == high_tree.content:
        return leaf
    return Tree(best[1], best[2], low_tree, high_tree)


def labelled_tree() -> Tree:
    return train_tree(*labelled_rows(LABELLED_PAGES))


def extract(page: str | None, tree: Tree) -> str:
    """The content blocks of a page, joined by blank lines; empty for null."""
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, tree.predict(block_features(found)), strict=True) if keep)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    A null or empty page has an empty text. Repeated rows and null ids come
    back as they are; pages of any length are read whole, in time that grows
    with their length; an empty table gives no row; other columns are ignored,
    whatever their names.
    """
    tree = labelled_tree()

    def run(pages: list[str | None]) -> dict[str, list]:
        texts = [extract(x, tree) for x in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return mapped(read, run, {"text": "string", "n_chars": "long"})
