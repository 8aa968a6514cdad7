"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level tags; inline tags leave no trace. Each block has its number of
words and its link density (the share of its words inside links), those of the block before and after
it, and what the tags around it say: a container for navigation, forms and the like by its name or role,
one by a word of its class or id, an article or main container, a heading. A decision tree (Gini impurity,
grown to the end of a small table) says which blocks are text of the article. The table (``annotated``) has
pages with telling tags, with telling class names, and with neither, where only words and links, the
block's own and its neighbours', tell a short paragraph from a short line between menus. It is cut up by
the very pass that cuts up the pages to be judged.

Character references are decoded, white space inside a block becomes one space, and the blocks kept are
joined by one space in page order.

What HTML lets a page leave out is filled in: the head has no end of its own; content that is never shown
(``noscript``, ``svg``, ``button`` and the like) ends with its own end tag, with its parent's, or where a
tag opens that cannot stand inside it, and where no end tag follows at all, nothing is left out.

Defined cases: null and empty pages have no text; unclosed tags, quotes, comments, scripts and styles end
with the page; an unclosed title ends at the next tag; a page of any length is read whole, in linear time;
repeated pages give repeated rows.
"""

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mspace menclose semantics annotation".split()
)
RAW = frozenset("script style textarea title".split())  #: their content is no markup
HIDDEN = frozenset("noscript template iframe svg object select button canvas audio video datalist".split())  #: their content is no text of the page
WITHIN = frozenset("script style noscript template svg".split())  #: they do not end a block
SECTIONS = frozenset("article main body section h1 h2 h3".split())  #: none of these stands in a hidden element that is closed
FLOW = SECTIONS | frozenset("p h4 h5 h6 ul ol dl table blockquote pre nav footer header aside form".split())  #: nor these in one of phrases
PHRASES = frozenset("svg button select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation sidebar side footer header masthead breadcrumb breadcrumbs comment comments commentlist disqus replies reply respond discussion "
    "notice notification alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations widget toolbar pagination pager login signup search copyright legal disclaimer tags skip".split()
)
#: A name that begins so says how a page is laid out, not what the element is.
LAYOUT_WORDS = frozenset("no has with without layout template grid is not".split())
ARTICLE_WORDS = frozenset("article main content post entry story body text".split())
ROLES = {"navigation": True, "banner": True, "contentinfo": True, "complementary": True, "search": True, "form": True, "alert": True, "dialog": True, "main": False, "article": False}

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    boiler: bool
    named: bool
    article: bool
    heading: bool
    keep: str | None  #: the annotation, on pages of the table


class Container(NamedTuple):
    """An open element, with what the elements above it hand down."""

    tag: str = ""
    boiler: bool = False
    named: bool = False
    article: bool = False
    keep: str | None = None
    hidden: bool = False


OUTSIDE = Container()


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks, in order."""
    out: list[Block] = []
    page = page or ""
    stack: list[Container] = []
    open_: Counter[str] = Counter()
    ends: dict[str, int] = {}
    parts: list[str] = []
    linked = links = 0
    at, heading = 0, ""

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                c = stack[-1] if stack else OUTSIDE
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), c.boiler, c.named, c.article, bool(heading), c.keep))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1].hidden):
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.split())

    def pop() -> str:
        tag = stack.pop().tag
        open_[tag] -= 1
        return tag

    def ended(tag: str) -> bool:
        """Whether an end tag follows. The next one is remembered, so that all calls read the page once."""
        if ends.get(tag, -2) != -1 and ends.get(tag, -2) < at:
            hit = re.compile(rf"</{tag}\b", re.I).search(page, at)
            ends[tag] = hit.start() if hit else -1
        return ends[tag] >= 0

    found = MARKUP.search(page)
    while found:
        add(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if found["cdata"]:
            add(found["cdata"])
        if tag:
            closing, attrs = bool(found["close"] or found["close2"]), found["attrs"] or found["attrs2"] or ""
            if tag in RAW:
                if tag not in WITHIN:
                    flush()
                if not closing:  # straight to the end tag
                    if ended(tag):
                        at = page.find(">", ends[tag]) + 1 or len(page)
                    elif tag in WITHIN:
                        at = len(page)
                    else:
                        at = page.find("<", at) if "<" in page[at:] else len(page)
            elif tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                add(" ")
            elif tag not in INLINE:
                if tag not in WITHIN:
                    flush()
                if tag in HEADINGS:
                    heading = "" if closing else tag
                if closing:
                    if open_[tag]:
                        while pop() != tag:
                            pass
                elif tag not in VOID and not attrs.endswith("/"):
                    while stack and stack[-1].hidden and (tag in SECTIONS or (tag in FLOW and stack[-1].tag in PHRASES)):
                        pop()
                    if stack and tag not in HIDDEN and (stack[-1].tag == "p" or tag == stack[-1].tag in ("li", "td", "tr", "dd", "dt", "option")):
                        pop()
                    if tag not in HIDDEN or ended(tag):
                        stack.append(container(tag, attrs, stack[-1] if stack else OUTSIDE))
                        open_[tag] += 1
        found = MARKUP.search(page, at)
    add(page[at:])
    flush()
    return out


def boiler_name(said: str) -> bool:
    """Whether a word of a class or id names a part that is no article: the whole, its first part, or its last unless it is about layout or an article's own header."""
    for name in said.lower().split():
        parts = re.split("[-_]+", name)
        first, last = parts[0], parts[-1]
        if first in BOILER_WORDS or (last in BOILER_WORDS and first not in LAYOUT_WORDS and not (last == "header" and first in ARTICLE_WORDS)):
            return True
    return False


def container(tag: str, attrs: str, above: Container) -> Container:
    _, boiler, named, article, keep, hidden = above
    if tag in ("article", "main"):
        boiler, named, article = False, False, True
    boiler |= tag in BOILER_TAGS and not (tag == "header" and article)
    if attrs:
        own = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
        keep = own.get("data-keep", keep)
        said = f"{own.get('class', '')} {own.get('id', '')}"
        role = ROLES.get(own.get("role", "").lower())
        if tag not in ("body", "html", "article", "main"):
            boiler |= role is True
            named |= boiler_name(said)
        article |= role is False or any(w in ARTICLE_WORDS for w in re.split(r"[-_\s]+", said.lower()))
    return Container(tag, boiler, named, article, keep, hidden or tag in HIDDEN)


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "boiler", "named", "article", "heading")
NEIGHBOURS = (2, 3, 4, 5)


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    x[:, 0] = [b.words for b in found]
    x[:, 1] = [b.linked / b.words for b in found]
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    for k, name in enumerate(FEATURES[6:], 6):
        x[:, k] = [getattr(b, name) for b in found]
    return x


class Tree:
    """A binary decision tree: at each node the split with the least weighted Gini impurity, the first on ties."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.nodes: list[tuple[int, float, int, int]] = []  # (feature, at most, left, right), or (-1, share, 0, 0)
        self._grow(x, y)

    def _grow(self, x: np.ndarray, y: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, float(y.mean()), 0, 0))
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, low = x[order, f], np.arange(1, len(y))
            ones = np.cumsum(y[order])[:-1]
            high, rest = len(y) - low, y.sum() - ones
            cost = 2 * ones * (1 - ones / low) + 2 * rest * (1 - rest / high)
            cost[v[1:] == v[:-1]] = np.inf
            if len(cost) and cost.min() < best[0] - 1e-12:
                k = int(cost.argmin())
                best = float(cost[k]), f, float(v[k] + v[k + 1]) / 2
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.nodes[at] = best[1], best[2], self._grow(x[low], y[low]), self._grow(x[~low], y[~low])
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for i, row in enumerate(x.tolist()):
            n = self.nodes[0]
            while n[0] >= 0:
                n = self.nodes[n[2] if row[n[0]] <= n[1] else n[3]]
            out[i] = n[1] > 0.5
        return out


def annotated(pages: int = 240, seed: int = 20240611) -> list[str]:
    """The pages of the labelled table; ``data-keep`` says y or n for all blocks below a tag.

    A page is laid out in one of four ways: by tags that tell, by class names that tell, by plain
    ``div`` and ``td``, or by bare paragraphs. In the last two its menus are links, its notices, captions and
    footers short lines beside them or at the page's ends, and its paragraphs, of any length, stand together.
    """
    rnd = random.Random(seed)
    w = lambda n: " ".join(["word"] * n)
    link = lambda n: f'<a href="/x">{w(n)}</a>'
    size = lambda: rnd.choice([rnd.randint(1, 12), rnd.randint(1, 60), rnd.randint(20, 300)])
    long = lambda: rnd.randint(25, 250)
    no, yes = 'data-keep="n"', 'data-keep="y"'

    def menu() -> str:
        return "".join(f"<li>{link(rnd.randint(1, 3))}</li>" for _ in range(rnd.randint(3, 7)))

    def paragraph(n: int) -> str:
        if rnd.random() < 0.15:
            return f"<p>{w(n)} {link(rnd.randint(1, 12))} {w(rnd.randint(0, 8))}</p>"
        return f"<p>{w(n)}</p>" if rnd.random() < 0.95 else f"<p>{link(rnd.randint(1, 12))}</p>"

    def body(plain: bool) -> str:
        """Paragraphs; in a page without telling tags the first and the last are long, and links stand inside text."""
        n = rnd.randint(0, 7)
        if not plain:
            return f"<h1>{w(rnd.randint(1, 14))}</h1>" + "".join(paragraph(size()) for _ in range(n)) + (f"<blockquote>{w(size())}</blockquote><ul><li>{w(size())}</li><li>{link(3)}</li></ul>" if rnd.random() < 0.2 else "")
        inner = []
        for _ in range(n):  # at most one short line between two long ones
            inner += [rnd.randint(1, 12), long()] if rnd.random() < 0.5 else [long()]
        title = f"<h1>{w(rnd.randint(4, 12))}</h1>" if rnd.random() < 0.5 else ""
        return title + "".join(f"<p>{w(k)}</p>" for k in [long(), *inner])

    def boiler(name: str | None) -> str:
        """A part that is no article, with a telling tag, a telling class name (name), or neither (an empty name)."""
        inner = rnd.choice([f"<ul>{menu()}</ul>", f"<p>{w(size())}</p>", f"<p>{w(size())}</p><p>{w(size())}</p>", f"<h3>{w(2)}</h3><p>{w(size())} {link(3)}</p>", w(size())])
        if name is None:
            tag = rnd.choice(["nav", "footer", "aside", "form", "header"])
            return f"<{tag} {no}>{inner}</{tag}>"
        return f'<div class="{name}" {no}>{inner}</div>'

    def lines(tag: str) -> str:
        """Menus and short lines, never a paragraph, in plain elements."""
        short = lambda: f"<{tag} {no}>{w(rnd.randint(1, 9))}</{tag}>"
        return "".join(rnd.choice([f"<{tag} {no}>{link(rnd.randint(1, 6))}</{tag}>", f"<{tag} {no}>{link(2)} {link(1)}</{tag}>", short() + f"<{tag} {no}>{link(3)}</{tag}>"]) for _ in range(rnd.randint(1, 4)))

    names = sorted(BOILER_WORDS)
    out = []
    for k in range(pages):
        around = [rnd.randint(0, 3) for _ in range(2)]
        if k % 4 == 0:
            parts = lambda n: "".join(boiler(None) for _ in range(n))
            inside = boiler(None) if rnd.random() < 0.3 else ""
            out.append(f"{parts(around[0])}<article {yes}>{body(False)}{inside.replace('header', 'aside')}{body(False)}</article>{parts(around[1])}")
        elif k % 4 == 1:
            parts = lambda n: "".join(boiler(rnd.choice(names)) for _ in range(n))
            held = rnd.choice(["<article", '<main', '<div id="content"', '<div class="post-body"'])
            out.append(f"{parts(around[0])}{held} {yes}>{body(False)}{parts(rnd.randint(0, 1))}{body(False)}</{held[1:].split()[0]}>{parts(around[1])}")
        elif k % 4 == 2:
            tag = rnd.choice(["div", "td", "li"])
            out.append(f"{lines(tag)}<div {yes}>{body(True)}</div>{lines(tag)}")
        else:
            out.append(f"{lines('p') if rnd.random() < 0.5 else ''}<div {yes}>{body(True)}</div>{lines('p') if rnd.random() < 0.5 else ''}")
    return out


def train(pages: list[str]) -> Tree:
    rows, labels = [], []
    for page in pages:
        found = blocks(page)
        x = features(found)
        for b, row in zip(found, x, strict=True):
            if b.keep:
                rows.append(row)
                labels.append(float(b.keep == "y"))
    return Tree(np.array(rows), np.array(labels))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    return " ".join(b.text for b, good in zip(found, tree(features(found)), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    tree = train(annotated())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
