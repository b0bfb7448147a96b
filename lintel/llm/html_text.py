"""HTML main-text extraction from flat text blocks.

A page becomes a flat list of text blocks: text between block-level tags, with its number of words, the share
of them inside links, and what its containers say: whether the page has an article or main element and the
block is inside it, whether it is in a menu, footer, aside, form or hidden element, whether a class or id names
something apart from an article (advert, notice, comments, ...) or controls (share, tags, menu, ...). Each block
is classified with the word counts and link densities of its neighbours by a decision tree. The tree is grown on
the small labelled pages below; a name is one feature of many, so prose in an element named like controls stays
and unnamed link lists and short lines outside an article go. Blocks of the article are joined in page order.

Scripts, styles, comments and other elements without readable text never become blocks. Character references are
decoded after tags are cut, so decoded "<" stays text. Unclosed and misnested tags close as their container does;
the work is in proportion to the page's length, however deep its tags, so very long pages are read whole. Null and
empty pages give an empty text; every row gives one row, equal rows equal ones; an empty table gives none. Extra
columns pass through, and a column named like an output is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.trees import Tree, grow
from lintel.session import prepare, widened

# Element and container names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style head title noscript template svg math iframe object applet canvas audio video select option datalist button textarea map".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
MAIN_TAGS = frozenset("article main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
APART = frozenset(
    "footer sidebar aside ad ads advert adverts advertisement advertising cookie cookies consent gdpr notice alert promo promoted sponsor sponsored comment comments respond reply replies "
    "disqus newsletter subscribe subscription signup popup modal overlay copyright disclaimer banner".split()
)
CONTROLS = frozenset(
    "nav navbar navigation menu header masthead share sharing social related recommended form login breadcrumb breadcrumbs pagination pager widget widgets toolbar search legal tags skip".split()
)
GENERIC = frozenset("content inner body text item items list box wrapper wrap container area section block bar link links button buttons group panel row col module top bottom left right site page main".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot menu select".split())
CELLS = frozenset("li td th body".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = "words link_density words_before density_before words_after density_after main chrome apart controls heading".split()

#: Labelled pages. +{n} stands for a block of n words of the article, -{n} for n other words, {n} for n more words of the block.
PAGES = """
<nav><ul><li><a>-{1}</a><li><a>-{1}</a><li><a>-{2}</a></ul></nav><div class=ad>-{9}</div><article><h1>+{9}</h1><p>+{70}<p>+{25}<p>+{2}<p>+{110}</article><footer>-{3} <a>{1}</a></footer>
<nav><a>-{1}</a> <a>{1}</a></nav><div class=ad>-{12}</div><article><h1>+{4}</h1><p>+{1}<p>+{6}<ul><li><a>+{3}</a><li><a>+{2}</a></ul><p>+{12} <a>{5}</a></article><footer>-{16}</footer>
<header><div>-{3}</div><a>-{1}</a></header><main><h1>+{6}</h1><p>+{40}<p>+{33}<ol><li>+{4}<li>+{7}</ol></main><aside><p>-{28}<p>-{12}</aside><footer><p>-{30}</footer>
<article><header><h1>+{8}</h1><p>+{3}</header><p>+{55}<div class=text-share><p>+{18}</div><section id=tags><p>+{24}</section><p>+{9}</article>
<article><p>+{3}</p><div class=text-share>+{8}</div><section id=tags>+{11}</section><div class="widget-share"><p>+{14}<p>+{9}</div></article>
<main><h1>+{4}</h1><div class=search-story>+{10}</div><div id=related><p>+{13}</div><div class=share-bar>-{1}</div><div class=share><a>-{1}</a><a>{4}</a><a>{4}</a></div></main>
<article><h2>+{5}</h2><p>+{60}<div class=share-buttons>-{2}<ul><li><a>-{1}</a><li><a>-{1}</a></ul></div><div class=tags>-{1} <a>{3}</a></div><p>+{30}</article>
<article><p>+{48}<aside><p>-{26}</aside><div class=comments><h3>-{2}</h3><p>-{34}<p>-{50}</div></article>
<main><p>+{21}<div class=ad>-{14}</div><p>+{35}<div class="promo-box">-{25}</div><div class=newsletter><p>-{11}</div><p>+{8}</main>
<article><p>+{64}<nav><p>-{1}<p>-{30}</nav><form><p>-{15}<p>-{3}</form><footer><p>-{22}</footer></article>
<article><p>+{44}<div class=ad-free><p>+{31}</div><div class=noticeable><p>+{13}</div><div class=comment-policy><p>+{40}</div></article>
<div><a>-{1}</a> <a>{1}</a> <a>{2}</a></div><div><h1>+{7}</h1><p>+{42}<p>+{5}<p>+{61}</div><div><a>-{2}</a><br><a>-{3}</a></div>
<div><a>-{2}</a></div><p>+{38}<p>+{52}<p>+{14}<p>+{29}<div>-{4}</div><div><a>-{4}</a></div>
<ul><li><a>-{1}</a><li><a>-{1}</a><li><a>-{1}</a></ul><h2>+{5}</h2><p>+{27}<p>+{3}<p>+{33}<ul><li><a>-{3}</a><li><a>-{2}</a></ul>
<div class=top-menu><a>-{1}</a></div><p>+{40}<p>+{40}<p>+{36} <a>{4}</a><div class=footer><p>-{24}</div>
<div class=header>-{4}</div><p>+{57}<div class=sidebar><p>-{32}<p>-{20}</div><p>+{26}<div id=comments><p>-{43}</div>
<div class=cookie-notice>-{13}</div><div class=cookie-notice><p>-{40}</div><h1>+{6}</h1><p>+{71}<form>-{9}</form><footer>-{5}</footer>
<p>+{22}<div class=share>-{3}</div><div class=share><p>+{35}</div><p>+{45}<div class=related><a>-{5}</a></div><div class=legal>-{8}</div>
<div>-{2}</div><article><h1>+{3}</h1><p>+{20}</article><div>-{5}</div><div><p>-{30}</div><div><a>-{6}</a></div>
<p>-{3}</p><a>-{2}</a><main><p>+{2}<p><a>+{1}</a><p>+{15}</main><p>-{45}<p>-{18}
<article><p>+{30}<div class=menu><a>-{2}</a></div><div class=related><p>-{3}<a>{6}</a></div><p>+{3}</article><article class=comment><p>-{37}</article>
<nav><p>-{21}</nav><p>+{33}<p>+{48}<aside>-{19}</aside><p>+{11}<dialog>-{17}</dialog>
<p>+{1}
<p>+{14}
<div>+{80}</div>
<a>-{2}</a>
"""


def labelled() -> tuple[list[list[float]], list[int]]:
    """The labelled pages' blocks as features, and 1 for blocks of the article."""
    rows, labels = [], []
    for page in PAGES.strip().split("\n"):
        blocks = blocks_of(re.sub(r"([+-]?)\{(\d+)\}", lambda m: m[1] + " ".join(["w"] * int(m[2])), page))
        rows += features(blocks)
        labels += [int(b.text[0] == "+") for b in blocks]
    return rows, labels


def train() -> Tree:
    return grow(*labelled(), depth=12, leaf=1)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    chrome: bool
    apart: int
    controls: int
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class Element:
    tag: str
    main: bool = False
    chrome: bool = False
    apart: int = 0
    controls: int = 0
    closed: bool = False
    saved: list[int] | None = None  # what was known outside an article


def named(value: str) -> tuple[int, int, bool]:
    """(apart, controls, main) of class or id names: 2 if a name ends in such a word, but for general words; 1 if it holds one elsewhere."""
    apart = controls = 0
    main = False
    for name in value.split():
        parts = [x for p in PART.split(name) if (x := p.lower().rstrip("0123456789"))]
        if not parts or parts[0] in ("has", "no", "with", "is", "not"):
            continue
        special = [p for p in parts if p not in GENERIC]
        for p in special:
            level = 2 if p == special[-1] else 1
            if p in APART:
                apart = max(apart, level)
            elif p in CONTROLS:
                controls = max(controls, level)
        main = main or parts[-1] in MAIN_WORDS and not any(p in APART or p in CONTROLS for p in parts)
    return apart, controls, main


class Walk:
    """Builds the flat blocks of one page. What the open elements say is counted as they open and close."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of the open elements in the stack, by tag
        self.solid: list[int] = []  # places of those that are not inline
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.main = self.unread = self.links = self.headings = 0
        self.evidence = [0, 0, 0, 0, 0]  # open elements: chrome, apart in part, apart, controls in part, controls

    def flush(self) -> None:
        if not self.parts:
            return
        text = SPACE.sub(" ", "".join([t for t, _ in self.parts])).strip()
        if text:
            linked = sum(len(t.split()) for t, link in self.parts if link)
            words = text.count(" ") + 1
            chrome, some_apart, apart, some_controls, controls = self.evidence
            self.blocks.append(
                Block(text, words, min(linked, words), self.main > 0, chrome > 0, 2 if apart else int(some_apart > 0), 2 if controls else int(some_controls > 0), self.headings > 0)
            )
        self.parts = []

    def count(self, e: Element, by: int) -> None:
        self.unread += by * (e.tag in UNREAD)
        self.links += by * (e.tag == "a")
        self.headings += by * (e.tag in HEADINGS)
        self.evidence[0] += by * e.chrome
        if e.apart:
            self.evidence[e.apart] += by
        if e.controls:
            self.evidence[2 + e.controls] += by

    def push(self, e: Element) -> None:
        if e.main:  # what stands around a whole article says nothing about it
            e.saved, self.evidence = self.evidence, [0, 0, 0, 0, 0]
            self.main += 1
        self.count(e, 1)
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(e)

    def close(self, at: int) -> None:
        """End the element at this place and all that it holds."""
        while len(self.stack) > at:
            e = self.stack.pop()
            if e.closed:
                continue
            self.places[e.tag].pop()
            if e.tag not in INLINE:
                self.solid.pop()
            self.count(e, -1)
            if e.saved is not None:
                self.evidence = e.saved
                self.main -= 1

    def last(self, tags: frozenset[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flush()
            return
        if self.places.get("head") and tag not in IN_HEAD:  # an unclosed head ends where the body's elements begin
            self.close(self.places["head"][-1])
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                self.implied("p", CLOSES_P)
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.implied(tag, LISTS)
        self.push(self.element(tag, attributes))

    def implied(self, tag: str, bounds: frozenset[str]) -> None:
        """End an open element of this tag, unless a container stands between."""
        at = self.places.get(tag)
        if at and self.last(bounds | CELLS) <= at[-1]:
            self.close(at[-1])

    def end(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        if not (at := self.places.get(tag)):
            return
        if tag not in INLINE:
            self.close(at[-1])
        elif not self.solid or self.solid[-1] < at[-1]:  # never closes a block around it
            e = self.stack[at.pop()]
            e.closed = True
            self.count(e, -1)

    def element(self, tag: str, attributes: str) -> Element:
        e = Element(tag, main=tag in MAIN_TAGS, chrome=tag in CHROME_TAGS or tag == "header" and not self.main)
        if attributes and tag not in ("html", "body"):
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    if tag == "article" and name == "id" or tag in INLINE and tag != "span":
                        continue
                    apart, controls, main = named(value)
                    e.apart, e.controls = max(e.apart, apart), max(e.controls, controls)
                    e.main = e.main or main and tag not in INLINE
                elif name == "role":
                    e.chrome = e.chrome or value.lower() in CHROME_ROLES
                    e.main = e.main or value.lower() in ("main", "article") and tag not in INLINE
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                    e.chrome = True
        return e


def blocks_of(page: str | None) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    walk, at, page = Walk(), 0, page or ""
    last = page.rfind(">") + 1
    comment = page.rfind("<!--")
    while m := TAG.search(page, at, max(last, len(page) if comment >= last else last)):
        if m.start() > at and not walk.unread:
            walk.parts.append((html.unescape(page[at : m.start()]), walk.links > 0))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            walk.end(tag)
            continue
        walk.start(tag, m[3])
        if tag in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            walk.end(tag)
    if at < len(page) and not walk.unread:
        walk.parts.append((html.unescape(page[at:]), walk.links > 0))
    walk.flush()
    return walk.blocks


def features(blocks: list[Block]) -> list[list[float]]:
    """In the order of FEATURES; beyond the ends the neighbours are empty. main: 2 inside, 1 on pages that mark no article, 0 outside."""
    rows = []
    marked = any(b.main for b in blocks)
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else None
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        rows.append(
            [
                b.words,
                b.density,
                before.words if before else 0,
                before.density if before else 0.0,
                after.words if after else 0,
                after.density if after else 0.0,
                2.0 if b.main else float(not marked),
                float(b.chrome),
                float(b.apart),
                float(b.controls),
                float(b.heading),
            ]
        )
    return rows


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page)
    return "\n".join([b.text for b, x in zip(blocks, features(blocks), strict=True) if tree.decide(x)])


def extract(df: DataFrame, column: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Append the main text and its number of code points; the html column is dropped."""
    prepare(df.sparkSession)
    kept = [c for c in df.columns if c not in (column, text, chars)]
    schema = widened(df.select(*kept), f"`{text}` string, `{chars}` long")
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts = [main_text(x, tree) for x in b.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return df.select(*kept, F.col(column).cast("string").alias("__html")).mapInArrow(run, schema)
