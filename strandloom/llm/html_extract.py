"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of tags and classes from the root to it (formatting tags count
to the block they are in). For every path of the page the text length, the punctuation and the text of links of its
blocks are summed; the ratios to the number of blocks are fused, less the share of links; the values are smoothed over
neighbouring blocks in page order, which lowers what stands alone and raises nothing; paths whose mean reaches the
threshold are selected, and their blocks are the result, in whatever containers they are, ``article`` and ``main`` too.
Of the other paths, headings, lists, tables, quotes and paragraphs without a name of their own join the selected blocks
that they stand beside, and so do those of containers without a name between selected blocks or in an article; mostly
linked ones do not, nor does what has a name of its own that is no plain word of layout or of a text's parts.

A prior says what takes no part at all: elements whose tag, or one whole name in class, id or role, stands for what
is no article (menus, footers, sidebars, notices, adverts, forms, reader comments). A name counts only if all of its
words are of the prior's or plain words of layout: ``related-posts`` does, ``related-work`` does not. The prior is
overruled where such an element holds the article itself, and within an article where its blocks are as long and as
punctuated as others (a section on terms or reviews). Buttons and labels are text where their block has other text.

The operator is one pass over the pages without a shuffle; a page is never split or cut, and takes time in proportion
to its length at any depth of nesting. A null or empty html, or one without content, gives an empty text. Rows that
repeat an id are extracted one by one; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import map_rows, small_batches

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NAMES = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？،।]")

#: Elements without content, with raw text, that start a block, and that close an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
LISTS = frozenset("ul ol dl table select menu".split())
#: The prior: elements that are no article, and the words of names in class, id and role that say so.
ASIDE_TAGS = frozenset(
    "head nav footer aside select option dialog menu svg canvas object audio video map input fieldset".split()
)
#: Elements whose text belongs to the sentence around them, and is left out where nothing else is in their block.
CONTROLS = frozenset("button label".split())
ASIDE_WORDS = frozenset(
    "sidebar sidenav rail nav navbar navigation menu menubar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup modal overlay share sharing social follow related recommended "
    "recommendations recommendation trending popular newsletter subscribe subscription signup login register pagination pager "
    "widget widgets toolbar tools footer copyright colophon masthead skip complementary contentinfo search legal disclaimer "
    "disclaimers privacy terms partners links tags feedback survey paywall donate bio review reviews discussion discussions".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus respond responses".split())
ADVERT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos "
    "promoted promotion promotions".split()
)
PRIOR = ASIDE_WORDS | COMMENT_WORDS | ADVERT_WORDS
#: Plain words of layout, which may stand beside a word of the prior in one name.
LAYOUT = frozenset(
    "area articles article author banner bar block body bottom box btn button buttons card cards col column container content div "
    "field footer form global group head header heading icon icons info inline inner item items left list main message middle module "
    "news outer page panel pane post posts primary reader readers region right row secondary section site slot small stories "
    "story text this thread title top unit user users view visitor wrap wrapper your zone".split()
)
#: Class names that say what a page has or lacks, and the share of a page's text by which the prior is overruled.
MODIFIER, MOST = re.compile(r"(?:has|with|without|no)[-_]"), 0.5
#: An element in doubt within an article stays if its blocks reach this share of the page's ratio of text and punctuation.
LIKE = 0.5
#: A class of these words alone, one of the first two among them, is the head of a site and not of an article.
HEAD_WORDS = frozenset(["header", "topbar"])
HEAD_PARTS = HEAD_WORDS | frozenset("site page top main global wrapper container bar inner".split())
#: Containers that are part of an article only with selected text in them; every other block element is one by itself.
GENERIC = frozenset("div section article main body html center form header address details figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text; those that an article's short blocks may be whatever they are called; names that say so of others.
TEXTUAL = HEADINGS | frozenset("p li dt dd td th caption pre blockquote figcaption summary".split())
KEPT = HEADINGS | frozenset("ul ol dl table pre blockquote figure header hgroup".split())
CONTENT_WORDS = frozenset("abstract caption chapter dek entry headline intro lead lede paragraph preface standfirst subheading subhead subtitle summary title".split())
#: Share of the page's mean that a path's smoothed value must reach, and of links from which a block is no text.
THRESHOLD, LINKED = 0.8, 0.5


@dataclass
class Page:
    """Elements as rows of parallel lists, numbered in page order, so that a parent comes before what is in it."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    aside: list[bool] = field(default_factory=lambda: [False])
    doubt: list[str] = field(default_factory=lambda: [""])
    article: list[bool] = field(default_factory=lambda: [False])  # whether it is or lies in an article or main
    names: list[str] = field(default_factory=lambda: [""])
    control: list[bool] = field(default_factory=lambda: [False])
    paths: dict[tuple[int, str, str], int] = field(default_factory=dict)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters of links

    def add(self, tag: str, parent: int, attributes: str) -> int:
        aside, doubt, names = self.aside[parent], "", ""
        if not aside:
            aside, doubt, names = prior(tag, attributes, self.article[parent])
        # Formatting does not make a path: its text belongs to the block around it.
        path = self.path[parent] if tag not in BLOCKS else self.paths.setdefault((self.path[parent], tag, names), len(self.paths) + 1)
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(path)
        self.aside.append(aside)
        self.doubt.append(doubt)
        self.names.append(names)
        self.control.append(tag in CONTROLS or tag not in BLOCKS and self.control[parent])
        self.article.append(self.article[parent] or tag in ("article", "main"))
        return len(self.tag) - 1

    def summed(self, own: dict[int, np.ndarray | int], zero) -> list:
        """What the elements have of their own, summed over all that is in them."""
        total = [zero] * len(self.tag)
        for e in range(len(total) - 1, -1, -1):
            if e in own:
                total[e] = total[e] + own[e]
            if e:
                total[self.parent[e]] = total[self.parent[e]] + total[e]
        return total


def prior(tag: str, attributes: str, in_article: bool) -> tuple[bool, str, str]:
    """Whether an element is an aside by itself, else why it may be one (form, comment, advert, word), and its class names."""
    if tag in ASIDE_TAGS or tag == "header" and not in_article:
        return True, "", ""
    doubt, names = "form" if tag == "form" else "", ""
    if not attributes or tag in ("html", "body"):
        return False, doubt, names
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and INVISIBLE.search(value):
            return True, "", ""
        if name not in ("class", "id", "role"):
            continue
        for one in value.split():
            words = set(NAMES.findall(one))
            if name == "class":
                names += " " + "-".join(NAMES.findall(one))
            if not in_article and words & HEAD_WORDS and words <= HEAD_PARTS:
                return True, "", ""
            if not words & PRIOR or not words <= PRIOR | LAYOUT or MODIFIER.match(one):
                continue
            if words & COMMENT_WORDS:
                doubt = "comment" if tag not in ("article", "main") or words & {"comment", "comments", "reply"} else doubt
            elif tag not in ("article", "main") and doubt != "comment":
                doubt = "advert" if words & ADVERT_WORDS else doubt or "word"
    return False, doubt, names


class Stack:
    """The open elements of a page, with the places of every tag and of the blocks among them."""

    def __init__(self, page: Page):
        self.page, self.open, self.of_tag, self.blocks = page, [0], defaultdict(list), []

    def last(self, tags) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none."""
        return max((self.of_tag[t][-1] for t in tags if self.of_tag.get(t)), default=0)

    def push(self, element: int) -> None:
        tag = self.page.tag[element]
        self.of_tag[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def pop_to(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.open) > place:
            tag = self.page.tag[self.open.pop()]
            self.of_tag[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        place = self.last((tag,))
        if place and (tag in BLOCKS or not self.blocks or self.blocks[-1] < place):  # formatting ends within its block
            self.pop_to(place)

    def make_room(self, tag: str) -> None:
        """End what a new element ends: an open paragraph, and list items and cells beside it."""
        if tag in BLOCKS and self.blocks and self.page.tag[self.open[self.blocks[-1]]] == "p":
            self.pop_to(self.blocks[-1])
        if tag in SIBLINGS and (place := self.last(SIBLINGS[tag])) > self.last(LISTS):
            self.pop_to(place)
            while self.page.tag[self.open[-1]] in SIBLINGS[tag]:
                self.pop_to(len(self.open) - 1)


def read(html: str) -> Page:
    """The elements of a page and its blocks of text that are not set aside; white space is one space."""
    page, at, groups, pieces = Page(), 0, [], []
    stack, end = Stack(page), len(html)
    add_text = lambda text: text and not page.aside[stack.open[-1]] and pieces.append((stack.open[-1], text))

    def close_block() -> None:
        if pieces:
            groups.append(pieces.copy())
            pieces.clear()

    while at < end:
        m = MARKUP.search(html, at)
        if m is None:
            add_text(html[at:])
            break
        add_text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCKS:
            close_block()
        if closing:
            stack.close(tag)
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else end
        elif tag in VOID:
            if tag == "br":
                add_text(" ")
        else:
            stack.make_room(tag)
            if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                stack.push(page.add(tag, stack.open[-1], attributes))
    close_block()
    groups = [group for group in groups if any(not text.isspace() for _, text in group)]
    set_aside(page, groups)
    block_of = [0] * len(page.tag)  # the block element around every element
    linked = [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        block_of[e] = e if page.tag[e] in BLOCKS else block_of[page.parent[e]]
        linked[e] = page.tag[e] == "a" or linked[page.parent[e]]
    for group in groups:
        kept = [(e, text) for e, text in group if not page.aside[e]]
        if all(page.control[e] or text.isspace() for e, text in kept):
            continue
        text = " ".join(entities.unescape("".join(text for _, text in kept)).split())
        if text:
            first = next(e for e, part in kept if not part.isspace())
            page.blocks.append((block_of[first], text, sum(len(part.strip()) for e, part in kept if linked[e])))
    return page


def set_aside(page: Page, groups: list[list[tuple[int, str]]]) -> None:
    """Make asides of the elements in doubt, unless they hold the article or, as parts of it, text like the rest."""
    if not any(page.doubt):
        return
    own: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(2))  # characters, and these times the ratio of their block
    for group in groups:
        whole = " ".join("".join(text for _, text in group).split())
        ratio = len(whole) * (1 + len(PUNCTUATION.findall(whole)))
        for e, text in group:
            n = len(" ".join(text.split()))
            own[e] += (n, n * ratio)
    sums = page.summed(own, np.zeros(2))
    heads = {e: 1 for e, tag in enumerate(page.tag) if tag in ("article", "main", "h1") and not page.doubt[e] and not page.aside[e]}
    within, total = page.summed(heads, 0), sums[0]
    for e in range(1, len(page.tag)):  # outer ones first
        page.aside[e] = page.aside[e] or page.aside[page.parent[e]]
        doubt, (chars, weighed) = page.doubt[e], sums[e]
        if doubt and not page.aside[e]:
            headed = heads and within[e] == len(heads)
            least = MOST if doubt == "comment" or not heads else MOST / 2
            holds = chars >= least * max(1, total[0]) and (headed or not heads and doubt != "comment")
            like = doubt == "word" and page.article[page.parent[e]] and weighed * total[0] >= LIKE * total[1] * chars > 0
            page.aside[e] = not (holds or like)


def selected_paths(page: Page) -> np.ndarray:
    """Whether the path of each block is one of content."""
    paths = defaultdict(list)
    for i, (e, _, _) in enumerate(page.blocks):
        paths[page.path[e]].append(i)
    size = np.array([len(text) for _, text, _ in page.blocks], float)
    marks = np.array([len(PUNCTUATION.findall(text)) for _, text, _ in page.blocks], float)
    links = np.array([min(n, len(text)) for _, text, n in page.blocks], float)
    ratio = np.empty(len(size))
    for of_path in paths.values():
        n, chars = len(of_path), size[of_path].sum()
        length, punctuation, linked = chars / n, (n + marks[of_path].sum()) / n, links[of_path].sum() / chars
        ratio[of_path] = np.log1p(length * punctuation * (1 - linked))  # the ratios of a path, fused
    padded = np.pad(ratio, 1, mode="edge")
    smooth = np.minimum(0.15 * padded[:-2] + 0.7 * padded[1:-1] + 0.15 * padded[2:], ratio)  # text around does not make a box text
    least = THRESHOLD * float((ratio * size).sum() / size.sum())
    chosen = np.zeros(len(size), bool)
    for of_path in paths.values():
        chosen[of_path] = smooth[of_path].mean() >= least
    return chosen if chosen.any() else ~chosen


def content(page: Page) -> list[str]:
    """The blocks of the article, in page order."""
    if not page.blocks:
        return []
    chosen = selected_paths(page)
    first, last, heads = {}, {}, {}
    for i, (e, _, _) in enumerate(page.blocks):
        if chosen[i]:
            first.setdefault(e, i)
            last[e] = i
        heads[e] = heads.get(e, True) and page.tag[e] in HEADINGS
    for e in range(len(page.tag) - 1, 0, -1):  # of each element: its first and last selected block, and if it has headings only
        up = page.parent[e]
        if e in first:
            first[up], last[up] = min(first[e], first.get(up, first[e])), max(last[e], last.get(up, last[e]))
        if e in heads:
            heads[up] = heads.get(up, True) and heads[e]
    around, child, whole = [0] * len(page.tag), [0] * len(page.tag), [False] * len(page.tag)
    for e in range(1, len(page.tag)):  # the lowest element around with selected blocks, what of it holds e, and if that is an article
        up = page.parent[e]
        around[e], child[e] = (e, e) if e in first else (around[up], child[up] if child[up] != around[up] else e)
        whole[e] = whole[up] or page.tag[e] in ("article", "main") and e in first
    out = []
    for i, (e, text, links) in enumerate(page.blocks):
        holder, part = around[e], child[e]
        near = whole[e] or first[holder] < i < last[holder]
        if chosen[i] or links < LINKED * len(text) and joins(page, e, part, near, heads[part], part in first):
            out.append(text)
    return out


def joins(page: Page, block: int, part: int, near: bool, headings: bool, has_text: bool) -> bool:
    """Whether a block whose path is not selected belongs to the article around it.

    part: what of the lowest element with selected blocks holds the block; near: it lies in an article or between such
    blocks. Headings, lists, tables and quotes do, and paragraphs and plain containers without a name of their own.
    """
    tag, words = page.tag[part], set(NAMES.findall(page.names[part]))
    if tag in KEPT or headings or words & CONTENT_WORDS:
        return True
    if not words <= LAYOUT:
        return False
    return tag not in GENERIC or near and (page.tag[block] in TEXTUAL or has_text)


def main_text(html: str) -> str:
    return "\n\n".join(content(read(html)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html)

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"page_id": batch.column(0), "url": batch.column(1), "text": [main_text(x) for x in batch.column(2).to_pylist()]}

    return map_rows(rows, kernel, "page_id long, url string, text string")
