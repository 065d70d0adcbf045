"""Main text of web pages by block rules in two passes.

The markup is read once into blocks: block elements begin a new one, inline elements don't, contents of scripts, styles
and the like are no text. Of every block its length, its density of stop words, the share of its text inside links, its
section and what its containers say are known.

Pass 1. Boilerplate: more than LINKS of it in links (in an article: LINKED), or in a navigation, page header, footer,
sidebar, form, or container whose class or id says advert, notice, comments and so on. Main text: not short, and dense in
stop words (outside articles: LONG as well). Outside articles, text with few stop words or short links is boilerplate too.
All else, what is short or in between, stays undecided, in an article or not.
Pass 2. An undecided block takes the label of its nearest decided neighbours of its section (the nearest container that
says anything): both alike, that label; different, the one nearer in blocks, of equally near ones that in the same
container (a heading looks ahead only). In a section without any decided block those of an article are main text, others
if they have SHORT characters and FEW stop words.

Density of stop words is the share of words in a list of English, German, French and Spanish; where most letters are of
another script, the share of words of up to three letters; in writing without spaces, the number of marks per ten signs.
Main blocks are joined by one space, white space inside a block being one space and character references decoded.
Defined results: null or blank html gives an empty text; broken and cut-off markup is read as far as it goes; every row
is a page of its own, whatever its id; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches, table

#: Shares of link text from which a block is boilerplate, outside and inside an article; lengths of a short and of a long block; densities of stop words.
LINKS, LINKED, SHORT, LONG, FEW, MANY = 0.33, 0.8, 70, 200, 0.12, 0.25

# Frequent words of English, German, French and Spanish.
STOP = frozenset(
    """a an and are as at be by but for from had has have he her his i in is it its not of on or our she that the their they this to was we were which will with you
    als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach nicht oder sich sie sind um und von war werden wie zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous
    al como con de del desde el ella en entre era es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus también un una y ya""".split()
)
# Elements.
SKIPPED = "script style noscript template iframe object svg math textarea select button title canvas audio video".split()
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table thead tbody tfoot tr td th figure blockquote fieldset details dialog body".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption summary legend hr option center html head".split())
BAD_ELEMENTS = frozenset("nav footer aside form dialog menu".split())
MAIN_ELEMENTS = frozenset("article main".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe subscription signup
    sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus popup modal toolbar pagination pager copyright login""".split()
)
#: Names that say so only alone or among names of parts of a page.
WEAK_NAMES = frozenset("promotion banner notice notices alert header related recommended recommendations share sharing social respond reply replies overlay widget search form".split())
PART_NAMES = frozenset("buttons button links link bar bars list box wrapper wrap container block section area item items tools icons icon top bottom left right site page global post posts articles content inner outer".split())
MAIN_NAMES = frozenset("article articlebody post entry story content main body text page".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(SKIPPED) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[a-z\u00c0-\u024f]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_MARKS = re.compile("[,.;:!?\u3001\u3002\uff0c\uff01\uff1a\uff1b\uff1f]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _hint(tag: str, more: str) -> int:
    """-1 boilerplate, 1 main text, 0 says nothing: by the element and its attributes."""
    bad, main = tag in BAD_ELEMENTS, tag in MAIN_ELEMENTS
    if more and not more.isspace():
        for name, *values in _ATTRIBUTE.findall(more):
            value, name = "".join(values), name.lower()
            if name == "role":
                bad |= value.lower() in BAD_ROLES
                main |= value.lower() in ("main", "article")
            elif name == "itemprop":
                main |= value.lower() == "articlebody"
            elif name in ("class", "id"):
                for one in value.split():
                    parts = {x.lower() for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", one) if x}
                    if parts & BAD_NAMES or parts & WEAK_NAMES and parts <= WEAK_NAMES | PART_NAMES:
                        bad = True
                    elif parts & {"article", "articlebody"} or parts <= MAIN_NAMES and parts & {"post", "entry", "story", "content", "main"}:
                        main = True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
                bad = True
    return -1 if bad else 1 if main else 0


class Block:
    __slots__ = ("text", "linked", "hint", "heading", "group", "section")

    def __init__(self, hint: int, heading: bool, group: int, section: int):
        self.text, self.linked, self.hint, self.heading, self.group, self.section = [], 0, hint, heading, group, section


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order; hint tells their containers' verdict."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # element, hint, numbers of the container and of the section
    block, links, at, number = Block(0, False, 0, 0), 0, 0, 0

    def close():
        text = " ".join(html.unescape("".join(block.text)).split())
        if text:
            block.text = text
            out.append(block)

    def add(piece: str):
        block.text.append(piece)
        if links:
            block.linked += len(" ".join(html.unescape(piece).split()))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end = tag.lower(), m["end"] or m["end2"]
        if tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            block.text.append(" ")
        elif tag in BLOCKS:
            close()
            hint = stack[-1][1]
            links = 0
            own = 0
            if tag in CONTAINERS:
                if end:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                    hint = stack[-1][1]
                else:
                    own = _hint(tag, m["more"] or m["more2"] or "")
                    if tag == "header" and hint != 1:
                        own = -1
                    # what is boilerplate stays so; inside main text a container may be boilerplate
                    hint = -1 if hint == -1 or own == -1 else max(hint, own)
                    number += 1
                    stack.append((tag, hint, number, number if own else stack[-1][3]))
            elif not end and _hint(tag, m["more"] or m["more2"] or "") == -1:
                hint = -1
            block = Block(hint, not end and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456", *stack[-1][2:])
    if at < len(page) and not page.startswith("<", at):
        add(page[at:])
    close()
    return out


def first_pass(block: Block) -> int:
    """1 main text, -1 boilerplate, 0 undecided."""
    text = block.text
    linked = block.linked / len(text)
    if block.hint == -1 or linked > (LINKED if block.hint == 1 else LINKS):
        return -1
    if block.heading or len(text) < SHORT:
        return -1 if block.linked and not block.heading and block.hint == 0 else 0
    density = stop_density(text)
    if density >= (FEW if block.hint == 1 else MANY) and (block.hint == 1 or len(text) >= LONG):
        return 1
    return -1 if density < FEW and block.hint == 0 else 0


def stop_density(text: str) -> float:
    text = text.lower()
    if text.isascii() or _LATIN.search(text):
        words = _LETTERS.findall(text)
        latin = words if text.isascii() else [w for w in words if _LATIN.match(w)]
        if 2 * len(latin) >= len(words):
            return sum(w in STOP for w in words) / len(words) if words else 0.0
    if 2 * len(signs := _UNSPACED.findall(text)) > len(text.split()) + len(text) // 2:
        return min(1.0, 10 * len(_MARKS.findall(text)) / len(signs))
    words = _LETTERS.findall(text)
    return sum(len(w) <= 3 for w in words) / len(words) if words else 0.0


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    """Labels without 0: from the nearest decided neighbours of the same section."""
    out, before, after = list(labels), {}, {}
    left: list[int | None] = []
    for k, b in enumerate(blocks):
        left.append(before.get(b.section))
        if labels[k]:
            before[b.section] = k
    for k in range(len(blocks) - 1, -1, -1):
        b, x, y = blocks[k], left[k], after.get(blocks[k].section)
        if labels[k]:
            after[b.section] = k
        elif x is None and y is None:
            out[k] = 1 if b.hint == 1 or len(b.text) >= SHORT and stop_density(b.text) >= FEW else -1
        elif x is None or y is None:
            out[k] = labels[y if x is None else x]
        elif labels[x] == labels[y] or b.heading:
            out[k] = labels[y]
        else:
            to_left, to_right = 2 * (k - x) + (blocks[x].group != b.group), 2 * (y - k) + (blocks[y].group != b.group)
            out[k] = labels[x] if to_left < to_right else labels[y] if to_right < to_left else 1 if b.hint == 1 or stop_density(b.text) >= MANY else -1
    return out


def main_blocks(page: str | None) -> list[str]:
    blocks = read_blocks(page or "")
    labels = second_pass(blocks, [first_pass(b) for b in blocks])
    return [b.text for b, label in zip(blocks, labels, strict=True) if label == 1]


def _extract(batches: Iterator[pa.RecordBatch], with_html: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [" ".join(main_blocks(page)) for page in b["html"].to_pylist()]
        more = ([b["html"]], ["html"]) if with_html else ([], [])
        yield pa.record_batch([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *more[0]], ["page_id", "url", "text", "n_chars", *more[1]])


def extract(pages: DataFrame, with_html: bool = False) -> DataFrame:
    """page_id, url, text, n_chars (and html) of every row with page_id, url and html."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda it: _extract(it, with_html), "page_id long, url string, text string, n_chars long" + ", html string" * with_html)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
