import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from pyspark.sql import functions as F

from skein.llm import html_text, language_id
from skein.llm.common import table

PROSE = "The keeper of the light was on the stairs when it began to rain, and he went down to look at the boats that were in the harbour. " * 2
CASES = {
    "<body><nav><a href=/>Home</a></nav><article><h1>T&eacute;te</h1><p>Short.</p><p>One<br>two &amp; three</p></article><footer>(c)</footer>": "Téte Short. One two & three",
    f"<div id=sidebar><p>{PROSE}</p></div><div><h2>On rain</h2><p>{PROSE}</p><p>Yes.</p></div><div class='cookie-notice'>We use cookies</div>": f"On rain {PROSE.strip()} Yes.",
    f"<header><p>{PROSE}</p></header><main><p>Hi</p><form><p>{PROSE}</p></form><ul><li>one<li>two</ul></main><section class=comments><p>{PROSE}</p></section>": "Hi one two",
    "<article><p>a<script>if (a</p><b) {}</script>b</p><!-- <p>no</p> --><style>p{}</style><p>c&#8211;d\xa0\n e</p><aside>x</aside><div class=ad>y</div>": "ab c–d e",
    "<article><p>open <b>never <i>closed<p>next": "open never closed next",
    "<article class=x data-a='>'><p title=\"a > b\">kept</p></article>": "kept",
    "": "", None: "", "   ": "", "plain words only": "", "<p": "", "<article>a < b and 3<4</article>": "a < b and 3<4",
}


@pytest.mark.parametrize("page", list(CASES))
def test_cases(page):
    assert " ".join(html_text.main_blocks(page)) == CASES[page]


def test_very_long_and_unbalanced_pages_are_read_in_time():
    assert " ".join(html_text.main_blocks("<article>" + "<p>word <b>" * 50_000)).count("word") == 50_000
    html_text.main_blocks("<a href=\"" + "x' " * 100_000)
    html_text.main_blocks("<div class='" * 20_000)


def test_every_article_comes_out_whole(spark, sf):
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = html_text.op4_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id]
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        want = " ".join(__import__("html").unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r.text.split() == want.split() and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, "http://a", "<article><p>x</p></article>", 1, "t"), (1, "http://a", "<article><p>x</p></article>", 1, "t"), (None, None, None, None, None), (2, None, "", None, "u")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_languages_of_documents(spark, sf, odd_docs, no_docs):
    got = language_id.op8_language_id(spark, sf).collect()
    assert len(got) == table(spark, sf, "documents").count()
    assert sum(r.language == r.declared for r in got) >= 0.97 * len(got) and sum(r.kept for r in got) >= 0.99 * len(got)
    odd = language_id.of_documents(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all((r.language == "und") == (not r.kept) for r in odd)
    assert language_id.of_documents(no_docs).count() == 0
    assert language_id.keep_identified(odd_docs).columns == odd_docs.columns
    bare = odd_docs.withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {r.language for r in language_id.of_documents(bare).collect()} == {"und"}


def test_evidence_decides_where_the_text_says_little(spark):
    rows = [(i, ("the of and with that " if i % 2 else "der die und mit das ") * 8, "en" if i % 2 else "de", None, "en.example" if i % 2 else "de.example") for i in range(60)]
    rows += [(100, "xq", None, None, "de.example"), (101, "xq", None, None, "en.example"), (102, "zz", "de", None, "new.example"), (103, "", "de", None, "de.example")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "_id long, _text string, declared string, suffix string, host string")).collect()}
    assert (got[100].language, got[101].language, got[102].language, got[103].language) == ("de", "en", "de", "und")


def test_languages_of_pages(spark, sf):
    got = language_id.language_id_pages(spark, sf).collect()
    assert len(got) == table(spark, sf, "pages").count() and sum(r.language == r.declared for r in got) >= 0.9 * len(got)


def test_rejected_rows_take_no_others_along(spark, sf, odd_docs):
    left = language_id.keep_identified(odd_docs).collect()
    assert sorted(r.text for r in left if r.doc_id is None) == ["lost id"]
    docs = table(spark, sf, "documents")
    third = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, F.lit(7)).otherwise(F.col("doc_id")).cast("long"))
    blank = docs.limit(1).withColumn("text", F.lit(" "))
    blanks = blank.withColumn("doc_id", F.lit(None).cast("long")).unionByName(blank.withColumn("doc_id", F.lit(7).cast("long")))
    mixed = third.unionByName(blanks.select(third.columns))
    kept = language_id.of_documents(mixed).filter("kept").count()
    got = language_id.keep_identified(mixed)
    assert got.schema == mixed.schema and got.count() == kept > 0.9 * docs.count()


class Plain(HTMLParser):
    """Blocks of (text, link characters, hint, heading, container, section) by the standard parser, for pages of the sample tables' elements."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.count, self.skip, self.link, self.heading = [], [("", 0, 0, 0)], 0, False, False, False
        self.text, self.linked, self.place = "", "", self.open[-1]
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join(self.text.split()):
            self.blocks.append((text, len(" ".join(self.linked.split())), self.place[1], self.heading, self.place[2], self.place[3]))
        self.text = self.linked = ""
        self.heading, self.place = False, self.open[-1]

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip = True
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self.text += " "
        elif tag in ("nav", "ul", "div", "article", "footer", "body", "main", "section"):
            own = -1 if tag in ("nav", "footer") or ("class", "ad") in attrs else 1 if tag in ("article", "main") else 0
            up = self.open[-1]
            self.count += 1
            self.open.append((tag, -1 if -1 in (up[1], own) else max(up[1], own), self.count, self.count if own else up[3]))
            self.flush()
        elif tag in ("p", "li", "h1", "h2", "html", "head"):
            self.flush()
            self.heading = tag in ("h1", "h2")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip = False
        elif tag == "a":
            self.link = False
        elif tag in ("p", "li", "h1", "h2", "html", "head", "body", "nav", "ul", "div", "article", "footer", "main", "section"):
            if tag in [x[0] for x in self.open]:
                while self.open.pop()[0] != tag:
                    pass
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += data if self.link else ""


def plain_rules(page, density=None):
    """Both passes, block by block, each looking at all others."""
    blocks = Plain(page).blocks
    H = html_text

    def share(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        return density if density is not None else sum(w in H.STOP for w in words) / max(1, len(words))

    labels = []
    for text, linked, hint, heading, _, _ in blocks:
        inside, short = hint == 1, heading or len(text) < H.SHORT
        if hint == -1 or linked / len(text) > (H.LINKED if inside else H.LINKS) or short and linked and not heading and not inside:
            labels.append(-1)
        elif not short and share(text) >= (H.FEW if inside else H.MANY) and (inside or len(text) >= H.LONG):
            labels.append(1)
        else:
            labels.append(-1 if not short and share(text) < H.FEW and not inside else 0)
    out = []
    for k, (text, _, hint, heading, group, section) in enumerate(blocks):
        around = [j for j, b in enumerate(blocks) if labels[j] and b[5] == section]
        x, y = max([j for j in around if j < k], default=None), min([j for j in around if j > k], default=None)
        far = lambda j: 2 * abs(j - k) + (blocks[j][4] != group)
        if labels[k]:
            label = labels[k]
        elif not around:
            label = 1 if hint == 1 or len(text) >= H.SHORT and share(text) >= H.FEW else -1
        elif x is None or y is None or heading:
            label = labels[x if y is None else y]
        elif labels[x] == labels[y] or far(x) != far(y):
            label = labels[min(x, y, key=far)]
        else:
            label = 1 if hint == 1 or share(text) >= H.MANY else -1
        if label == 1:
            out.append(text)
    return out


def without_article(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def test_both_passes_equal_plain_rules(spark, sf):
    rng = random.Random(4)
    pages = [r.html for r in table(spark, sf.replace("sf0.001", "sf0.01"), "pages").collect()]
    pages += [without_article(p) for p in pages]
    few, prose = "Zebra xylophone quartz. ", "The keeper of the light was on the stairs when it began to rain and he went down. "
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            text = rng.choice([few, prose]) * rng.choice([0, 1, 2, 5])
            text = rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<p>{} <a href=x>more</a></p>", "<p><a href=x>{}</a></p>", "<div><p>{}</p></div>"]).format(text or "Yes")
            parts.append(rng.choice(["{}", "{}", "{}", "<section>{}</section>", "<div class=ad>{}</div>", "<article>{}</article>", "<nav>{}</nav>"]).format(text))
        pages.append(f"<html><body>{''.join(parts)}</body></html>")
    for page in pages:
        assert html_text.main_blocks(page) == plain_rules(page)


def test_density_decides_without_article(spark, sf, monkeypatch):
    """Pages without article or main: the words of the former article come out, nothing else does; with density switched off nothing is left."""
    words = lambda text: Counter(text.split())
    got, want = Counter(), Counter()
    pages = [r.html for r in table(spark, sf.replace("sf0.001", "sf0.01"), "pages").collect()]
    for page in pages:
        whole, found = words(" ".join(html_text.main_blocks(page))), words(" ".join(html_text.main_blocks(without_article(page))))
        assert not found - whole
        got += found
        want += whole
    assert got.total() >= 0.9 * want.total()
    monkeypatch.setattr(html_text, "stop_density", lambda text: 0.0)
    assert not any(html_text.main_blocks(without_article(p)) for p in pages)


@pytest.mark.parametrize("attribute", ['style="overflow:hidden"', 'title="hidden gems"', 'data-id="menu"', 'data-hidden="false"', 'class="market-share"', 'aria-hidden="false"', 'data-role=navigation'])
def test_attributes_are_read_by_their_whole_name(attribute):
    assert html_text.main_blocks(f"<article {attribute}><p>{PROSE}</p></article>") == [PROSE.strip()]


@pytest.mark.parametrize("attribute", ["hidden", 'class="share-buttons"', 'id=comments', 'role="navigation"', 'aria-hidden="true"', "style='display: none'", 'class="post siteSidebar"'])
def test_containers_that_are_no_main_text(attribute):
    assert html_text.main_blocks(f"<article><p>{PROSE}</p><div {attribute}><p>{PROSE}</p></div></article>") == [PROSE.strip()]


@pytest.mark.parametrize("prose", ["Смотритель маяка стоял на лестнице, когда начался дождь, и он спустился вниз, чтобы посмотреть на лодки. " * 3, "灯塔的看守人站在楼梯上，这时候开始下雨了，他走下去看港口里的那些船，海面上没有什么人。" * 6])
def test_prose_of_other_scripts(prose):
    assert html_text.main_blocks(f"<ul><li><a href=/>x</a></ul><div><p>{prose}</p></div><div class=ad>{prose}</div>") == [prose.strip()]
