"""Main text by site style trees.

Pages of a host are merged to one tree of style nodes: paths of block elements with their
classes. A node's presentation is the sequence of its children, its content the text right
under it. Over the pages of the host, the entropy of each (scaled to 0 .. 1 by the number of
different pages) says whether the node is alive: a menu or notice that looks and reads the
same everywhere has entropy 0. A branch whose nodes all stay below ``noise`` is taken out of
each page, as are branches marked as no article by tag, role or class. An article or main
element is a prior only: its parts are judged like all others, but where nothing in it is
alive there is nothing to tell its parts from, and it stays whole.

Names and forms are weak marks. They are overruled by an article below them on a page that has
no other, and on a page without any by holding most of the page's words; a form also by text
below it that varies from page to page.

The tree is a table of (host, node) with grouped counts, so a host with a third of all pages
is no task's work. Pages are read twice, for the tree and for the text, and meet only the
list of their own host's dead branches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slices, staged
from .urls import host_and_path

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base col embed hr img input link meta param source track".split())
NO_TEXT = frozenset("head title script style noscript template nav footer aside button select textarea iframe svg canvas object menu dialog".split())
NO_TEXT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar".split())
NO_TEXT_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus newsletter subscribe share sharing social related widget toolbar pagination pager copyright".split())
# whole names made of two or more words, of which one is in the list above
NO_TEXT_NAMES |= frozenset("ad-container ad-slot ad-banner ad-box ad-unit ad-wrapper google-ad google-ads adsbygoogle banner-ad top-banner cookie-banner cookie-notice cookie-bar cookie-consent cookies-notice consent-banner gdpr-banner site-notice popup-overlay side-bar left-sidebar right-sidebar sidebar-left sidebar-right sidebar-primary main-menu main-nav main-navigation site-navigation nav-bar nav-menu nav-links navbar-nav top-nav menu-item dropdown-menu breadcrumb-nav site-footer page-footer footer-links footer-nav comments-area comments-section comments-list comment-list comment-form comment-respond post-comments user-comments disqus_thread reply-form newsletter-signup newsletter-form subscribe-form share-buttons share-links social-links social-icons social-share social-media related-posts related-articles related-links related-content widget-area".split())
# an id of these is made from the heading as a rule
OWN_IDS = frozenset("section article main h1 h2 h3 h4 h5 h6".split())
PAGE_WIDE = 0.9  # of a page's words, from which a weak mark is overruled
ARTICLE = frozenset(("article", "main"))
CLOSED_BY = {"p": frozenset("p".split()), "li": frozenset("li p".split()), "dd": frozenset("dd dt p".split()), "dt": frozenset("dd dt p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split()), "tr": frozenset("tr td th p".split()), "option": frozenset(("option",))}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot".split())
NOISE = 0.05
# Entropies of few pages say little. A node's importance is taken together with that of FADE
# pages on which it is alive, and a form's life fades in with the pages that show it.
FADE, FORM_FADE = 0.25, 3


_CUT_TAG = re.compile(r"<[/!?A-Za-z][^<>]*\Z")  # a tag that the page ends in is no text


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


@lru_cache(maxsize=65_536)
def _node(above: int, style: str) -> int:
    """A style node by the one above it, so that no path is ever spelt out."""
    return _hash(f"{above}/{style}")


class _Page(HTMLParser):
    """Blocks of text with the style node they stand in, and what each node looks like. Nodes
    and weak marks know the one above them; the work of a tag does not depend on its depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, node, strongly marked, weak mark, the weak mark above the article around it
        # (None outside of one)
        self.stack: list[tuple[str, int, bool, int, int | None]] = []
        self.open: Counter = Counter()
        self.marks: list[tuple[int, bool]] = [(0, False)]  # the mark above, is it a form's only?
        self.children: dict[int, list[str]] = {}
        self.content: dict[int, list[str]] = {}
        self.parent: dict[int, int] = {}
        self.article: dict[int, int | None] = {0: None}  # the outermost article or main above or at a node
        self.blocks: list[tuple[str, int, bool, int, int | None]] = []
        self.text: list[str] = []

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            _, node, marked, mark, article = self.stack[-1] if self.stack else ("", 0, False, 0, None)
            self.content.setdefault(node, []).append(text)
            self.blocks.append((text, node, marked, mark, article))

    def pop(self, size: int):
        for tag, *_ in self.stack[size:]:
            self.open[tag] -= 1
        del self.stack[size:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in INLINE or tag == "br":
            return
        self.flush()
        if tag in CLOSED_BY:
            size = len(self.stack)
            while size and self.stack[size - 1][0] in CLOSED_BY[tag]:
                size -= 1
            self.pop(size)
        elif self.stack and self.stack[-1][0] == "p" and tag not in EMPTY:
            self.pop(len(self.stack) - 1)
        named = dict(attrs)
        _, above, marked, mark, article = self.stack[-1] if self.stack else ("", 0, False, 0, None)
        names = (named.get("class") or "").lower().split()
        style = tag + "".join("." + n for n in sorted(names))
        node = _node(above, style)
        self.children.setdefault(above, []).append(style)
        self.parent[node] = above
        outermost = self.article[above]
        self.article[node] = outermost if outermost is not None else node if tag in ARTICLE else None
        if tag in EMPTY:
            return
        role = (named.get("role") or "").lower()
        marked = marked or tag in NO_TEXT or (tag == "header" and article is None) or role in NO_TEXT_ROLES
        if tag in ARTICLE and article is None and not marked:
            article = mark
        if tag not in OWN_IDS:
            names.append((named.get("id") or "").strip().lower())
        form = tag == "form" or role == "form"
        if form or (tag not in ("html", "body", "main") and not NO_TEXT_NAMES.isdisjoint(names)):
            self.marks.append((mark, form and NO_TEXT_NAMES.isdisjoint(names)))
            mark = len(self.marks) - 1
        self.open[tag] += 1
        self.stack.append((tag, node, marked, mark, article))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag not in INLINE and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE or tag in EMPTY or not self.open[tag]:
            return
        size = len(self.stack) - 1
        while self.stack[size][0] != tag:
            size -= 1
        self.flush()
        self.pop(size)

    def handle_data(self, data):
        self.text.append(data)


def _read(html: str) -> tuple[_Page, list[tuple[str, int, bool, bool]], bool]:
    """The page, its blocks as (text, node, in a form, in an article) without those that marks
    take out, and whether it has an article. Blocks of a form are listed, as only the tree can
    tell which of them live."""
    page = _Page()
    page.feed(_CUT_TAG.sub("", html))
    page.close()
    page.flush()
    blocks = [(text, node, mark, article) for text, node, marked, mark, article in page.blocks if not marked]
    has_article = any(article is not None and not mark for _, _, mark, article in blocks)
    counts = [True] * len(page.marks)
    inside = False  # marks count below the article only
    if not has_article and any(article == mark for _, _, mark, article in blocks if article is not None):
        has_article = inside = True
    elif not has_article and any(mark for _, _, mark, _ in blocks):
        words = [0] * len(page.marks)
        for text, _, mark, _ in blocks:
            words[mark] += len(text.split())
        for mark in range(len(words) - 1, 0, -1):  # a mark's number is above that of the one above it
            words[page.marks[mark][0]] += words[mark]
        counts = [n < PAGE_WIDE * words[0] for n in words]
    # how many marks that count, and of those how many are no form's, lie from the top to each
    total, named = [0] * len(counts), [0] * len(counts)
    for mark in range(1, len(counts)):
        above, form = page.marks[mark]
        total[mark] = total[above] + counts[mark]
        named[mark] = named[above] + (counts[mark] and not form)
    kept = []
    for text, node, mark, article in blocks:
        base = article if inside and article is not None else 0
        if named[mark] == named[base]:
            kept.append((text, node, total[mark] > total[base], article is not None))
    return page, kept, has_article


def style_nodes(html: str) -> list[tuple[int, int, int, int, int | None, bool]]:
    """(node, presentation, content, parent, article, form) of each node that is not marked by a name;
    ``article`` is the outermost article or main element around it or itself, if any, and
    ``form`` says that blocks right under it need a live node."""
    page, blocks, _ = _read(html)
    seen: set[int] = set()
    forms = set()
    for _, node, form, _ in blocks:
        if form:
            forms.add(node)
        while node and node not in seen:
            seen.add(node)
            node = page.parent[node]
    return [
        (
            n, _hash(" ".join(page.children.get(n, ()))), _hash("\n".join(page.content.get(n, ()))),
            page.parent[n], page.article[n], n in forms,
        )
        for n in seen
    ]


def text_of(html: str, dead: set[int], live: set[int] = frozenset(), alone: bool = True) -> str:
    """Blocks in page order, without what is marked or under a dead node; of a form, those right
    under a ``live`` node. Of a page read ``alone``, without a tree of its host, an article is
    taken for all of the main text."""
    page, blocks, has_article = _read(html)
    only = alone and has_article
    gone = {0: False}  # is the node or one above it dead?

    def under_dead(node: int) -> bool:
        line = []
        while node not in gone:
            line.append(node)
            node = page.parent[node]
        for n in reversed(line):
            gone[n] = gone[page.parent[n]] or n in dead
        return gone[line[0]] if line else gone[node]

    return "\n".join(
        text
        for text, node, form, article in blocks
        if (article or not only) and not (form and node not in live) and not (dead and under_dead(node))
    )


NODES = "host long, page long, node long, look long, content long, parent long, article long, form boolean"
TOPS = (_node(0, "html"), _node(_node(0, "html"), "body"))


def _entropy(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """Entropy of the counts within ``by``, over that of as many different pages."""
    n, weighted = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    return counts.groupBy(*by).agg(
        F.when(n > 1, (F.log(n) - weighted / n) / F.log(n)).otherwise(1.0).alias(name), n.alias("pages")
    )


def main_text(pages: DataFrame, noise: float = NOISE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row: ``id_col``, ``url_col``, ``text`` and ``n_chars``.

    Blocks are joined in page order by one newline; white space within a block is one space.
    Null and empty markup, and pages without text, give the empty text. Null URLs and URLs
    without a host share the empty host. Copies of a page count once for the tree; the fewer
    different pages a host has, the less of what is not marked goes. Repeated ids
    are extracted each for itself. An empty table gives no rows; other columns are not
    carried.
    """
    host = F.xxhash64(host_and_path(F.col(url_col))[0])
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), html.alias("html"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()]
        for batch in batches:
            for start, n in slices(batch, "html"):
                part = batch.slice(start, n)
                found = [style_nodes(h) for h in part.column("html").to_pylist()]
                at = pa.array(np.repeat(np.arange(n), [len(f) for f in found]))
                columns = list(zip(*(x for f in found for x in f))) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column("host").take(at), part.column("page").take(at), *map(pa.array, columns, kinds)],
                    names=["host", "page", "node", "look", "content", "parent", "article", "form"],
                )

    # copies of a page are one page of the tree
    seen = rows.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(nodes, NODES).distinct()
    by = ["host", "node", "parent"]
    look = _entropy(seen.groupBy(*by, "look").agg(F.count("*").alias("n")), by, "look")
    content = _entropy(seen.groupBy(*by, "content").agg(F.count("*").alias("n")), by, "content").drop("pages")
    article = seen.groupBy(*by).agg(F.max("article").alias("article"), F.max("form").alias("form"))
    importance = (F.greatest("look", "content") * F.col("pages") + FADE) / (F.col("pages") + FADE)
    quiet = (importance < noise) & ~F.col("node").isin(*TOPS)
    varied = F.col("form") & (F.col("content") * (F.col("pages") - 1) / (F.col("pages") + FORM_FADE) >= noise)
    judged = staged(
        look.join(content, by).join(article, by).select(*by, "article", quiet.alias("quiet"), varied.alias("live")), "style-nodes"
    )
    # an article in which nothing lives gives nothing to tell its parts from, and stays
    still = judged.where("article IS NOT NULL").groupBy("host", "article").agg(F.min("quiet").alias("still"))
    tree = staged(
        judged.join(still, ["host", "article"], "left").select(*by, (F.col("quiet") & ~F.coalesce("still", F.lit(False))).alias("dead")),
        "style-tree",
    )
    # a branch goes only as a whole: what has a living child lives
    while True:
        living = tree.where(~F.col("dead")).select("host", F.col("parent").alias("node")).distinct()
        raised = tree.where("dead").join(living, ["host", "node"], "left_semi").select("host", "node").distinct()
        if raised.isEmpty():
            break
        raised = raised.withColumn("up", F.lit(True))
        tree = staged(
            tree.join(raised, ["host", "node"], "left").select(*by, (F.col("dead") & F.col("up").isNull()).alias("dead")),
            "style-tree",
        )
    # of a dead branch the top is enough; a host's list is written, so its size is known to
    # the join, which broadcasts a small table and splits a large host otherwise
    dead = tree.where("dead")
    tops = dead.join(dead.select("host", F.col("node").alias("parent")).distinct(), ["host", "parent"], "left_anti")
    both = tops.select("host", "node", F.lit(True).alias("dead")).unionByName(
        judged.where("live").select("host", "node", F.lit(False).alias("dead"))
    )
    lists = staged(
        both.groupBy("host").agg(
            F.collect_set(F.when(F.col("dead"), F.col("node"))).alias("dead"),
            F.collect_set(F.when(~F.col("dead"), F.col("node"))).alias("live"),
        ),
        "style-dead",
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch, "html"):
                part = batch.slice(start, n)
                gone, live = ([frozenset(d or ()) for d in part.column(c).to_pylist()] for c in ("dead", "live"))
                texts = [text_of(h, d, x, alone=False) for h, d, x in zip(part.column("html").to_pylist(), gone, live)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"]
                )

    met = rows.join(lists, "host", "left").select("id", "url", "html", "dead", "live")
    schema = met.select("id", "url").schema.add("text", "string")
    return met.mapInArrow(extract, schema).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )
