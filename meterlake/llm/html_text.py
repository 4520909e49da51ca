"""HTML extraction with site template removal.

Pages are parsed to elements, and every block element of the whole page gets a
hash of its tag, text and children.  A block is its host's template by the pages it stands on, each counted by what
its main content (``article``, else ``main``, else the page) holds besides the block (exact copies of one page are one): ``MIN_PAGES`` of them, and ``MIN_SHARE`` of the host's or
``MANY_PAGES`` (headings only by share; a host of fewer pages needs it on all, ``LEAST_PAGES`` at least); a block that is no part of the content, and so no article's text, needs ``LEAST_PAGES``.  The rest of these pages
must also be of different texts: near copies share most of it, so of each rest one text node is drawn (least hash by
length), and ``MIN_KINDS`` of the rests must draw different ones.  Template blocks are deleted first, wherever they stand.  Words within a line,
and cells or list items without blocks of their own, only go with what holds them.

Of what is left the main content is chosen.  Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments that don't recur go by element and role, and by names that are boilerplate words and
nothing else (an ``article`` that is a comment too); a name like ``related-work`` or ``social-history`` says nothing, and only recurrence does.
The text of the main content is read in page order.

The template hashes go to the executors as a set while they are at most ``MAX_SET``; beyond it pages
are joined with the hashes found on them.

Defined results: null or empty html has empty text; a null url is a host of its own; broken markup is read as far as it
goes (unclosed elements end with their parents); a very long page is read whole, as one task's row; repeated rows are returned each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import durable, forget, ship, table

MIN_PAGES, MIN_SHARE, MAX_SET = 5, 0.3, 200_000
LEAST_PAGES, MANY_PAGES, MIN_KINDS = 3, 100, 0.3
#: Fixed values of HTML: elements without content, elements that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time u var".split())
CELLS = frozenset("caption dd dt figcaption li option td th tr tbody thead tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GONE = frozenset("nav footer aside form script style noscript template iframe head title button select textarea svg object menu dialog".split())
#: Words that name what is no article, and words that say nothing else beside them: a name counts when all its words are of these two lists and one is of the first,
#: so ``related-posts`` does and ``related-work`` doesn't.
NO_ARTICLE = frozenset("""ad ads advert adverts advertisement advertising alert alerts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter
    notice notices popup promo promos promotion related replies reply share sharing sidebar social sponsor sponsored subscribe subscription widget widgets""".split())
BESIDE = frozenset("""area articles bar bottom box buttons block container content form global group icons inner item items left link links list main module news outer page panel popular posts primary
    right row secondary section side signup site slot stories thread toolbar top unit wrap wrapper""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search status tablist toolbar tooltip".split())
#: What holds no text to read.
SILENT = frozenset("script style head title noscript template svg object iframe".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9_-]+")


def names_no_article(names: str) -> bool:
    """Whether one of the class names, ids or roles is made of boilerplate words alone."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
        if words and all(w in NO_ARTICLE or w in BESIDE for w in words) and any(w in NO_ARTICLE for w in words):
            return True
    return False


class Element:
    __slots__ = ("tag", "gone", "items", "parent")

    def __init__(self, tag: str, gone: bool, parent: Element | None) -> None:
        self.tag, self.gone, self.parent, self.items = tag, gone, parent, []


class Tree(HTMLParser):
    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", False, None)
        self.main: list[Element] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:  # a block ends an open paragraph
            e = self.at
            while e.parent is not None and (e.tag in INLINE or e.tag == "p"):
                if e.tag == "p":
                    self.at = e.parent
                    break
                e = e.parent
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.at.tag == tag:
            self.at = self.at.parent
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = any(k == "hidden" or (k == "role" and v and not ROLES.isdisjoint(v.lower().split())) for k, v in attrs)
        e = Element(tag, (tag in GONE or hidden) and tag not in ("html", "body", "article", "main") or (tag not in ("html", "body") and names_no_article(named)), self.at)
        self.at.items.append(e)
        if tag in ("article", "main"):
            self.main.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def _content(tree: Tree) -> list[Element]:
    """The outermost articles that are not reader comments or the like, else main elements, else everything."""
    for tag in ("article", "main"):
        out = []
        for e in tree.main:
            up, inner, bad = e.parent, False, False
            while up is not None:
                inner, bad, up = inner or (up.tag == tag and not up.gone), bad or up.gone, up.parent
            if e.tag == tag and not inner and not bad and not e.gone:
                out.append(e)
        if out:
            return out
    return [tree.root]


def _gone(e: Element, whole_page: bool) -> bool:
    return e.gone or (whole_page and e.tag == "header")


def _blocks(content: list[Element], whole_page: bool) -> tuple[list[tuple[Element, int, int, int]], list[tuple[int, int]], set[int]]:
    """(element, hash, first text, last text + 1) of each block of the content, (hash, length) of its texts in page order, and what its elements are (by id)."""
    blocks, texts, digests, starts = [], [], {}, {}
    for top in content:
        stack: list[Element | str] = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if t := " ".join(x.split()):
                    texts.append((int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little"), len(t)))
            elif id(x) not in starts:
                if not _gone(x, whole_page):
                    starts[id(x)] = len(texts)
                    stack += [x, *reversed(x.items)]
            else:
                h, plain = hashlib.blake2b(x.tag.encode(), digest_size=8), True
                for y in x.items:
                    if isinstance(y, Element):
                        plain = plain and y.tag in INLINE
                        h.update(b"<" + digests.get(id(y), b""))
                    elif y.strip():
                        h.update(b"=" + " ".join(y.split()).encode("utf-8", "replace"))
                digests[id(x)] = h.digest()
                lo = starts[id(x)]
                if lo < len(texts) and x.tag not in INLINE and x.tag not in ("", "html", "body") and not (plain and x.tag in CELLS):
                    blocks.append((x, int.from_bytes(h.digest(), "little", signed=True), lo, len(texts)))
    return blocks, texts, {*starts}


def _beside(tree: Tree, content: list[Element], inside: set[int]) -> list[tuple[Element, int]]:
    """(element, hash) of the blocks with text that are no part of the content's text (``inside``) and don't hold it: what stands beside it, and what goes within it."""
    out, digests, begun, tops = [], {}, set(), {id(c) for c in content}
    stack = [tree.root]
    while stack:
        x = stack.pop()
        if id(x) not in begun:
            begun.add(id(x))
            stack += [x, *[y for y in x.items if isinstance(y, Element) and y.tag not in SILENT]]
            continue
        h, said, holds = hashlib.blake2b(b"#" + x.tag.encode(), digest_size=8), False, id(x) in tops
        for y in x.items:
            if isinstance(y, Element):
                d, spoke, held = digests.get(id(y), (b"", False, False))
                h.update(b"<" + d)
                said, holds = said or spoke, holds or held
            elif t := " ".join(y.split()):
                h.update(b"=" + t.encode("utf-8", "replace"))
                said = True
        digests[id(x)] = (h.digest(), said, holds)
        if said and not holds and id(x) not in inside and x.tag not in INLINE and x.tag not in ("", "html", "body"):
            out.append((x, int.from_bytes(h.digest(), "little", signed=True)))
    return out


#: Kinds of blocks: in the content, headings there, beside the content.
PART, HEADING, BESIDE_IT = 0, 1, 2


def page_rests(page: str | None) -> list[tuple[int, int, int, int]]:
    """(hash, kind, rest, drawn) of each block of a page, once: digest of the content without it, and the text drawn of that.

    The whole content has hash 0; a digest is 0 where nothing is left.
    """
    tree = Tree(page or "")
    content = _content(tree)
    blocks, texts, inside = _blocks(content, content == [tree.root])
    signed = lambda x: (x & (2**64 - 1)) - ((x & 2**63) << 1)
    sums = [0]
    for h, _ in texts:
        sums.append(sums[-1] + h)
    order = sorted(range(len(texts)), key=lambda i: -math.log((texts[i][0] + 1) / 2**64) / texts[i][1])
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {(0, PART): []}
    for e, h, lo, hi in blocks:
        spans.setdefault((h, HEADING if e.tag in HEADINGS else PART), []).append((lo, hi))
    for _, h in _beside(tree, content, inside):
        spans.setdefault((h, BESIDE_IT), [])  # the rest of these is the whole content
    out = []
    for (h, kind), at in spans.items():
        drawn = next((texts[i][0] for i in order if not any(lo <= i < hi for lo, hi in at)), 0)
        out.append((h, kind, signed(sums[-1] - sum(sums[hi] - sums[lo] for lo, hi in at)), signed(drawn)))
    return out


def extract(page: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The main text of one page, without blocks of the template."""
    return extracted(page, template)[0]


def extracted(page: str | None, template: set[int] | frozenset[int] = frozenset()) -> tuple[str, int]:
    """The main text of one page, and how many blocks the template deleted from the page (those within another not counted)."""
    tree = Tree(page or "")
    content = _content(tree)
    deleted = 0
    if template:
        blocks, _, inside = _blocks(content, content == [tree.root])
        found = [e for e, h, *_ in blocks if h in template] + [e for e, h in _beside(tree, content, inside) if h in template]
        marked = {id(e) for e in found}
        for e in found:
            e.gone, up = True, e.parent
            while up is not None and id(up) not in marked:
                up = up.parent
            deleted += up is None
        content = _content(tree)  # of what is left
    whole_page = content == [tree.root]
    out: list[str] = []
    for top in content:
        stack: list[Element | str] = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif not _gone(x, whole_page):
                edge = [] if x.tag in INLINE else [" "]
                stack += [*edge, *reversed(x.items), *edge]
    return " ".join("".join(out).split()), deleted


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_set: int = MAX_SET) -> DataFrame:
    """page_id, url, text, template_blocks (how many blocks recurrence deleted from the page) of every row."""
    spark = pages.sparkSession
    ship(spark)
    p = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    p = p.withColumn("key", F.xxhash64("page_id", "url", "html"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [page_rests(t) for t in b.column("html").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
            cols = [pa.array([r[i] for m in made for r in m], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("key").take(row), b.column("host").take(row), *cols], names=["key", "host", "h", "kind", "rest", "drawn"])

    seen = p.select("key", "host", "html").mapInArrow(found, "key bigint, host string, h bigint, kind int, rest bigint, drawn bigint")
    rests = seen.filter("rest != 0").select("host", "h", "kind", "rest", "drawn").distinct()
    drawn = rests.groupBy("host", "h", "kind", "drawn").agg(F.count("*").alias("n"))
    often = drawn.groupBy("host", "h", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).filter(F.col("n") >= LEAST_PAGES)
    often = durable(often.filter((F.col("h") == 0) | (F.col("kinds") - 1 >= MIN_KINDS * (F.col("n") - 1))), "often")
    total = often.filter("h = 0").select("host", F.col("n").alias("total"))
    enough = F.col("n") >= F.least(F.lit(min_pages), F.col("total"))
    wide = (F.col("n") >= min_share * F.col("total")) | ((F.col("kind") != HEADING) & (F.col("n") >= MANY_PAGES))
    template = durable(often.filter("h != 0").join(total, "host").filter((F.col("kind") == BESIDE_IT) | (enough & wide)).select("host", "h").distinct(), "template")
    few = template.count() <= max_set
    forget(often)
    if few:
        sets: dict[str, set[int]] = {}
        for r in template.toLocalIterator():
            sets.setdefault(r["host"], set()).add(r["h"])
        known = spark.sparkContext.broadcast(sets)
        forget(template)
        work = p.select("page_id", "url", "html", "host", F.lit(None).cast("array<bigint>").alias("hs"))
    else:
        known = None
        mine = seen.select("key", "host", "h").distinct().join(template, ["host", "h"]).groupBy("key").agg(F.collect_set("h").alias("hs"))
        work = p.join(mine, "key", "left").select("page_id", "url", "html", "host", "hs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, hosts = b.column("hs"), b.column("host").to_pylist()
            own = [known.value.get(h, set()) if known else set(lists[i].as_py() or ()) for i, h in enumerate(hosts)]
            made = [extracted(t, s) for t, s in zip(b.column("html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())],
                                             names=["page_id", "url", "text", "template_blocks"])

    return work.mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, template_blocks bigint")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
