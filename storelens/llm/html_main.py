"""Main text of web pages: site template removal and the article's blocks.

1. Every page is read into its element tree.  Each block element that could belong to
   the site's template (see ``_Page``) gets a hash of its subtree: name, text and the
   hashes of its children.
2. Spark counts, per host, on how many pages a subtree occurs (pages of one host with
   equal subtrees and equal text count once, so copies of an article are no template).
   Subtrees on at least ``least`` pages and ``share`` of the host's pages are its
   template; a host has at most (subtrees of a page) / ``share`` of them.
3. The template's subtrees are deleted from that host's pages, then whatever the names,
   classes, ids and roles of elements mark as no article text; the article (else the
   main element, else the body) is cut into its blocks.

The counts cover all pages.  The table of templates, one row per host, is broadcast if
its measured size is small; else pages meet it by host and salt, with as many salts as
the host's pages need.
"""

from __future__ import annotations

import html as _entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import free_name, require, shared_folder, stored

# Elements of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th
thead tr ul""".split())
DROPPED = frozenset("""head nav footer aside form menu dialog search button select option datalist object audio video canvas map
script style title textarea noscript iframe xmp noembed noframes template svg math""".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: An open element of the first kind ends when one of the second kind starts.
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
            "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words in a class, id or role that mark a part outside the article.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager skip
header masthead footer colophon contentinfo sidebar complementary aside rail widget widgets
notice notices cookie cookies consent gdpr alert popup modal overlay paywall newsletter subscribe subscription signup login
comment comments commentlist disqus respond replies reply discussion
share sharing social related recommended teaser teasers form search toolbar hidden""".split())

# a quote counts only after "=": elsewhere it is a character like any other
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
_MAIN = re.compile(r"""role\s*=\s*["']?main\b""", re.I)
_PIECE = re.compile(r"[a-z]+")


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """The attributes say that this element is no article text."""
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        found = MARKS.intersection(_PIECE.findall(value))
        if inside:
            found -= {"header"}  # the heading of an article is part of it
        # a class of the whole page or of the main element speaks of the layout; an article may be a reader's comment
        if name == "article":
            found &= {"comment", "reply", "teaser", "related"}
        if found and name not in ("html", "body", "main"):
            return True
    return False


class _Frame:
    __slots__ = ("name", "tag", "begin", "dropped", "soft", "inside", "parts", "chars", "linked", "holds")

    def __init__(self, name: str, tag: str, begin: int, dropped: bool, soft: bool, inside: bool) -> None:
        self.name, self.tag, self.begin, self.dropped, self.soft, self.inside = name, tag, begin, dropped, soft, inside
        self.parts, self.chars, self.linked, self.holds = [tag], 0, 0, False


class _Page:
    """One pass over a page.  ``hashes`` gets the subtrees that can be template: block elements with text
    that neither hold nor lie in the article; inside it only those whose text is mostly links."""

    def __init__(self, page: str, template: frozenset[int] = frozenset()) -> None:
        self.template = template
        # the only article may stand in a wrapper whose class names a part beside it ("content-sidebar-wrap"):
        # then what holds an article is not dropped for its class
        for self.wrapped in (False, True):
            self.hashes: set[int] = set()
            self.pieces: list[str | None] = []  # text, or None between two blocks
            self.ranges: list[tuple[int, int, str]] = []
            self.stack, self.lost = [_Frame("", "", 0, False, False, False)], False
            self._read(page)
            while len(self.stack) > 1:
                self._close()
            if self.ranges or not self.lost:
                break

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if raw and top.name not in RAW:
            text = _entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            packed = " ".join(text.split())
            if packed:
                top.parts.append(packed)
                top.chars += len(packed)

    def _read(self, page: str) -> None:
        at = 0
        while token := _TOKEN.search(page, at):
            self._text(page[at:token.start()])
            at = token.end()
            ending, name, attributes = token.group(1, 2, 3)
            if not name:
                continue
            name = name.lower()
            if ending:
                self._end(name)
            else:
                self._start(name, attributes)
                if name in RAW and not (name in ("svg", "math") and attributes.rstrip().endswith("/")):
                    close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                    at = close.start() if close else len(page)
                elif name in RAW:
                    self._close()
        self._text(page[at:])

    def _start(self, name: str, attributes: str) -> None:
        if name in ENDS_P:
            self._end("p", within=True)
        for k in range(len(self.stack) - 1, 0, -1):
            kind = self.stack[k].name
            if name in SIBLINGS.get(kind, ()):
                while len(self.stack) > k:
                    self._close()
            elif kind in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"):
                break
        top = self.stack[-1]
        if name in BLOCKS:
            self.pieces.append(None)
        elif name == "br":
            self.pieces.append(" ")
        if name in VOID:
            return
        told = "=" in attributes or "hidden" in attributes.lower()
        main = name in ("article", "main") or (told and name in BLOCKS and _MAIN.search(attributes) is not None)
        soft = told and _marked("main" if main and name != "article" else name, attributes, top.inside)
        dropped = top.dropped or name in DROPPED or (name == "header" and not top.inside) or (soft and not self.wrapped)
        self.lost = self.lost or (main and top.dropped and not soft)
        self.stack.append(_Frame("main" if main and name != "article" else name, name, len(self.pieces), dropped, soft,
                                 top.inside or (main and not dropped and not soft)))

    def _end(self, name: str, within: bool = False) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag == name:
                while len(self.stack) > k:
                    self._close()
                return
            if within and tag in ("table", "td", "th", "caption", "button", "article", "main"):
                return

    def _close(self) -> None:
        frame = self.stack.pop()
        up = self.stack[-1]
        up.chars += frame.chars
        up.linked += frame.chars if frame.name == "a" else frame.linked
        gone = frame.dropped or (frame.soft and not frame.holds)
        if frame.chars:
            digest = blake2b("\x1f".join(frame.parts).encode("utf-8", "replace"), digest_size=8).digest()
            up.parts.append(digest.hex())
            whole = frame.name in ("html", "body", "article", "main")
            if frame.name in BLOCKS and not whole and not frame.holds and (not frame.inside or 2 * frame.linked >= frame.chars):
                key = int.from_bytes(digest, "little", signed=True)
                self.hashes.add(key)
                gone = gone or key in self.template
        main = frame.name in ("article", "main") and not gone
        up.holds = up.holds or frame.holds or main
        if gone:
            del self.pieces[frame.begin:]
            self.ranges = [r for r in self.ranges if r[0] < frame.begin]
        elif main:
            self.ranges = [r for r in self.ranges if r[0] < frame.begin or r[2] != frame.name] + [(frame.begin, len(self.pieces), frame.name)]
        if frame.name in BLOCKS:
            self.pieces.append(None)

    def blocks(self) -> list[str]:
        """The blocks of the article: of all article elements, else of the main elements, else of the body."""
        kinds = {kind for _, _, kind in self.ranges}
        kind = "article" if "article" in kinds else "main"
        spans = sorted((a, b) for a, b, k in self.ranges if k == kind) or [(0, len(self.pieces))]
        out: list[str] = []
        for a, b in spans:
            block: list[str] = []
            for piece in [*self.pieces[a:b], None]:
                if piece is not None:
                    block.append(piece)
                elif block:
                    text = " ".join("".join(block).split())
                    out += [text] if text else []
                    block = []
        return out


def subtrees(page: str | None) -> list[int]:
    """The 64-bit hashes of the page's subtrees that can be template, sorted."""
    return sorted(_Page(page or "").hashes)


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The page's blocks without the subtrees of ``template``, one a line."""
    return "\n".join(_Page(page or "", template).blocks())


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case; null without one."""
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", least: int = 5, share: float = 0.2) -> DataFrame:
    """One row per host with a template: ``host``, ``pages`` and ``template`` (hashes of its recurring subtrees)."""
    @F.arrow_udf("struct<body:bigint,subtrees:array<bigint>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            bodies, lists = [], []
            for page in batch:
                tree = _Page(page.as_py() or "")
                lists.append(sorted(tree.hashes))
                text = "\n".join(tree.blocks()).encode("utf-8", "replace")
                bodies.append(int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True))
            yield pa.StructArray.from_arrays([pa.array(bodies, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["body", "subtrees"])

    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), read(F.col(f"`{html}`")).alias("_r"))
    rows = rows.select("host", "_r.body", "_r.subtrees").where("host is not null")
    # pages with one text and the same subtrees are copies: they count once
    rows = rows.distinct()
    # the host's number of pages is the count of a key that every page has
    keyed = rows.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("subtrees"))).alias("subtree"))
    counts = keyed.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    pages_of = F.max(F.when(F.col("subtree").isNull(), F.col("n")))
    hosts = counts.groupBy("host").agg(pages_of.alias("pages"), F.collect_list(F.when(F.col("subtree").isNotNull(), F.struct("subtree", "n"))).alias("_all"))
    recurring = F.transform(F.filter("_all", lambda x: x["n"] >= F.col("pages") * share), lambda x: x["subtree"])
    return hosts.select("host", "pages", F.array_sort(recurring).alias("template")).where(F.size("template") > 0)


def with_main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", least: int = 5, share: float = 0.2,
                   broadcast_bytes: int = 64 << 20, pages_per_salt: int = 100_000) -> DataFrame:
    """``pages`` with ``out``, the main text.

    A null or empty page, or one without text outside the dropped parts, gives an empty text.  A page
    whose URL is null or names no host is a site of its own.  White space in a block becomes one space;
    nothing else is changed, dropped or cut.  Repeated rows are treated each, an empty table stays
    empty, a column named ``out`` is replaced, others pass through.
    """
    require(pages, url, html)
    templates = stored(site_templates(pages, url, html, least, share), shared_folder(pages.sparkSession), "templates")
    size = templates.agg(F.sum(F.size("template") * 8 + F.octet_length("host") + 48)).first()[0] or 0
    host, salt, mine, own = (free_name(pages, n) for n in ("_host", "_salt", "_template", "_salts"))
    pages = pages.withColumn(host, host_of(F.col(f"`{url}`")))
    if size <= broadcast_bytes:
        templates = F.broadcast(templates.select(F.col("host").alias(host), F.col("template").alias(mine)))
        joined = pages.join(templates, host, "left")
    else:  # every host with a template has its row under each of its salts; a page takes one by its content
        salts = templates.select(F.col("host").alias(host), F.ceil(F.col("pages") / pages_per_salt).cast("long").alias(own), F.col("template").alias(mine))
        hot = salts.where(F.col(own) > 1).select(host, own)
        pages = pages.join(hot, host, "left").withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{url}`"), F.col(f"`{html}`")), F.coalesce(F.col(own), F.lit(1))))
        spread = salts.select(host, mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(own) - 1)).alias(salt))
        joined = pages.join(spread, [host, salt], "left").drop(salt, own)

    @F.arrow_udf("string")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sets: dict[tuple, frozenset[int]] = {}
        for page, template in batches:
            texts = []
            for p, t in zip(page, template):
                key = tuple(t.as_py() or ())
                if key not in sets:
                    sets.clear() if len(sets) > 10_000 else None
                    sets[key] = frozenset(key)
                texts.append(main_text(p.as_py(), sets[key]))
            yield pa.array(texts, pa.string())

    return joined.withColumn(out, extract(F.col(f"`{html}`"), F.col(mine))).drop(host, mine)
