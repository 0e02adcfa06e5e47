"""The article of web pages, by deduction of each host's template from equivalence classes of tokens.

A page is read into tokens: tags, and blocks of text, each told apart by its path of enclosing elements. A token's
occurrence vector says how often each page of the host has it; tokens of one vector are an equivalence class. Classes
that are large and frequent, tags among them, are the template; paths nest them. What the template leaves open are
slots, the paths under which text stands. The classes decide in this order: (1) of the template's elements that stand
once on a page, the smallest that holds most of the host's text which isn't links is the container (an article
element goes before others); what lies outside it is left out, whatever it is called. (2) A text that itself is in a
class is the template's own (a menu, a notice) and is left out, but never all of the container's texts, and inside an
article element less than half of them, so that equal articles stay. (3) Inside the container, slots whose elements say that they are
no article (a form, reader comments, an advert) are left out. Classes can't tell those: they vary like the article does.
Names decide alone where a host has no template, or a page hasn't its container: then slots in an article element are
the article, else those in a main element, else those whose text isn't mostly links. ``n_outside``, ``n_template`` and
``n_named`` say how many blocks went by (1), (2) and (3).

The vectors are never gathered: two sums over the pages of a hash of (page, number) stand for a vector, and combine
before the shuffle, so a host may have any share of the pages. What a host's pages need to know of their template is
one row, whose size follows the template.

Defined cases: a null or empty html has the text ''; a null url, or one without ``://``, has the host ''; a host of
few pages has no template of its own and is judged by its elements; a page of any length is read whole, and one of
unclosed or broken tags as far as they go; repeated rows get equal results and count each; an empty table gives no
rows; further columns are left out, whatever their names.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole, written

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
NO_ARTICLE = frozenset("head nav footer aside form button select option svg canvas object audio video map dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "sidebar side widget widgets adsense adsbygoogle copyright menu menus nav navbar navigation breadcrumb breadcrumbs toolbar masthead topbar footer comment comments respond replies disqus share sharing social related recommended recommendations trending pagination pager login search skip".split()
)
CONTENT = frozenset("article content main post entry story text body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Block:
    """``level``: 2 inside an article element, 1 inside a main one, 0 elsewhere. ``chain``: the paths of the enclosing
    elements, the block's own last. ``named``: how deep the innermost of them lies that is no article by its name (0: none)."""

    path: int
    text: str
    linked: int
    level: int
    chain: tuple[int, ...]
    named: int


@dataclass
class _Open:
    name: str
    path: int
    level: int
    chain: tuple[int, ...]
    named: int


@dataclass
class Page:
    """``tags``: how often each path stands on the page; ``articles``: those of article elements; ``depth``: of each."""

    tags: Counter = field(default_factory=Counter)
    depth: dict[int, int] = field(default_factory=dict)
    articles: set[int] = field(default_factory=set)
    blocks: list[Block] = field(default_factory=list)


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_NAMED.finditer(source)))} if source else {}


def _marked(attributes: dict[str, str], level: int, name: str) -> bool:
    """Whether an element's attributes say that it is no part of an article.

    The last word of a class or id is what it names: post-footer is a footer, article-body a body. A name that ends in
    a word for content outweighs the others; one with comments in it never does.
    """
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) or attributes.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    mark = content = False
    for token in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = [w.lower() for w in _WORD.findall(token)]
        if not words:
            continue
        if "comment" in words or "comments" in words:
            return True
        content |= words[-1] in CONTENT
        mark |= words[-1] in MARKS or (not CONTENT.intersection(words) and bool(MARKS.intersection(words))) or (level == 0 and words[-1] == "header")
    return mark and not content


def read_page(source: str) -> Page:
    """Tags by path, and the blocks of text in page order. Inline elements neither end a block nor are in its path."""
    page, stack, text, at = Page(), [_Open("", 0, 0, (), 0)], [], 0
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            top = stack[-1]
            page.blocks.append(Block(top.path, joined, linked, top.level, top.chain, top.named))
        text.clear()
        linked = 0

    def say(part: str) -> None:
        nonlocal linked
        if part:
            plain = html.unescape(part) if "&" in part else part
            text.append(plain)
            if links:
                linked += len(plain)

    while m := _TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in INLINE:
            links = max(0, links + (-1 if closing else 1)) if name == "a" else links
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        if closing:
            if any(x.name == name for x in stack[1:]):
                while stack.pop().name != name:
                    pass
            continue
        if name in CLOSES_P and stack[-1].name == "p" or name == stack[-1].name and name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            stack.pop()
        top, named = stack[-1], _attributes(attributes)
        path = _hash(top.path, name, *sorted(set(_WORD.findall(named.get("class", "")))))
        chain = (*top.chain, path)
        none = name in NO_ARTICLE or name == "header" and top.level == 0 or _marked(named, top.level, name)
        page.tags[path] += 1
        page.depth[path] = len(chain)
        if name == "article":
            page.articles.add(path)
        if not attributes.endswith("/"):
            stack.append(_Open(name, path, 2 if name == "article" else max(top.level, int(name == "main" or named.get("role", "").lower() == "main")), chain, len(chain) if none else top.named))
    say(source[at:])
    flush()
    return page


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


#: A template needs so many pages of a host, and that share of them; its classes so many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 4, 0.5, 3
#: The container holds so large a share of a host's text that isn't links.
CONTAINER_SHARE = 0.6
#: Inside an article or the container, texts that nearly all of some more pages have are the template's.
ARTICLE_PAGES, ARTICLE_SHARE = 8, 0.95
#: A slot that so large a share of the host's pages has is judged for all of them, others on their own page; so a host
#: has 10 times the slots of a page at most to tell its pages.
COMMON_SHARE = 0.1
#: The hosts' rows are broadcast up to so many bytes, else joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_PAGE, _TAG, _TEXT, _SLOT = range(4)


def _tokens(pages: DataFrame) -> DataFrame:
    names = ["host", "kind", "token", "v1", "v2", "article", "no_article", "times", "depth", "chars", "linked"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows = []
            for key, host, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page = read_page(source)

                def add(kind: int, token: int, times: int, article: bool = False, no_article: bool = False, depth: int = 0, chars: int = 0, linked: int = 0) -> None:
                    v = xxhash.xxh64_intdigest(f"{key}/{times}")
                    rows.append((host, kind, token, v & 0x7FFFFFFF, v >> 33, article, no_article, times, depth, chars, linked))

                below, slots = sums(page)
                add(_PAGE, 0, 1, chars=sum(len(b.text) for b in page.blocks), linked=sum(b.linked for b in page.blocks))
                for path, n in page.tags.items():
                    add(_TAG, path, n, path in page.articles, False, page.depth[path], *below.get(path, (0, 0)))
                texts: Counter = Counter((b.path, b.text) for b in page.blocks)
                first = {b.path: b for b in page.blocks}
                for (path, text), n in texts.items():
                    add(_TEXT, _hash(path, text), n, first[path].level > 0)
                for path, (chars, linked) in slots.items():
                    add(_SLOT, path, 1, False, first[path].named > 0, 0, chars, linked)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    return pages.select("id", "host", "html").mapInArrow(run, "host string, kind int, token long, v1 long, v2 long, article boolean, no_article boolean, times long, depth long, chars long, linked long")


def sums(page: Page) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Characters, and those in links, of the text below each path and of that in each slot."""
    below: dict[int, list[int]] = {}
    slots: dict[int, list[int]] = {}
    for b in page.blocks:
        for into, path in [(slots, b.path), *((below, p) for p in b.chain)]:
            had = into.setdefault(path, [0, 0])
            had[0] += len(b.text)
            had[1] += b.linked
    return below, slots


def templates(pages: DataFrame) -> DataFrame:
    """From (id, host, html), per host: the container, the hashes of the template's own texts, and its common slots, open and closed."""
    added = [F.sum(c).alias(c) for c in ("v1", "v2", "times", "chars", "linked")]
    tokens = written(_tokens(pages).groupBy("host", "kind", "token").agg(*added, F.count("*").alias("n"), F.max("article").alias("article"), F.max("no_article").alias("no_article"), F.max("depth").alias("depth")).where(f"kind != {_TEXT} OR n > 1"))
    plain = (F.col("chars") - F.col("linked")).alias("plain")
    of_host = tokens.where(F.col("kind") == _PAGE).select("host", F.col("n").alias("pages"), plain.alias("all"))
    vectors = tokens.where(F.col("kind").isin(_TAG, _TEXT)).groupBy("host", "n", "v1", "v2")
    of_kind = lambda kind, *what: F.collect_list(F.when((F.col("kind") == kind) & (F.col("times") == F.col("n") if kind == _TAG else F.lit(True)), F.struct("token", *what)))
    classes = vectors.agg(F.count("*").alias("size"), F.count_if(F.col("kind") == _TAG).alias("tags"), of_kind(_TEXT, "article").alias("texts"), of_kind(_TAG, "article", plain, "depth").alias("once"))
    valid = classes.join(of_host, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("pages")) & (F.col("size") >= LEAST_TOKENS) & (F.col("tags") > 0))
    sure = (F.col("pages") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("pages"))
    own = valid.select("host", F.explode("texts").alias("t"), sure.alias("sure")).where(~F.col("t.article") | F.col("sure")).groupBy("host").agg(F.collect_list("t.token").alias("own"))
    once = valid.select("host", "all", F.explode("once").alias("t")).where((F.col("t.plain") > 0) & (F.col("t.plain") >= CONTAINER_SHARE * F.col("all")))
    container = once.groupBy("host").agg(F.min(F.struct((~F.col("t.article")).alias("a"), F.col("t.plain").alias("b"), (-F.col("t.depth")).alias("c"), F.col("t.token").alias("container"))).alias("best")).select("host", "best.container")
    slots = tokens.where((F.col("kind") == _SLOT) & ~F.col("no_article"))
    common = slots.join(of_host, "host").withColumn("common", F.col("n") >= COMMON_SHARE * F.col("pages"))
    listed = lambda links: F.collect_list(F.when(F.col("common") & ((F.col("linked") * 2 > F.col("chars")) == F.lit(links)), F.col("token")))
    judged = common.groupBy("host").agg(listed(False).alias("open"), listed(True).alias("closed"))
    return of_host.select("host").join(own, "host", "left").join(judged, "host", "left").join(container, "host", "left")


def extract(page: Page, own: set[int], open_: set[int], closed: set[int], container: int | None) -> tuple[str, int, int, int]:
    """The page's article, and how many blocks were left out as outside the container, as the template's own and by names."""
    _, slots = sums(page)

    def is_open(path: int) -> bool:
        return path in open_ or (path not in closed and slots[path][1] * 2 <= slots[path][0])

    inside = [b for b in page.blocks if container in b.chain]
    deep = page.depth[container] if inside else 0
    outside = len(page.blocks) - len(inside) if inside else 0
    inside = inside or page.blocks
    mine = [b for b in inside if _hash(b.path, b.text) not in own]
    if deep and (not mine or any(b.level for b in inside) and 2 * sum(len(b.text) for b in mine) < sum(len(b.text) for b in inside)):
        mine = inside
    good = [b for b in mine if b.named <= deep]
    level = max((b.level for b in good), default=0)
    kept = [b for b in good if b.level == level and (level or is_open(b.path))]
    return " ".join(b.text for b in kept), outside, len(inside) - len(mine), len(mine) - len(kept)


def articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars, n_outside, n_template, n_named."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), whole(html_col).alias("html"))
    hosts = written(templates(rows))
    measured = hosts.agg(F.sum(F.length("host") + 48 + 8 * (F.coalesce(F.size("own"), F.lit(0)) + F.coalesce(F.size("open"), F.lit(0)) + F.coalesce(F.size("closed"), F.lit(0))))).first()[0] or 0
    joined = rows.join(F.broadcast(hosts) if measured <= BROADCAST_BYTES else hosts, "host", "left").select("id", "url", "html", "own", "open", "closed", "container")
    counts = ["n_chars", "n_outside", "n_template", "n_named"]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())] + [T.StructField(n, T.LongType()) for n in counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found = [extract(read_page(h), set(own or ()), set(open_ or ()), set(closed or ()), c) for h, own, open_, closed, c in zip(*(batch.column(i).to_pylist() for i in range(2, 7)))]
            texts, *numbers = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(x, pa.int64()) for x in numbers)], names=schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
