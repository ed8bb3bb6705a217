"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements (by path: tags and classes from the root) and its text nodes (by path and text). The
occurrence vector of a token counts it on each page of one host. Tokens that come the same number of times wherever
they occur, and whose vectors are the same up to that number, form an equivalence class; a class is valid if it has
several tokens and is on most pages of the host. A text token of a valid class belongs to the host's template if the
element around it is in the same class: wherever the element is, so is the text. (Copies of one article on many pages
stand in elements that have other texts elsewhere.) What the template leaves are slots. The deepest element that holds
nearly all of the slots' text of a host is its main region.

Vectors are never built: each page adds its hash to a token's signature by exclusive or, and the least and the largest
count are kept, so classes come from partial aggregations by (host, token), and the page side of the last join is a
plain equi-join on the host.

The text of a page is that of its slots inside its article (the ``article`` or ``main`` element or, if it has none, the
host's main region and running text elsewhere, or all of its slots where the region holds less of them), without menus, headers, footers, sidebars, notices, adverts, forms and comments, which are known
by their elements, roles and class names. Running text inside an explicit article stays even if many pages share it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import materialize, utf8

LEAST_PAGES = 5  # of a host, for a class to be valid
LEAST_SHARE = 0.5  # of its pages
LEAST_TOKENS = 2  # in a class
NEARLY_ALL = 0.9  # of the slots' text, for a region to hold it
FLUSH_TOKENS = 100_000  # of a task's partial aggregation

# fixed values: elements and class words of page furniture, and how elements break text
FURNITURE = frozenset("head title nav footer aside form button select option label fieldset dialog menu iframe object "
                      "annotation annotation-xml".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side rail aside ad ads "
    "adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login form search share sharing "
    "social related recommended comment comments commentlist disqus respond reply replies pagination pager widget "
    "skip toolbar copyright legal".split())
# words that a name of furniture may have besides
PLACES = frozenset("site page global main top bottom left right primary secondary area list links link block box bar item "
                   "items inner outer wrap wrapper container section group button buttons icons posts articles".split())
NEVER_LAYOUT = frozenset("comment comments commentlist disqus respond reply replies".split())
ARTICLE = frozenset(("article", "main"))
RUNNING = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dd td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp "
                   "small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup "
                   "msubsup munder mover munderover mstyle mspace mpadded mphantom semantics".split())
CLOSED_BY_THEMSELVES = frozenset("p li dt dd tr td th option".split())

PIECE = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(?i:(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z))"
    r"|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|[!?/][^>]*(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}


def _hash(*parts: object) -> int:
    raw = utf8("\0".join(map(str, parts)))
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


class Node:
    """A text node: text with references decoded, element path, and where it stands."""

    __slots__ = ("article", "furniture", "link", "path", "running", "text", "wrappers")

    def __init__(self, text: str, element: tuple):
        self.text = text
        _, self.path, self.furniture, self.wrappers, self.article, self.link, self.running = element

    @property
    def token(self) -> int:
        return _hash(self.path, " ".join(self.text.split()))


_ELEMENTS: dict[tuple, tuple] = {}


def _element(tag: str, attributes: str, around: tuple) -> tuple:
    """The element, from a bounded table of those met before."""
    telling = tuple(ATTRIBUTE.findall(attributes)) if attributes else ()
    key = (tag, telling, around)
    known = _ELEMENTS.get(key)
    if known is None:
        if len(_ELEMENTS) > 50_000:
            _ELEMENTS.clear()
        known = _ELEMENTS[key] = _new_element(tag, telling, around)
    return known


def _names_furniture(words: list[str], article: bool) -> bool:
    """Whether a whole class name or id is that of furniture: no word in it is about something else."""
    own = FURNITURE_WORDS.intersection(words)
    if not own or not FURNITURE_WORDS.issuperset(set(words) - PLACES):
        return False
    # the header of an article or of a page's text holds its headline
    return not (own <= {"header", "masthead"} and (article or "page" in words))


def _new_element(tag: str, telling: tuple, around: tuple) -> tuple:
    """(tag, path, in furniture, in wrappers, in article, in link, in running text) of an element. Wrappers are those
    that are furniture unless they hold the text of the page: forms, and what is known by its names only."""
    _, path, furniture, wrappers, article, link, running = around
    main = tag == "main" or any(k.lower() == "role" and "main" in (v.lower() for v in values) for k, *values in telling)
    if main and not article:
        furniture, wrappers = False, ()
    article = article or main or tag in ARTICLE
    name = tag
    own = (tag in FURNITURE and tag != "form") or (tag == "header" and not article)
    soft, layout = tag == "form", True
    for key, *values in telling:
        value = next((v for v in values if v), "").lower()
        if key.lower() == "role":
            soft, own = soft or value == "form", own or (value in ROLES and value != "form")
            continue
        words = WORD.findall(value)
        if tag not in ("html", "body") and tag not in ARTICLE and not main:
            for one in value.split():
                parts = WORD.findall(one)
                if _names_furniture(parts, article):
                    soft, layout = True, layout and NEVER_LAYOUT.isdisjoint(parts)
        if key.lower() == "class" and words:
            name += "." + "-".join(words)
    path = f"{path}/{name}"
    if soft and layout:
        wrappers = (*wrappers, path)
    return (tag, path, furniture or own or (soft and not layout), wrappers, article, link or tag == "a",
            running or tag in RUNNING)


def _judge(nodes: list[Node | None]) -> None:
    """Text in a wrapper is furniture, unless the page has no article outside one and the wrapper holds most of its
    running text."""
    texts = [n for n in nodes if n is not None]
    if not any(n.wrappers for n in texts):
        return
    able = [n for n in texts if not n.furniture]
    opened: set[str] = set()
    if not any(n.article and not n.wrappers for n in able):
        telling = [n for n in able if n.running and not n.link] or [n for n in able if not n.link]
        held: dict[str, int] = {}
        for n in telling:
            for w in set(n.wrappers):
                held[w] = held.get(w, 0) + len(n.text)
        total = sum(len(n.text) for n in telling)
        opened = {w for w, size in held.items() if 2 * size > total}
    for n in able:
        n.furniture = not opened.issuperset(n.wrappers)


def parse(page: str) -> tuple[list[Node | None], list[str]]:
    """Text nodes in page order, with None where a block ends, and the element paths. Broken markup is read as far as
    it goes: a tag without an end counts as a tag, an element without an end ends with the one around it."""
    nodes: list[Node | None] = []
    paths: list[str] = []
    stack: list[tuple] = [("", "", False, (), False, False, False)]
    at = 0
    for m in PIECE.finditer(page):
        if m.start() > at:
            _text(nodes, page[at:m.start()], stack[-1])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            nodes.append(None)
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # a new block ends an open paragraph; items and cells end their like
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k][0]
                if open_tag == "p" or (open_tag == tag and tag in CLOSED_BY_THEMSELVES):
                    del stack[k:]
                    break
                if open_tag not in INLINE:
                    break
        element = _element(tag, m[4], stack[-1])
        paths.append(element[1])
        if not m[4].rstrip().endswith("/"):
            stack.append(element)
    if at < len(page):
        _text(nodes, page[at:], stack[-1])
    _judge(nodes)
    return nodes, paths


def _text(nodes: list[Node | None], raw: str, element: tuple) -> None:
    text = html.unescape(raw) if "&" in raw else raw
    if text.strip():
        nodes.append(Node(text, element))
    elif text and nodes and nodes[-1] is not None:
        nodes[-1].text += " "


def main_text(page: str, template: frozenset[int], region: str | None) -> str:
    """The slots of the page's article, given the host's template texts and main region."""
    nodes, _ = parse(page)
    able = [n for n in nodes if n is not None and not n.furniture]
    if any(n.article for n in able):
        chosen = {id(n) for n in able if n.article and (n.running or not template or n.token not in template)}
    else:
        # a page of which nothing is its own is a copy among copies: no template tells its text apart
        slots = [n for n in able if n.token not in template] or able
        inside = {id(n) for n in slots if region and (n.path + "/").startswith(region + "/")}
        held, whole = (sum(len(n.text) for n in x if not n.link) for x in ([n for n in slots if id(n) in inside], slots))
        chosen = {id(n) for n in slots if n.running or id(n) in inside or held < NEARLY_ALL * whole}
    parts: list[str] = []
    for n in nodes:
        if n is None:
            parts.append(" ")
        elif id(n) in chosen:
            parts.append(n.text)
    return SPACE.sub(" ", "".join(parts)).strip()


TOKEN_ROWS = "host string, path string, token bigint, vector bigint, pages bigint, least int, most int, chars bigint"


def _host(url_col: str):
    url = F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    return F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)


def host_templates(rows: DataFrame) -> DataFrame:
    """host, ``template`` (tokens of its template texts), ``region`` (path of its main region), from rows of
    (host, key, html). The template of a host is at most as long as its pages; hosts without one are left out."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = [*zip(*seen, strict=True), *zip(*seen.values(), strict=True)] if seen else [[]] * 8
            seen.clear()
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["host", "path", "token", "vector", "pages", "least", "most", "chars"])

        for batch in batches:
            for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
                nodes, paths = parse(page)
                counts: dict[tuple[str, int], int] = {("", 0): 1}  # the page itself
                chars: dict[tuple[str, int], int] = {}
                for path in paths:
                    counts[path, 0] = counts.get((path, 0), 0) + 1
                own: dict[str, int] = {}
                for n in nodes:
                    if n is None:
                        continue
                    token = n.path, n.token
                    counts[token] = counts.get(token, 0) + 1
                    if not (n.furniture or n.link):
                        own[n.path] = own.get(n.path, 0) + len(n.text)
                        chars[token] = chars.get(token, 0) + len(n.text)
                for path, size in own.items():  # text counts for every element around it
                    chars["", 0] = chars.get(("", 0), 0) + size
                    while path:
                        chars[path, 0] = chars.get((path, 0), 0) + size
                        path = path.rpartition("/")[0]
                mark = _hash(key)
                for (path, token), k in counts.items():
                    size = chars.get((path, token), 0)
                    old = seen.get((host, path, token))
                    if old is None:
                        seen[host, path, token] = [mark, 1, k, k, size]
                    else:
                        seen[host, path, token] = [old[0] ^ mark, old[1] + 1, min(old[2], k), max(old[3], k),
                                                   old[4] + size]
                if len(seen) >= FLUSH_TOKENS:
                    yield flush()
        yield flush()

    found = rows.where(F.col("host") != "").mapInArrow(tokens, TOKEN_ROWS).groupBy("host", "path", "token").agg(
        F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.sum("chars").alias("chars"))
    # rarer tokens are in no class; what is left is small, and saves reading the pages once for each use of it
    found = materialize(found.where(F.col("pages") >= LEAST_PAGES), "page_tokens")
    whole = found.where((F.col("path") == "") & (F.col("token") == 0)).select(
        "host", F.col("pages").alias("of_host"), F.col("chars").alias("host_chars"))
    common = found.join(whole, "host").where(
        (F.col("pages") >= LEAST_SHARE * F.col("of_host")) & (F.col("path") != ""))
    classes = common.where(F.col("least") == F.col("most")).groupBy("host", "vector", "pages").agg(
        F.count(F.lit(1)).alias("size"),
        F.collect_set(F.when(F.col("token") == 0, F.col("path"))).alias("elements"),
        F.collect_list(F.when(F.col("token") != 0, F.struct("path", "token", "chars"))).alias("texts"),
    ).where(F.col("size") >= LEAST_TOKENS)
    # a class's texts that stand in elements of its own
    texts = classes.select("host", F.explode(F.expr("filter(texts, t -> array_contains(elements, t.path))")).alias("t"))
    texts = texts.select("host", "t.*")
    template = texts.groupBy("host").agg(F.collect_list("token").alias("template"))
    # what they hold of the text of every element around them
    around = F.expr("transform(sequence(1, size(split(path, '/'))), k -> array_join(slice(split(path, '/'), 1, k), '/'))")
    taken = texts.select("host", "chars", F.explode(around).alias("path")).groupBy("host", "path").agg(
        F.sum("chars").alias("taken"))
    of_host = whole.join(taken.where("path = ''").drop("path"), "host", "left").select(
        "host", (F.col("host_chars") - F.coalesce("taken", F.lit(0))).alias("host_slots"))
    depth = F.size(F.split("path", "/"))
    name = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)
    holds = (F.col("token") == 0) & ~name.isin(*RUNNING, *INLINE)  # elements that hold blocks, not running text
    slots = common.where(holds & (F.col("chars") > 0)).join(taken, ["host", "path"], "left").join(of_host, "host").select(
        "host", "path", "host_slots", (F.col("chars") - F.coalesce("taken", F.lit(0))).alias("chars"))
    region = slots.where((F.col("chars") >= NEARLY_ALL * F.col("host_slots")) & (F.col("chars") > 0)).groupBy("host").agg(
        F.max_by("path", F.struct(depth, "chars", "path")).alias("region"))
    return template.join(region, "host", "full")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text``.

    Null and empty html gives the empty text. Pages without a host (null or odd urls) and hosts with few pages have no
    template; their text is that of the article or, without one, all that is not furniture. Rows with the same id, or
    none, each give a row. An empty table gives an empty result. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _host(url_col).alias("host"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.select("host", F.xxhash64("id", "url", "html").alias("key"), "html")
    joined = rows.join(host_templates(keyed), "host", "left").select("id", "url", "html", "template", "region")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, frozenset(t for t in template or () if t is not None), region)
                     for page, template, region in zip(
                         *(batch.column(c).to_pylist() for c in ("html", "template", "region")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["id", "url", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"id {kind}, url string, text string").withColumnsRenamed(
        {"id": id_col, "url": url_col})
