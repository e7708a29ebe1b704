"""Main text of pages by deducing each host's template.

1. Every page becomes a sequence of tokens: its containers, named by their path of tags and class
   words, and the word runs of its blocks, named by their container's path and all their words. A
   token's occurrence vector over the host's pages is kept as a fingerprint (exclusive-or of hashes
   of page and count), which adds up in any order, so no host's pages are ever gathered. Tokens of
   one fingerprint form an equivalence class.
2. A class is valid if it stands on three different pages or more and holds a container. A word run
   that is in the class of its container, or of one around it, is there whenever that container is,
   and as often: it is template text, inside article and main too. Classes nest by the containers'
   paths; what lies between their tokens are the slots. Pages of a host that say the same count
   once, since copies of a page cannot tell template from text.
3. Template text is kept as rows (host, token), for any number of pages of the host, and joined with
   the tokens of each page. A page's text is all its blocks, character references decoded, that are
   neither template text nor in containers for navigation, advertising, notices, forms, comments and
   the like (by tag, role or class words). Nothing else is dropped.

Defined results: null and empty pages give an empty text; null hosts form one host; unclosed and
misnested tags end with their container; repeated rows are extracted each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import stage

#: Element names by what they do.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "canvas", "object", "iframe", "head", "title", "select", "textarea", "video", "audio", "map"}
SIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN = {"article", "main"}
CONTAINERS = {"html", "body", "div", "section", "header", "table", "ul", "ol", "dl", "blockquote", "figure", "details", "center"} | SIDE | MAIN
BREAKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "tr", "hr", "address", "figcaption", "summary", "caption", "legend", "hgroup", "tbody", "thead", "tfoot", "option"}
SPACES = {"br", "td", "th", "img", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class and id names, and roles, of containers without main text.
SIDE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "widgets", "footer", "masthead", "share", "sharing",
    "social", "related", "recommended", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "respond", "pagination", "pager", "toolbar", "search", "login", "skip",
}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    __slots__ = ("token", "up", "side", "main", "tag")

    def __init__(self, token: int, up: int, side: bool, main: bool, tag: str):
        self.token, self.up, self.side, self.main, self.tag = token, up, side, main, tag


def _digest(text: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed) - (1 << 63)


#: The token of the page itself, around all containers.
ROOT = _digest("")


def _named(tag: str, attributes: str, in_main: bool) -> tuple[str, bool]:
    """A container's name and whether it is at the side."""
    side = tag in SIDE or (tag == "header" and not in_main)
    name = tag
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "role":
                side |= value in SIDE_ROLES and tag not in MAIN
            elif key in ("class", "id"):
                words = re.findall(r"[a-z]+", value)
                side |= tag not in ("html", "body") and tag not in MAIN and not SIDE_WORDS.isdisjoint(words)
                name += "." + ".".join(words)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                side = True
    return name, side


def blocks_of(page: str) -> Iterator[tuple[str, Node | None, str]]:
    """('open'|'close', node, '') and ('text', innermost container, block text) in page order."""
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    pos, size = 0, len(page)

    def flush() -> str:
        if not buffer:
            return ""
        text = "".join(buffer)
        buffer.clear()
        return " ".join((entities.unescape(text) if "&" in text else text).split())

    while pos < size:
        m = TOKEN.search(page, pos)
        if m is None:
            buffer.append(page[pos:])
            break
        if m.start() > pos:
            buffer.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[1] == "/"
        if tag in SILENT:
            if not closing and tag not in ("head", "title") and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                pos = end.end() if end else size
                continue
            if tag == "title" and not closing:
                end = re.compile(r"</title\s*>", re.I).search(page, pos)
                pos = end.end() if end else pos
            if tag == "head":
                buffer.clear()
            continue
        if tag in SPACES:
            buffer.append(" ")
            continue
        here = stack[-1] if stack else None
        if tag in BREAKS:
            text = flush()
            if text:
                yield "text", here, text
            if here is not None and here.tag not in CONTAINERS and not closing:
                opened[here.tag] -= 1
                yield "close", stack.pop(), ""  # a block that is no container ends where the next one begins
                here = stack[-1] if stack else None
        if closing:
            if opened[tag]:
                if tag not in BREAKS:
                    text = flush()
                    if text:
                        yield "text", here, text
                while stack:
                    node = stack.pop()
                    opened[node.tag] -= 1
                    yield "close", node, ""
                    if node.tag == tag:
                        break
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        in_main = here is not None and here.main
        attributes = m[3]
        if tag not in CONTAINERS and not attributes:
            continue
        name, side = _named(tag, attributes, in_main)
        if tag in CONTAINERS or side:
            if tag not in BREAKS:
                text = flush()
                if text:
                    yield "text", here, text
            up = here.token if here else ROOT
            node = Node(_digest(name, seed=up & 0xFFFFFFFFFFFFFFFF), up, side or (here is not None and here.side), in_main or tag in MAIN, tag)
            stack.append(node)
            opened[tag] += 1
            yield "open", node, ""
    text = flush()
    if text:
        yield "text", stack[-1] if stack else None, text
    while stack:
        yield "close", stack.pop(), ""


def page_tokens(page: str) -> tuple[list[dict], list[tuple[int, str]]]:
    """(tokens: token, count, up, run), (blocks of token, text), without those at the side.

    A container's token stands for the names from the root to it, ``up`` is that of the container around it; a word
    run's stands for its container and text, ``up`` is its container. So a page's tokens grow with the page,
    however deep it nests.
    """
    counts: dict[int, dict] = {ROOT: {"token": ROOT, "count": 1, "up": 0, "run": False}}
    blocks = []
    for what, node, text in blocks_of(page):
        if what == "close" or (node is not None and node.side):
            continue
        here = node.token if node is not None else ROOT
        if what == "open":
            x = counts.setdefault(here, {"token": here, "count": 0, "up": node.up, "run": False})
        else:
            token = _digest(text, seed=here & 0xFFFFFFFFFFFFFFFF)
            blocks.append((token, text))
            x = counts.setdefault(token, {"token": token, "count": 0, "up": here, "run": True})
        x["count"] += 1
    return list(counts.values()), blocks


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


TOKENS = pa.list_(pa.struct([("token", pa.int64()), ("count", pa.int32()), ("up", pa.int64()), ("run", pa.bool_())]))


def keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, host, key, html. ``key`` is the digest of host and page: rows that are equal in both have the same template text."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), html.alias("html"))
    return rows.select("page_id", "url", "host", F.unhex(F.md5(F.concat("host", F.lit("\n"), "html").cast("binary"))).alias("key"), "html")


def tokens_of(rows: DataFrame) -> DataFrame:
    """host, key, says (hash of the blocks), tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_tokens(page) for page in batch.column(2).to_pylist()]
            says = [_digest("\0".join(text for _, text in blocks)) for _, blocks in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(says, pa.int64()), pa.array([t for t, _ in found], TOKENS)], names=["host", "key", "says", "tokens"])

    return rows.select("host", "key", "html").mapInArrow(run, "host string, key binary, says long, tokens array<struct<token:long,count:int,up:long,run:boolean>>")


def templates(tokens: DataFrame) -> DataFrame:
    """host, token: the word runs that are template text.

    Every page with a run has all containers around it, so the containers that are on the run's pages alone are
    the innermost ones. They are climbed from the run's own container until one is as often as the run.
    """
    each = tokens.groupBy("host", "says").agg(F.min("key").alias("key"))
    each = tokens.join(each.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("host", "key", F.inline("tokens"))
    vectors = each.groupBy("host", "token", "up", "run").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("key", "count")).alias("print")).where("pages > 1")
    vectors = stage(vectors, "vectors")
    containers = vectors.where("not run").select("host", F.col("token").alias("at"), F.col("pages").alias("at_pages"), F.col("print").alias("at_print"), F.col("up").alias("above"))
    climbing = vectors.where("run and pages >= 3").select("host", "token", "pages", "print", F.col("up").alias("at"))
    found = []
    while True:
        met = climbing.join(containers, ["host", "at"]).where("at_pages = pages")
        met = stage(met.select("host", "token", "pages", "print", F.col("above").alias("at"), (F.col("at_print") == F.col("print")).alias("alike")), "climbing")
        found.append(met.where("alike").select("host", "token"))
        climbing = met.where("not alike and at <> 0").drop("alike")
        if climbing.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (blocks joined by two line feeds), n_chars."""
    rows = keyed(pages, id_col, url_col, html_col)
    tokens = stage(tokens_of(rows), "tokens")
    held = stage(templates(tokens), "templates")
    mine = tokens.select("key", "host", F.inline("tokens")).where("run")
    # Staged, so that its size is known before pages are moved for the join.
    dropped = stage(mine.join(held, ["host", "token"], "left_semi").groupBy("key").agg(F.collect_set("token").alias("dropped")), "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, without in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                without = set(without or ())
                texts.append("\n\n".join(text for token, text in page_tokens(page)[1] if token not in without))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(dropped, "key", "left").select("page_id", "url", "html", "dropped").mapInArrow(run, "page_id long, url string, text string, n_chars long")
