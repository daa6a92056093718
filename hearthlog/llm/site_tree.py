"""Main text of web pages by a style tree per site.

All pages of a host are merged into one tree whose nodes are element paths (tag and class from the root).
Two entropies say how much a node matters, both with the number m of pages that have it as base:

* presentation: the entropy of its child sequences over the pages; furniture always looks the same;
* content: for each text that d of the m pages with its path show, 1 - log(d) / log(m + length / PRIOR_CHARS); a text
  on every one of many pages has importance near 0, a text on one page 1. The length in code points stands for
  pages not seen that lack the text: menus are short and prose is long, so two pages that share a menu entry tell
  much against it, and two that share a paragraph, as versions of one article do, tell little. A node's content importance is passed up from the leaves: the mean over
  all texts in and below it, weighted by how often they are shown and how long they are.

A node's composite importance is ``(1 - GAMMA) * presentation + GAMMA * content``. Branches of low importance,
with all that is below them, and single texts of low content importance are cut out of each page. ``html``,
``body``, ``main`` and ``article`` are no such branches; and where branches hold most of what would stay of a
page without them, they are its main text and stay.

Pages whose candidate texts are equal count once, so copies of an article do not turn it into furniture. There is no
least number of pages: for small m only short texts on all of them have low importance. A path on one page cannot tell
and stays. Elements that name themselves furniture (tags, roles, class and id words) are
low-importance branches whatever their statistics, since adverts and menus may differ on every page.
Where a page marks its article, only that branch counts.

Pages are parsed twice, once for narrow (host, path, hash) rows and once for the text, rather than staged.
Counts are combined before each exchange, so a host with a third of all pages is no hot group. What is cut
on a host is a set of hashes: a text is in it only if m**(1 - LOW) pages have it, so a host's set is far
smaller than its pages; a set is joined to its pages by host, and Spark splits a skewed side.

Null and empty pages have an empty text; a null or odd url belongs to the host ""; repeated rows give
repeated results; broken, unclosed and cut-off markup is read as far as it goes; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.session import cut

LOW = 0.3
GAMMA = 0.9
PRIOR_CHARS = 40

# Element kinds and furniture words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SIBLING_LIMIT = frozenset("ul ol menu dl table select tbody thead tfoot".split())
FURNITURE_TAGS = frozenset("head nav footer aside form dialog menu button select svg object canvas audio video".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies "
    "copyright disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promotion recommended related share sharing sidebar signin signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
SPARES_COMMENTS = frozenset("has with without".split())
NEVER_FURNITURE = frozenset("html body main".split())
NEVER_BRANCHES = NEVER_FURNITURE | {"article"}
CONTENT_LEAD = frozenset("with has no without article post entry story main content page".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")


class Block(NamedTuple):
    path: str
    text: str
    in_article: bool


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _names_furniture(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element calls itself furniture, and its class for the path."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True, ""
    if not attributes:
        return False, ""
    own_class = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, ""
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, ""
        if name == "role" and value in FURNITURE_ROLES:
            return True, ""
        if name in ("class", "id"):
            own_class = value if name == "class" else own_class
            for word in value.split():
                if tag in NEVER_FURNITURE:
                    break
                parts = re.split(r"[-_:]+", word)
                first = next((k for k, part in enumerate(parts) if part in COMMENT_WORDS), 0)
                spared = SPARES_COMMENTS.intersection(parts[:first]) or (tag == "article" and "no" in parts[:first])
                if COMMENT_WORDS.intersection(parts) and not spared:
                    return True, ""
                if tag != "article" and parts[0] not in CONTENT_LEAD:
                    if FURNITURE_WORDS.intersection(parts):
                        return True, ""
    return False, own_class


class _Page:
    """Open elements and finished blocks of one page."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, bool, bool]] = []  # tag, path, furniture, in article
        self.blocks: list[Block] = []
        self.children: dict[str, list[str]] = {}
        self.parents: dict[str, str] = {}  # of paths that can be cut as branches
        self.held: list[str] = []

    def top(self) -> tuple[str, str, bool, bool]:
        return self.open[-1] if self.open else ("", "", False, False)

    def flush(self) -> None:
        if self.held:
            _, path, furniture, in_article = next(
                (o for o in reversed(self.open) if o[0] in BLOCK), ("", "", False, False)
            )
            text = " ".join(html.unescape("".join(self.held)).split())
            self.held = []
            if text and not furniture:
                self.blocks.append(Block(path, text, in_article))

    def add_text(self, raw: str) -> None:
        if raw and not self.top()[2]:
            self.held.append(raw)

    def close_to(self, depth: int) -> None:
        if any(o[0] in BLOCK for o in self.open[depth:]):
            self.flush()
        del self.open[depth:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in CLOSED_BY_BLOCK:
                    self.close_to(depth)
                    break
                if self.open[depth][0] in BLOCK:
                    break
        if tag in SIBLINGS:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in SIBLING_LIMIT:
                    break
                if self.open[depth][0] in SIBLINGS[tag]:
                    self.close_to(depth)
                    break
        if tag in VOID:
            self.add_text(" ")
            return
        _, path, furniture, in_article = self.top()
        own_class = ""
        if not furniture:
            furniture, own_class = _names_furniture(tag, attributes, in_article)
        in_article = in_article or (tag in ("article", "main") and not furniture)
        own = f"{path}/{tag}.{own_class}" if own_class else f"{path}/{tag}"
        if not furniture:
            self.children.setdefault(path, []).append(tag)
            if tag not in NEVER_BRANCHES:
                self.parents.setdefault(own, path)
        self.open.append((tag, own, furniture, in_article))

    def branches(self, path: str) -> list[str]:
        """The branches that a text with this path is in, the innermost first."""
        found = []
        while path in self.parents:
            found.append(path)
            path = self.parents[path]
        return found

    def end(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.close_to(depth)
                return


def parse(page: str | None) -> _Page:
    """Blocks and child sequences of a page, furniture by name left out."""
    state, at, text = _Page(), 0, page or ""
    while True:
        found = _TOKEN.search(text, at)
        if not found:
            # A tag that is cut off at the end of the page is no text.
            rest = text[at:]
            state.add_text(re.sub(r"<[/a-zA-Z!?][^<]*\Z", "", rest))
            break
        state.add_text(text[at : found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            state.end(tag)
        elif tag in RAW:
            finish = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            at = finish.end() if finish else len(text)
        else:
            state.start(tag, attributes)
    state.flush()
    return state


def candidate_blocks(state: _Page) -> list[Block]:
    """The blocks of the marked article, or all blocks if none is marked."""
    inside = [b for b in state.blocks if b.in_article]
    return inside or state.blocks


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def features(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, page, path, kind, feature, n): child sequences (``style``) and texts (``text``, with n code points) of
    every page, and of every path with text the branches it is in (``in``, page 0)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[str, str]] = set()
        for batch in batches:
            out = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                state = parse(page)
                blocks = candidate_blocks(state)
                host, name = host_of(url), _hash(*[b.text for b in blocks])
                nodes = {}
                for path in {b.path for b in blocks}:
                    above = state.branches(path)
                    for node in [path, *above]:
                        if node not in nodes:
                            nodes[node] = _hash(node)
                            out.append((host, name, nodes[node], "style", _hash(*state.children.get(node, [])), 0))
                    if (host, path) not in known:
                        # Repeats are dropped below; this only saves rows.
                        known.add((host, path))
                        out += [(host, 0, nodes[path], "in", nodes[node], 0) for node in above]
                if len(known) > 100_000:
                    known.clear()
                out += [(host, name, nodes[b.path], "text", _hash(b.path, b.text), len(b.text)) for b in blocks]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["host", "page", "path", "kind", "feature", "n"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(emit, "host string, page long, path long, kind string, feature long, n long").distinct()


def unimportant(feature_rows: DataFrame, low: float = LOW, gamma: float = GAMMA) -> DataFrame:
    """(host, kind, cut): hashes of the branches (``in``) and texts (``text``) of low importance on each host."""
    shown = cut(feature_rows.groupBy("host", "path", "kind", "feature", "n").agg(F.count(F.lit(1)).alias("d")))
    # Every page with the path has exactly one child sequence there.
    pages = cut(shown.filter("kind = 'style'").groupBy("host", "path").agg(F.sum("d").alias("m")))
    share, many = F.col("d") / F.col("m"), F.col("m") > 1
    known = shown.filter("kind <> 'in'").join(pages, ["host", "path"]).select(
        "*",
        F.when(many, -share * F.log("d") / F.log("m") + share).otherwise(1.0).alias("entropy_part"),
        F.when(many, 1 - F.log("d") / F.log(F.col("m") + F.col("n") / PRIOR_CHARS)).otherwise(1.0).alias("content"),
    )
    style, text = F.col("kind") == "style", F.col("kind") == "text"
    weight = F.when(text, F.col("d") * F.col("n"))
    nodes = cut(
        known.groupBy("host", "path").agg(
            F.sum(F.when(style, F.col("entropy_part"))).alias("presentation"),
            F.sum(weight * F.col("content")).alias("part"),
            F.sum(weight).alias("whole"),
            F.first("m").alias("m"),
        )
    )
    within = shown.filter("kind = 'in'").select("host", "path", F.col("feature").alias("branch"))
    content = (
        within.join(nodes.select("host", "path", "part", "whole"), ["host", "path"])
        .groupBy("host", F.col("branch").alias("path"))
        .agg((F.sum("part") / F.sum("whole")).alias("content"))
    )
    importance = (1 - gamma) * F.col("presentation") + gamma * F.col("content")
    branches = nodes.filter("m > 1").join(content, ["host", "path"]).filter(importance < low)
    return branches.select("host", F.lit("in").alias("kind"), F.col("path").alias("cut")).union(
        known.filter(text & (F.col("content") < low)).select("host", "kind", F.col("feature").alias("cut"))
    )


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    low: float = LOW,
    gamma: float = GAMMA,
) -> DataFrame:
    """One row per page: id, url, main text and its length in code points."""
    cuts = unimportant(features(pages, url_col, html_col), low, gamma)
    # Staged, so that Spark knows its size when it plans the join with the pages.
    per_host = cut(cuts.groupBy("host").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("cut"))).alias(v) for k, v in (("text", "cuts"), ("in", "gone"))]))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST.pattern, 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, cuts, gone in zip(batch.column("html"), batch.column("cuts"), batch.column("gone")):
                state = parse(page.as_py())
                blocks = candidate_blocks(state)
                cuts, gone = set(cuts.as_py() or ()), set(gone.as_py() or ())
                if cuts:
                    blocks = [b for b in blocks if _hash(b.path, b.text) not in cuts]
                kept = [b.text for b in blocks]
                if gone:
                    low = {p for p in {b.path for b in blocks} if any(_hash(n) in gone for n in state.branches(p))}
                    main = [b.text for b in blocks if b.path not in low]
                    kept = main if 2 * sum(map(len, main)) >= sum(map(len, kept)) else kept
                out.append("\n".join(kept))
            text = pa.array(out, pa.string())
            chars = pa.array([len(t) for t in out], pa.int64())
            yield pa.record_batch([batch.column("id"), batch.column("url"), text, chars], names=["id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    found = rows.join(per_host, "host", "left").select("id", "url", "html", "cuts", "gone")
    out = found.mapInArrow(texts, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)
