"""HTML main text by a site style tree.

All pages of a host are merged into one tree of presentation nodes (an element with those
of its classes that recur on the host, below its parent's node). Spark counts, for each
node, the pages that have it, the presentation styles (sequences of child nodes) and the
content features (text blocks) below it; entropies of both give each node an importance,
combined bottom-up, one level of all trees at a time. In a page, branches at low-importance
nodes go. An ``article`` or ``main`` element is a prior on importance: it counts like
``MIN_PAGES`` pages on which a node is important, and many pages that repeat it outweigh it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import checkpointed, fresh, table

#: Pages a node must be on before its entropies count; nodes of less importance go.
MIN_PAGES = 5
LOW = 0.35
GAMMA = 0.9
#: Paths of the low-importance table, or recurring classes, up to which they are broadcast.
BROADCAST_PATHS = 100_000
#: Levels that are combined one by one; what is nested deeper is combined within its branch.
DEEP = 40
#: What is nested deeper (unclosed tags, as a rule) is one node of the tree with its ancestor on this level; its text stays.
NESTED = 256
#: Paths of nodes that are, or are inside, an article or main element or one with that role.
IN_MAIN = r"/(article|main)(\.[^/]*)?(/|$)|%main"

#: Elements without an end tag, elements of raw text, elements that break a block (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends an open element of the second (fixed values of HTML).
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = frozenset("table ul ol dl select body html article main section div td th".split())
#: Elements, roles, and words of class or id that name something else than the article.
NOT_TEXT = frozenset("head title script style noscript template svg iframe object canvas audio video button select textarea".split())
NOT_MAIN = frozenset("nav footer aside form menu dialog search".split())
NOT_MAIN_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOT_MAIN_WORD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside footer header masthead topbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget "
    "comment comments disqus reply replies respond reader-comments pagination pager toolbar skip".split()
)

#: Words that stand beside those in compound names; a compound that has any other word is left to the tree.
BESIDE = frozenset(
    "site page main top bottom left right center global primary secondary list item items box bar block container wrapper wrap "
    "inner outer section area panel button buttons btn link links icon icons post posts article articles slot unit form thread "
    "content text title row col column group card region zone strip sticky fixed mobile desktop nav".split()
)
#: An article or main element with a smaller share of the text that is left is not taken for the whole of it.
MAIN_SHARE = 0.5

#: Elements whose content is no markup: skipped up to their end tag.
RAW = frozenset("script style noscript template textarea title svg iframe".split())
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup of a page in order: start, end, tag in lower case (None: a comment or raw element, to skip), closing, attributes.

    One pass: a ``<`` without any ``>`` behind it is text, and once a tag's quotes turn out never to
    close, tags end at the next ``>``, so that broken pages take time in proportion to their length.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = len(page) if end < 0 else end + 3
            yield lt, end, None, False, ""
        elif lt > last:
            at = lt + 1 if (lt := page.find("<!--", lt)) < 0 else lt  # only a comment needs no end
            if lt < 0:
                return
            continue
        elif page[lt + 1] in "!?":
            end = page.find(">", lt) + 1
            yield lt, end, None, False, ""
        elif m := _OPEN.match(page, lt):
            found = _END.match(page, m.end()) if quotes else None
            quotes = quotes and found is not None
            end = found.end() if found else page.find(">", m.end()) + 1
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                raw = _RAW_END[tag].search(page, end)
                end = raw.end() if raw else len(page)
                yield lt, end, None, False, ""
            else:
                yield lt, end, tag, closing, page[m.end(): end - 1]
        else:
            end = lt + 1
        at = end


_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element while it is open: its path in the site's tree, and what was decided about it."""

    __slots__ = ("tag", "path", "drop", "main", "kids")

    def __init__(self, tag: str, path: str, drop: bool, main: bool):
        self.tag, self.path, self.drop, self.main, self.kids = tag, path, drop, main, []


def _named_as_other(tag: str, attrs: dict[str, str], main: bool) -> bool:
    if tag in NOT_TEXT or tag in NOT_MAIN or (tag == "header" and not main):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "") in NOT_MAIN_ROLE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(map(_other_name, f"{attrs.get('class', '')} {attrs.get('id', '')}".split()))


@lru_cache(100_000)
def _other_name(name: str) -> bool:
    """Whether a class or id names something else than the article: by all of its words, not by one among others."""
    words = _WORDS.findall(_CAMEL.sub("-", name).lower())
    return any(w in NOT_MAIN_WORD for w in words) and all(w in NOT_MAIN_WORD or w in BESIDE for w in words)


def _escaped(name: str) -> str:
    return name.replace("%", "%25").replace("/", "%2F").replace(".", "%2E")


def _key(tag: str, attrs: dict[str, str], classes: frozenset[str]) -> str:
    """An element's step in a path: its tag, and in order its recurring classes; neither has a bare ``/`` or ``.``."""
    named = sorted({_escaped(c) for c in attrs.get("class", "").split() if c in classes})
    if attrs.get("role") == "main":
        named.append("%main")
    return ".".join([_escaped(tag), *named])


def walk(
    page: str, low: frozenset[str] = frozenset(), classes: frozenset[str] = frozenset()
) -> tuple[list[tuple[str, str, bool, bool]], list[Node]]:
    """Blocks (path, text, dropped, inside article or main) and elements of a page, in page order.

    A block's text has its character references decoded and its white space made single.
    ``low``: paths whose branches go. ``classes``: the class tokens that paths are keyed on.
    """
    blocks: list[tuple[str, str, bool, bool]] = []
    seen: list[Node] = []
    stack = [Node("", "", False, False)]
    text: list[str] = []

    def flush() -> None:
        if text:
            told = " ".join("".join(text).split())
            if told:
                top = stack[-1]
                blocks.append((top.path, told, top.drop, top.main))
            text.clear()

    def close(upto: int) -> None:
        if any(n.tag in BLOCK or n.drop != stack[upto - 1].drop for n in stack[upto:]):
            flush()
        del stack[upto:]

    at = 0
    for start, end, tag, closing, told in tokens(page):
        if start > at and not stack[-1].drop:
            text.append(unescape(page[at: start]))
        at = end
        if tag is None:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
            if ended := ENDS.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        close(k)
                    elif k < len(stack) and stack[k].tag in SCOPE and stack[k].tag not in ended:
                        break
            flush()
        elif tag == "br":
            if not stack[-1].drop:
                text.append(" ")
            continue
        if tag in VOID:
            continue
        up = stack[-1]
        attrs = {a[1].lower(): next((v for v in a.groups()[1:] if v is not None), "") for a in _ATTR.finditer(told)} if told else {}
        named = _key(tag, attrs, classes)
        deep = len(stack) > NESTED
        path = up.path if deep else f"{up.path}/{named}"
        main = up.main or tag in ("article", "main") or attrs.get("role") == "main"
        node = Node(tag, path, up.drop, main)
        if not up.drop and (_named_as_other(tag, attrs, main) or path in low):
            flush()
            node.drop = True
        up.kids.append(named)
        stack.append(node)
        if deep:
            node.kids = up.kids
        else:
            seen.append(node)
        if told.endswith("/") and tag not in BLOCK:
            stack.pop()
    if at < len(page) and not stack[-1].drop:
        text.append(unescape(page[at:]))
    flush()
    return blocks, seen


def main_text(page: str | None, low: frozenset[str] = frozenset(), classes: frozenset[str] = frozenset()) -> str:
    """The blocks of the article, joined by line feeds; those of article and main elements alone if they hold most of the text."""
    if not page:
        return ""
    kept = [(text, main) for _, text, dropped, main in walk(page, low, classes)[0] if not dropped]
    inner = [text for text, main in kept if main]
    if sum(map(len, inner)) < MAIN_SHARE * sum(len(text) for text, _ in kept):
        inner = []
    return "\n".join(inner or [text for text, _ in kept])


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without port; null or strange URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: one row (host, name) per class token."""
    for batch in batches:
        hosts: list[str] = []
        names: list[str] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own: set[str] = set()
            for _, _, tag, closing, told in tokens(page or ""):
                if tag and not closing and "class" in told.lower():
                    for a in _ATTR.finditer(told):
                        if a[1].lower() == "class":
                            own.update(next((v for v in a.groups()[1:] if v is not None), "").split())
            hosts += [host] * len(own)
            names += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.string())], ["host", "name"])


def recurring_classes(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, classes): the class tokens on ``MIN_PAGES`` pages of a host; names of fewer pages tell nothing of a site."""
    seen = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(_classes, "host string, name string")
    counts = seen.groupBy("host", "name").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= MIN_PAGES)
    return counts.groupBy("host").agg(F.sort_array(F.collect_list("name")).alias("classes"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and node: one row (host, path, kind, value) per style and per text block."""
    for batch in batches:
        rows: list[tuple[str, str, int, int]] = []
        for host, page, classes in zip(*(c.to_pylist() for c in batch.columns)):
            if not page:
                continue
            blocks, nodes = walk(page, classes=frozenset(classes or ()))
            own = set()
            for n in nodes:
                kids = [k for i, k in enumerate(n.kids) if not i or n.kids[i - 1] != k]  # repeated items are one style
                own.add((n.path, 0, xxhash.xxh3_64_intdigest("\n".join(kids)) >> 1))
                own.add((n.path, 2, 0))
            own.update((path, 1, xxhash.xxh3_64_intdigest(text) >> 1) for path, text, _, _ in blocks)
            rows += [(host, *x) for x in own]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
            ["host", "path", "kind", "value"],
        )


def _deep_importance(stats: pd.DataFrame) -> pd.DataFrame:
    """What ``_importances`` says of the nodes of one branch, children before parents."""
    own = {r.path: r for r in stats.itertuples()}
    kids: dict[str, list[str]] = {}
    for path, r in own.items():
        kids.setdefault(r.parent, []).append(path)
    got: dict[str, float] = {}
    peak: dict[str, float] = {}
    for path in sorted(own, key=lambda p: -own[p].depth):
        r = own[path]
        parts = [(own[k].pages, got[k]) for k in kids.get(path, [])]
        if r.blocks:
            parts.append((r.pages, r.content))
        below = sum(w * x for w, x in parts) / sum(w for w, _ in parts) if parts else 0.0
        share = GAMMA ** r.styles
        got[path] = (1 - share) * r.style + share * below if kids.get(path) else below
        told = (MIN_PAGES + r.pages * got[path]) / (MIN_PAGES + r.pages) if re.search(IN_MAIN, path) else got[path]
        peak[path] = max(told, *(peak[k] for k in kids.get(path, [])), 0.0)
    return stats[["host", "path", "parent", "depth", "pages"]].assign(
        importance=stats["path"].map(got), branch=stats["path"].map(peak)
    )


def _importances(nodes: DataFrame) -> DataFrame:
    """Composite importance of all nodes, bottom-up: all hosts' nodes of one level meet their children's sums.

    Below ``DEEP`` levels, the few branches of broken or generated pages are combined whole, each in one task.
    """
    nodes = nodes.withColumn("depth", F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))))
    nodes = checkpointed(nodes.withColumn("parent", F.expr("substring_index(path, '/', depth)")))
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    columns = ["host", "path", "parent", "depth", "pages", "importance", "branch"]
    levels: list[DataFrame] = []
    if deepest > DEEP:
        top = F.expr(f"substring_index(path, '/', {DEEP + 2})")
        levels.append(checkpointed(
            nodes.filter(F.col("depth") > DEEP).groupBy("host", top.alias("top")).applyInPandas(
                _deep_importance, "host string, path string, parent string, depth int, pages long, importance double, branch double"
            )
        ))
    for depth in range(min(deepest, DEEP), 0, -1):
        level = nodes.filter(F.col("depth") == depth)
        if levels:
            under = levels[-1].filter(F.col("depth") == depth + 1).groupBy("host", F.col("parent").alias("path")).agg(
                F.sum("pages").alias("w"), F.sum(F.col("pages") * F.col("importance")).alias("wx"), F.max("branch").alias("peak")
            )
            level = level.join(under, ["host", "path"], "left")
        else:
            level = level.withColumns({"w": F.lit(None).cast("long"), "wx": F.lit(None).cast("double"), "peak": F.lit(None).cast("double")})
        said = F.when(F.col("blocks") > 0, F.col("pages")).otherwise(F.lit(0))
        weight = F.coalesce("w", F.lit(0)) + said
        below = F.when(weight > 0, (F.coalesce("wx", F.lit(0.0)) + said * F.col("content")) / weight).otherwise(F.lit(0.0))
        share = F.pow(F.lit(GAMMA), F.col("styles"))
        level = level.withColumn(
            "importance", F.when(F.col("w").isNull(), below).otherwise((F.lit(1.0) - share) * F.col("style") + share * below)
        )
        told = F.when(
            F.col("path").rlike(IN_MAIN), (F.lit(MIN_PAGES) + F.col("pages") * F.col("importance")) / (F.lit(MIN_PAGES) + F.col("pages"))
        ).otherwise(F.col("importance"))
        levels.append(checkpointed(level.withColumn("branch", F.greatest(told, F.coalesce("peak", F.lit(0.0)))).select(*columns)))
    out = levels[0] if levels else nodes.withColumns({"importance": F.lit(0.0), "branch": F.lit(0.0)}).select(*columns)
    for level in levels[1:]:
        out = out.union(level)
    return out.select("host", "path", "pages", "importance", "branch")


def style_tree(pages: DataFrame, host: str = "host", html: str = "html", classes: str = "classes") -> DataFrame:
    """(host, path, pages, importance, branch) of all nodes of all hosts' style trees.

    ``classes`` has the class tokens that recur on the page's host. ``branch`` is the highest
    importance at or below the node, raised by the prior in an article or main element: a
    branch is noise only if all of it is.

    Style importance of a node on m pages is the entropy of its styles to the base m;
    content importance is 1 minus the mean, over its text blocks, of the entropy log_m(k) of
    a block that is on k pages. A host's pages meet only as counts: by value, then by node.
    """
    seen = pages.select(F.col(host).alias("host"), F.col(html).alias("html"), F.col(classes).alias("classes")).mapInArrow(
        _features, "host string, path string, kind int, value long"
    )
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("k"))
    k, style, block = F.col("k"), F.col("kind") == 0, F.col("kind") == 1
    nodes = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 2, k)).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"), F.sum(F.when(style, k * F.log(k))).alias("klogk"),
        F.count(F.when(block, 1)).alias("blocks"), F.sum(F.when(block, F.log(k))).alias("logs"),
    ).filter("pages IS NOT NULL")
    base = F.when(F.col("pages") > 1, F.log("pages"))
    nodes = nodes.select(
        "host", "path", "pages", "styles", "blocks",
        F.coalesce((F.log("pages") - F.col("klogk") / F.col("pages")) / base, F.lit(1.0)).alias("style"),
        F.coalesce(F.lit(1.0) - F.col("logs") / F.col("blocks") / base, F.lit(1.0)).alias("content"),
    )
    return _importances(nodes)


def _with_lists(rows: DataFrame, lists: DataFrame, host: str, column: str) -> DataFrame:
    """``rows`` with the array ``column`` that their host has in ``lists`` (checkpointed), or null."""
    n = lists.agg(F.sum(F.size(column)).alias("n")).first()["n"] or 0
    return rows.join(F.broadcast(lists) if n <= BROADCAST_PATHS else lists, host, "left")


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", keep: bool = False) -> DataFrame:
    """``pages`` with the main text in column ``out`` (replaced if it exists); ``keep`` keeps the html.

    Null and empty html give an empty text; a null url shares the host of strange urls. Rows
    stay as they are, repeated rows count as pages of their own. An empty table gives an empty
    one. Very long and broken pages take time in proportion to their length.
    """
    host_column, classes_column, low_column = (fresh(pages, c) for c in ("__host", "__classes", "__low"))
    names = [c for c in pages.columns if c != out and (keep or c != html)]
    hosted = pages.withColumn(host_column, host_of(F.col(url)))
    classes = recurring_classes(hosted, host_column, html)
    classes = checkpointed(classes.select(F.col("host").alias(host_column), F.col("classes").alias(classes_column)))
    hosted = _with_lists(hosted, classes, host_column, classes_column)
    low = checkpointed(
        style_tree(hosted, host_column, html, classes_column).filter((F.col("pages") >= MIN_PAGES) & (F.col("branch") < LOW))
        .groupBy(F.col("host").alias(host_column)).agg(F.sort_array(F.collect_list("path")).alias(low_column))
    )
    rows = _with_lists(hosted, low, host_column, low_column)
    schema = StructType([*pages.select(names).schema.fields, StructField(out, StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = [frozenset(x or ()) for x in batch.column(low_column).to_pylist()]
            names_of = [frozenset(x or ()) for x in batch.column(classes_column).to_pylist()]
            told = [main_text(p, x, y) for p, x, y in zip(batch.column(html).to_pylist(), lows, names_of)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(told, pa.string())], [*names, out])

    return rows.mapInArrow(run, schema)


def op3_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
