"""Main text of web pages by a site style tree.

The pages of one host are merged into a tree of style nodes (the chain of
elements and classes that leads to a branch). A node's importance is a mix of
the entropy of its presentation (how its children differ among pages) and of
its content (features that stand on one page tell much, features that stand on all
pages nothing). Branches of low importance, and branches that by their element,
role or class are menus, headers, footers, sidebars, notices, adverts, forms or
comments, are removed; the blocks that are left are the text.

Pages that equal another page of the host block by block count once, so copies of
an article do not make it a template. Tree counts are sums over (host, node,
feature), merged inside tasks first: a host with a third of all pages is spread
like any other. Only its short list of removed nodes is joined back.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.url_filter import parts
from residuum.storage import cut

#: A node is judged from so many different pages, and on at least this share of the host's.
LEAST_PAGES = 4
LEAST_SHARE = 0.05
#: Importance below which a branch is removed, and the weight of content against presentation.
LEAST_IMPORTANCE = 0.3
CONTENT_WEIGHT = 0.9
#: Features a task sums before it passes them on.
TASK_FEATURES = 200_000

# Elements by what they do, and words of classes, ids and roles that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
REMOVED = frozenset("aside button datalist dialog fieldset footer form head header input label menu nav noscript object select".split())
RAW = "script style noscript template textarea title iframe svg math canvas audio video object select"
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOISE_WORDS = (
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices notification outbrain popup promo promoted related replies share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget"
).split()
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Headings, paragraphs, lists and tables of the article itself are its text, however many near copies of it the host has.
_OWN = re.compile(r">(?:article|main)[^>]*(?:>(?:p|h[1-6]|[uod]l|li|dt|dd|table|tbody|thead|tr|td|th|blockquote|pre|figure|figcaption)[^>]*)+$")
_NOISE = re.compile(r"(?:^|[\s_-])(?:" + "|".join(NOISE_WORDS) + r")(?:$|[\s_-])")


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """Blocks of a page in order: (style path, text, removed by its elements, inside an article)."""
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # element, style path, removed, article
    path, removed, inside = "", False, False
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((path, text, removed, inside))
            pieces.clear()

    def top() -> tuple[str, bool, bool]:
        return stack[-1][1:] if stack else ("", False, False)

    def close(to: int) -> None:
        nonlocal path, removed, inside
        del stack[to:]
        path, removed, inside = top()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in ("article", "main") and removed:  # an open menu or header ends where the article begins
                close(next(k for k, s in enumerate(stack) if s[2]))
            ends = SIBLINGS.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                other = stack[k][0]
                if other == "p" and name in CLOSES_P or other in ends:
                    close(k)
                    if other == "p":
                        break
                elif other in BLOCKS:
                    break
        if name in VOID:
            continue
        marks, off, main = "", name in REMOVED and not (name == "header" and inside), name in ("article", "main")
        if m["attrs"]:
            for key, value in _ATTR.findall(m["attrs"]):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "role":
                    off = off or value in NOISE_ROLES
                    main = main or value in ("main", "article")
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    off = True
                elif key == "itemprop":
                    main = main or value == "articlebody"
                elif key in ("class", "id"):
                    if value and _NOISE.search(value) and name not in ("html", "body", "article", "main"):
                        off = True
                    if key == "class":
                        marks = "." + re.sub(r"[0-9]+", "", value.split(" ")[0]) if value else ""
        if name in BLOCKS:
            path = f"{path}>{name}{marks}"
        removed, inside = removed or off, inside or main
        stack.append((name, path, removed, inside))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def _features(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, page): kind 0 content, 1 presentation; one row each and per page of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int, int, int], None] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*seen)) or [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["host", "node", "kind", "feature", "page"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = blocks(page.as_py() or "")
                own = _number("\n".join(f"{p}\t{t}" for p, t, _, _ in found))
                children: dict[int, list[str]] = {}
                for path, text, _, _ in found:
                    node = _number(path)
                    seen[host, node, 0, _number(text), own] = None
                    children.setdefault(node, []).append(str(len(text) // 40))
                for node, sizes in children.items():
                    seen[host, node, 1, _number(",".join(sizes)), own] = None
                if len(seen) > TASK_FEATURES:
                    yield out()
                    seen.clear()
        yield out()

    return pages.select("host", "html").mapInArrow(run, "host string, node long, kind long, feature long, page long")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of each style node of ``pages`` (host, html).

    With m different pages, a content feature on k of them has entropy log k / log
    m, and content importance is one less their mean. Presentation importance is
    the entropy of the sizes of the node's blocks over pages, by log m. A node of one page has importance one.
    """
    rows = _features(pages).groupBy("host", "node", "kind", "feature", "page").agg(F.lit(1).alias("one"))
    counted = rows.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("k"))
    sums = counted.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("k"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.log("k"))).alias("content"), F.count(F.when(F.col("kind") == 0, 1)).alias("features"),
        F.sum(F.when(F.col("kind") == 1, F.col("k") * F.log("k"))).alias("repeated"),
    )
    m = F.col("pages")
    content = 1 - F.col("content") / F.col("features") / F.log(m)
    shown = (F.log(m) - F.col("repeated") / m) / F.log(m)
    mixed = CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * shown
    return sums.select("host", "node", "pages", F.when(m <= 1, 1.0).otherwise(mixed).alias("importance"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``: the blocks of the main text, joined by one \\n, empty if there are none.

    Where a page has an article or main element with text that is kept, only
    blocks inside it count. Null and empty html give an empty text; a null or
    malformed URL makes one host of its own. Repeated rows give equal texts; a
    column named ``text_col`` is replaced.
    """
    host = parts(F.col(url_col))[0]
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    tree = style_tree(pages.select(host.alias("host"), html.alias("html")))
    size = tree.groupBy("host").agg(F.max("pages").alias("most"))
    low = tree.join(size, "host").where(
        (F.col("importance") < LEAST_IMPORTANCE) & (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("most") * LEAST_SHARE))
    # at most 1 / LEAST_SHARE times the nodes of a page for each host
    noise = cut(low.groupBy("host").agg(F.collect_set("node").alias("_nodes")), "style-tree").withColumnRenamed("host", "_host")
    source = pages.drop(text_col)
    named = source.withColumns({"_at": host, "_html": html}).join(noise, F.col("_at") == F.col("_host"), "left").drop("_at", "_host")
    schema = source.withColumn(text_col, F.lit("")).schema
    keep = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, nodes in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                off = frozenset(nodes.as_py() or ())
                found = [b for b in blocks(page.as_py()) if not b[2] and not (off and _number(b[0]) in off and not _OWN.search(b[0]))]
                main = [b for b in found if b[3]]
                out.append("\n".join(b[1] for b in main or found))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], [*keep, text_col])

    return named.select(*keep, "_html", "_nodes").mapInArrow(run, schema)
