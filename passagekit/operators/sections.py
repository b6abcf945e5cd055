"""Sections of HTML pages, and the text a URI points to."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.functions.uris import DOMAIN, SCHEME, path_to_uri, uri_anchor, uri_page
from passagekit.operators.markup import Element, parse, parse_reported
from passagekit.session import estimated_bytes

_SECTIONS = pa.list_(pa.struct([("anchor", pa.string()), ("text", pa.string())]))


def _own_text(element: Element, container: str, keep_comments: bool) -> str:
    """Texts of the direct children, one per line; nested containers are rows of their own."""
    lines = []
    for child in element.children:
        if isinstance(child, Element):
            if child.name != container:
                lines.append(child.text().strip())
        elif child[1].strip() and (keep_comments or child[0] != "comment"):
            lines.append(child[1].strip())
    return "\n".join(lines)


def _section_finder(container: str, keep_comments: bool):
    @F.arrow_udf("struct<damaged:boolean,sections:array<struct<anchor:string,text:string>>>")
    def find(pages: pa.Array) -> pa.Array:
        found, damage = [], []
        for html in pages:
            tree, damaged = parse_reported(html.as_py() or "")
            damage.append(damaged)
            found.append([
                {"anchor": e.attrs.get("id"), "text": _own_text(e, container, keep_comments)}
                for e in tree.elements() if e.name == container
            ])
        return pa.StructArray.from_arrays([pa.array(damage, pa.bool_()), pa.array(found, _SECTIONS)], names=["damaged", "sections"])

    return find.asNondeterministic()  # never evaluated twice by a pushed-down filter


def extract_sections(
    pages: DataFrame,
    container: str = "section",
    require_id: bool = True,
    html_col: str = "html",
    path_col: str = "url",
    scheme: str = SCHEME,
    domain: str | None = DOMAIN,
    keep_direct_comments: bool = True,
    damaged: str | None = None,
) -> DataFrame:
    """One row per container element: the other page columns, section_pos, source and text.

    `source` is the page URI followed by `#` and the element's id. With `domain=None` the path
    column already holds the URI. Sections without an id are left out unless `require_id` is off. `damaged` names a column
    that says whether markup of the page could not be read (see `damaged_pages` for pages without sections).
    """
    lists = section_lists(pages, container, require_id, html_col, path_col, scheme, domain, keep_direct_comments, damaged)
    keys = [c for c in lists.columns if c not in ("_uri", "_sections")]
    rows = lists.select(*keys, "_uri", F.explode("_sections").alias("_section"))
    return rows.select(
        *keys, F.col("_section.pos").alias("section_pos"),
        F.concat_ws("#", "_uri", F.nullif(F.col("_section.anchor"), F.lit(""))).alias("source"),
        F.col("_section.text").alias("text"),
    )


def section_lists(
    pages: DataFrame,
    container: str = "section",
    require_id: bool = True,
    html_col: str = "html",
    path_col: str = "url",
    scheme: str = SCHEME,
    domain: str | None = DOMAIN,
    keep_direct_comments: bool = True,
    damaged: str | None = None,
) -> DataFrame:
    """One row per page: its other columns, `_uri`, and `_sections`, a list of pos, anchor and text; with `damaged`, a column of that name."""
    keys = [c for c in pages.columns if c not in (html_col, path_col, "source", "text")]
    uri = F.col(path_col) if domain is None else path_to_uri(F.col(path_col), scheme, domain)
    find = _section_finder(container, keep_direct_comments)
    rows = pages.select(*keys, uri.alias("_uri"), find(html_col).alias("_found"))
    numbered = F.transform("_found.sections", lambda s, i: F.struct(i.alias("pos"), s["anchor"].alias("anchor"), s["text"].alias("text")))
    if require_id:
        numbered = F.filter(numbered, lambda s: F.coalesce(F.length(s["anchor"]), F.lit(0)) > 0)
    report = [F.col("_found.damaged").alias(damaged)] if damaged else []
    return rows.select(*keys, *report, "_uri", numbered.alias("_sections"))


def damaged_pages(pages: DataFrame, html_col: str = "html", into: str = "damaged") -> DataFrame:
    """Add whether markup of the page could not be read and was taken as a comment."""
    @F.arrow_udf(T.BooleanType())
    def check(pages: pa.Array) -> pa.Array:
        return pa.array([parse_reported(html.as_py() or "")[1] for html in pages], pa.bool_())

    return pages.withColumn(into, check.asNondeterministic()(html_col))


# Anchors of one page that are looked up with one copy of its HTML.
ANCHORS_PER_COPY = 64
# Pages asked for up to this many (their names, some 100 bytes each) are broadcast as a filter.
ASKED_PAGES = 100_000
# Below this size all pages may be moved, which is cheaper than counting those that are asked for.
SMALL_PAGES = 64 << 20


@F.arrow_udf(T.ArrayType(T.StringType()))
def _texts_at(pages: pa.Array, wanted: pa.Array) -> pa.Array:
    """Text of the first element with each wanted id, else of the whole page. Each page is parsed once."""
    found = []
    for html, anchors in zip(pages, wanted.to_pylist()):
        html = html.as_py()
        if html is None:
            found.append([None] * len(anchors))
            continue
        tree, by_id = parse(html), {}
        for element in tree.elements():
            by_id.setdefault(element.attrs.get("id"), element)
        texts = {id(e): e.text() for e in {by_id.get(a, tree) if a else tree for a in anchors}}
        found.append([texts[id(by_id.get(a, tree) if a else tree)] for a in anchors])
    return pa.array(found, pa.list_(pa.string()))


def page_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """The whole text of each page."""
    texts = _texts_at.asNondeterministic()(F.col(html_col), F.array(F.lit(None).cast("string")))
    return pages.withColumn(into, F.get(texts, F.lit(0)))


def resolve_uris(uris: DataFrame, pages: DataFrame, uri_col: str = "uri", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """Add `text`: what each URI points to, or NULL if there is no such page.

    Every distinct URI is resolved once, however often it is asked for. The anchors of a page are
    cut by hash into groups of about ANCHORS_PER_COPY; each group meets one copy of the HTML, so
    neither a page with very many anchors nor its text piles up in one group.
    """
    distinct = uris.select(uri_col).distinct().select(
        F.col(uri_col).alias("_uri"), uri_page(F.col(uri_col)).alias("_page"), uri_anchor(F.col(uri_col)).alias("_anchor"))
    sizes = distinct.groupBy("_page").agg(F.count(F.lit(1)).alias("_n"))
    group = F.pmod(F.xxhash64("_uri"), F.ceil(F.col("_n") / ANCHORS_PER_COPY))
    groups = (
        distinct.join(sizes, "_page").groupBy("_page", group.alias("_group"))
        .agg(F.collect_list(F.struct("_uri", "_anchor")).alias("_wanted"))
    )
    bodies = pages.select(F.col(url_col).alias("_page"), F.col(html_col).alias("_html"))
    names = distinct.select("_page").distinct()
    if estimated_bytes(bodies) > SMALL_PAGES and names.limit(ASKED_PAGES + 1).count() <= ASKED_PAGES:  # few pages are asked for: only their HTML is moved
        bodies = bodies.join(F.broadcast(names), "_page", "left_semi")
    texts = _texts_at.asNondeterministic()(F.col("_html"), F.col("_wanted._anchor"))
    pairs = groups.join(bodies, "_page").select(F.col("_wanted._uri").alias("_uris"), texts.alias("_texts"))
    resolved = pairs.select(F.explode(F.arrays_zip("_uris", "_texts")).alias("_pair")).select(
        F.col("_pair._uris").alias("_uri"), F.col("_pair._texts").alias("text"))
    return uris.join(resolved, uris[uri_col] == resolved["_uri"], "left").drop("_uri")
