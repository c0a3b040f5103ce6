"""HTML as a table function: one row per element of interest, and plain DataFrame operators over these rows (S4, S7, S8, §2.8.6)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, text
from . import dom

#: Pages that a worker holds at once.
BATCH_PAGES = 200
#: The spacer that lazy loaders put where the real source comes later.
_SPACER = "data:image/gif;base64,R0lGOD"
_WINDOW = re.compile(r"(?:window|self|globalThis)\.([A-Za-z0-9_$]+)\s*=\s*({.*?});", re.S)
_BACKGROUND = re.compile(r"background(?:-image)?\s*:\s*url\(['\"]?([^'\")]+)", re.I)

_ROW = pa.schema([
    ("page_id", pa.int64()), ("element", pa.string()), ("ord", pa.int32()), ("tag", pa.string()), ("dom_path", pa.string()), ("text", pa.string()),
    ("level", pa.int32()), ("kind", pa.string()), ("visible", pa.bool_()), ("src", pa.string()), ("alt", pa.string()), ("caption", pa.string()),
    ("before_path", pa.string()), ("list_index", pa.int32()), ("cells", pa.list_(pa.list_(pa.string()))), ("attrs", pa.map_(pa.string(), pa.string())),
])
_ROW_SQL = "page_id long, element string, ord int, tag string, dom_path string, text string, level int, kind string, visible boolean, src string, alt string, caption string, before_path string, list_index int, cells array<array<string>>, attrs map<string,string>"


def absolute(src: str, base: str | None) -> str:
    return src if not src or src.startswith(("data:", "http://", "https://", "file://")) or not base else urljoin(base, src)


def image_source(node: dom.Node, base: str | None) -> str | None:
    """The first source of an image that isn't a spacer: its attributes, the last of its set, its picture's; else the spacer."""
    spacer = None
    for name in ("src", "data-src", "data-original", "data-lazy-src", "xlink:href"):
        value = node.attrs.get(name, "").strip()
        if value.startswith(_SPACER):
            spacer = spacer or value
        elif value:
            return absolute(value, base)
    choices = [part.split()[0] for part in (node.attrs.get("srcset") or node.attrs.get("data-srcset") or "").split(",") if part.strip()]
    if choices:
        return absolute(choices[-1], base)
    if node.parent is not None and node.parent.tag == "picture" and (source := node.parent.find("source")) is not None:
        choices = [part.split()[0] for part in source.attrs.get("srcset", "").split(",") if part.strip()]
        if choices:
            return absolute(choices[0], base)
    return spacer


def image_caption(node: dom.Node) -> str | None:
    """The caption of the figure that holds an image, else a caption that follows it."""
    figure = next((a for a in node.ancestors() if a.tag == "figure"), None)
    if figure is not None and (caption := figure.find("figcaption")) is not None:
        return caption.text()
    after = [c for c in node.parent.children[node.index() + 1 :] if isinstance(c, dom.Node)]
    return after[0].text() if after and after[0].tag in ("figcaption", "caption", "small") else None


def kind_of(tag: str) -> str:
    if tag in dom.HEADINGS:
        return "heading"
    return {"li": "list_item", "figcaption": "caption", "caption": "caption", "td": "table", "th": "table"}.get(tag, "paragraph")


def element_rows(page: int | None, markup: str | None, base: str | None, closed: bool = False) -> Iterator[dict]:
    """Rows of one page: text, heading, image, table, link, list item, meta, data and document; ``ord`` counts each kind from 0."""
    root = dom.parse(markup, closed)
    at = dom.paths(root)
    counts: dict[str, int] = {}

    def row(element: str, node: dom.Node, **more) -> dict:
        n = counts[element] = counts.get(element, -1) + 1
        return {"page_id": page, "element": element, "ord": n, "tag": node.tag, "dom_path": at.get(id(node)), **more}

    title, html = root.find("title"), root.find("html")
    yield row("document", html or root, text=title.text() if title else None, attrs={"lang": html.attrs["lang"]} if html is not None and html.attrs.get("lang") else {})
    for n in root.elements():
        if n.tag == "meta":
            key = n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("http-equiv")
            if key and n.attrs.get("content"):
                yield row("meta", n, text=n.attrs["content"], attrs={"key": key.lower()})
        elif n.tag == "script":
            raw = "".join(c for c in n.children if isinstance(c, str)).strip()
            kind = n.attrs.get("type", "").lower()
            if raw and (kind in ("application/json", "application/ld+json") or n.attrs.get("id")) and _is_json(raw):
                yield row("data", n, text=raw, attrs={"id": n.attrs.get("id", ""), "type": kind or "inline"})
            else:
                for m in _WINDOW.finditer(raw):
                    if _is_json(m.group(2)):
                        yield row("data", n, text=m.group(2), attrs={"id": m.group(1), "type": "window-global"})
    before = None
    for n in dom.body(root).elements():
        if n.tag in dom.RAW or any(a.tag in dom.RAW for a in n.ancestors()):
            continue
        if n.tag in dom.BLOCKS and (own := n.own_text()):
            before = at[id(n)]
            yield row("text", n, text=own, kind=kind_of(n.tag), visible=dom.visible(n))
        if n.tag in dom.HEADINGS:
            yield row("heading", n, text=n.text(), level=int(n.tag[1]), visible=dom.visible(n))
        elif n.tag in ("img", "image"):
            attrs = {k: n.attrs[k] for k in ("width", "height", "role", "style") if k in n.attrs}
            yield row("image", n, src=image_source(n, base), alt=n.attrs.get("alt"), caption=image_caption(n), before_path=before, kind="raster", visible=dom.visible(n), attrs=attrs)
        elif n.tag == "svg":
            name = n.find("title")
            yield row("image", n, alt=name.text() if name else None, kind="vector", visible=dom.visible(n))
        elif n.tag == "table":
            cells = [[c.text() for c in r.elements() if c.tag in ("td", "th")] for r in n.elements() if r.tag == "tr"]
            yield row("table", n, text=" | ".join(" ".join(r) for r in cells), cells=cells)
        elif n.tag == "a" and n.attrs.get("href"):
            yield row("link", n, src=absolute(n.attrs["href"], base), text=n.text(), attrs={"href": n.attrs["href"]})
        elif n.tag == "li" and n.parent.tag == "ol":
            place = [c for c in n.parent.children if isinstance(c, dom.Node) and c.tag == "li"]
            yield row("item", n, text=n.text(), list_index=next(i for i, c in enumerate(place, 1) if c is n))
        if m := _BACKGROUND.search(n.attrs.get("style", "")):
            yield row("image", n, src=absolute(m.group(1), base), alt=n.attrs.get("aria-label"), kind="region", visible=dom.visible(n))


def _is_json(raw: str) -> bool:
    try:
        json.loads(raw)
    except ValueError:
        return False
    return True


def _extract(batches: Iterator[pa.RecordBatch], closed: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, BATCH_PAGES):
            part = b.slice(start, BATCH_PAGES)
            rows = [r for p, m, u in zip(*(part.column(c).to_pylist() for c in ("page_id", "html", "url")), strict=True) for r in element_rows(p, m, u, closed)]
            yield pa.RecordBatch.from_pylist([{**r, "attrs": list((r.get("attrs") or {}).items())} for r in rows], schema=_ROW)


def elements(pages: DataFrame, closed: bool = False) -> DataFrame:
    """One row per element of ``pages`` (page_id, url, html); a page always has a ``document`` row. Null html counts as empty, a null url leaves sources as they are. ``closed`` is that of ``dom.parse``."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(lambda batches: _extract(batches, closed), _ROW_SQL)


def of_kind(found: DataFrame, element: str, *columns: str) -> DataFrame:
    return found.where(F.col("element") == element).select("page_id", "ord", *columns)


def metadata(found: DataFrame) -> DataFrame:
    """Title, language, and a map of the metas by lower-cased name, of several the last."""
    doc = found.where("element = 'document'").select("page_id", F.col("text").alias("title"), F.col("attrs")["lang"].alias("lang"))
    last = found.where("element = 'meta'").groupBy("page_id", F.col("attrs")["key"].alias("key")).agg(F.max_by("text", "ord").alias("value"))
    metas = last.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("extra"))
    return doc.join(metas, "page_id", "left")


def headings(found: DataFrame) -> DataFrame:
    """Headings with the path of the heading that they are under."""
    from ..operators.sequence import nearest_smaller

    return nearest_smaller(of_kind(found, "heading", "text", "level", "dom_path"), ["page_id"], ["ord"], "level", "dom_path", name="parent_path")


def questions(found: DataFrame) -> DataFrame:
    """Questions of ordered lists that have a hint, then numbered ones of prose; the first of those with equal normalised texts."""
    items = found.where("element = 'item'").where(classify.has_question_hint(F.col("text"))).select("page_id", F.lit(0).alias("rank"), "ord", "dom_path", "text", "list_index")
    prose = found.where("element = 'text'").where(F.col("tag").isin("p", "li", "div", "td") & classify.looks_like_question(F.col("text"))).select("page_id", F.lit(1).alias("rank"), "ord", "dom_path", "text", F.lit(None).cast("int").alias("list_index"))
    both = items.union(prose).withColumn("q", classify.parse_question(F.col("text")))
    both = both.withColumn("body", F.coalesce(F.nullif(F.col("q.text"), F.lit("")), "text")).withColumn("norm", text.normalize(F.col("body")))
    first = both.withColumn("__n", F.row_number().over(W.partitionBy("page_id", "norm").orderBy("rank", "ord"))).where("__n = 1")
    return first.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("rank", "ord")).alias("ord"), "dom_path", F.coalesce("q.number", F.col("list_index").cast("string")).alias("number"), F.col("body").alias("text"), "norm", F.col("q.number").isNotNull().alias("numbering_explicit"), F.coalesce("q.options", F.array().cast("array<string>")).alias("options"))


def watermarks(found: DataFrame, opacity: Column | None = None, limit: int = 20) -> DataFrame:
    """Texts with a hint of a watermark, or fainter than 0.35 where their opacity is known; the first ``limit`` of a page."""
    hint = classify.watermark_hint(text.normalize(F.col("text"), keep_punctuation=True))
    faint = F.coalesce((opacity > 0) & (opacity < 0.35), F.lit(False)) if opacity is not None else F.lit(False)
    marked = found.where("element = 'text'").withColumn("hint", hint).where(F.col("hint").isNotNull() | faint)
    first = marked.withColumn("__n", F.row_number().over(W.partitionBy("page_id").orderBy("ord"))).where(F.col("__n") <= limit)
    return first.select("page_id", "ord", "dom_path", F.substring("text", 1, 120).alias("text"), F.when(F.col("hint").isNotNull(), "hint").otherwise("very-low-opacity").alias("reason"), F.when(F.col("hint").isNotNull(), 0.9).otherwise(0.6).alias("confidence"))


def hidden_panels(found: DataFrame, least: int = 200) -> DataFrame:
    """The outermost hidden containers with ``least`` characters of text: of the hidden texts' paths those under no other."""
    hidden = found.where("element = 'text' and not visible").select("page_id", F.explode(_ancestors(F.col("dom_path"))).alias("dom_path"), F.length("text").alias("n"))
    big = hidden.groupBy("page_id", "dom_path").agg(F.sum("n").alias("n_chars"))
    shown = found.where("element = 'text' and visible").select("page_id", F.explode(_ancestors(F.col("dom_path"))).alias("dom_path")).distinct()
    own = big.where(F.col("n_chars") >= least).join(shown, ["page_id", "dom_path"], "left_anti")
    above = own.select("page_id", "dom_path", F.explode(F.slice(_ancestors(F.col("dom_path")), F.lit(1), F.size(_ancestors(F.col("dom_path"))) - 1)).alias("up"))
    nested = above.join(own.select("page_id", F.col("dom_path").alias("up")), ["page_id", "up"], "left_semi").select("page_id", "dom_path").distinct()
    return own.join(nested, ["page_id", "dom_path"], "left_anti")


def _ancestors(path: Column) -> Column:
    parts = F.split(path, " > ")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), " > "))


def script_built(pages: DataFrame, rendered: str, static: str) -> Column:
    """Whether a page's text comes from its scripts: over 500 characters rendered, under half of them in the markup."""
    return (F.length(rendered) > 500) & (F.length(static) < 0.5 * F.length(rendered))


def dom_tree(found: DataFrame, most: int = 12) -> DataFrame:
    """The tree as an adjacency list of the text blocks and headings: path, parent path, depth up to ``most`` and length of the own text."""
    parts = F.split("dom_path", " > ")
    rows = found.where("element = 'text'").withColumn("depth", F.size(parts) - 1)
    return rows.where(F.col("depth") <= most).select("page_id", "ord", "tag", "dom_path", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " > ").alias("parent_path"), "depth", F.length("text").alias("text_length"), "visible")


def section_profiles(found: DataFrame) -> DataFrame:
    """Panels of a page: the elements that in-page links name, here the whole body: heading levels, images, tables, items and question numbers."""
    from ..operators.aggregates import section_profile

    number = F.regexp_extract("text", r"^\s*(?:Q\s*\.?\s*)?(\d{1,3})\s*[.)]", 1).try_cast("long")
    rows = found.where(F.col("element").isin("heading", "image", "table", "text")).select(
        "page_id", F.struct("element", "ord").alias("at"), F.when(F.col("element") == "image", "img").when(F.col("element") == "table", "table").when((F.col("element") == "text") & (F.col("tag") == "li"), "li").alias("tag"),
        F.when(F.col("element") == "heading", F.col("level")).alias("level"), F.when((F.col("element") == "text") & F.col("tag").isin("li", "p"), number).alias("number"),
    )
    return section_profile(rows, ["page_id"], "at")


def with_geometry(found: DataFrame, geometry: DataFrame) -> DataFrame:
    """Elements with what a renderer measured (page_id, dom_path, box, shown, opacity, font_size, font_weight), by path; where it is known its visibility holds, and weights from 600 on are bold."""
    g = geometry.select("page_id", "dom_path", "box", "shown", "opacity", "font_size", F.col("font_weight").cast("string").alias("font_weight"))
    rows = found.join(g, ["page_id", "dom_path"], "left")
    bold = F.col("font_weight").isin("bold", "bolder") | F.coalesce(F.col("font_weight").try_cast("int") >= 600, F.lit(False))
    return rows.withColumns({"visible": F.coalesce("shown", "visible"), "bold": F.coalesce(bold, F.lit(False))}).drop("shown", "font_weight")
