"""Printed pages (S3, W8, W11, A12, A14, A15, J8, P9): from extracted lines, words and shapes to blocks, furniture, captions and figures.

Pages come as tables that an extractor wrote: ``lines`` (doc, page, top, bottom,
x0, x1, size, font, text), ``words`` and ``shapes`` (doc, page, box), ``pages``
(doc, page, width, height).
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import normalize, strip_cid_tokens
from . import aggregates, sequence

Box = tuple[float, float, float, float]
#: Halo within which shapes belong together, in points.
HALO = 12.0
#: A figure's least share of its page.
LEAST_FIGURE = 0.004


def text_blocks(lines: DataFrame) -> DataFrame:
    """Paragraphs of lines (doc, page, ord, text, box, size, font, bold, kind), ``ord`` from 1 in the document."""
    rows = lines.withColumn("__line", F.round("top", 1))
    keys, order = ["doc", "page"], ["__line", "x0"]
    rows = rows.withColumn("__break", F.coalesce(sequence.paragraph_breaks("top", "bottom", "x0", "size", keys, order), F.lit(True)))
    rows = rows.withColumn("block", sequence.sessions(F.col("__break"), keys, order)).withColumn("__at", F.struct("__line", "x0"))
    blocks = rows.groupBy("doc", "page", "block").agg(
        aggregates.joined_text("text", "__at", " ").alias("text"), aggregates.envelope("x0", "top", "x1", "bottom").alias("box"), F.round(F.avg("size"), 2).alias("size"), F.mode("font").alias("font"),
    ).where("text <> ''")
    blocks = blocks.withColumn("ord", F.row_number().over(W.partitionBy("doc").orderBy("page", "block"))).drop("block")
    blocks = blocks.withColumns({"bold": F.coalesce(F.col("font").rlike("(?i)bold|black|heavy|semibold"), F.lit(False)), "bad": classify.unreadable(F.col("text"))})
    body = aggregates.weighted_mode(blocks.where("not bad"), ["doc"], F.round("size", 1), F.length("text"), F.col("ord"), "body_size").drop("weight")
    blocks = blocks.join(body, "doc", "left")
    kind = classify.block_kind(F.col("text"), classify.heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size")))
    return blocks.withColumn("kind", F.when(F.col("bad"), "unreadable").otherwise(kind)).withColumn("text", F.when(F.col("bad"), F.col("text")).otherwise(strip_cid_tokens(F.col("text")))).drop("bad", "body_size")


def furniture(blocks: DataFrame, pages: DataFrame, margin: float = 0.12) -> DataFrame:
    """Blocks with ``kind`` furniture where their text repeats on three pages and 40 % of them, is a page number or a print artifact, and stands in the margins wherever it occurs."""
    rows = blocks.withColumn("norm", normalize(F.col("text"))).join(pages.select("doc", "page", F.col("height").alias("__h")), ["doc", "page"], "left")
    near = (F.col("box.top") <= F.col("__h") * margin) | (F.col("box.bottom") >= F.col("__h") * (1 - margin))
    n = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    found = rows.where("norm <> ''").groupBy("doc", "norm").agg(F.countDistinct("page").alias("on"), aggregates.all_in_band(near).alias("edge"), F.bool_or(classify.print_artifact(F.col("text"))).alias("artifact")).join(n, "doc", "left")
    often = (F.col("on") >= 3) & (F.col("on") >= 0.4 * F.col("pages"))
    marked = found.where(F.col("edge") & (often | F.col("norm").rlike(r"^\d{1,4}$") | F.col("artifact"))).select("doc", "norm", F.lit(True).alias("__f"))
    return rows.join(marked, ["doc", "norm"], "left").withColumn("kind", F.when(F.col("__f"), "furniture").otherwise(F.col("kind"))).drop("norm", "__h", "__f")


def repeated_watermarks(blocks: DataFrame, limit: int = 20) -> DataFrame:
    """Texts with a hint, or on three and 80 % of the pages, the surest first."""
    rows = blocks.withColumn("norm", normalize(F.col("text"))).where(F.length("norm").between(3, 80))
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    found = rows.groupBy("doc", "norm").agg(F.countDistinct("page").alias("n")).join(pages, "doc").withColumn("hint", classify.watermark_hint(F.col("norm")))
    often = (F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 0.8)))
    sure = F.when(F.col("hint").isNotNull(), 0.9).otherwise(0.6)
    kept = found.where(F.col("hint").isNotNull() | often).withColumn("confidence", sure)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("confidence"), "norm"))).where(F.col("place") <= limit)


def captions(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """Figures (doc, s, page, box) with the text of the nearest caption that begins from 4 points above their end to 60 below it."""
    f = figures.select("doc", "page", "s", F.col("box.bottom").alias("end"))
    c = blocks.where("kind = 'caption'").select("doc", "page", F.col("box.top").alias("top"), F.struct("ord", "text").alias("said"))
    near = sequence.nearest_within(f, c, ["doc", "page"], "end", "top", -4.0, 60.0, "said", 64.0)
    return figures.join(near.select("doc", "s", F.col("nearest.text").alias("caption")), ["doc", "s"], "left")


def _around(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def _shared(a0: float, a1: float, b0: float, b1: float) -> float:
    return min(a1, b1) - max(a0, b0)


def _strips(shapes: list[Box], width: float, height: float) -> list[list[Box]]:
    """Rows and columns of five small shapes or more that span a good part of the page; columns in its margins are ornaments."""
    small = [b for b in shapes if b[2] - b[0] <= 60 and b[3] - b[1] <= 30]
    out = []
    for axis, least in ((1, 0.30 * width), (0, 0.28 * height)):
        lanes: dict[int, list[Box]] = defaultdict(list)
        for b in small:
            lanes[round((b[axis] + b[axis + 2]) / 2 / 16)].append(b)
        for lane in lanes.values():
            x0, top, x1, bottom = _around(lane)
            along = x1 - x0 if axis else bottom - top
            if len(lane) >= 5 and along >= least and (axis or not (x1 < 0.18 * width or x0 > 0.82 * width)):
                out.append(lane)
    return out


def figure_boxes(shapes: list[Box], words: list[tuple[Box, str]], width: float, height: float) -> list[Box]:
    """The figures that a page's shapes draw.

    Strips come first; every shape joins the first group whose box, with a halo,
    it touches. Groups of three shapes or more are joined down the page where
    they are 30 points apart at most and share half of the narrower one's width,
    then along it where they share half of the lower one's height and are from
    -10 to 60 points apart. Strips and joined groups take in the labels near
    them; no word stays cut, or the figure is given up.
    """
    usable = []
    for x0, top, x1, bottom in shapes:
        x0, x1 = (x0 - 1, x1 + 1) if x1 - x0 < 2 else (x0, x1)
        top, bottom = (top - 1, bottom + 1) if bottom - top < 2 else (top, bottom)
        b = (min(max(x0, 0.0), width), min(max(top, 0.0), height), min(max(x1, 0.0), width), min(max(bottom, 0.0), height))
        rule = b[3] - b[1] < 4 and b[2] - b[0] > 0.5 * width
        border = b[2] - b[0] >= 0.97 * width and b[3] - b[1] >= 0.97 * height
        if not rule and not border:
            usable.append(b)
    if len(usable) < 3:
        return []
    groups = _strips(usable, width, height)
    n_strips, around = len(groups), [_around(g) for g in groups]
    for b in sorted(usable, key=lambda b: (b[1], b[0])):
        for i, g in enumerate(around):
            if _shared(g[0] - HALO, g[2] + HALO, b[0], b[2]) > 0 and _shared(g[1] - HALO, g[3] + HALO, b[1], b[3]) > 0:
                groups[i].append(b)
                around[i] = _around([g, b])
                break
        else:
            groups.append([b])
            around.append(b)
    # Box, groups in it, shapes in it, whether a strip is in it.
    parts = [(around[i], 1, len(g), i < n_strips) for i, g in enumerate(groups) if len(g) >= 3]

    def fused(a: tuple, b: tuple) -> tuple:
        return _around([a[0], b[0]]), a[1] + b[1], a[2] + b[2], a[3] or b[3]

    down: list[tuple] = []
    for p in sorted(parts, key=lambda p: p[0][1]):
        if down:
            a, b = down[-1][0], p[0]
            narrow = min(a[2] - a[0], b[2] - b[0])
            if b[1] - a[3] <= 30 and narrow > 0 and _shared(a[0], a[2], b[0], b[2]) >= 0.5 * narrow:
                down[-1] = fused(down[-1], p)
                continue
        down.append(p)
    along: list[tuple] = []
    for p in sorted(down, key=lambda p: p[0][0]):
        b = p[0]
        for i, (a, *_) in enumerate(along):
            low = min(a[3] - a[1], b[3] - b[1])
            if low > 0 and _shared(a[1], a[3], b[1], b[3]) >= 0.5 * low and -10 <= b[0] - a[2] <= 60:
                along[i] = fused(along[i], p)
                break
        else:
            along.append(p)
    labels = _labels(words)
    out = []
    for b, n, size, strip in along:
        if n > 1 or strip or (size >= 5 and b[3] > b[1] and b[2] - b[0] >= 6 * (b[3] - b[1])):
            b = _with_labels(b, labels, width, height)
        b = _with_whole_words(b, [w for w, _ in words], width, height)
        if b is not None and (b[2] - b[0]) * (b[3] - b[1]) >= LEAST_FIGURE * width * height:
            out.append(b)
    return out


def _labels(words: list[tuple[Box, str]]) -> list[Box]:
    """Lines of words with three or fewer real words."""
    rows: dict[int, list[tuple[Box, str]]] = defaultdict(list)
    for w in words:
        rows[round(w[0][1] / 4)].append(w)
    return [_around([b for b, _ in r]) for r in rows.values() if sum(sum(c.isalpha() for c in t) >= 2 for _, t in r) <= 3]


def _with_labels(b: Box, labels: list[Box], width: float, height: float) -> Box:
    for _ in range(2):  # a label can bring the next one within reach
        for line in labels:
            if b[1] - 26 <= (line[1] + line[3]) / 2 <= b[3] + 18:
                b = _around([b, line])
    return max(0.0, b[0] - 6), max(0.0, b[1] - 6), min(width, b[2] + 6), min(height, b[3] + 8)


def _with_whole_words(b: Box, words: list[Box], width: float, height: float, most: float = 110.0) -> Box | None:
    first = b
    for _ in range(4):
        before = b
        for w in words:
            dx, dy = _shared(b[0], b[2], w[0], w[2]), _shared(b[1], b[3], w[1], w[3])
            if dx > 0 and dy > 0 and 0.15 <= dx * dy / max(1e-6, (w[2] - w[0]) * (w[3] - w[1])) < 0.98:
                b = _around([b, w])
        if b == before:
            break
    if max(first[0] - b[0], first[1] - b[1], b[2] - first[2], b[3] - first[3]) > most:
        return None
    return max(0.0, b[0]), max(0.0, b[1]), min(width, b[2]), min(height, b[3])


_FIGURES = pa.schema([("doc", pa.int64()), ("page", pa.int32()), ("s", pa.int32()), ("box", pa.struct([(n, pa.float64()) for n in ("x0", "top", "x1", "bottom")]))])


def _page_figures(own: pa.Table, marks: pa.Table) -> pa.Table:
    rows = []
    if own.num_rows:
        doc, page, width, height = (own.column(c)[0].as_py() for c in ("doc", "page", "width", "height"))
        of = lambda b: (b["x0"], b["top"], b["x1"], b["bottom"])
        items = sorted(((k, of(b), t or "") for k, b, t in zip(*(marks.column(c).to_pylist() for c in ("kind", "box", "text")), strict=True) if b), key=lambda x: (x[0], x[1], x[2]))
        found = figure_boxes([b for k, b, _ in items if k == "shape"], [(b, t) for k, b, t in items if k == "word"], width, height)
        rows = [{"doc": doc, "page": page, "s": i, "box": dict(zip(("x0", "top", "x1", "bottom"), b, strict=True))} for i, b in enumerate(sorted(found, key=lambda b: (b[1], b[0])))]
    return pa.Table.from_pylist(rows, schema=_FIGURES)


def vector_figures(pages: DataFrame, shapes: DataFrame, words: DataFrame) -> DataFrame:
    """W11 page by page: doc, page, s and box of the figures; a group is one page."""
    own = pages.select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    marks = shapes.select("doc", "page", F.lit("shape").alias("kind"), "box", F.lit(None).cast("string").alias("text")).union(words.select("doc", "page", F.lit("word"), "box", "text"))
    marks = marks.select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), "kind", "box", "text")
    return own.groupBy("doc", "page").cogroup(marks.groupBy("doc", "page")).applyInArrow(_page_figures, "doc long, page int, s int, box struct<x0: double, top: double, x1: double, bottom: double>")
