"""Issue rules (§2.12) over two analysed sides of documents, and their assembly: union, keep best, suppression, order.

Every rule returns rows of ``COLUMNS``. Inputs are tables of elements, keyed by
``doc``; ``ord`` is the order in a side. Blocks have text, norm, kind, page and,
in the rendition, dom_path; matches come from ``matching``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, geometry
from ..functions.similarity import best_fuzzy_similarity
from ..functions.text import clip
from . import aggregates, matching, sequence

#: Order of severities in the review queue.
SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
#: Order in which the rules' lists are joined.
LISTS = ("images", "text", "structure", "questions", "order", "layout", "watermarks")
#: Thresholds of the one-to-one matches.
TEXT, IMAGE, STRUCTURE, QUESTION = 0.75, 0.75, 0.80, 0.72
COLUMNS = ("doc", "list", "seq", "type", "severity", "confidence", "page", "dom_path", "pdf_ord", "html_ord", "description", "text", "action", "payload", "target", "auto_fixable")


def issue(df: DataFrame, list_: str, seq: Column, type_: str, severity: Column | str, confidence: Column | float, description: Column, **more: Column | str | bool) -> DataFrame:
    """Rows of ``COLUMNS``; what isn't given is null, and not fixable by itself."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    empty = {"page": "int", "dom_path": "string", "pdf_ord": "long", "html_ord": "long", "text": "string", "action": "string", "payload": "map<string,string>", "target": "string", "auto_fixable": "boolean"}
    given = {k: lit(more.get(k, False if k == "auto_fixable" else None)).cast(t) for k, t in empty.items()}
    return df.select(
        "doc", F.lit(LISTS.index(list_)).alias("list"), seq.cast("long").alias("seq"), F.lit(type_).alias("type"), lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence"),
        *(given[k].alias(k) for k in ("page", "dom_path", "pdf_ord", "html_ord")), description.alias("description"), *(given[k].alias(k) for k in ("text", "action", "payload", "target", "auto_fixable")),
    )


def payload(**pairs: Column | str) -> Column:
    """A map of the pairs whose value isn't null."""
    made = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def content(blocks: DataFrame) -> DataFrame:
    """P1 of a side's blocks."""
    return blocks.where(classify.content_block(F.col("text"), F.col("kind"), F.col("visible")))


def text_anchors(pdf: DataFrame, html: DataFrame, matches: DataFrame) -> DataFrame:
    """Every authoritative block with ``anchor``, the path of the nearest matched one before it, else after it, and ``position``."""
    at = matches.join(html.select("doc", F.col("ord").alias("t"), "dom_path"), ["doc", "t"]).select("doc", F.col("s").alias("ord"), F.col("dom_path").alias("own"))
    w = W.partitionBy("doc").orderBy("ord")
    rows = pdf.join(at, ["doc", "ord"], "left")
    before = F.last("own", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("own", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return rows.withColumns({"anchor": F.coalesce(before, after), "position": F.when(before.isNull() & after.isNotNull(), "before").otherwise("after")}).drop("own")


def text_rules(pdf: DataFrame, html: DataFrame, matches: DataFrame) -> DataFrame:
    """MISSING_TEXT, EXTRA_TEXT, TEXT_MISMATCH of content blocks and their matches."""
    missing = matching.unmatched(text_anchors(pdf, html, matches), matches, ["doc"], "s")
    here = html.groupBy("doc").agg(F.collect_list("norm").alias("__norms"))  # one document's blocks
    missing = missing.join(here, "doc", "left").withColumn("best", best_fuzzy_similarity(F.col("norm"), F.col("__norms"))).drop("__norms")
    missing = missing.withColumn("heavy", classify.symbol_heavy(F.col("text")))
    sure = F.round(F.least(F.lit(0.97), 0.62 + (TEXT - F.coalesce("best", F.lit(0.0)))), 3)
    a = issue(
        missing, "text", F.col("ord"), "MISSING_TEXT", F.when(~F.col("heavy") & (classify.word_count(F.col("text")) > 12), "HIGH").otherwise("MEDIUM"), F.when(F.col("heavy"), F.least(sure, F.lit(0.80))).otherwise(sure),
        F.concat(F.lit("Text of the source is missing: "), clip(F.col("text"))), page=F.col("page"), pdf_ord=F.col("ord"), text=F.col("text"), action="INSERT_TEXT", target=F.col("anchor"), auto_fixable=F.col("anchor").isNotNull(),
        payload=payload(text=F.col("text"), tag=F.when(F.col("kind") == "heading", "h2").otherwise("p"), position=F.col("position")),
    )
    extra = matching.unmatched(html, matches, ["doc"], "t")
    b = issue(extra, "text", F.lit(1 << 20) + F.col("ord"), "EXTRA_TEXT", "LOW", 0.55, F.concat(F.lit("Text without a counterpart: "), clip(F.col("text"))), dom_path=F.col("dom_path"), html_ord=F.col("ord"), text=F.col("text"))
    pairs = matches.where("score < 0.95").join(pdf.select("doc", F.col("ord").alias("s"), "page"), ["doc", "s"]).join(html.select("doc", F.col("ord").alias("t"), "dom_path", "text"), ["doc", "t"])
    c = issue(
        pairs, "text", F.lit(1 << 21) + F.col("s"), "TEXT_MISMATCH", F.when(F.col("score") < 0.85, "MEDIUM").otherwise("LOW"), F.round(F.least(F.lit(0.9), 1.35 - F.col("score")), 3),
        F.format_string("Wording differs (similarity %.2f)", "score"), page=F.col("page"), dom_path=F.col("dom_path"), pdf_ord=F.col("s"), html_ord=F.col("t"), text=F.col("text"),
    )
    return a.union(b).union(c)


def extraction_warning(pdf: DataFrame, share: float = 0.4) -> DataFrame:
    """EXTRACTION_WARNING of the documents whose text can't be read."""
    bad = aggregates.reliable_text(pdf, ["doc"], "kind", share).where("not reliable")
    return issue(bad, "text", F.lit(0), "EXTRACTION_WARNING", "MEDIUM", 0.99, F.concat(F.col("n_unreadable").cast("string"), F.lit(" blocks can't be decoded")))


def structure_rules(pdf: DataFrame, html: DataFrame, matches: DataFrame, anchors: DataFrame) -> DataFrame:
    """Heading rules over headings (doc, ord, title, level, page; dom_path in the rendition). ``anchors``: doc, page, ord and dom_path of matched text."""
    pairs = matches.join(pdf.select("doc", F.col("ord").alias("s"), "title", "level", "page"), ["doc", "s"]).join(html.select("doc", F.col("ord").alias("t"), F.col("level").alias("html_level"), "dom_path"), ["doc", "t"])
    wrong = pairs.where("level <> html_level")
    a = issue(wrong, "structure", F.col("s"), "HEADING_LEVEL_MISMATCH", "MEDIUM", 0.96, F.format_string("%s: level %d in the source, %d here", clip(F.col("title"), 60), "level", "html_level"),
              page=F.col("page"), dom_path=F.col("dom_path"), action="FIX_HEADING_LEVEL", target=F.col("dom_path"), auto_fixable=True, payload=payload(level=F.col("level")))
    missing = matching.unmatched(pdf, matches, ["doc"], "s")
    near = missing.select("doc", "ord", "page").join(anchors.select("doc", F.col("page").alias("__page"), F.col("ord").alias("__ord"), F.col("dom_path").alias("anchor")), "doc").where(F.col("__page") <= F.col("page"))
    near = near.groupBy("doc", "ord").agg(F.max_by("anchor", F.struct("__page", "__ord")).alias("anchor"))
    missing = missing.join(near, ["doc", "ord"], "left")
    b = issue(missing, "structure", F.lit(1 << 20) + F.col("ord"), "MISSING_SECTION", "HIGH", 0.9, F.concat(F.lit("Section is missing: "), clip(F.col("title"), 70)), page=F.col("page"), pdf_ord=F.col("ord"), text=F.col("title"),
              action="INSERT_SECTION", target=F.col("anchor"), auto_fixable=F.col("anchor").isNotNull(), payload=payload(title=F.col("title"), level=F.col("level"), position="after"))
    extra = matching.unmatched(html, matches, ["doc"], "t")
    c = issue(extra, "structure", F.lit(1 << 21) + F.col("ord"), "STRUCTURE_MISMATCH", "LOW", 0.6, F.concat(F.lit("Heading without a counterpart: "), clip(F.col("title"), 70)), dom_path=F.col("dom_path"), html_ord=F.col("ord"))
    jumps = sequence.level_jumps(html, ["doc"], ["ord"], "level").join(wrong.select("doc", "dom_path"), ["doc", "dom_path"], "left_anti")
    d = issue(jumps, "structure", F.lit(1 << 22) + F.col("ord"), "HEADING_LEVEL_MISMATCH", "LOW", 0.88, F.format_string("Level jumps from %d to %d", "previous_level", "level"), dom_path=F.col("dom_path"), action="FIX_HEADING_LEVEL", target=F.col("dom_path"), payload=payload(level=F.col("previous_level") + 1))
    return reduce(DataFrame.union, (a, b, c, d))


def order_rules(sections: DataFrame, blocks: DataFrame, cap: int = 25) -> DataFrame:
    """ORDER_MISMATCH of matched sections and of matched blocks outside moved ones; both report ``cap`` together.

    ``sections``: doc, s, t, title, page, dom_path; ``blocks``: doc, s, t,
    dom_path, section_path (of the heading that a block is under) and kind.
    """
    moved = sequence.out_of_order(sections, ["doc"], "s", "t", "dom_path").withColumnRenamed("t", "html_ord").checkpoint()
    a = issue(moved.where("expected_after is not null"), "order", F.col("rank"), "ORDER_MISMATCH", "MEDIUM", 0.9, F.lit("Section is out of sequence"), dom_path=F.col("dom_path"), html_ord=F.col("html_ord"), action="REORDER_ELEMENT", target=F.col("dom_path"), auto_fixable=True,
              payload=payload(scope="section", after_scope="section", after_dom_path=F.col("expected_after")))
    rest = blocks.where("kind <> 'heading'").join(moved.select("doc", F.col("dom_path").alias("section_path")), ["doc", "section_path"], "left_anti")
    single = sequence.out_of_order(rest, ["doc"], "s", "t", "dom_path")
    taken = moved.groupBy("doc").agg(F.count("*").alias("taken"))
    numbered = single.join(taken, "doc", "left").withColumn("__n", F.row_number().over(W.partitionBy("doc").orderBy("rank"))).where(F.col("__n") <= F.greatest(F.lit(0), F.lit(cap) - F.coalesce("taken", F.lit(0))))
    b = issue(numbered, "order", F.lit(1 << 20) + F.col("rank"), "ORDER_MISMATCH", "MEDIUM", 0.88, F.lit("Element is out of sequence"), dom_path=F.col("dom_path"), html_ord=F.col("t"), action="REORDER_ELEMENT", target=F.col("dom_path"), auto_fixable=F.col("expected_after").isNotNull(),
              payload=payload(after_dom_path=F.col("expected_after")))
    return a.union(b)


def question_rules(pdf: DataFrame, html: DataFrame, matches: DataFrame) -> DataFrame:
    """Rules of questions (doc, ord, number, text, norm, numbering_explicit, answer; page or dom_path)."""
    in_list = F.contains("dom_path", F.lit(" > li:"))
    anchor = html.groupBy("doc").agg(F.min_by(F.when(in_list, F.regexp_replace("dom_path", " > [^>]*$", "")), F.when(in_list, F.col("ord"))).alias("list_path"), F.max_by("dom_path", "ord").alias("last_path"))
    missing = matching.unmatched(pdf, matches, ["doc"], "s").join(anchor, "doc", "left").withColumn("anchor", F.coalesce("list_path", "last_path"))
    a = issue(missing, "questions", F.col("ord"), "MISSING_QUESTION", "HIGH", F.when(F.col("anchor").isNotNull(), 0.95).otherwise(0.88), F.concat(F.lit("Exercise is missing: "), clip(F.col("text"), 90)), page=F.col("page"), pdf_ord=F.col("ord"), text=F.col("text"),
              action="INSERT_TEXT", target=F.col("anchor"), auto_fixable=F.col("anchor").isNotNull(), payload=payload(text=F.col("text"), tag="li", position="append"))
    again = sequence.later_occurrences(html, F.concat_ws("\n", F.col("doc").cast("string"), "norm"), F.col("ord"), "dom_path")
    b = issue(again, "questions", F.lit(1 << 20) + F.col("ord"), "DUPLICATE_QUESTION", "MEDIUM", 0.93, F.concat(F.lit("Exercise is repeated; first at "), F.coalesce("first_id", F.lit(""))), dom_path=F.col("dom_path"), html_ord=F.col("ord"))
    p = pdf.select("doc", F.col("ord").alias("s"), F.col("number").alias("a"), F.col("numbering_explicit").alias("ea"), F.col("answer").alias("xa"))
    h = html.select("doc", F.col("ord").alias("t"), "dom_path", F.col("number").alias("b"), F.col("numbering_explicit").alias("eb"), F.col("answer").alias("xb"))
    pairs = matches.join(p, ["doc", "s"]).join(h, ["doc", "t"])
    c = issue(pairs.where("score < 0.9"), "questions", F.lit(1 << 21) + F.col("s"), "QUESTION_MISMATCH", "MEDIUM", F.round(F.least(F.lit(0.9), 1.05 - F.col("score")), 3), F.lit("Exercise wording differs"), dom_path=F.col("dom_path"), html_ord=F.col("t"))
    d = issue(pairs.where("ea and eb and a <> b"), "questions", F.lit((1 << 21) + (1 << 19)) + F.col("s"), "QUESTION_MISMATCH", "LOW", 0.85, F.concat(F.lit("Numbered "), F.col("b"), F.lit(" instead of "), F.col("a")), dom_path=F.col("dom_path"), html_ord=F.col("t"))
    e = issue(pairs.where("coalesce(xa, '') <> '' and coalesce(xb, '') = ''"), "questions", F.lit(1 << 22) + F.col("s"), "MISSING_ANSWER", "MEDIUM", 0.85, F.lit("The source has an answer"), dom_path=F.col("dom_path"), html_ord=F.col("t"))
    return reduce(DataFrame.union, (a, b, c, d, e))


def image_rules(pdf: DataFrame, html: DataFrame, matches: DataFrame, twins: DataFrame, context: DataFrame, anchors: DataFrame, reliable: DataFrame) -> DataFrame:
    """Image rules. Images: doc, ord, caption, page and box, or dom_path, alt, src and error.

    ``twins`` (J4) and ``context`` (J3) pair unmatched images (doc, s, t);
    ``anchors``: doc, s, anchor, position; ``reliable``: doc, reliable. A figure
    that its context pairs isn't reported as missing too.
    """
    pairs = matches.join(pdf.select("doc", F.col("ord").alias("s"), "caption", "page"), ["doc", "s"]).join(html.select("doc", F.col("ord").alias("t"), "dom_path", "alt"), ["doc", "t"])
    bare = pairs.where("coalesce(caption, '') <> '' and trim(coalesce(alt, '')) = ''")
    a = issue(bare, "images", F.col("s"), "MISSING_ALT_TEXT", "LOW", 0.97, F.lit("Image has no alternative text"), page=F.col("page"), dom_path=F.col("dom_path"), pdf_ord=F.col("s"), html_ord=F.col("t"), action="SET_ALT_TEXT", target=F.col("dom_path"), auto_fixable=True, payload=payload(alt=F.col("caption")))
    side = lambda m: m.select("doc", "s", "t").join(pdf.select("doc", F.col("ord").alias("s"), "caption", "page"), ["doc", "s"]).join(html.select("doc", F.col("ord").alias("t"), "dom_path", "alt"), ["doc", "t"])
    b = issue(side(twins), "images", F.lit(1 << 20) + F.col("s"), "IMAGE_MISMATCH", "HIGH", 0.95, F.lit("Another picture stands under this caption"), page=F.col("page"), dom_path=F.col("dom_path"), pdf_ord=F.col("s"), html_ord=F.col("t"), action="REPLACE_IMAGE", target=F.col("dom_path"), auto_fixable=True, payload=payload(alt=F.col("caption")))
    c = issue(side(context), "images", F.lit(1 << 22) + F.col("s"), "IMAGE_MISMATCH", "HIGH", 0.92, F.lit("A broken placeholder stands where the figure belongs"), page=F.col("page"), dom_path=F.col("dom_path"), pdf_ord=F.col("s"), html_ord=F.col("t"), action="REPLACE_IMAGE", target=F.col("dom_path"), auto_fixable=True,
              payload=payload(alt=F.coalesce(F.nullif("alt", F.lit("")), "caption", F.lit("")), broken_replacement="true"))
    paired = reduce(DataFrame.union, (m.select("doc", "s", "t") for m in (matches, twins, context)))
    missing = pdf.join(paired.select("doc", F.col("s").alias("ord")), ["doc", "ord"], "left_anti").join(anchors.select("doc", F.col("s").alias("ord"), "anchor", "position"), ["doc", "ord"], "left").join(reliable.select("doc", "reliable"), "doc", "left")
    weak = ~F.coalesce("reliable", F.lit(True))
    d = issue(missing, "images", F.lit(1 << 21) + F.col("ord"), "MISSING_IMAGE", F.when(weak, "MEDIUM").otherwise("HIGH"), F.when(weak, 0.6).when(F.col("anchor").isNotNull(), 0.96).otherwise(0.85), F.concat(F.lit("Figure is missing: "), clip(F.col("caption"), 60)), page=F.col("page"), pdf_ord=F.col("ord"), text=F.col("caption"),
              action="INSERT_IMAGE", target=F.col("anchor"), auto_fixable=F.col("anchor").isNotNull(), payload=payload(alt=F.coalesce("caption", F.lit("")), caption=F.col("caption"), position=F.col("position")))
    extra = html.join(paired.select("doc", F.col("t").alias("ord")), ["doc", "ord"], "left_anti")
    e = issue(extra.where("error is not null"), "images", F.lit(1 << 23) + F.col("ord"), "BROKEN_IMAGE_SRC", "HIGH", 0.98, F.concat(F.lit("Image can't be loaded: "), F.col("error")), dom_path=F.col("dom_path"), html_ord=F.col("ord"), action="FIX_IMAGE_SRC", target=F.col("dom_path"))
    f = issue(extra.where("error is null"), "images", F.lit(1 << 23) + F.col("ord"), "EXTRA_IMAGE", "LOW", 0.6, F.lit("Image without a counterpart"), dom_path=F.col("dom_path"), html_ord=F.col("ord"))
    return reduce(DataFrame.union, (a, b, c, d, e, f))


def layout_rules(pairs: DataFrame) -> DataFrame:
    """ALIGNMENT and LAYOUT_MISMATCH of matched images: doc, s, page, dom_path, a and b (boxes), and the pages' sizes a_width, a_height, b_width, b_height."""
    mine, here = geometry.horizontal_alignment(F.col("a"), F.col("a_width")), geometry.horizontal_alignment(F.col("b"), F.col("b_width"))
    known = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumns({"mine": mine, "here": here, "gap": geometry.width_gap(F.col("a"), F.col("b"), F.col("a_width"), F.col("b_width"))})
    a = issue(known.where("mine <> here and mine <> 'unknown' and here <> 'unknown'"), "layout", F.col("s"), "ALIGNMENT", "LOW", 0.9, F.concat(F.col("here"), F.lit(" instead of "), F.col("mine")), page=F.col("page"), dom_path=F.col("dom_path"), action="ADJUST_ALIGNMENT", target=F.col("dom_path"), auto_fixable=True, payload=payload(align=F.col("mine")))
    b = issue(known.where("gap > 0.35"), "layout", F.lit(1 << 20) + F.col("s"), "LAYOUT_MISMATCH", "LOW", 0.75, F.lit("Share of the page's width differs"), page=F.col("page"), dom_path=F.col("dom_path"))
    return a.union(b)


def watermark_rules(candidates: DataFrame, pdf: DataFrame) -> DataFrame:
    """WATERMARK of candidates (doc, ord, dom_path, text, norm, reason); those that the source has too are less sure and not fixed by themselves."""
    there = matching.similar_exists(candidates, pdf, ["doc"], "ord", 0.9).withColumn("__in", F.lit(True))
    rows = candidates.join(there, ["doc", "ord"], "left").withColumn("in_pdf", F.coalesce("__in", F.lit(False)))
    sure = F.when((F.col("reason") == "hint") & ~F.col("in_pdf"), 0.96).otherwise(0.7)
    return issue(rows, "watermarks", F.col("ord"), "WATERMARK", "MEDIUM", sure, F.concat(F.lit("Watermark: "), clip(F.col("text"), 70)), dom_path=F.col("dom_path"), html_ord=F.col("ord"), text=F.col("text"), action="REMOVE_WATERMARK", target=F.col("dom_path"), auto_fixable=~F.col("in_pdf"))


def deduplicated(issues: DataFrame, parity: bool = False) -> DataFrame:
    """A16 by type, place and elements. With ``parity`` missing questions and sections are told apart by page alone, so that several of a page are one."""
    pdf = F.when(F.col("type").isin("MISSING_QUESTION", "MISSING_SECTION"), None).otherwise(F.col("pdf_ord")) if parity else F.col("pdf_ord")
    return aggregates.keep_best(issues.withColumn("__pdf", pdf), ["doc", "type", "dom_path", "__pdf", "html_ord", "page"], "confidence", ["list", "seq"]).drop("__pdf")


def suppressed(issues: DataFrame, norm: Column) -> DataFrame:
    """Without missing text that a missing question or image covers, and extra text at a watermark's path; ``norm`` normalises the text."""
    rows = issues.withColumn("norm", F.coalesce(norm, F.lit(""))).checkpoint()
    specific = rows.where(F.col("type").isin("MISSING_QUESTION", "MISSING_IMAGE"))
    covered = matching.similar_exists(rows.where("type = 'MISSING_TEXT'").select("doc", "norm", F.struct("list", "seq").alias("__at")), specific, ["doc"], "__at", 0.85)
    marks = rows.where("type = 'WATERMARK'").select("doc", "dom_path").distinct()
    left = rows.withColumn("__at", F.struct("list", "seq"))
    text = left.where("type = 'MISSING_TEXT'").join(covered, ["doc", "__at"], "left_anti")
    extra = left.where("type = 'EXTRA_TEXT'").join(marks, ["doc", "dom_path"], "left_anti")
    other = left.where(~F.col("type").isin("MISSING_TEXT", "EXTRA_TEXT"))
    return text.select(*issues.columns).unionByName(extra.select(*issues.columns)).unionByName(other.select(*issues.columns))


def ranked(issues: DataFrame) -> DataFrame:
    """O1: ``place`` from 1 in a document by severity, confidence and the order of the rules."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, n) for s, n in SEVERITY_RANK.items()), F.lit(len(SEVERITY_RANK)))
    return issues.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy(rank, F.desc("confidence"), "list", "seq")))


def assembled(lists: list[DataFrame], norm: Column, parity: bool = False) -> DataFrame:
    """U1 and the rest: all rules' rows joined, deduplicated, suppressed and ranked."""
    return ranked(suppressed(deduplicated(reduce(DataFrame.unionByName, lists), parity), norm))
