"""Document builders (§2.14, X10, X30-X34, W14, W18, W19): sections, fragments and documents as strings, and reports on their structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import aggregates, sequence

#: Attribute and folder that mark a figure which a correction added.
ADDED_ATTRIBUTE, ADDED_FOLDER = "data-inserted", "/inserted/"


def escaped(text: Column) -> Column:
    """Text as it stands in markup."""
    out = F.coalesce(text, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def element(tag: Column | str, text: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("<"), tag, F.lit(">"), escaped(text), F.lit("</"), tag, F.lit(">"))


def table_markup(cells: Column) -> Column:
    """Rows of cells, the first as heads; empty cells hold a no-break space."""
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"<{tag}>&nbsp;</{tag}>")).otherwise(element(tag, c))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(cells, lambda r, i: F.when(i == 0, row(r, "th")).otherwise(row(r, "td"))), ""), F.lit("</table>"))


def figure_markup(src: Column, alt: Column, caption: Column) -> Column:
    """X33."""
    text = F.when(F.coalesce(caption, F.lit("")) != "", element("figcaption", caption)).otherwise(F.lit(""))
    return F.concat(F.lit('<figure><img src="'), escaped(src), F.lit('" alt="'), escaped(alt), F.lit('">'), text, F.lit("</figure>"))


def stack_markup(lines: Column) -> Column:
    """Displayed equations line by line."""
    return F.concat(F.lit("<div>"), F.array_join(F.transform(lines, lambda x: element("p", x)), ""), F.lit("</div>"))


def block_markup(kind: Column, level: Column, text: Column) -> Column:
    return (
        F.when(kind == "heading", element(F.concat(F.lit("h"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(2)))).cast("string")), text))
        .when(kind == "list_item", element("li", text)).when(kind == "caption", element("figcaption", text)).otherwise(element("p", text))
    )


def sections(blocks: DataFrame, top_level: int = 2) -> DataFrame:
    """Blocks (doc, ord, kind, level, text) with ``section``, which begins at headings up to a level, and its title; what comes before the first is the introduction."""
    starts = F.coalesce((F.col("kind") == "heading") & (F.col("level") <= top_level), F.lit(False))
    rows = blocks.withColumn("section", sequence.sessions(starts, ["doc"], ["ord"]))
    title = F.first(F.when(starts, F.col("text"))).over(W.partitionBy("doc", "section").orderBy("ord"))
    return rows.withColumn("section_title", F.coalesce(title, F.lit("Introduction")))


def document_title(blocks: DataFrame, titles: DataFrame | None, default: str) -> DataFrame:
    """The metadata's title, else the first heading, else the default."""
    first = blocks.groupBy("doc").agg(F.min_by(F.when(F.col("kind") == "heading", F.col("text")), F.when(F.col("kind") == "heading", F.col("ord"))).alias("first"))
    rows = first if titles is None else first.join(titles.select("doc", F.nullif(F.trim("title"), F.lit("")).alias("given")), "doc", "left")
    return rows.select("doc", F.coalesce(*([F.col("given")] if titles is not None else []), "first", F.lit(default)).alias("title"))


def rendered(blocks: DataFrame, default_title: str, titles: DataFrame | None = None) -> DataFrame:
    """A document (doc, title, n_sections, html) from its blocks: sections in order, fragments joined. A group is one section, then one document."""
    rows = sections(blocks).withColumn("markup", block_markup(F.col("kind"), F.col("level"), F.col("text")))
    part = rows.groupBy("doc", "section").agg(aggregates.joined_text("markup", "ord", "").alias("inner"))
    part = part.withColumn("markup", F.concat(F.lit('<section id="s'), F.col("section").cast("string"), F.lit('">'), "inner", F.lit("</section>")))
    whole = part.groupBy("doc").agg(F.count("*").alias("n_sections"), aggregates.joined_text("markup", "section", "").alias("body"))
    found = whole.join(document_title(blocks, titles, default_title), "doc")
    return found.select("doc", "title", "n_sections", F.concat(F.lit("<!DOCTYPE html><html><head>"), element("title", F.col("title")), F.lit("</head><body>"), "body", F.lit("</body></html>")).alias("html"))


def merged_into_panels(sections_: DataFrame, votes: DataFrame, panels: DataFrame) -> DataFrame:
    """Template merge: each section (doc, section, markup) in the panel that its votes (doc, section, panel, score, words) elect, else in the document's home panel, else in its first panel (doc, panel, ord)."""
    weight = F.col("score") * F.col("words")
    elected = aggregates.capped_votes(votes, ["doc", "section"], "panel", weight)
    home = aggregates.home_panel(votes, elected, ["doc"], "section", "panel", weight).select("doc", F.col("panel").alias("home"))
    first = panels.groupBy("doc").agg(F.min_by("panel", "ord").alias("first"))
    placed = sections_.join(elected.select("doc", "section", "panel"), ["doc", "section"], "left").join(home, "doc", "left").join(first, "doc", "left")
    placed = placed.withColumn("panel", F.coalesce("panel", "home", "first"))
    return placed.groupBy("doc", "panel").agg(F.count("*").alias("n_sections"), aggregates.joined_text("markup", "section", "").alias("markup"))


def added_figure(attrs: Column, src: Column) -> Column:
    """X34."""
    return F.coalesce(F.map_contains_key(attrs, F.lit(ADDED_ATTRIBUTE)), F.lit(False)) | F.coalesce(F.contains(src, F.lit(ADDED_FOLDER)), F.lit(False))


def hosted_source(payload_url: Column, cached: Column, content: Column, mime: Column) -> Column:
    """The payload's URL, the cached one, or the bytes themselves in a data URL."""
    inline = F.when(content.isNotNull(), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)))
    return F.coalesce(F.nullif(payload_url, F.lit("")), F.nullif(cached, F.lit("")), inline)


def missing_in_section(parts: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Unmatched parts (keys, text) but for short numbers and for up to three words without a letter."""
    left = parts.join(matched.select(*keys).distinct(), keys, "left_anti")
    short = (F.length("text") <= 3) & F.col("text").rlike(r"^\d+$")
    bare = ~F.col("text").rlike(r"\p{L}") & (F.size(F.split("text", r"\s+")) <= 3)
    return left.where(~(short | bare))


def page_images(images: DataFrame) -> DataFrame:
    """Figures of a page: neither tiny nor its background, without error, not decorative, and no source that repeats on three pages and 40 % of them. Columns: doc, page, pages, area, page_area, source_key, error, decorative."""
    sized = images.where((F.col("area") >= 0.001 * F.col("page_area")) & (F.col("area") < 0.80 * F.col("page_area")) & F.col("error").isNull() & ~F.col("decorative"))
    often = aggregates.repeated_keys(images, ["doc"], "source_key", "page", images.groupBy("doc").agg(F.max("pages").alias("pages")))
    return sized.join(often.select("doc", "source_key"), ["doc", "source_key"], "left_anti")


def anchors_for_images(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """Path and position for figures (doc, s, page, top, caption norm): before the matched block that says the caption by more than 0.9, the first of several; else after the lowest matched block of the page that ends two points below the top or higher. Blocks: doc, ord, page, bottom, norm, dom_path."""
    from ..functions.similarity import fuzzy_similarity

    b = blocks.select("doc", F.col("ord").alias("__o"), F.col("page").alias("__p"), "bottom", F.col("norm").alias("__n"), "dom_path")
    near = figures.join(b, "doc")
    said = near.where((F.col("norm") != "") & (fuzzy_similarity(F.col("norm"), F.col("__n")) > 0.9)).groupBy("doc", "s").agg(F.min_by("dom_path", "__o").alias("by_caption"))
    above = near.where((F.col("__p") == F.col("page")) & (F.col("bottom") <= F.col("top") + 2)).groupBy("doc", "s").agg(F.max_by("dom_path", "bottom").alias("by_place"))
    found = figures.select("doc", "s").join(said, ["doc", "s"], "left").join(above, ["doc", "s"], "left")
    return found.select("doc", "s", F.coalesce("by_caption", "by_place").alias("anchor"), F.when(F.col("by_caption").isNotNull(), "before").otherwise("after").alias("position"))


def structure_problems(a: DataFrame, b: DataFrame) -> DataFrame:
    """The parity report: problems of documents (doc, position, title, heading_levels, n_images, numbers per section) on two sides: doc, position, problem.

    Sections are compared by position: one that a side lacks, other counts of
    images or headings, and question numbers of one side only; then, per side,
    numbers that its sequence lacks.
    """
    cols = ("title", "heading_levels", "n_images", "numbers")
    side = lambda df, p: df.select("doc", "position", *(F.col(c).alias(f"{p}_{c}") for c in cols), F.lit(True).alias(f"{p}_here"))
    both = side(a, "a").join(side(b, "b"), ["doc", "position"], "full_outer")
    only = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)).cast("array<string>"), ",")
    whole = F.col("a_here").isNotNull() & F.col("b_here").isNotNull()
    tests = F.array(
        F.when(F.col("b_here").isNull(), "section only in a"), F.when(F.col("a_here").isNull(), "section only in b"),
        F.when(whole & (F.col("a_n_images") != F.col("b_n_images")), F.format_string("images: %d and %d", "a_n_images", "b_n_images")),
        F.when(whole & (F.size("a_heading_levels") != F.size("b_heading_levels")), F.format_string("headings: %d and %d", F.size("a_heading_levels"), F.size("b_heading_levels"))),
        F.when(whole & (only(F.col("a_numbers"), F.col("b_numbers")) != ""), F.concat(F.lit("questions only in a: "), only(F.col("a_numbers"), F.col("b_numbers")))),
        F.when(whole & (only(F.col("b_numbers"), F.col("a_numbers")) != ""), F.concat(F.lit("questions only in b: "), only(F.col("b_numbers"), F.col("a_numbers")))),
    )
    found = both.select("doc", "position", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("problem"))

    def gaps(df: DataFrame, name: str) -> DataFrame:
        numbers = df.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("n"))
        lacking = F.array_join(aggregates.numbering_gaps(F.col("n")), ",")
        return numbers.where((F.size("n") > 0) & (lacking != "")).select("doc", F.lit(None).cast("int").alias("position"), F.concat(F.lit(f"numbers missing in {name}: "), lacking).alias("problem"))

    return found.union(gaps(a, "a")).union(gaps(b, "b"))
