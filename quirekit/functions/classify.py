"""Regular-expression predicates and small classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbering, verbs and hints that make a line a question or a watermark.
QUESTION_PREFIX = r"(?i)^\s*(?:(?:Q(?:uestion)?\s*\.?\s*)?(\d{1,3})\s*[.)\]:]|\(([ivxlcdm]{1,7})\)|\(([a-z])\)|([ivxlcdm]{1,7})\s*[.)]\s)"
QUESTION_WORDS = (
    "find", "calculate", "explain", "define", "write", "solve", "prove", "state", "describe", "why", "what", "how", "which", "where", "when",
    "name", "list", "identify", "choose", "match", "draw", "show that", "compare", "derive", "discuss",
)
QUESTION_HINT = r"(?i)(\?|\b(?:" + "|".join(QUESTION_WORDS) + r")\b|\bgive reason|\bfill in the blank)"
OPTION = r"(?i)\(([a-d])\)\s*([^()]{1,80})"
WATERMARK_HINTS = (
    "watermark", "sample", "specimen", "draft copy", "do not copy", "confidential",
    "for evaluation only", "demo version", "trial version", "www.", "copyright ©",
)
PRINT_ARTIFACT = r"(?i)\.(indd|qxd|pmd|ai|psd)\b|\b\d{2}-\d{2}-\d{4}\s+\d{1,2}:\d{2}(:\d{2})?"
CAPTION = r"(?i)^\s*(fig(ure)?|table|chart|diagram|photo|image)[\s.:]*\d"
LIST_ITEM = r"(?i)^\s*([-•●▪*]|\(?[a-z0-9]{1,3}[.)])\s+\S"
NUMBERED_HEADING = r"^\s*(\d+(\.\d+)*)\s+\S"
MATH_LINE = "^[\\d\\s=+*/×÷·^().,%–—_-]+$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _compact(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"(?U)\s", "")


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def word_count(c: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_count(_text(c), F.lit(r"(?U)\S+"))


def symbol_heavy(text: Column) -> Column:
    """Text of eight characters or more with few letters, or fewer than 60 % and three numbers that stand alone."""
    compact = _compact(text)
    share = _letters(compact) / F.greatest(F.lit(1), F.length(compact))
    numbers = F.regexp_count(_text(text), F.lit(r"(?U)(?<![\w.])\d+(?![\w.])"))
    return (F.length(compact) >= 8) & ((share < 0.45) | ((share < 0.6) & (numbers >= 3)))


def has_question_hint(text: Column) -> Column:
    """R3."""
    return _text(text).rlike(QUESTION_HINT)


def looks_like_question(text: Column) -> Column:
    """R2: numbered, of five characters or more, with a hint."""
    t = F.trim(_text(text))
    return (F.length(t) >= 5) & t.rlike(QUESTION_PREFIX) & t.rlike(QUESTION_HINT)


def parse_question(text: Column) -> Column:
    """``struct(number, text, options)``; null where the text has no number."""
    t = F.trim(_text(text))
    group = lambda i: F.nullif(F.regexp_extract(t, QUESTION_PREFIX, i), F.lit(""))
    body = F.trim(F.regexp_replace(t, QUESTION_PREFIX, ""))
    letters, values = F.regexp_extract_all(body, F.lit(OPTION), 1), F.regexp_extract_all(body, F.lit(OPTION), 2)
    options = F.zip_with(letters, values, lambda a, b: F.concat(F.lit("("), F.lower(a), F.lit(") "), F.trim(b)))
    return F.when(t.rlike(QUESTION_PREFIX), F.struct(F.coalesce(*map(group, (1, 2, 3, 4))).alias("number"), F.trim(F.regexp_replace(body, OPTION, "")).alias("text"), options.alias("options")))


def watermark_hint(normalised: Column) -> Column:
    """The first hint of the list in a text of up to 120 characters that keeps its punctuation; else null."""
    found = F.coalesce(*(F.when(F.contains(normalised, F.lit(h)), h) for h in WATERMARK_HINTS))
    return F.when(F.length(normalised) <= 120, found)


def math_line(line: Column) -> Column:
    """Three to sixty characters of an equation, or with few letters around an equals sign."""
    t, compact = F.trim(_text(line)), _compact(line)
    symbols = t.rlike(MATH_LINE)
    plain = symbols & t.rlike("[=+×]")
    lettered = ~symbols & (F.length(compact) > 0) & (_letters(compact) < 0.25 * F.length(compact)) & F.contains(t, F.lit("="))
    return F.length(t).between(3, 60) & (plain | lettered)


def math_stack(lines: Column) -> Column:
    """Of two lines or more, two and 60 % at least are equations."""
    real = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(_text(x)) != "")
    mathy = F.size(F.filter(real, math_line))
    return (F.size(real) >= 2) & (mathy >= 2) & (mathy >= 0.6 * F.size(real))


def unreadable(text: Column) -> Column:
    """A share of 30 % or three tokens of undecoded glyphs, or over a quarter control and private characters."""
    t, compact = _text(text), _compact(text)
    tokens = F.regexp_extract_all(t, F.lit(r"(\(cid:\d+\))"), 1)
    chars = F.length(F.array_join(tokens, ""))
    bad = F.length(compact) - F.length(F.regexp_replace(compact, "[\\u0000-\\u001f\\u0080-\\u009f\\ue000-\\uf8ff]", ""))
    return (F.length(t) > 0) & (((F.size(tokens) > 0) & (chars >= 0.3 * F.length(t))) | (F.size(tokens) >= 3) | (bad > 0.25 * F.length(compact)))


def heading(text: Column, size: Column, bold: Column, body_size: Column) -> Column:
    """Up to 140 characters and 20 words with a letter; larger than the body, bold or in capitals; no closing mark unless numbered or in capitals."""
    t = F.trim(_text(text))
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    capitals = (F.length(t) > 3) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    styled = F.coalesce(size >= body_size + 0.75, F.lit(False)) | (F.coalesce(bold, F.lit(False)) & F.coalesce(size >= body_size - 0.2, F.lit(False))) | capitals
    closed = t.rlike("[.,;:]$") & ~t.rlike(NUMBERED_HEADING) & ~capitals
    return (F.length(t) <= 140) & (word_count(t) <= 20) & (F.length(letters) > 0) & styled & ~closed


def block_kind(text: Column, is_heading: Column) -> Column:
    """Caption, list item, heading or paragraph, whichever fits first."""
    t = _text(text)
    return F.when(t.rlike(CAPTION), "caption").when(t.rlike(LIST_ITEM), "list_item").when(is_heading, "heading").otherwise("paragraph")


def print_artifact(text: Column) -> Column:
    """R11."""
    return _text(text).rlike(PRINT_ARTIFACT)


def ui_mathy(text: Column) -> Column:
    """Twelve characters or more, of which under half are ASCII letters."""
    t = _compact(text)
    return (F.length(t) >= 12) & (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) < 0.5 * F.length(t))


def confidence_band(confidence: Column) -> Column:
    """From 0.9, from 0.8, or below."""
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.8, "medium").otherwise("low")


def label_like(text: Column) -> Column:
    """Up to three words and thirty characters without a closing mark."""
    return (word_count(text) <= 3) & (F.length(_text(text)) <= 30) & ~_text(text).rlike(r"[.?!]\s*$")


def kind_of_tag(tag: Column) -> Column:
    """R15."""
    return F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list_item").when(tag.isin("figcaption", "caption"), "caption").when(tag.isin("td", "th"), "table").otherwise("paragraph")


def content_block(text: Column, kind: Column, visible: Column, min_words: int = 3) -> Column:
    """Visible, neither furniture nor unreadable, with a letter, and of three words unless it is a heading."""
    t = F.trim(_text(text))
    return visible & ~kind.isin("furniture", "unreadable") & (t != "") & ~t.rlike(r"(?U)^[\s\d\W]*$") & ((word_count(t) >= min_words) | (kind == "heading"))


def content_image(width: Column, height: Column, size: Column) -> Column:
    """P10: 32 pixels either way and 256 bytes where they are known."""
    return (width >= 32) & (height >= 32) & F.coalesce(size >= 256, F.lit(True))


def usable_table(rows: Column, cols: Column, cells: Column, has_box: Column) -> Column:
    """With a box, two rows and columns, and half of the cells filled."""
    flat = F.flatten(cells)
    filled = F.size(F.filter(flat, lambda c: F.trim(_text(c)) != ""))
    return has_box & (rows >= 2) & (cols >= 2) & (filled >= 0.5 * F.greatest(F.lit(1), F.size(flat)))


def engine_verdict(auto_fixable: Column, confidence: Column, threshold: float = 0.95) -> Column:
    """Fixed without review where that is possible and sure enough."""
    return F.when(F.coalesce(auto_fixable & (confidence >= threshold), F.lit(False)), "AUTO_FIXED").otherwise("PENDING_REVIEW")


def fix_decision(status: Column, has_correction: Column, auto_fixable: Column, confidence: Column, threshold: float = 0.95) -> Column:
    """``struct(apply, reason)``; the reason is null where the fix is applied."""
    reason = (
        F.when(status == "REJECTED", "rejected by reviewer")
        .when(~F.coalesce(has_correction, F.lit(False)), "no correction available")
        .when(status == "APPROVED", None)
        .when(~F.coalesce(auto_fixable, F.lit(False)), "not auto-fixable")
        .when(F.coalesce(confidence < threshold, F.lit(True)), "confidence below threshold")
    )
    return F.struct(reason.isNull().alias("apply"), reason.alias("reason"))
