"""Text normalization and string functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Runs of characters that are neither letters, digits, underscores nor white space.
_PUNCT = r"[^\p{L}\p{N}_\s]"

#: Typographic characters and what stands for them in comparisons.
TYPOGRAPHY = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"',
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u2010": "-", "\u2011": "-",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u200b": "", "\ufeff": "", "\u00ad": "",
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u2026": "...",
}


def normalize_sql(text: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _PUNCT, " "), r"\s+", " "))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition, which Spark lacks; null stays null."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in parts:
            yield pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in a.to_pylist()], pa.string())

    return arrow_udf(run, "string")(text)


def plain_typography(text: Column) -> Column:
    """Typographic characters as plain ones, in one pass for those of one character each and one per ligature."""
    single = {k: v for k, v in TYPOGRAPHY.items() if len(v) == 1}
    gone = "".join(k for k, v in TYPOGRAPHY.items() if not v)
    out = F.translate(text, "".join(single) + gone, "".join(single.values()))
    for k, v in TYPOGRAPHY.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def normalize(text: Column, keep_punctuation: bool = False, lowercase: bool = True, compose: bool = True) -> Column:
    """the canonical form of comparisons; null gives an empty text.

    Compatibility composition (``compose``, the one step in Python), plain
    typography, words that a hyphen splits over two lines rejoined, lower case,
    punctuation to blanks, white space collapsed and trimmed.
    """
    out = plain_typography(nfkc(text) if compose else text)
    out = F.regexp_replace(out, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    if lowercase:
        out = F.lower(out)
    if not keep_punctuation:
        out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    return F.coalesce(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", ""), F.lit(""))


def tokenize(normalised: Column) -> Column:
    """words of a normalised text; an empty one has none."""
    return F.filter(F.split(F.coalesce(normalised, F.lit("")), " "), lambda w: w != "")


def split_sentences(text: Column) -> Column:
    """sentences that end with a mark and white space, trimmed; empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "(?<=[.!?।])\\s+"), F.trim), lambda s: s != "")


def clip(text: Column, limit: int = 110) -> Column:
    """trimmed, on one line, with an ellipsis in the last place where it is longer than ``limit``."""
    line = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def squash(text: Column, compose: bool = True) -> Column:
    """lower-cased with plain dashes and crosses and without white space, for tests of containment."""
    out = F.lower(nfkc(text) if compose else text)
    out = F.translate(out, "‐‑‒–—−×", "------x")
    return F.coalesce(F.regexp_replace(out, r"(?U)\s", ""), F.lit(""))


def strip_cid_tokens(text: Column) -> Column:
    """without glyph tokens that an extractor couldn't decode."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\(cid:\d+\)", ""), r"\s{2,}", " "))


def csv_cell(value: Column) -> Column:
    """quoted only where the value has a quote, comma or line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def format_bytes(size: Column) -> Column:
    """in the largest of B, KB, MB and GB that the size reaches, with a decimal from KB on; a dash for none or zero. The double itself is rounded, halves to even, not its shortest decimal."""
    value = size.cast("double")
    out = F.when(F.coalesce(value, F.lit(0.0)) == 0, "—").when(value < 1024, F.concat(F.call_function("format_number", value, F.lit("0")), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        shown = F.concat(F.call_function("format_number", value / float(1024**i), F.lit("0.0")), F.lit(f" {unit}"))
        out = out.when(value < 1024 ** (i + 1), shown) if unit != "GB" else out.otherwise(shown)
    return out


def strip_blank_placeholders(html: Column) -> Column:
    """F16: ``[blank]`` marks removed, and empty table cells filled with a no-break space."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)\[blank\]", ""), r"(?i)<(td|th)([^>]*)>\s*</\1>", "<$1$2>&nbsp;</$1>")


def merge_style(old: Column, new: Column) -> Column:
    """declarations of ``new`` over those of ``old``, by property, in the order in which properties first come."""
    pairs = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda d: F.contains(d, F.lit(":"))), lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("k"), F.trim(F.regexp_replace(d, r"^[^:]*:", "")).alias("v")))
    both = F.concat(pairs(old), pairs(new))
    keys = F.array_distinct(F.transform(both, lambda p: p.k))
    last = lambda k: F.element_at(F.filter(both, lambda p: p.k == k), -1).v
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(": "), last(k))), "; ")


def rewrite_urls(html: Column, mapping: Column) -> Column:
    """every ``src`` of an array of (src, url) replaced, row after row; those without a url stay."""
    known = F.filter(mapping, lambda e: e.src.isNotNull() & (e.src != "") & e.url.isNotNull() & (e.url != ""))
    return F.aggregate(known, html, lambda h, e: F.replace(h, e.src, e.url))
