"""Quality rules: a threshold table compiled into Spark projections, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "with", "as", "be", "this", "from", "at", "or",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine", "dem", "als", "auch", "im", "für",
    "le", "la", "les", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "est", "sur", "pas", "au", "par", "avec", "ne",
    "el", "los", "las", "de", "y", "que", "del", "se", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "un",
)

WORD_BREAKS = r"[\x20\x09-\x0D]+"
_SYMBOLS, _BREAKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Keeps rows where ``low * denominator <= numerator <= high * denominator``; null bounds don't bind."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The production table. Numerators and denominators are columns that ``measure`` makes.
RULES = (
    Rule("length", "n_words", "one", low=50),
    Rule("word_length", "word_chars", "n_words", low=1.5, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.10),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.50),
)


def measure(docs: DataFrame) -> DataFrame:
    """The rows with the counts that the rules use, and nothing aggregated across rows.

    Null texts count as empty, with all counts 0. Three-word windows are
    compared by a 64-bit hash. Columns of ``docs`` that clash with a count are
    replaced; the arrays on the way are in columns of reserved names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = docs.withColumn("__words", F.expr(f"filter(split(coalesce(cast(text as string), ''), r'{WORD_BREAKS}'), w -> w <> '')"))
    counts = counts.withColumns({
        "__lines": F.expr(r"filter(split(coalesce(cast(text as string), ''), '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"),
        "__grams": F.expr("transform(if(size(__words) < 3, cast(array() as array<int>), sequence(0, size(__words) - 3)), i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)))"),
    })
    # Only texts in which a window comes again pay for sorting.
    counts = counts.withColumn("__sorted", F.expr("if(size(array_distinct(__grams)) < size(__grams), sort_array(transform(__grams, (g, i) -> struct(g as g, i as i))), cast(array() as array<struct<g: bigint, i: int>>))"))
    counts = counts.withColumn("__starts", F.expr("sort_array(transform(filter(__sorted, (x, i) -> get(__sorted, i - 1).g <=> x.g or get(__sorted, i + 1).g <=> x.g), x -> x.i))"))
    long = lambda c: c.cast("long")
    return counts.withColumns({
        "one": F.lit(1),
        "n_words": long(F.size("__words")),
        "word_chars": long(F.length(F.translate(text, _BREAKS, ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))),
        "n_lines": long(F.size("__lines")),
        "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
        "n_repeat_words": F.expr("aggregate(__starts, struct(0L as n, -3 as last), (a, s) -> struct(a.n + least(3, s - a.last) as n, s as last), a -> a.n)"),
        "n_stop_words": long(F.size(F.filter("__words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS)))))),
    }).drop("__words", "__lines", "__grams", "__sorted", "__starts")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One boolean column that is true where every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        a, b = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        if r.low is not None:
            verdict = verdict & (a >= b * r.low)
        if r.high is not None:
            verdict = verdict & (a <= b * r.high)
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows with their counts, ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated
    three-word windows; such rows are never kept. Others are kept where the
    threshold table holds. Every row of ``docs`` comes back once, repeated
    rows and null texts included.
    """
    measured = measure(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules)).drop("one")


def keep_passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    judged = quality_rules(docs.withColumn("__row", F.struct(*docs.columns)), rules).select("__row", "kept")
    # The verdict passes a generator, below which the filter isn't pushed; there it would repeat the counts' nested arrays over and over.
    return judged.select("__row", F.explode_outer(F.array("kept")).alias("kept")).where("kept").select("__row.*")


def oracle() -> str:
    """DuckDB SQL of the contract's columns over ``documents``, from the same threshold table."""
    rules = " AND ".join(
        f"{side}" for r in RULES for side in (
            *([f"CAST({r.numerator} AS DOUBLE) >= CAST({r.denominator} AS DOUBLE) * CAST({r.low} AS DOUBLE)"] if r.low is not None else []),
            *([f"CAST({r.numerator} AS DOUBLE) <= CAST({r.denominator} AS DOUBLE) * CAST({r.high} AS DOUBLE)"] if r.high is not None else []),
        )
    )
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, 1 AS one, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept, n_lines, n_stop_words
FROM judged
"""
