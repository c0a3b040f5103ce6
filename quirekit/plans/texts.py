"""Text queries: normalisation, classification and block operators over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, misc, text
from ..sources.tables import table
from .catalog import register

_LINES_SQL = "(SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line of every document, numbered from 1."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)


@register("text_block_explode", rf"SELECT doc_id, CAST(i AS INTEGER) AS i, md5(trim(line)) AS digest, CAST(len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_words FROM {_LINES_SQL} WHERE trim(line) <> ''")
def text_block_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks with their order."""
    return lines_of(spark, sf_dir).where(F.trim("line") != "").select("doc_id", "i", F.md5(F.trim("line").cast("binary")).alias("digest"), F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("n_words"))


@register("block_content_filter", rf"""
WITH b AS (SELECT doc_id, i, trim(line) AS t, length(trim(line)) % 7 = 0 AS heading, i % 9 <> 0 AS visible FROM {_LINES_SQL})
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_content FROM b WHERE visible AND t <> '' AND regexp_matches(t, '[\p{{L}}\p{{M}}_]') AND (heading OR len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) >= 3) GROUP BY doc_id""")  # fmt: skip
def block_content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content blocks per document; some lines play headings and hidden blocks."""
    t = F.trim("line")
    rows = lines_of(spark, sf_dir).where(classify.content_block(t, F.when(F.length(t) % 7 == 0, "heading").otherwise("paragraph"), F.col("i") % 9 != 0))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_content"))


_SINGLE = {k: v for k, v in text.TYPOGRAPHY.items() if len(v) == 1}
_PLAIN_SQL = "translate(coalesce(text, ''), '{}{}', '{}')".format("".join(_SINGLE), "".join(k for k, v in text.TYPOGRAPHY.items() if not v), "".join(_SINGLE.values()).replace("'", "''"))
for _k, _v in text.TYPOGRAPHY.items():
    if len(_v) > 1:
        _PLAIN_SQL = f"replace({_PLAIN_SQL}, '{_k}', '{_v}')"


@register("normalized_text_sql", rf"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace({_PLAIN_SQL}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")  # fmt: skip
def normalized_text_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 without the compatibility composition, which SQL lacks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"), compose=False).cast("binary")).alias("digest"))


@register("normalized_text_nfkc")
def normalized_text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2 whole, F11."""
    norm = text.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm.cast("binary")).alias("digest"), F.size(text.tokenize(norm)).alias("n_tokens"), F.length(text.squash(F.col("text"))).alias("n_squashed"))


@register("text_clips", """
WITH s AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(replace(t, chr(10), ' ')) <= 40 THEN replace(t, chr(10), ' ') ELSE replace(t, chr(10), ' ')[1:39] || '…' END AS clip FROM s""")  # fmt: skip
def text_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first characters of a text, on one line."""
    return table(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text"), 40).alias("clip"))


@register("question_parse", r"""
WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id % 300 || '. Explain ' WHEN 1 THEN '(iv) what is ' WHEN 2 THEN 'Q' || doc_id % 300 || ') list ' WHEN 3 THEN 'Find ' ELSE doc_id % 300 || '. ' END || substr(regexp_replace(string_split(text, chr(10))[1], '[()?]', '', 'g'), 1, 60) || CASE WHEN doc_id % 2 = 0 THEN ' (a) one (b) Two' ELSE '' END AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, doc_id % 5 <> 3 AS numbered, CASE doc_id % 5 WHEN 1 THEN 'iv' WHEN 3 THEN NULL ELSE CAST(doc_id % 300 AS VARCHAR) END AS number, CASE WHEN doc_id % 5 <> 3 THEN CASE WHEN doc_id % 2 = 0 THEN '(a) one|(b) Two' ELSE '' END END AS options, regexp_matches(t, '(?i)(\?|\b(find|calculate|explain|define|write|solve|prove|state|describe|why|what|how|which|where|when|name|list|identify|choose|match|draw|show that|compare|derive|discuss)\b|\bgive reason|\bfill in the blank)') AS hint FROM q""")  # fmt: skip
def question_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2-R4 on first lines with numbers, verbs and options put before and after them."""
    d, c = F.col("doc_id"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    lead = F.when(d % 5 == 0, c(d % 300, ". Explain ")).when(d % 5 == 1, "(iv) what is ").when(d % 5 == 2, c("Q", d % 300, ") list ")).when(d % 5 == 3, "Find ").otherwise(c(d % 300, ". "))
    first = F.substring(F.regexp_replace(F.substring_index("text", "\n", 1), "[()?]", ""), 1, 60)
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("t", F.concat(lead, first, F.when(d % 2 == 0, " (a) one (b) Two").otherwise("")))
    rows = rows.withColumn("q", classify.parse_question(F.col("t")))
    return rows.select("doc_id", F.col("q").isNotNull().alias("numbered"), F.col("q.number").alias("number"), F.array_join("q.options", "|").alias("options"), classify.has_question_hint(F.col("t")).alias("hint"))


@register("watermark_hints", r"""
WITH t AS (SELECT doc_id, i, lower(trim(regexp_replace(line || CASE (doc_id + i) % 6 WHEN 0 THEN ' DRAFT copy' WHEN 1 THEN ' Sample of a watermark' WHEN 2 THEN ' www.x.y' ELSE '' END, '\s+', ' ', 'g'))) AS t FROM """ + _LINES_SQL + r""")
SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN contains(t, 'watermark') THEN 'watermark' WHEN contains(t, 'sample') THEN 'sample' WHEN contains(t, 'specimen') THEN 'specimen' WHEN contains(t, 'draft copy') THEN 'draft copy' WHEN contains(t, 'do not copy') THEN 'do not copy' WHEN contains(t, 'confidential') THEN 'confidential'
  WHEN contains(t, 'for evaluation only') THEN 'for evaluation only' WHEN contains(t, 'demo version') THEN 'demo version' WHEN contains(t, 'trial version') THEN 'trial version' WHEN contains(t, 'www.') THEN 'www.' WHEN contains(t, 'copyright ©') THEN 'copyright ©' END AS hint
FROM t WHERE length(t) <= 120 AND regexp_matches(t, 'watermark|sample|specimen|draft copy|do not copy|confidential|for evaluation only|demo version|trial version|www\.|copyright ©')""")  # fmt: skip
def watermark_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 on lines, some of which are given a hint."""
    k = (F.col("doc_id") + F.col("i")) % 6
    rows = lines_of(spark, sf_dir).withColumn("t", F.concat("line", F.when(k == 0, " DRAFT copy").when(k == 1, " Sample of a watermark").when(k == 2, " www.x.y").otherwise("")))
    return rows.select("doc_id", "i", classify.watermark_hint(text.normalize(F.col("t"), keep_punctuation=True, compose=False)).alias("hint")).where("hint is not null")


@register("unreadable_ratio", r"""
WITH t AS (SELECT source, CASE doc_id % 4 WHEN 0 THEN repeat('(cid:12)', 3) ELSE '' END || coalesce(text, '') AS t FROM documents),
u AS (SELECT source, length(t) > 0 AND (len(regexp_extract_all(t, '\(cid:\d+\)')) >= 3 OR (len(regexp_extract_all(t, '\(cid:\d+\)')) > 0 AND length(array_to_string(regexp_extract_all(t, '\(cid:\d+\)'), '')) >= 0.3 * length(t))
  OR length(regexp_replace(t, '\s', '', 'g')) - length(regexp_replace(regexp_replace(t, '\s', '', 'g'), '[\x{0}-\x{1f}\x{80}-\x{9f}\x{e000}-\x{f8ff}]', '', 'g')) > 0.25 * length(regexp_replace(t, '\s', '', 'g'))) AS bad FROM t)
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS n_unreadable, count(*) FILTER (bad) < 0.4 * count(*) AS reliable FROM u GROUP BY source""")  # fmt: skip
def unreadable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some texts begin with glyphs that couldn't be decoded."""
    from ..operators.aggregates import reliable_text as reliable

    t = F.concat(F.when(F.col("doc_id") % 4 == 0, "(cid:12)(cid:12)(cid:12)").otherwise(""), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").withColumn("kind", F.when(classify.unreadable(t), "unreadable").otherwise("paragraph"))
    return reliable(rows, ["source"], "kind")


@register("cid_tokens", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace('(cid:3) ' || coalesce(text, '') || '(cid:44)', '\(cid:\d+\)', '', 'g'), '\s{2,}', ' ', 'g'))) AS digest FROM documents")
def cid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    t = F.concat(F.lit("(cid:3) "), F.coalesce("text", F.lit("")), F.lit("(cid:44)"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_cid_tokens(t).cast("binary")).alias("digest"))


@register("line_classes")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of every line; sizes follow the lines' length."""
    c = F.col("line")
    size = F.when(F.length(c) < 40, 14.0).otherwise(10.0)
    head = classify.heading(c, size, F.lit(False), F.lit(10.0))
    return lines_of(spark, sf_dir).select("doc_id", "i", classify.block_kind(c, head).alias("kind"), classify.symbol_heavy(c).alias("heavy"), classify.math_line(c).alias("math"), classify.print_artifact(c).alias("artifact"), classify.ui_mathy(c).alias("mathy"), classify.label_like(c).alias("label"))


@register("math_stacks", r"""
WITH t AS (SELECT doc_id, list_filter(list_concat(string_split(coalesce(text, ''), chr(10))[1:1], CASE WHEN doc_id % 3 = 0 THEN ['1 + 3 = 4', '1 + 3 + 5 = 9', ' '] ELSE ['a'] END), lambda x: trim(x) <> '') AS l FROM documents),
m AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: length(trim(x)) BETWEEN 3 AND 60 AND ((regexp_matches(trim(x), '^[\d\s=+*/×÷·^().,%–—_-]+$') AND regexp_matches(x, '[=+×]'))
  OR (NOT regexp_matches(trim(x), '^[\d\s=+*/×÷·^().,%–—_-]+$') AND contains(x, '=') AND length(regexp_replace(x, '\s', '', 'g')) > 0 AND length(regexp_replace(x, '[^\p{L}]', '', 'g')) < 0.25 * length(regexp_replace(x, '\s', '', 'g')))))) AS k FROM t)
SELECT doc_id, n >= 2 AND k >= 2 AND k >= 0.6 * n AS stack FROM m""")  # fmt: skip
def math_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first line with, in some documents, equations below it."""
    more = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("1 + 3 = 4"), F.lit("1 + 3 + 5 = 9"), F.lit(" "))).otherwise(F.array(F.lit("a")))
    rows = F.concat(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 1), more)
    return table(spark, sf_dir, "documents").select("doc_id", classify.math_stack(rows).alias("stack"))


@register("style_overlays", """
SELECT p_partkey, 'color: ' || CASE WHEN p_size % 2 = 0 THEN 'red' ELSE 'blue' END || '; width: ' || p_size || 'px; margin: 0' AS style FROM part""")  # fmt: skip
def style_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """declarations over others."""
    old = F.concat(F.lit("color:blue; Width : "), F.col("p_size").cast("string"), F.lit("px;;bad"))
    new = F.when(F.col("p_size") % 2 == 0, "COLOR: red; margin:0").otherwise("margin: 0;")
    return table(spark, sf_dir, "part").select("p_partkey", text.merge_style(old, new).alias("style"))


@register("url_rewrites", """
SELECT page_id, md5(replace(replace(html, '<title>', '<title data-a="1">'), '</article>', '</article ><hr>')) AS digest FROM pages""")  # fmt: skip
def url_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a mapping applied row after row; a row without a target is left out."""
    row = lambda a, b: F.struct(F.lit(a).alias("src"), F.lit(b).cast("string").alias("url"))
    mapping = F.array(row("<title>", '<title data-a="1">'), row("</article>", "</article ><hr>"), row("<p>", None), row("", "x"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.rewrite_urls(F.col("html"), mapping).cast("binary")).alias("digest"))


@register("url_parts", r"""
SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[A-Za-z0-9]{1,8})$', 1)) AS suffix, regexp_matches(url, '(?i)^(https?|file)://') AS is_url,
  regexp_extract(regexp_replace(url, '[?#].*$|/+$', ''), '([^/]*)$', 1) <> '' AS same FROM pages""")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12, X35."""
    u = F.col("url")
    moved = F.concat(F.lit("https://cdn/x/"), F.regexp_extract(F.regexp_replace(u, r"[?#].*$|/+$", ""), r"([^/]*)$", 1), F.lit("?v=2"))
    return table(spark, sf_dir, "pages").select("page_id", misc.suffix(u).alias("suffix"), misc.is_url(u).alias("is_url"), misc.same_src(u, moved).alias("same"))


@register("map_overlays", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '/' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS shown FROM events""")  # fmt: skip
def map_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5, JSON and map helpers: the right side's entries win; keys that aren't wanted are left out."""
    s = lambda *x: F.create_map(*(v if isinstance(v, Column) else F.lit(v) for v in x))
    old = s("a", F.col("event_type"), "b", "old", "drop", "x")
    new = F.when(F.col("event_id") % 2 == 0, s("b", "new"))
    m = misc.without_keys(misc.overlay(old, new), ("drop",))
    k = F.try_variant_get(misc.safe_json(F.col("props")), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.array_join(F.array(m["a"], m["b"]), "/").alias("shown"))
