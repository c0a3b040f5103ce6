"""Aggregations (A1-A32) over findings, blocks and sections; every one combines before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Penalties by severity and weights of the six scores.
SEVERITY_PENALTY = {"CRITICAL": 10, "MAJOR": 4, "MINOR": 1, "INFO": 0}
SCORE_WEIGHTS = {"text": 0.30, "image": 0.25, "structure": 0.15, "order": 0.10, "question": 0.15, "layout": 0.05}
CHECKS = {"text": ("Text coverage", 0.95), "image": ("Image coverage", 0.98), "structure": ("Structure integrity", 0.95), "order": ("Element order", 0.90), "question": ("Question coverage", 1.00), "layout": ("Visual layout", 0.80)}


def _long(c: Column) -> Column:
    return c.cast("long")


def zero_filled_counts(df: DataFrame, keys: list[str], value: str, domain: tuple[str, ...], prefix: str = "n_") -> DataFrame:
    """A1: a count per value of a fixed domain, 0 where none; other values aren't counted."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(value) == v).alias(f"{prefix}{v.lower()}") for v in domain))


def penalty_score(severity: Column, penalties: dict[str, int] = SEVERITY_PENALTY, start: int = 100) -> Column:
    """A2, an aggregate: ``start`` less the penalties of all rows, at least 0; unknown severities cost nothing."""
    cost = F.coalesce(*(F.when(severity == s, n) for s, n in penalties.items()), F.lit(0))
    return _long(F.greatest(F.lit(0), F.lit(start) - F.coalesce(F.sum(cost), F.lit(0))))


def filtered_counts(df: DataFrame, keys: list[str], condition: Column, name: str = "n") -> DataFrame:
    """Rows that meet a condition, per group."""
    return df.where(condition).groupBy(*keys).agg(F.count("*").alias(name))


def mixed_counters(df: DataFrame, severity: str, status: str) -> DataFrame:
    """A5: ``(counter, n)`` of every severity and every ``status:`` value, in one pass; before any limit is applied to the rows."""
    each = F.explode(F.array(F.col(severity).cast("string"), F.concat(F.lit("status:"), F.col(status).cast("string"))))
    return df.select(each.alias("counter")).where("counter is not null").groupBy("counter").agg(F.count("*").alias("n"))


def limited_with_counters(df: DataFrame, severity: str, status: str, order: list, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first rows of a total order, 1 to 2000 of them, and the counters of all rows."""
    return df.orderBy(*order).limit(min(2000, max(1, limit))), mixed_counters(df, severity, status)


def counter_map(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A map of counts by value per group; values are few."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), "__n")))).alias(name))


def status_summary(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Findings by status and the share that is fixed or approved, 1 where there are none."""
    of = lambda s: F.count_if(F.col(status) == s)
    found = df.groupBy(*keys).agg(
        F.count("*").alias("issues_found"), of("AUTO_FIXED").alias("auto_fixed"), of("APPROVED").alias("approved"), of("REJECTED").alias("rejected"), of("OPEN").alias("needs_review"), of("UNFIXABLE").alias("unfixable")
    )
    return found.withColumn("auto_fix_rate", F.when(F.col("issues_found") > 0, F.round((F.col("auto_fixed") + F.col("approved")) / F.col("issues_found"), 4)).otherwise(1.0))


def overall_score(**scores: Column) -> Column:
    """The weighted sum of six scores, to four digits."""
    total = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        total = total + weight * scores[name]
    return F.round(total, 4)


def coverage_ratio(matched: Column, n: Column, empty: float) -> Column:
    """To four digits; ``empty`` where there is nothing to cover."""
    return F.when(n > 0, F.round(matched / F.greatest(F.lit(1), n), 4)).otherwise(F.lit(empty))


def quality_score(overall: Column, high: Column, medium: Column, regressions: Column) -> Column:
    """A10: the overall score less 0.05 per high, 0.02 per medium and 0.04 per new finding, 0.35 at most, to four digits."""
    penalty = F.least(F.lit(0.35), 0.05 * high + 0.02 * medium + 0.04 * regressions)
    return F.round(F.greatest(F.lit(0.0), overall - penalty), 4)


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, order: Column, name: str = "mode") -> DataFrame:
    """The value with the largest sum of weights, of several the one that comes first; null values have no weight."""
    sums = df.where(value.isNotNull()).groupBy(*keys, value.alias("__v")).agg(F.sum(weight).alias("__w"), F.min(order).alias("__o"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("__w")).alias("w"), "__o", "__v")).alias("__b"))
    return best.select(*keys, F.col("__b.__v").alias(name), (-F.col("__b.w")).alias("weight"))


def line_features(chars: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest font, mean size and envelope of the characters (font, size, x0, top, x1, bottom, ord) of each group."""
    fonts = weighted_mode(chars, keys, F.col("font"), F.lit(1), F.col("ord"), "font").drop("weight")
    boxes = chars.groupBy(*keys).agg(F.avg("size").alias("size"), envelope("x0", "top", "x1", "bottom").alias("box"))
    return boxes.join(fonts, keys, "left")


def envelope(x0: str, top: str, x1: str, bottom: str) -> Column:
    """A13, an aggregate: the smallest box around all."""
    return F.struct(F.min(x0).alias("x0"), F.min(top).alias("top"), F.max(x1).alias("x1"), F.max(bottom).alias("bottom"))


def repeated_keys(df: DataFrame, doc: list[str], key: str, page: str, n_pages: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """Keys on ``least`` pages and ``share`` of a document's pages: doc, key and n. ``n_pages`` has doc and pages."""
    # Distinct (doc, key, page) first, so a hot key is spread by page before it is counted.
    on = df.select(*doc, key, page).where(F.col(key).isNotNull()).distinct().groupBy(*doc, key).agg(F.count("*").alias("n"))
    return on.join(n_pages, doc).where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select(*doc, key, "n")


def all_in_band(in_band: Column) -> Column:
    """A15, an aggregate: every occurrence is in the margin band; nulls are not."""
    return F.bool_and(F.coalesce(in_band, F.lit(False)))


def keep_best(df: DataFrame, keys: list[str], confidence: str, order: list[str]) -> DataFrame:
    """The row of each key (nulls are a value) with the highest confidence, of several the first: a minimum, combined before the shuffle."""
    rank = F.struct((-F.col(confidence)).alias("c"), *order)
    best = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), rank).alias("__row"))
    return best.select("__row.*")


def mean_or_one(value: Column) -> Column:
    """A17, an aggregate: the mean to four digits, 1 without values."""
    return F.coalesce(F.round(F.avg(value), 4), F.lit(1.0))


def page_counts(pages: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Elements of each kind per page, 0 where none."""
    out = pages
    for name, df in parts.items():
        out = out.join(df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}")), keys, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def document_stats(blocks: DataFrame, keys: list[str], text: str, kind: str, visible: str) -> DataFrame:
    """Blocks, words, headings and visible blocks of a document."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"))
    return blocks.groupBy(*keys).agg(F.count("*").alias("n_blocks"), _long(F.coalesce(F.sum(words), F.lit(0))).alias("n_words"), F.count_if(F.col(kind) == "heading").alias("n_headings"), F.count_if(F.col(visible)).alias("n_visible"))


def capped_votes(votes: DataFrame, section: list[str], panel: str, weight: Column, cap: float = 25.0, least: float = 30.0) -> DataFrame:
    """The panel with the largest sum of capped weights of each section, of several the least; null in ``panel`` where that sum is under ``least``."""
    sums = votes.groupBy(*section, panel).agg(F.sum(F.least(F.lit(cap), weight)).alias("__w"))
    best = sums.groupBy(*section).agg(F.min(F.struct((-F.col("__w")).alias("w"), F.col(panel).alias("p"))).alias("__b"))
    return best.select(*section, F.when(-F.col("__b.w") >= least, F.col("__b.p")).alias(panel), (-F.col("__b.w")).alias("votes"))


def home_panel(votes: DataFrame, decided: DataFrame, doc: list[str], section: str, panel: str, weight: Column, cap: float = 25.0) -> DataFrame:
    """The panel with most votes over all sections of a document that ``capped_votes`` left undecided."""
    open_ = decided.where(F.col(panel).isNull()).select(*doc, section)
    left = votes.join(open_, [*doc, section], "left_semi")
    return capped_votes(left, doc, panel, weight, cap, 0.0)


def section_profile(elements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A22 of elements (tag, level, number): heading levels in order, counts and sorted distinct question numbers."""
    levels = F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct(order, "level")))), lambda x: x.level)
    return elements.groupBy(*keys).agg(
        levels.alias("heading_levels"), F.count_if(F.col("tag") == "img").alias("n_images"), F.count_if(F.col("tag") == "table").alias("n_tables"), F.count_if(F.col("tag") == "li").alias("n_items"),
        F.array_sort(F.collect_set("number")).alias("numbers"),
    )


def numbering_gaps(numbers: Column) -> Column:
    """A23 of an array: the numbers from 1 to the greatest that it lacks, in order; none for an empty one."""
    top = F.array_max(numbers)
    return F.when(top >= 1, F.array_except(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), top).cast("long")), F.transform(numbers, lambda n: n.cast("long")))).otherwise(F.array().cast("array<long>"))


def issue_groups(df: DataFrame, severity: Column, type_: Column, band: Column, mathy: Column, id_: str, pending: Column, sample: int = 3) -> DataFrame:
    """Findings by severity, type, confidence band and mathematics: count, pending ones, the first ids and how many more there are.

    The sample is the least ids, found without collecting a group: a group's
    ids are ranked in parts, and then the parts' first ones.
    """
    rows = df.select(severity.alias("severity"), type_.alias("type"), band.alias("band"), mathy.alias("mathy"), F.col(id_).alias("__id"), pending.alias("__p"))
    keys = ["severity", "type", "band", "mathy"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("__p").alias("n_pending"))
    part = F.pmod(F.xxhash64("__id"), F.lit(64))
    first = rows.select(*keys, "__id", part.alias("__part")).withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__part").orderBy("__id"))).where(F.col("__r") <= sample)
    first = first.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("__id"))).where(F.col("__r") <= sample)
    ids = first.groupBy(*keys).agg(F.array_sort(F.collect_list("__id")).alias("sample"))
    same = None
    for k in keys:
        c = F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = c if same is None else same & c
    return counts.alias("c").join(ids.alias("s"), same).select(*(F.col(f"c.{k}") for k in keys), "n", "n_pending", "sample", F.greatest(F.lit(0), F.col("n") - sample).alias("n_more"))


def reliable_text(df: DataFrame, keys: list[str], kind: str, share: float = 0.4) -> DataFrame:
    """Whether under ``share`` of a document's blocks are unreadable."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == "unreadable").alias("n_unreadable"))
    return counts.withColumn("reliable", F.col("n_unreadable") < share * F.col("n"))


def joined_text(text: str, order: str, separator: str = "\n") -> Column:
    """A31, an aggregate: the group's texts that aren't empty, in order. A group is one document."""
    rows = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(order, text))))
    return F.array_join(F.transform(rows, lambda x: x[text]), separator)


def checklist(scores: DataFrame, keys: list[str]) -> DataFrame:
    """A row per check of each document: keys, seq, name, passed, score.

    Columns of ``scores``: the six scores by their names in ``CHECKS``, n_high,
    n_regressions and n_broken. A null score counts as 0.
    """
    items = [F.struct(F.lit(i).alias("seq"), F.lit(name).alias("name"), (F.coalesce(c, F.lit(0.0)) >= mark).alias("passed"), F.round(F.coalesce(c, F.lit(0.0)), 4).alias("score")) for i, (c, (name, mark)) in enumerate((F.col(k), v) for k, v in CHECKS.items())]
    for i, (name, c) in enumerate((("No high-severity issues remaining", "n_high"), ("No regressions introduced", "n_regressions"), ("All image URLs resolve", "n_broken")), len(items)):
        none = F.coalesce(F.col(c), F.lit(0)) == 0
        items.append(F.struct(F.lit(i).alias("seq"), F.lit(name).alias("name"), none.alias("passed"), none.cast("double").alias("score")))
    return scores.select(*keys, F.inline(F.array(*items)))


def top_counts(df: DataFrame, keys: list[str], value: str, order: str, n: int = 4) -> DataFrame:
    """The commonest values of each group, of equal counts the one that comes first; ``place`` from 1. Values are few."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first_at"))).where(F.col("place") <= n)


def recommendations(high: Column, top: Column, regressions: Column, borderline: Column) -> Column:
    """Next steps in order of weight; ``top`` is an array of (type, n)."""
    say = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(text)))
    by_type = F.transform(top, lambda t: F.concat(t.n.cast("string"), F.lit(" unresolved "), F.lower(F.replace(t.type, F.lit("_"), F.lit(" "))), F.lit(" issue(s)")))
    notes = F.concat(
        F.array(say(high, " high-severity issue(s) to review before publishing")), by_type,
        F.array(say(regressions, " issue(s) appeared only after correction"), say(borderline, " issue(s) just below the auto-fix threshold")),
    )
    kept = F.filter(notes, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("No outstanding issues")))


def report_recommendations(critical: Column, pending: Column, missing_images: Column, tables: Column, total: Column) -> Column:
    """A32 of the dashboard's report."""
    say = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(text)))
    notes = F.array(
        say(critical, " critical issue(s) need manual review"), say(pending, " correction(s) wait for a decision"), say(missing_images, " image(s) are absent"),
        F.when(tables > 0, F.lit("Table structure differs")), F.when(total == 0, F.lit("No issues detected")),
    )
    return F.filter(notes, lambda x: x.isNotNull())


def shares(df: DataFrame, value: str) -> DataFrame:
    """Counts by value and their share of all, to six digits; the window runs over a row per value."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def type_ranking(df: DataFrame, value: str) -> DataFrame:
    """Values that occur, the commonest first, with the bar width relative to it; windows run over a row per value."""
    counts = df.groupBy(value).agg(F.count("*").alias("n")).where("n > 0")
    return counts.withColumns({"place": F.row_number().over(W.orderBy(F.desc("n"), value)), "bar": F.round(F.col("n") / F.greatest(F.lit(1), F.max("n").over(W.partitionBy())), 6)})
