"""Operators over rows in an order (W1-W22): windows, folds and sequences.

Every operator takes the columns of a group (``keys``) and of a total order.
Where a group may be large, running values are found in two steps, in blocks of
a group and over a row per block, so that no task holds a whole group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_BEFORE = (W.unboundedPreceding, -1)
_AFTER = (1, W.unboundedFollowing)


def dense_levels(size: Column, keys: list[str], most: int = 6, missing: int = 3) -> Column:
    """Rank of a size among the group's distinct ones, the largest first, up to ``most``; a null size has level ``missing``."""
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(size.desc_nulls_last()))
    return F.when(size.isNull(), missing).otherwise(F.least(F.lit(most), rank)).cast("int")


def numbering_depth(title: Column) -> Column:
    """W1's override: 3 for ``2.3.1 Title``; null without a number."""
    number = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)\.?\s", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def level_jumps(df: DataFrame, keys: list[str], order: list[str], level: str) -> DataFrame:
    """Rows whose level is over one more than that of the row before, which is in ``previous_level``."""
    previous = F.lag(level).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous_level", previous).where((F.col("previous_level") != 0) & (F.col(level) > F.col("previous_level") + 1))


def nearest_smaller(df: DataFrame, keys: list[str], order: list[str], level: str, id_: str, levels: range = range(1, 7), name: str = "parent") -> DataFrame:
    """For every row the last row before it of a smaller level, null without one.

    Levels are few and known, so there is a running last row for each, in one
    window; of those below a row's level the latest is its parent.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("__n", F.row_number().over(w))
    last = [F.last(F.when(F.col(level) == k, F.struct("__n", F.col(id_).alias("id"))), ignorenulls=True).over(w.rowsBetween(*_BEFORE)) for k in levels]
    numbered = numbered.withColumn("__last", F.array(*last))
    smaller = F.filter("__last", lambda x, i: x.isNotNull() & (i + levels.start < F.col(level)))
    return numbered.withColumn(name, F.array_max(smaller)["id"]).drop("__n", "__last")


def carried_forward(value: Column, is_mark: Column, keys: list[str], order: list) -> Column:
    """The value of the last marked row up to the row itself."""
    return F.last(F.when(is_mark, value), ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def increasing_members(values: list) -> list[int]:
    """Places of a longest strictly increasing subsequence: of several, the one that ends least and, going back, holds the latest fit."""
    ends: list[int] = []  # place of the least end for each length
    keys: list = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(keys, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(ends):
            ends.append(i)
            keys.append(v)
        else:
            ends[k], keys[k] = i, v
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def longest_increasing(values: Column) -> Column:
    """W5 of an array column: the places, from 0, of its members; null and empty arrays have none."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in parts:
            yield pa.array([increasing_members(x or []) for x in a.to_pylist()], pa.list_(pa.int32()))

    return arrow_udf(run, "array<int>")(values)


def in_order_array(order: Column, value: Column) -> Column:
    """Aggregate: the group's values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x.v)


def out_of_order(df: DataFrame, keys: list[str], order: str, position: str, id_: str) -> DataFrame:
    """Rows that aren't in the group's longest increasing subsequence of ``position`` and don't come first.

    ``rank`` is the row's place in the order from 0, ``expected_after`` the id
    of the row before it. A group is one document's sequence.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(position).alias("p"), F.col(id_).alias("id")))).alias("__rows"))
    rows = rows.withColumn("__keep", longest_increasing(F.transform("__rows", lambda r: r.p)))
    each = rows.select(*keys, "__rows", "__keep", F.posexplode("__rows").alias("rank", "__row"))
    return each.where((F.col("rank") > 0) & ~F.array_contains("__keep", F.col("rank"))).select(*keys, F.col("__row.id").alias(id_), "rank", F.col("__row.p").alias(position), F.expr("__rows[rank - 1].id").alias("expected_after"))


def first_after_cap(issues: DataFrame, taken: int, keys: list[str], order: list[str], cap: int = 25) -> DataFrame:
    """W16's cap: as many rows of a group, in order, as ``cap`` leaves once ``taken`` are reported."""
    return issues.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= max(0, cap - taken)).drop("__n")


def later_occurrences(df: DataFrame, key: Column, order: Column, id_: str) -> DataFrame:
    """Rows whose key came before in the order, with the first one's id in ``first_id``; null keys have no duplicates.

    Keys are shuffled as strong digests, and a hot key is one row per task before the join.
    """
    rows = df.where(key.isNotNull()).select("*", F.unhex(F.sha2(key.cast("string"), 256)).alias("__digest"), order.alias("__order"))
    first = rows.groupBy("__digest").agg(F.min(F.struct("__order", F.col(id_).alias("id"))).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return rows.join(first, "__digest").where(F.col("__order") > F.col("__first.__order")).withColumn("first_id", F.col("__first.id")).drop("__digest", "__order", "__first")


def sessions(starts: Column, keys: list[str], order: list) -> Column:
    """Numbers from 1 of runs, each of which begins where ``starts`` holds; the first row begins one."""
    w = W.partitionBy(*keys).orderBy(*order)
    return F.sum(F.when(F.coalesce(starts, F.lit(True)) | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))


def paragraph_breaks(top: str, bottom: str, x0: str, size: str, keys: list[str], order: list[str]) -> Column:
    """W8's rule: a gap over 0.85 of the height of the line before, a size that differs by over 1, or an indent by over 18 and 1.5 of that height."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    height = F.greatest(F.lit(1.0), before(bottom) - before(top))
    gap = F.col(top) - before(bottom)
    return (gap > 0.85 * height) | (F.abs(F.col(size) - before(size)) > 1) | (F.abs(F.col(x0) - before(x0)) > F.greatest(F.lit(18.0), 1.5 * height))


def overstruck(chars: DataFrame, keys: list[str], order: list[str], near: float = 0.6) -> DataFrame:
    """Groups of six characters or more of which 40 % repeat the one before within ``near`` points, and their text with pairs collapsed.

    Columns of ``chars``: char, x0, top. Returns keys, ``doubled`` and ``text``.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    twin = (F.lag("char").over(w) == F.col("char")) & (F.abs(F.lag("x0").over(w) - F.col("x0")) < near) & (F.abs(F.lag("top").over(w) - F.col("top")) < near)
    rows = chars.select("*", F.coalesce(twin, F.lit(False)).alias("__twin"), F.row_number().over(w).alias("__n"))
    lines = rows.groupBy(*keys).agg(in_order_array(F.col("__n"), F.col("char")).alias("__chars"), F.count_if("__twin").alias("__twins"), F.count("*").alias("__all"))
    doubled = (F.col("__all") >= 6) & (F.col("__twins") >= 0.4 * F.col("__all"))
    raw = F.array_join("__chars", "")
    return lines.select(*keys, doubled.alias("doubled"), F.when(doubled, F.regexp_replace(raw, r"(?s)(.)\1", "$1")).otherwise(raw).alias("text"))


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: Column) -> DataFrame:
    """Spans merged unless a gap of over ``gap`` is between them: keys, island, start, end and n_spans of each."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(*_BEFORE))
    marked = df.withColumn("__new", F.coalesce(F.col(start) - reach > gap, F.lit(True)).cast("int"))
    numbered = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans"))


def column_count(spans: DataFrame, keys: list[str], page_width: str, gap: float = 0.06, least: float = 0.15) -> DataFrame:
    """Columns of a page: islands of text spans (x0, x1) that are wider than 15 % of it, at least one."""
    merged = islands(spans.where("x1 > x0"), [*keys, page_width], "x0", "x1", F.col(page_width) * gap)
    return merged.groupBy(*keys).agg(F.greatest(F.lit(1), F.count_if(F.col("x1") - F.col("x0") > F.col(page_width) * least)).cast("long").alias("n_columns"))


def continuous_numbers(df: DataFrame, name: str, order: str, start: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Distinct names numbered by their first appearance, and the number with two digits or more in ``label``. Windows run over distinct names."""
    keys = keys or []
    first = df.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min(order).alias("first_at"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("first_at", name)) + (start - 1)
    return first.withColumn("number", number.cast("long")).withColumn("label", F.format_string("%02d", F.col("number")))


def reading_order(page: Column, top: Column, x0: Column, grid: float = 6.0) -> list[Column]:
    """Page, line of a grid of six points (halves to even), left edge; rows without a box come first on their page."""
    return [F.coalesce(page, F.lit(0)), F.coalesce(F.rint(top / grid), F.lit(0.0)), F.coalesce(x0, F.lit(0.0))]


def reading_stream(texts: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Elements (page, top, x0, element_id) of three tables in one order, text before others at one place: ``stream`` from 1 in a page."""
    every = texts.withColumn("kind", F.lit("text")).unionByName(figures.withColumn("kind", F.lit("figure"))).unionByName(tables.withColumn("kind", F.lit("table")))
    w = W.partitionBy("page").orderBy("top", "x0", F.when(F.col("kind") == "text", 0).otherwise(1), "element_id")
    return every.withColumn("stream", F.row_number().over(w))


def pairs_with_next(is_first: Column, is_second: Column, keys: list[str], order: list) -> Column:
    """True where a row begins a pair with the next. A row that could also end one begins none if the row before took it.

    Rows that begin stand in runs; in a run of rows that both begin and end
    pairs, the first, third and so on begin one.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    begins = F.coalesce(is_first & F.lead(is_second).over(w), F.lit(False))
    run = F.row_number().over(w) - F.coalesce(F.last(F.when(~begins, F.row_number().over(w)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return begins & (run % 2 == 1)


def section_extent(df: DataFrame, keys: list[str], order: str, level: str, levels: range = range(1, 7)) -> DataFrame:
    """``extent_end``, the order of the last row before the next heading of the same or a smaller level; null for rows that aren't headings."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(*_AFTER)
    following = F.array(*(F.min(F.when(F.col(level) <= k, F.col(order))).over(w) for k in levels))
    last = F.max(order).over(W.partitionBy(*keys))
    rows = df.withColumns({"__next": following, "__last": last})
    inside = F.col("__next")[F.col(level) - levels.start]
    return rows.withColumn("extent_end", F.when(F.col(level).isNotNull(), F.coalesce(inside - 1, F.col("__last")))).drop("__next", "__last")


def insertion_chain(df: DataFrame, anchor: str, order: list[str]) -> DataFrame:
    """``chain``, the place from 1 of an insertion among those with its anchor, in input order."""
    return df.withColumn("chain", F.row_number().over(W.partitionBy(anchor).orderBy(*order)))


def inversions(values: Column, cap: int = 200) -> Column:
    """W22 of an array: pairs of places (i, j), i before j, whose values are in the wrong order, the first ``cap`` by (i, j)."""
    places = F.transform(values, lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("v")))
    pairs = F.flatten(F.transform(places, lambda a: F.transform(F.filter(places, lambda b: (b.i > a.i) & (b.v < a.v)), lambda b: F.struct(a.i.alias("i"), b.i.alias("j")))))
    return F.slice(pairs, 1, cap)


def asof_either_way(df: DataFrame, keys: list[str], order: str, is_anchor: Column, value: Column, block: int = 4096, name: str = "anchor") -> DataFrame:
    """Value of the nearest anchor before a row, else of the nearest after it, else null; a row isn't its own anchor.

    ``order`` is a whole number, unique in a group. Values are found inside
    blocks of it and carried over a row per block, so a hot group is many tasks'.
    """
    rows = df.withColumns({"__block": F.floor(F.col(order) / F.lit(block)), "__mark": F.when(is_anchor, value)})
    ends = rows.where("__mark is not null").groupBy(*keys, "__block").agg(F.max(F.struct(order, "__mark")).alias("hi"), F.min(F.struct(order, "__mark")).alias("lo"))
    every = rows.select(*keys, "__block").distinct().join(ends, [*keys, "__block"], "left")
    across = W.partitionBy(*keys).orderBy("__block")
    carried = every.select(
        *keys, "__block",
        F.last("hi.__mark", ignorenulls=True).over(across.rowsBetween(*_BEFORE)).alias("__earlier"),
        F.first("lo.__mark", ignorenulls=True).over(across.rowsBetween(*_AFTER)).alias("__later"),
    )
    inside = W.partitionBy(*keys, "__block").orderBy(order)
    near = rows.withColumns({
        "__before": F.last("__mark", ignorenulls=True).over(inside.rowsBetween(*_BEFORE)),
        "__after": F.first("__mark", ignorenulls=True).over(inside.rowsBetween(*_AFTER)),
    })
    found = near.join(carried, [*keys, "__block"])
    return found.withColumn(name, F.coalesce("__before", "__earlier", "__after", "__later")).drop("__block", "__mark", "__before", "__after", "__earlier", "__later")


def nearest_within(df: DataFrame, other: DataFrame, keys: list[str], at: str, other_at: str, low: float, high: float, other_id: str, bin_size: float) -> DataFrame:
    """For every row of ``df`` the row of ``other`` in [at + low, at + high) that is nearest to it, ties by id, in ``nearest``; null without one.

    An equi-join on bins: a row looks into the few bins that its band covers.
    """
    probes = df.withColumn("__bin", F.explode(F.sequence(F.floor((F.col(at) + low) / bin_size), F.floor((F.col(at) + high) / bin_size))))
    sides = other.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col(other_at).alias("__at"), F.col(other_id).alias("__id"), F.floor(F.col(other_at) / bin_size).alias("__of"))
    same = F.col("__bin") == F.col("__of")
    for k in keys:
        same &= F.col(k) == F.col(f"__k_{k}")
    gap = F.col("__at") - F.col(at)
    best = probes.join(sides, same).where((gap >= low) & (gap < high)).groupBy(*df.columns).agg(F.min(F.struct(F.abs(gap).alias("gap"), "__id")).alias("__best"))
    return df.join(best.select(*df.columns, F.col("__best.__id").alias("nearest")), df.columns, "left")


def gap_sessions(df: DataFrame, keys: list[str], at: str, id_: str, gap: int, block: int, name: str = "session") -> DataFrame:
    """W8 by time: numbers from 1 of a group's sessions, cut where more than ``gap`` passes; ``at`` is a whole number, ties go by ``id_``.

    Rows are numbered inside blocks of time and blocks by a row each, so a hot
    group is many tasks'.
    """
    inside = W.partitionBy(*keys, "__block").orderBy(at, id_)
    rows = df.withColumn("__block", F.floor(F.col(at) / F.lit(block))).withColumn("__previous", F.lag(at).over(inside))
    across = W.partitionBy(*keys).orderBy("__block")
    ends = rows.groupBy(*keys, "__block").agg(F.max(at).alias("__last")).withColumn("__before", F.lag("__last").over(across)).drop("__last")
    previous = F.coalesce("__previous", "__before")
    marked = rows.join(ends, [*keys, "__block"]).withColumn("__new", F.when(previous.isNull() | (F.col(at) - previous > gap), 1).otherwise(0))
    starts = marked.groupBy(*keys, "__block").agg(F.sum("__new").alias("__n"))
    offset = F.coalesce(F.sum("__n").over(across.rowsBetween(*_BEFORE)), F.lit(0))
    starts = starts.select(*keys, "__block", offset.alias("__offset"))
    running = F.sum("__new").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return marked.join(starts, [*keys, "__block"]).withColumn(name, (running + F.col("__offset")).cast("long")).drop("__block", "__previous", "__before", "__new", "__offset")
