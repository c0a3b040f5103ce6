"""Quotation linking: reply-ordered conversations without their quotes, in DataFrame functions alone.

A line's level is the number of ``>`` it starts with. Lines of one level that
follow one another without a blank line form a passage. Passages, and the lines
of passages of several lines, are normalised and hashed. A quoted hash (level 1
or more) is joined to the first message of the same conversation that states it
unquoted; only hashes, conversations and turns are shuffled for that, a row for
each distinct one. A hash without an original there is joined to its first
statement in another conversation, which is reported beside the reply tree and
isn't part of it. The reply tree is followed by doubling pointers, so rounds
grow with the logarithm of its depth. Conversations are put in reply order by
one sort over ranges, and positions are counted from the ranges' sizes, so that
a conversation of any length is many tasks'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialised, maybe_broadcast, prepare

#: A line above a quote that says whose it is.
ATTRIBUTION = r"(?i)\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
_MARKS = r"^(?:[ \t]*>)+"

_LINES = rf"""transform(split(coalesce(cast(text as string), ''), '\r?\n'), l -> struct(
  l as raw, length(translate(regexp_extract(l, r'{_MARKS}', 0), ' \t', '')) as level,
  trim(regexp_replace(lower(regexp_replace(l, r'{_MARKS}', '')), r'\s+', ' ')) as norm))"""
_STARTS = """filter(sequence(0, size(__lines) - 1), i -> __lines[i].norm <> '' and
  (i = 0 or get(__lines, i - 1).norm = '' or get(__lines, i - 1).level <> __lines[i].level))"""
_PASSAGES = """transform(__starts, (s, k) -> struct(__lines[s].level as level,
  filter(transform(slice(__lines, s + 1, coalesce(get(__starts, k + 1), size(__lines)) - s), x -> x.norm), n -> n <> '') as norms))"""
_UNITS = """array_distinct(flatten(transform(__passages, p -> transform(
  if(size(p.norms) > 1, concat(array(array_join(p.norms, ' ')), p.norms), p.norms), n -> struct(p.level as level, unhex(sha2(n, 256)) as hash)))))"""
_QUOTED = """transform(filter(__passages, p -> p.level > 0), p -> struct(p.level as level, array_join(p.norms, '\n') as passage))"""
_OWN = f"""trim(BOTH '\n' FROM array_join(transform(filter(__lines, (x, i) -> x.level = 0
  and not (x.raw rlike r'{ATTRIBUTION}' and coalesce(get(__lines, i + 1).level, 0) > 0)), x -> x.raw), '\n'))"""


def parsed(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, own_text, quoted, n_quotes, units)`` of every row; a null text counts as empty.

    ``quoted`` has level and normalised text of the quoted passages that
    ``own_text`` lacks, whether or not they link to an original.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    rows = rows.withColumn("__lines", F.expr(_LINES)).withColumn("__starts", F.expr(_STARTS)).withColumn("__passages", F.expr(_PASSAGES))
    return rows.select("conv_id", "turn", "role", F.expr(_OWN).alias("own_text"), F.expr(_QUOTED).alias("quoted"), F.expr("cast(size(filter(__passages, p -> p.level > 0)) as bigint)").alias("n_quotes"), F.expr(_UNITS).alias("units"))


def parents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, turn, parent_turn, n_linked)`` of the messages with a quote whose original is known, and ``elsewhere`` of the others.

    The original of a hash is the first turn of the conversation that states
    it. Of a message's linked hashes the least level decides, and on it the
    latest original.
    """
    keyed = rows.where("conv_id is not null and turn is not null")
    quotes = keyed.where("n_quotes > 0").select("conv_id", "turn", F.explode(F.expr("filter(units, u -> u.level > 0)")).alias("u")).groupBy("conv_id", "turn", F.col("u.hash").alias("hash")).agg(F.min("u.level").alias("level")).checkpoint()
    asked = quotes.select("conv_id", "hash").distinct()
    stated = keyed.select("conv_id", "turn", F.explode(F.expr("transform(filter(units, u -> u.level = 0), u -> u.hash)")).alias("hash"))
    first = stated.join(maybe_broadcast(asked, quotes.count()), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    linked = quotes.join(first, ["conv_id", "hash"]).where("original < turn").checkpoint()
    found = linked.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("original"))).alias("best"), F.count("*").alias("n_linked")).select("conv_id", "turn", (-F.col("best.col2")).alias("parent_turn"), "n_linked")
    return found, elsewhere(quotes.join(linked, ["conv_id", "turn", "hash"], "left_anti").checkpoint(), stated)


def elsewhere(quotes: DataFrame, stated: DataFrame) -> DataFrame:
    """``(conv_id, turn, n_elsewhere, other_conv_id, other_turn)`` of the quotes that another conversation states.

    The original of a hash is its first statement by (conv_id, turn) outside
    the quote's own conversation. Of a message's hashes the least level
    decides, and on it the first original. Statements are reduced to two rows
    per hash, the first and the first of another conversation.
    """
    asked = quotes.select("hash").distinct().checkpoint()
    many = asked.count()
    at = stated.join(maybe_broadcast(asked, many), "hash", "left_semi").groupBy("hash", "conv_id").agg(F.min("turn").alias("original")).select("hash", F.struct("conv_id", "original").alias("at")).checkpoint()
    one = at.groupBy("hash").agg(F.min("at").alias("one")).checkpoint()
    two = at.join(maybe_broadcast(one, many), "hash").where("at.conv_id <> one.conv_id").groupBy("hash").agg(F.min("at").alias("two"))
    firsts = one.join(two, "hash", "left")
    found = quotes.join(maybe_broadcast(firsts, many), "hash").withColumn("at", F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))).where("at is not null")
    best = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "at")).alias("best"), F.count("*").alias("n_elsewhere"))
    return best.select("conv_id", "turn", "n_elsewhere", F.col("best.at.conv_id").alias("other_conv_id"), F.col("best.at.original").alias("other_turn"))


def reply_tree(links: DataFrame) -> DataFrame:
    """``links`` with ``root_turn`` and ``depth``; parents precede their replies, so there are no cycles."""
    now = links.select("conv_id", "turn", "parent_turn", "n_linked", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")).checkpoint()
    while True:
        step = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("further"), F.col("depth").alias("more"))
        new = now.join(step, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", "parent_turn", "n_linked", F.coalesce("further", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"),
        ).checkpoint()
        now = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return now


def linked_conversations(messages: DataFrame) -> DataFrame:
    """Every row of ``messages`` without its quotes and with its place in the replies.

    Columns: conv_id, turn, role, own_text, quoted, formatted, n_quotes (quoted
    passages), n_linked (distinct quoted hashes with an original), parent_turn,
    root_turn, depth, n_elsewhere (distinct quoted hashes that only another
    conversation states before), other_conv_id, other_turn. The order (conv_id,
    root_turn, turn) puts every message after the one it answers. Rows that
    repeat a conversation and turn count as one message in links and come back
    each; rows without either link with nothing and are their own root. A null
    role is formatted as ``unknown``. Other columns are ignored.
    """
    prepare(messages.sparkSession)
    rows = materialised(parsed(messages), "messages")
    links, other = parents(rows)
    tree, other = reply_tree(links).checkpoint(), other.checkpoint()
    found = rows.drop("units").join(maybe_broadcast(tree, tree.count()), ["conv_id", "turn"], "left").join(maybe_broadcast(other, other.count()), ["conv_id", "turn"], "left")
    return found.select(
        "conv_id", "turn", "role", "own_text", "quoted",
        F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), "own_text", F.lit("<|im_end|>\n")).alias("formatted"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("n_elsewhere", F.lit(0)).alias("n_elsewhere"), "other_conv_id", "other_turn",
    )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Conversations in reply order: the rows of ``linked_conversations`` with ``position``, sorted by (conv_id, position).

    A thread stands after the threads of earlier roots and, within it, every
    message after the one it answers; position counts a conversation's messages
    from 0. Joined in this order, ``formatted`` is the conversation's text. Rows
    without a conversation have a position among themselves, those without a
    turn come first in theirs; rows that repeat a turn follow one another.
    """
    found = linked_conversations(messages).drop("position")
    order = [F.col("conv_id").asc_nulls_first(), F.col("root_turn").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("formatted").asc()]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    ranged = materialised(ranged, "ordered")
    # A row per conversation and range, so never many of one conversation.
    runs = ranged.groupBy("conv_id", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("conv_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("conv_id").alias("__conv"), F.col("__part").alias("__of"), "__first", before.alias("__before"))
    joined = ranged.join(runs, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__part") == F.col("__of")))
    return joined.withColumn("position", F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__at", "__conv", "__of", "__first", "__before")
