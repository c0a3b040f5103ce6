"""One-to-one matching of images by their hashes (J2), without a row per pair.

Pairs are scored in blocks, of which each image keeps its best candidates. A
group is then matched from these lists; an image whose candidates are all taken
is compared with those that are left, so no pair is lost to the lists' bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import hashing

#: Images of either side in a block.
SOURCES, TARGETS = 1024, 8192
#: Candidates listed for an image.
LISTED = 32
#: Pairs scored at once.
PAIRS = 1 << 20

_NONE = np.iinfo(np.int64).max


def ranks(spark, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Place of every two distances (of 65 each) among the distinct scores by H5, the best first, and these scores; distances that miss the threshold come after them."""
    none, one, zero = F.lit(None).cast("string"), F.lit(1.0), F.lit("0" * 16)
    ones = F.array(*(F.lit(f"{(1 << i) - 1:016x}") for i in range(65)))
    far = lambda n: F.get(ones, n.cast("int"))
    score = hashing.image_score(none, none, zero, far(F.col("id") / 65), zero, far(F.col("id") % 65), one, one, one, one)
    found = np.array([x for (x,) in spark.range(0, 65 * 65, 1, 1).select(score).collect()])
    scores = np.unique(found[found >= threshold])[::-1]
    return np.where(found >= threshold, np.searchsorted(-scores, -found), len(scores)).astype(np.int64), scores


def best(p: np.ndarray, d: np.ndarray, tp: np.ndarray, td: np.ndarray, table: np.ndarray, n_scores: int, listed: int) -> np.ndarray:
    """The ``listed`` best targets of each image as rank * targets + place in order, ``_NONE`` where there are fewer."""
    n, k = len(tp), min(listed, len(tp))
    out = np.full((len(p), listed), _NONE)
    step = max(1, PAIRS // max(1, n))
    for i in range(0, len(p) if k else 0, step):
        at = np.bitwise_count(p[i : i + step, None] ^ tp).astype(np.uint16) * 65 + np.bitwise_count(d[i : i + step, None] ^ td)
        keys = table[at] * n + np.arange(n)
        keys = np.sort(np.partition(keys, k - 1, axis=1)[:, :k] if k < n else keys, axis=1)
        out[i : i + step, :k] = np.where(keys < n_scores * n, keys, _NONE)
    return out


def _columns(rows: pa.StructArray) -> list[np.ndarray]:
    """Ids and both hashes; a hash that is missing is an error."""
    ids, p, d = (rows.field(i).to_numpy(zero_copy_only=True) for i in range(3))
    return [ids, p.view(np.uint64), d.view(np.uint64)]


def settled(sources: list[np.ndarray], targets: list[np.ndarray], lists: np.ndarray, table: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Matches of one group, the best score first, then the smaller source, then the smaller target.

    Both sides come in the order of their ids; ``lists`` has the best targets of
    every source. The heap holds each free source's best target that was free
    when it was looked up, so what is on top and still free is the best of all.
    """
    ids, p, d = sources
    tids, tp, td = targets
    n, listed = len(tids), lists.shape[1]
    source = np.unique(ids, return_inverse=True)[1].tolist()
    target = np.unique(tids, return_inverse=True)[1]
    taken = np.zeros(n, bool)
    left, done, out = np.arange(n), set(), []
    rest: list = [None] * len(ids)
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        nonlocal left
        while True:
            while rest[i]:
                rank, at = divmod(rest[i].pop(), n)
                if not taken[target[at]]:
                    heapq.heappush(heap, (rank, source[i], at, i))
                    return
            if not full[i]:
                return
            left = left[~taken[target[left]]]
            keys = best(p[i : i + 1], d[i : i + 1], tp[left], td[left], table, len(scores), listed)[0]
            keys = keys[keys != _NONE]
            full[i] = len(keys) == listed
            rest[i] = [r * n + int(left[at]) for r, at in (divmod(x, len(left)) for x in keys.tolist())][::-1]

    sizes = (lists != _NONE).sum(axis=1).tolist()
    full = [size == listed for size in sizes]
    for i, size in enumerate(sizes):
        rest[i] = lists[i, :size][::-1].tolist()
        push(i)
    while heap:
        rank, s, at, i = heapq.heappop(heap)
        if s in done:
            continue
        if taken[target[at]]:
            push(i)
            continue
        done.add(s)
        taken[target[at]] = True
        out.append((int(ids[i]), int(tids[at]), float(scores[rank])))
    return out


def match_hashed(source: DataFrame, target: DataFrame, keys: list[str], threshold: float = 0.75, listed: int = LISTED, blocks: tuple[int, int] = (SOURCES, TARGETS)) -> DataFrame:
    """J2 of images (keys, s or t, phash, dhash) of one shape, both hashes known: keys, s, t and score of those matched one to one; ties go to the smaller s, then the smaller t.

    Ids are longs. Scoring, whose work grows with the product of a group's
    sides, is dealt in blocks; one task then holds the hashes of a group and the
    lists of its images.
    """
    table, scores = ranks(source.sparkSession, threshold)
    bits = lambda c: F.conv(F.col(c), 16, -10).cast("long")

    def packed(side: DataFrame, id_: str, block: str, most: int, name: str) -> tuple[DataFrame, DataFrame]:
        """Blocks of a side, and the numbers of all blocks of each group."""
        side = side.where(F.col(id_).isNotNull())
        n = side.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("__n"))
        rows = side.select(*keys, F.struct(F.col(id_).cast("long").alias("id"), bits("phash").alias("p"), bits("dhash").alias("d")).alias("row"))
        dealt = rows.join(n, keys).withColumn(block, F.pmod(F.xxhash64("row.id"), F.col("__n")).cast("int"))
        return dealt.groupBy(*keys, block).agg(F.array_sort(F.collect_list("row")).alias(name)), n.select(*keys, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias(block))

    (a, all_a), (b, all_b) = packed(source, "s", "__a", blocks[0], "__left"), packed(target, "t", "__b", blocks[1], "__right")
    left, right = a.join(all_b, keys), b.join(all_a, keys)
    pairs = left.join(right, [*keys, "__a", "__b"]).select(*keys, "__a", "__b", "__left", "__right")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("__left"), batch.column("__right"), strict=True):
                (_, p, d), (_, tp, td) = _columns(x.values), _columns(y.values)
                found.append(best(p, d, tp, td, table, len(scores), listed).tobytes())
            # The images themselves are sent on once, not with each block of targets.
            first = [x if b == 0 else [] for x, b in zip(batch.column("__left").to_pylist(), batch.column("__b").to_pylist(), strict=True)]
            own = [batch.column(i) for i in range(len(keys) + 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first, batch.schema.field("__left").type), pa.array(found, pa.binary())], names=[*keys, "__a", "__b", "__left", "__lists"])

    key_fields = [pairs.schema[k] for k in keys]
    row_type = ArrayType(StructType([StructField(n, LongType()) for n in ("id", "p", "d")]))
    scored = pairs.mapInArrow(score, StructType([*key_fields, StructField("__a", IntegerType()), StructField("__b", IntegerType()), StructField("__left", row_type), StructField("__lists", BinaryType())]))

    def match(key: tuple, found: pa.Table, others: pa.Table) -> pa.Table:
        matches = _matched(found, others, listed, table, scores) if found.num_rows and others.num_rows else []
        columns = [pa.array([k.as_py()] * len(matches), k.type) for k in key]
        of = lambda i, t: pa.array([m[i] for m in matches], t)
        return pa.table([*columns, of(0, pa.int64()), of(1, pa.int64()), of(2, pa.float64())], names=[*keys, "s", "t", "score"])

    return scored.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(match, StructType([*key_fields, StructField("s", LongType()), StructField("t", LongType()), StructField("score", DoubleType())]))


def _matched(found: pa.Table, others: pa.Table, listed: int, table: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Puts a group's blocks together and matches it."""
    chunks = {b: _columns(rows.values) for b, rows in zip(others["__b"].to_pylist(), others["__right"], strict=True)}
    names = sorted(chunks)
    targets = [np.concatenate([chunks[b][i] for b in names]) for i in range(3)]
    order = np.argsort(targets[0], kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    starts = dict(zip(names, np.cumsum([0, *(len(chunks[b][0]) for b in names)])[:-1].tolist(), strict=True))
    blocks: dict[int, list] = {}
    for a, b, rows, lists in zip(found["__a"].to_pylist(), found["__b"].to_pylist(), found["__left"], found["__lists"], strict=True):
        block = blocks.setdefault(a, [None, []])
        if b == 0:
            block[0] = _columns(rows.values)
        keys = np.frombuffer(lists.as_py(), np.int64).reshape(-1, listed)
        rank, at = np.divmod(keys, len(chunks[b][0]))
        # Places in a block of targets become places among all.
        block[1].append(np.where(keys == _NONE, _NONE, rank * len(order) + place[np.where(keys == _NONE, 0, at) + starts[b]]))
    lists = np.concatenate([np.sort(np.concatenate(x, axis=1), axis=1)[:, :listed] for _, x in blocks.values()])
    sources = [np.concatenate([own[i] for own, _ in blocks.values()]) for i in range(3)]
    by = np.argsort(sources[0], kind="stable")
    return settled([x[by] for x in sources], [x[order] for x in targets], lists[by], table, scores)
