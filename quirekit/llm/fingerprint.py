"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph cells.

Sketches of two versions subtract cell by cell; peeling the difference recovers
the digests of the paragraphs in which they differ. Where peeling stops early,
it is tried again with larger sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import maybe_broadcast, mix64, prepare

#: Cells of the sketch that is the fingerprint, in three parts.
CELLS = 24
#: Within a line a cell ends after a word whose hash is a multiple of this, so long paragraphs have several.
CELL_WORDS = 8
#: Bytes of text that a task is sized for.
TASK_BYTES = 16 << 20
#: Parts of the documents' order, at most; beyond that a task streams through more than ``TASK_BYTES``.
MOST_PARTS = 8192
#: Where null ids stand in the order, after all others.
_NULL_ID = -(2**63)

_SALT = np.uint64(0x9E3779B97F4A7C15)
_CHECK = np.uint64(0xD6E8FEB86659FD93)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


class _Tokens(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_LINE_END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def digests(text: str | None, tokens: _Tokens) -> np.ndarray:
    """Sorted digests of the text's paragraph cells, alike cells told apart by their number. Empty and null texts have none."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").replace(b"\n", b" \n ").split(b" ")
    h = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    ends = ((h & np.uint64(CELL_WORDS - 1)) == 0) | (h == _LINE_END)
    starts = np.concatenate(([0], np.flatnonzero(ends[:-1]) + 1))
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(h)))).astype(np.uint64)
    cells = np.sort(mix64(np.add.reduceat(mix64(h + place * _SALT), starts)))
    first = np.searchsorted(cells, cells)
    return np.sort(mix64(cells + (np.arange(len(cells)) - first).astype(np.uint64) * _SALT))


class Sketch:
    """Counts, key sums and check sums of cells; each key is in one cell of each of three parts."""

    __slots__ = ("counts", "keys", "checks", "seed")

    def __init__(self, counts: np.ndarray, keys: np.ndarray, checks: np.ndarray, seed: int):
        self.counts, self.keys, self.checks, self.seed = counts, keys, checks, seed

    @staticmethod
    def places(keys: np.ndarray, cells: int, seed: int) -> np.ndarray:
        """A row for each part, with the cell of every key."""
        part = cells // 3
        h = mix64(keys ^ np.uint64((seed + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
        at = np.empty((3, len(keys)), np.uint64)
        np.bitwise_and(h, _LOW, out=at[0])
        np.right_shift(h, _HALF, out=at[1])
        np.bitwise_and(at[0] + at[1] * _SALT, _LOW, out=at[2])
        at *= np.uint64(part)
        at >>= _HALF
        at[1] += np.uint64(part)
        at[2] += np.uint64(2 * part)
        return at.view(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, cells: int = CELLS, seed: int = 0) -> Sketch:
        at, marks = cls.places(keys, cells, seed).ravel(), mix64(keys ^ _CHECK)
        sums, checks = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        np.add.at(sums, at, np.concatenate((keys, keys, keys)))
        np.add.at(checks, at, np.concatenate((marks, marks, marks)))
        return cls(np.bincount(at, minlength=cells), sums, checks, seed)

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.counts - other.counts, self.keys - other.keys, self.checks - other.checks, self.seed)

    def text(self) -> str:
        """The sketch as base64 of its cells: counts of 4 bytes, key sums of 8, check sums of 4."""
        return base64.b64encode(self.counts.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + (self.checks >> np.uint64(32)).astype("<u4").tobytes()).decode()

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys with count +1 and with count -1, or None where some can't be told."""
        counts, sums, checks = self.counts.copy(), self.keys.copy(), self.checks.copy()
        plus, minus = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for _ in range(len(counts) + 1):
            one = np.flatnonzero(np.abs(counts) == 1)
            if not len(one):
                return None if counts.any() or sums.any() or checks.any() else (np.concatenate(plus), np.concatenate(minus))
            sign = counts[one]
            keys = np.where(sign == 1, sums[one], -sums[one])
            mark = mix64(keys ^ _CHECK)
            pure = np.where(sign == 1, checks[one], -checks[one]) == mark
            keys, at = np.unique(keys[pure], return_index=True)
            if not len(keys):
                return None
            sign, mark = sign[pure][at], mark[pure][at]
            plus.append(keys[sign == 1])
            minus.append(keys[sign == -1])
            places = self.places(keys, len(counts), self.seed).ravel()
            keys, mark = np.where(sign == 1, keys, -keys), np.where(sign == 1, mark, -mark)
            np.subtract.at(counts, places, np.concatenate((sign, sign, sign)))
            np.subtract.at(sums, places, np.concatenate((keys, keys, keys)))
            np.subtract.at(checks, places, np.concatenate((mark, mark, mark)))
        return None


def difference(a: np.ndarray, b: np.ndarray, base: Sketch | None = None, tries: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in ``a`` and only in ``b``, from sketches alone.

    ``base`` is the difference of the fingerprints where it is known. When it
    doesn't peel, sketches follow that hold all digests, each twice as large as
    the one before; should ``tries`` of these fail, the sets are compared.
    """
    # More differences than cells can't peel.
    found = (base or Sketch.of(a) - Sketch.of(b)).peel() if abs(len(a) - len(b)) <= CELLS else None
    cells = 3 * (8 + (len(a) + len(b)) * 24 // 30)
    for seed in range(1, tries + 1):
        if found is not None:
            return found
        found = (Sketch.of(a, cells, seed) - Sketch.of(b, cells, seed)).peel()
        cells *= 2
    return found if found is not None else (np.setdiff1d(a, b), np.setdiff1d(b, a))


def likeness(a: np.ndarray, b: np.ndarray, base: Sketch | None = None) -> float:
    """Share of the cells of both texts that are common to them; 1 for two texts without cells."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    left, right = difference(a, b, base)
    return (total - len(left) - len(right)) / total


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and, in it, in order; the row after a part's last one is marked as extra."""
    tokens = _Tokens()
    held: tuple | None = None
    for batch in batches:
        rows = []
        for part, extra, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if extra and held is None:
                continue
            own = digests(text, tokens)
            now = (part, doc, text, own, Sketch.of(own))
            if held is not None and held[0] == part:
                _, before, old, keys, sketch = held
                m = len(old) // 3
                edited = old[: len(old) - m] + text[:m]
                changed = digests(edited, tokens)
                other = Sketch.of(changed)
                rows.append((
                    before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), sketch.text(), other.text(),
                    likeness(keys, changed, sketch - other), likeness(keys, own, sketch - now[4]),
                ))
            held = None if extra else now
        columns = zip(*rows, strict=True) if rows else [()] * len(_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``(part, extra, doc_id, text)`` such that every document stands before its next one.

    Order is by descending doc_id, null ids last, equal ids by a hash of the
    text; after the last comes the first. Documents are dealt out by quantiles
    of doc_id, so a part has an even share; an id (null too) that several
    quantiles have in common is dealt over their parts by its texts' hashes. The
    first document of each part is sent to the part before it as well. Of the
    parts, which are bounded, one row each comes to the driver.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = texts.withColumns({"key": F.coalesce("doc_id", F.lit(_NULL_ID)), "hash": F.xxhash64("text")})
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, int(total // TASK_BYTES) + 1)
    cuts = keyed.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    splits = np.sort(np.array(cuts or [], np.int64))

    def part_of(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(parts_of(splits, keys.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)), pa.int32())

    part_of.__annotations__ = {"keys": pa.Array, "hashes": pa.Array, "return": pa.Array}
    dealt = keyed.withColumn("part", arrow_udf(part_of, "int")("key", "hash"))
    # The first document of each part that has rows; parts in the documents' order.
    heads = sorted((r.part, *r.head) for r in dealt.groupBy("part").agg(F.min(F.struct(F.bitwise_not("key").alias("k"), "hash")).alias("head")).collect())[::-1]
    moves = [(heads[i][0], ~heads[(i + 1) % len(heads)][1], heads[(i + 1) % len(heads)][2]) for i in range(len(heads))]
    extra = spark.createDataFrame(moves, "part int, key long, hash long")
    sent = keyed.join(maybe_broadcast(extra, len(moves)), ["key", "hash"]).select("part", F.lit(True).alias("extra"), "doc_id", "text")
    own = dealt.select("part", F.lit(False).alias("extra"), "doc_id", "text")
    order = ["part", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"]
    return own.union(sent).repartitionById(len(splits) + 1, "part").sortWithinPartitions(*order)


def parts_of(splits: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Parts of documents, the last in order first; a key that stands for several splits is dealt over their parts, lesser hashes to later ones."""
    low, high = np.searchsorted(splits, keys, "left"), np.searchsorted(splits, keys, "right")
    share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    many = np.maximum(high - low, 1)
    return low + many - 1 - np.minimum((share * many).astype(np.int64), many - 1)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, a row per row of ``docs``.

    The edited text has its last third (rounded down) of code points replaced
    by as many first ones of the next document, or by all of these. Null texts
    count as empty. Equal texts have equal fingerprints.
    """
    return with_next(docs).mapInArrow(_follow, _OUT_SQL)
