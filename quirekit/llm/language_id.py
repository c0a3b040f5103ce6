"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import held_out, prepare

#: Buckets of hashed n-grams.
BUCKETS = 1 << 15
#: Lengths of the n-grams in code points.
ORDERS = (1, 2, 3)
#: Labelled rows that training takes at most of each language, those whose ids hash least.
MAX_TRAIN_ROWS = 2000
#: Languages that are counted, and held in one matrix, at a time; any number of blocks makes up a model.
LANGUAGE_BLOCK = 64
#: Parts of a language's ids that are ranked apart where there is more than one block.
RANK_PARTS = 64
#: Answer for texts that are null or have no letter.
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_SLAB = 1 << 20


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-cased text between two blanks, in slabs of bounded size.

    White space counts as one blank each. Slabs overlap so that no n-gram is lost or counted twice.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = np.where((points >= 9) & (points <= 13), np.uint64(32), points)
    for start in range(0, len(points), _SLAB):
        for n in ORDERS:
            part = points[start : start + _SLAB + n - 1]
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, np.uint64)
                for j in range(n):
                    h = (h ^ part[j : len(part) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield (h >> np.uint64(32)) & np.uint64(BUCKETS - 1)


@dataclass
class Model:
    """Matrices ``[bucket, language]`` of log-probabilities, one per block of languages, and the logarithms of the languages' shares."""

    langs: list[str]
    logp: list[np.ndarray]
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Answers for a batch: n-grams of many texts make a sparse matrix, whose rows are summed text by text."""
        total = np.tile(self.prior, (len(texts), 1))
        asked = [i for i, t in enumerate(texts) if self.langs and t is not None and _LETTER.search(t)]
        parts: list[np.ndarray] = []
        rows: list[int] = []
        held = 0

        def add() -> None:
            nonlocal held
            index = np.concatenate(parts).astype(np.int64)
            starts = np.cumsum([0, *map(len, parts[:-1])])
            at = 0
            for block in self.logp:
                sums = np.add.reduceat(np.take(block, index, axis=0), starts, axis=0, dtype=np.float64)
                np.add.at(total, (np.array(rows)[:, None], np.arange(at, at + block.shape[1])), sums)
                at += block.shape[1]
            parts.clear(), rows.clear()
            held = 0

        most = max(1, 2 * _SLAB // max((b.shape[1] for b in self.logp), default=1))  # bounds the rows taken at once
        for i in asked:
            for g in grams(texts[i]):
                for start in range(0, len(g), most):
                    parts.append(g[start : start + most])
                    rows.append(i)
                    held += len(parts[-1])
                    if held >= most:
                        add()
        if parts:
            add()
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for i in asked:
            best = int(total[i].argmax())  # the first in order where several are best
            out[i] = self.langs[best], float(1 / np.exp(total[i] - total[i][best]).sum())
        return out


_COUNT_SQL = "lang string, rows long, counts binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            rows[lang] = rows.get(lang, 0) + 1
            for g in grams(text):
                own += np.bincount(g.astype(np.int64), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([rows[k] for k in counts], pa.int64()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["lang", "rows", "counts"])


def _sum(t: pa.Table) -> pa.Table:
    counts = np.sum([np.frombuffer(c, np.int64) for c in t.column("counts").to_pylist()], axis=0)
    return pa.table({"lang": t.column("lang")[:1].combine_chunks(), "rows": pa.array([sum(t.column("rows").to_pylist())], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, alpha: float = 0.5, tasks: int = 8) -> Model:
    """A model from rows outside the held-out fold with text, lang and doc_id.

    Takes at most ``max_rows`` whole texts of each language, those whose ids
    hash least; ids and languages alone are ranked, in parts first so that no
    language is one task's. N-grams are counted and summed on the executors,
    block by block of languages, in ``tasks`` tasks since the sample is bounded;
    one row per language of the block comes to the driver.
    """
    prepare(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id"), 4, 2))
    ids = known.select("doc_id", "lang").distinct()
    langs = [r.lang for r in ids.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return Model([], [], np.zeros(0))
    blocks = [langs[i : i + LANGUAGE_BLOCK] for i in range(0, len(langs), LANGUAGE_BLOCK)]
    least = _least(ids, max_rows)
    if len(blocks) == 1:  # the sample's ids are bounded by max_rows and the block
        texts = [known.join(F.broadcast(least), ["doc_id", "lang"], "left_semi").select("lang", "text")]
    else:
        sample = known.join(least, ["doc_id", "lang"], "left_semi").select("lang", "text").checkpoint()
        texts = [sample.where(F.col("lang").between(b[0], b[-1])) for b in blocks]
    logp, shares = [], []
    for own, part in zip(blocks, texts, strict=True):
        counts, rows, at = np.zeros((BUCKETS, len(own))), np.zeros(len(own)), {lang: i for i, lang in enumerate(own)}
        for r in part.repartition(tasks).mapInArrow(_count, _COUNT_SQL).groupBy("lang").applyInArrow(_sum, _COUNT_SQL).collect():
            counts[:, at[r.lang]] += np.frombuffer(bytes(r.counts), np.int64)
            rows[at[r.lang]] += r.rows
        logp.append((np.log(counts + alpha) - np.log(counts.sum(0) + alpha * BUCKETS)).astype(np.float32))
        shares.append(rows + 1)
    share = np.concatenate(shares)
    return Model(langs, logp, np.log(share) - np.log(share.sum()))


def _least(ids: DataFrame, max_rows: int) -> DataFrame:
    """The rows of each language whose ids hash least, ranked in parts first so that no language is one task's."""
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = ids.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS)))
    for key in (("lang", "part"), ("lang",)):
        parts = parts.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= max_rows)
    return parts.select("doc_id", "lang")


def predictor(spark: SparkSession, model: Model):
    """A column function of text that gives ``struct(lang_pred, score)``."""
    shared = spark.sparkContext.broadcast((model.langs, model.logp, model.prior))

    @arrow_udf("struct<lang_pred: string, score: double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        for texts in parts:
            found = m.predict([t.as_py() for t in texts])
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    return predict


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which depend on text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text where there was nothing to learn from. Every row comes back once.
    """
    prepare(docs.sparkSession)
    found = docs.withColumn("__lang", predictor(docs.sparkSession, model)(F.col("text").cast("string")))
    return found.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")
