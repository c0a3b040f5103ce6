"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A score is ``sigmoid(w0 + sum(w x) + 1/2 sum_f((sum(v_f x))^2 - sum(v_f^2 x^2)))``;
the bracket gives all pairwise interactions in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import held_out, prepare

#: Buckets of hashed words.
WORD_BUCKETS = 1 << 14
#: Labelled rows that training takes at most, those whose ids hash least.
MAX_TRAIN_ROWS = 4096
#: Features that are scored in one batch; a longer text is a batch of its own.
BATCH_FEATURES = 100_000
#: A row is predicted 1 from this score on.
THRESHOLD = 0.3

#: Upper edges of the bins of each statistic, in their order in ``statistics``.
EDGES = {
    "log2_words": (1.5, 3, 4.5, 5.7, 7, 9, 11, 13),
    "word_length": (2, 3, 4, 5, 6, 7, 9, 13),
    "symbols_per_word": (0.002, 0.02, 0.05, 0.1, 0.3, 1, 2),
    "upper_share": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "digits_share": (0.001, 0.005, 0.02, 0.05, 0.1, 0.3),
    "shouts_per_word": (0.005, 0.05, 0.2, 0.5, 1),
    "same_as_previous": (0.005, 0.02, 0.05, 0.1, 0.3, 0.6),
    "distinct_share": (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95),
    "bars_per_word": (0.005, 0.05, 0.2, 0.5, 0.8),
    "lines_per_word": (0.005, 0.01, 0.02, 0.05, 0.1, 0.3),
    "repeated_lines": (0.001, 0.1, 0.2, 0.35, 0.5, 0.75),
    "stops_per_word": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "commas_per_word": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "commonest_share": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "log2_n_chars": (3, 5, 7, 8, 9, 10, 11, 12, 13, 15),
}
_BINS = max(map(len, EDGES.values())) + 2
N_FEATURES = WORD_BUCKETS + _BINS * len(EDGES)

_SYMBOL, _UPPER, _LOWER, _DIGIT, _SHOUT, _BAR, _STOP, _COMMA, _LINE = range(1, 10)
_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b"#*$%&|<>", _SYMBOL), (bytes(range(65, 91)), _UPPER), (bytes(range(97, 123)), _LOWER), (b"0123456789", _DIGIT), (b"!", _SHOUT), (b"|", _BAR), (b".", _STOP), (b",", _COMMA), (b"\n", _LINE)):
    _CLASS[list(_chars)] = _k


class _Buckets(dict):
    """Word buckets, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) & (WORD_BUCKETS - 1)
        return b


def features(text: str | None, n_chars: int | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a row's features. A null text counts as empty; a null n_chars has a bin of its own."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    n = len(words)
    at = np.fromiter(map(buckets.__getitem__, words), np.int64, n)
    index, counts = np.unique(at, return_counts=True)
    value = counts / np.sqrt((counts * counts).sum()) if n else counts.astype(float)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = kinds[_UPPER] + kinds[_LOWER]
    m = max(n, 1)
    stats = (
        np.log2(m) if n else -1.0, sum(map(len, words)) / m, (kinds[_SYMBOL] + kinds[_BAR]) / m, kinds[_UPPER] / max(letters, 1), kinds[_DIGIT] / max(len(data), 1), kinds[_SHOUT] / m,
        np.count_nonzero(at[1:] == at[:-1]) / m, len(index) / m, kinds[_BAR] / m, len(lines) / m, 1 - len(set(lines)) / max(len(lines), 1), kinds[_STOP] / m, kinds[_COMMA] / m,
        (counts.max() if n else 0) / m, None if n_chars is None or n_chars < 0 else np.log2(1 + n_chars),
    )
    bins = [WORD_BUCKETS + _BINS * i + (_BINS - 1 if s is None else int(np.searchsorted(e, s))) for i, (e, s) in enumerate(zip(EDGES.values(), stats, strict=True))]
    return np.concatenate([index, bins]), np.concatenate([value, np.full(len(bins), 0.5)])


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows whose features stand one after the other from ``starts`` on."""
        x = value[:, None]
        vx = self.v[index] * x
        s, q = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (s * s - q).sum(1)

    def logits_of(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of the indices and values of several rows, each of which has some."""
        if not rows:
            return np.empty(0)
        return self.logits(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum([0, *(len(i) for i, _ in rows[:-1])]))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 12, steps: int = 600, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> Model:
    """Adagrad on the logistic loss in batches, in the order that the seed gives.

    Runs for ``epochs``, and for as many more as ``steps`` batches take.

    Without rows, or with labels of one kind, the model is a constant: the
    smoothed share of label 1, and 0.5 without rows.
    """
    ones = sum(y for *_, y in rows)
    rng = np.random.default_rng(seed)
    model = Model(float(np.log((ones + 1) / (len(rows) - ones + 1))), np.zeros(N_FEATURES), np.zeros((N_FEATURES, rank)))
    if not 0 < ones < len(rows):
        return model
    model.v = rng.normal(0, 0.05, (N_FEATURES, rank))
    gw, gv = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, rank), 1e-2)
    for _ in range(max(epochs, -(-steps * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), 64):
            batch = [rows[i] for i in order[start : start + 64]]
            n = np.array([len(b[0]) for b in batch])
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            index, x = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
            own = np.repeat(np.arange(len(batch)), n)
            vx = model.v[index] * x[:, None]
            s = np.add.reduceat(vx, starts)
            z = model.w0 + np.add.reduceat(model.w[index] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([b[2] for b in batch]))[own] / len(batch)
            seen, back = np.unique(index, return_inverse=True)
            dw, dv = np.zeros(len(seen)), np.zeros((len(seen), rank))
            np.add.at(dw, back, g * x)
            np.add.at(dv, back, (g * x)[:, None] * (s[own] - vx))
            dw += l2 * model.w[seen]
            dv += l2 * model.v[seen]
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            model.w[seen] -= rate * dw / np.sqrt(gw[seen])
            model.v[seen] -= rate * dv / np.sqrt(gv[seen])
            model.w0 -= 0.05 * float(g[starts].sum())
    return model


_TRAIN_SQL = "doc_id long, label int, features binary, vals binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = _Buckets()
    for b in batches:
        found = [features(t, n, buckets) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
        blobs = [[i.astype(np.uint16).tobytes() for i, _ in found], [x.astype(np.float16).tobytes() for _, x in found]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *(pa.array(x, pa.binary()) for x in blobs)], names=["doc_id", "label", "features", "vals"])


def _metadata(docs: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """A model from at most ``max_rows`` labelled rows outside the held-out fold.

    The sample is that of the least id hashes, so it is the same in every run.
    Its ids, bounded, are broadcast to pick its texts; features are extracted
    on the executors and only these come to the driver. Rows with a null label
    or id are not labelled.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    chosen = known.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("label")).distinct().orderBy(F.xxhash64("__id"), "__id", "label").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _metadata(docs).alias("n_chars"))
    picked = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "label", "text", "n_chars")
    rows = sorted((r.doc_id, r.label, bytes(r.features), bytes(r.vals)) for r in picked.mapInArrow(_extract, _TRAIN_SQL).collect())
    return fit([(np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(x, np.float16).astype(float), y) for _, y, i, x in rows])


def scorer(spark: SparkSession, model: Model):
    """A column function of (text, n_chars) that gives the score."""
    shared = spark.sparkContext.broadcast((model.w0, model.w, model.v))

    @arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m, buckets = Model(*shared.value), _Buckets()
        for texts, sizes in parts:
            out, found, held = [], [], 0
            for t, n in zip(texts, sizes, strict=True):
                found.append(features(t.as_py(), n.as_py(), buckets))
                held += len(found[-1][0])
                if held >= BATCH_FEATURES:
                    out.append(m.logits_of(found))
                    found, held = [], 0
            z = np.concatenate([*out, m.logits_of(found)])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score, which depends on text and n_chars alone.

    Null texts are scored as empty ones. Every row comes back once, in whatever
    way rows or ids repeat; a column of the score's name is replaced.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(column, scorer(docs.sparkSession, model)(F.col("text").cast("string"), _metadata(docs)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that a model trained from ``labels`` doesn't reject, with the columns of ``docs``.

    Every row is judged by itself, null and empty texts as empty ones. Without
    usable labels all rows score 0.5 and stay.
    """
    found = scored(docs, train(docs, labels), "__score")
    return found.where(F.col("__score") >= threshold).drop("__score")
