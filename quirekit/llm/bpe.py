"""Byte-level BPE over a global shuffle of distinct words.

Texts are split into pre-tokens once, in chunks of bounded size. A chunk is its
distinct words, numbered by frequency, and for every text the word numbers in
the order of their positions. Each distinct word goes once per chunk to the
task that owns the word's hash, where each distinct one is encoded once; the
ids are joined back by chunk and word number, and every text is put together by
position. Decoding joins the ids with the token-byte table, whose size is fixed.

Words and ids travel packed, one row for each chunk and owner: rows of single
words would be several times the volume. Owners are bounded, so the rows grow
with the number of chunks, and there are never more of them than there are
words in chunks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Bytes of text after which a chunk ends. A longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Texts after which a chunk ends.
CHUNK_ROWS = 100_000
#: Tasks that own words, at most.
MOST_OWNERS = 2048
#: Words whose ids a task remembers; beyond that it forgets all and starts anew.
KNOWN_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and a rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed with their first bytes together, then their second ones and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words), 3)


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends.tolist()], ends.tolist(), strict=False)]


class Codec:
    """Pre-tokens of texts, ids of pre-tokens and the token-byte table of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # A pre-token is one match as a whole.
        self.encoding = tiktoken.Encoding("shared", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern).findall
        self.table: list[bytes] = [b""] * (1 + max(ranks.values(), default=0))
        for token, rank in ranks.items():
            self.table[rank] = token

    def encode_piece(self, piece: str) -> list[int]:
        return self.encoding.encode_ordinary(piece)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec, built once for each broadcast."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(*shared.value)
    return _CODECS[shared.id]


class _Shared:
    """A broadcast with a key that survives pickling."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


class _Numbers(dict):
    """Numbers of words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


_SPLIT = pa.schema([
    ("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("digests", pa.binary()),
    ("places", pa.binary()), ("owners", pa.binary()), ("asked", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())),
])
_SPLIT_SQL = "chunk long, docs array<long>, sizes array<int>, digests binary, places binary, owners binary, asked array<int>, words array<binary>"
_ASK = pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary())])
_ASK_SQL = "owner int, chunk long, words binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())])
_ANSWER_SQL = "chunk long, owner int, counts binary, ids binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("round_trip", pa.bool_())])
_OUT_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, round_trip boolean"


def _split(shared: _Shared, owners: int):
    """Rows of chunks: documents, their numbers of pre-tokens, word numbers by position, and the words to ask of each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _codec(shared).pieces
        chunk = TaskContext.get().partitionId() << 33
        docs: list[int | None] = []
        digests: list[bytes] = []
        places: list[np.ndarray] = []
        numbers, held = _Numbers(), 0

        def flush() -> pa.RecordBatch:
            nonlocal numbers, held, chunk
            flat = np.concatenate([np.empty(0, np.uint32), *places])
            rank = np.empty(len(numbers), np.uint32)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            rank[order] = np.arange(len(numbers), dtype=np.uint32)
            first = [w.encode("utf-8", "surrogatepass") for w in numbers]
            words = [first[i] for i in order.tolist()]
            to = np.fromiter((xxhash.xxh3_64_intdigest(w) % owners for w in words), np.uint32, len(words))
            by = np.argsort(to, kind="stable")
            asked, starts = np.unique(to[by], return_index=True)
            parts = [pack_words([words[i] for i in part.tolist()]) for part in np.split(by, starts[1:])] if len(by) else []
            row = [chunk, list(docs), [len(p) for p in places], b"".join(digests), squeeze(rank[flat]), squeeze(to), asked.tolist(), parts]
            docs.clear(), digests.clear(), places.clear()
            numbers, held, chunk = _Numbers(), 0, chunk + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SPLIT, strict=True)], schema=_SPLIT)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                found = pieces(text)
                docs.append(doc)
                places.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                raw = text.encode("utf-8", "surrogatepass")
                digests.append(hashlib.sha256(raw).digest())
                held += len(raw)
                if held >= CHUNK_BYTES or len(docs) >= CHUNK_ROWS:
                    yield flush()
        if docs:
            yield flush()

    return run


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, owners, words in zip(*(b.column(c).to_pylist() for c in ("chunk", "asked", "words")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), pa.array([chunk] * len(owners), pa.int64()), pa.array(words, pa.binary())], schema=_ASK)


def _answer(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        known: dict[bytes, bytes] = {}
        for b in batches:
            for owner, chunk, words in zip(*(b.column(c).to_pylist() for c in ("owner", "chunk", "words")), strict=True):
                ids = []
                for w in unpack_words(words):
                    if (found := known.get(w)) is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        found = known[w] = np.array(codec.encode_piece(w.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                    ids.append(found)
                row = [chunk, owner, squeeze(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4), squeeze(np.frombuffer(b"".join(ids), "<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ANSWER, strict=True)], schema=_ANSWER)

    return run


def _reassemble(shared: _Shared, keep_ids: bool):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        codec = _codec(shared)
        (row,) = own.to_pylist()
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("owner", "counts", "ids")), strict=True))
        empty = np.empty(0, np.uint32)
        flat = np.concatenate([empty, *(unsqueeze(g[2]) for g in got)])
        # Answers stand by owner and, of one owner, by word number.
        by = np.argsort(unsqueeze(row["owners"]), kind="stable")
        counts, starts = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        counts[by] = np.concatenate([empty, *(unsqueeze(g[1]) for g in got)])
        starts[by] = np.cumsum(counts[by]) - counts[by]
        shown = [" ".join(map(str, flat[a:b].tolist())) for a, b in zip(starts.tolist(), (starts + counts).tolist(), strict=True)]
        places, at, out = unsqueeze(row["places"]), 0, []
        for i, (doc, n) in enumerate(zip(row["docs"], row["sizes"], strict=True)):
            p = places[at : at + n]
            at += n
            c = counts[p]
            total = int(c.sum())
            ids = flat[np.repeat(starts[p] - (np.cumsum(c) - c), c) + np.arange(total)]
            digest = hashlib.sha256(codec.decode(ids)).digest()
            out.append((
                doc, total, hashlib.sha256(" ".join(map(shown.__getitem__, p.tolist())).encode()).hexdigest(), digest.hex(),
                ids.astype("<u4").tobytes() if keep_ids else None, digest == row["digests"][32 * i : 32 * i + 32],
            ))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(_OUT), _OUT, strict=True)], schema=_OUT)

    return run


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = True) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, digests of ids and of decoded bytes, ids (uint32, little end first) and round_trip.

    Every match of ``pattern`` is encoded by itself, without special tokens;
    ``round_trip`` says whether the decoded bytes are those of the text. Null
    and empty texts have no tokens. Rows that repeat a doc_id come back each;
    a null doc_id stays null. Other columns are ignored. Chunks go by row, not
    by key, so neither a hot key nor many copies make one large; the
    vocabulary, of fixed size, is broadcast. The rows of a task are put in
    order first, so that a chunk that has to be made again is the same.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(tasks, 2 * int(total // CHUNK_BYTES) + 1)
    owners = min(MOST_OWNERS, chunks)
    shared = _Shared(spark.sparkContext.broadcast((ranks, pattern)), xxhash.xxh3_64_intdigest(repr((len(ranks), pattern, max(ranks.items(), default=None, key=lambda x: x[1]))).encode()))
    # Both users take all columns, so that they share one exchange and texts are split once.
    split = texts.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(_split(shared, owners), _SPLIT_SQL).repartition(chunks, "chunk")
    answers = split.mapInArrow(_ask, _ASK_SQL).repartitionById(owners, "owner").mapInArrow(_answer(shared), _ANSWER_SQL).repartition(chunks, "chunk")
    return split.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_reassemble(shared, keep_ids), _OUT_SQL)
