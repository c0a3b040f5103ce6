"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersections.

Two texts link when the Jaccard similarity of their sets of word n-grams
reaches a ratio. No link between different texts is lost:

* Sizes fall into bands. A pair meets in the tile of its smaller set's band,
  where its sets differ in at most ``k`` n-grams. The hash space is cut into
  ``P > k`` parts; by counting, at least ``P - k`` parts of the two sets are
  equal. Each text posts the hash of its parts, least first left out as long
  as no more than ``P - k - 1`` are; so every linking pair shares a posting.
* Postings that meet give a sparse graph (a star per posting, never all pairs).
  Its components are the only places where links can be.
* A passage that many texts share merges them into one component without their
  being alike. The texts of large components are therefore dealt again, by
  their rarest n-grams: of ``n`` n-grams, counted over all these texts and
  ordered from rare to frequent, linking texts share one among the first
  ``n - ceil(ratio * n) + 1``. N-grams that one text alone has post nothing.
* Components are cut into tiles of bounded size. In a tile, hashed parity
  bitmaps bound the overlap of a pair from above by their bit counts, and the
  pairs left are settled by intersecting sorted arrays. Pairs that links join
  already are skipped, which leaves components as they are. A large component
  is first held against an anchor block, in time linear in its size; only the
  texts that stay outside its main group meet all its blocks afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, maybe_broadcast, mix64, prepare, text_rows

#: Ratio of the upper sizes of two successive bands.
BAND_GROWTH = 1.3
#: Postings that a map task holds before it sends them off; also what a reducing task is sized for.
CHUNK_POSTINGS = 1_000_000
#: Texts of a component's block; a tile has two blocks at most.
BLOCK = 256
#: N-grams of a chunk of a large component's texts.
CHUNK_NGRAMS = 200_000
#: Bytes per word in which the number of postings is estimated, for the number of tasks only.
_WORD_BYTES = 6
_CANDIDATE, _LINK, _SIZE, _NULL_ID = 0, 1, 2, 3
_SALT = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams.

    A-Z are lower-cased; words are runs without ASCII white space. With fewer
    words than ``width`` the whole sequence is one n-gram; null, empty and
    blank texts have none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    w = min(width, len(words))
    with np.errstate(over="ignore"):
        acc = np.full(len(words) - w + 1, w, np.uint64)
        for j in range(w):
            acc = mix64(acc + h[j : len(words) - w + 1 + j]) + _SALT
    return np.unique(acc)


@lru_cache(maxsize=8)
def _bands(num: int, den: int, top: int) -> list[int]:
    upper, bands = 1, []
    while upper < top:
        bands.append(upper)
        upper = max(upper + 1, int(upper * BAND_GROWTH))
    return [*bands, upper]


def _parts(upper: int, num: int, den: int) -> tuple[int, int]:
    """Most differing n-grams of a pair whose smaller set has up to ``upper``, and the number of parts."""
    k = upper * (den - num) // num
    return k, k + 1 + (k * (25 if num * 100 < den * 85 else 10)) // 100


def part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The postings of a set: one hash for each part that it posts in each of its tiles."""
    n, out = len(s), []
    bands = _bands(num, den, 1 << max(20, n.bit_length() + 1))
    b = int(np.searchsorted(bands, n))
    mixed = mix64(s)
    high = s >> np.uint64(32)
    while b >= 0 and (n <= bands[b] or n * num <= bands[b] * den):
        k, parts = _parts(bands[b], num, den)
        part = (high * np.uint64(parts)) >> np.uint64(32)
        size = np.bincount(part.astype(np.int64), minlength=parts)
        drop = parts - k - 1
        least = int(np.partition(size, drop)[drop])  # at most ``drop`` parts are smaller
        with np.errstate(over="ignore"):
            total = np.zeros(parts, np.uint64)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            total[part[at].astype(np.int64)] = np.add.reduceat(mixed, at)
            keep = np.flatnonzero(size >= least)
            out.append(mix64(total[keep] ^ mix64((np.uint64(b) << np.uint64(40)) + keep.astype(np.uint64) + _SALT)))
        b -= 1
    return np.concatenate(out)


_PACKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("left", pa.binary()), ("right", pa.binary())])
_PACKED_SQL = "bucket long, kind byte, left binary, right binary"
_EDGE = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
_EDGE_SQL = "kind byte, a long, b long"


def _stars(keys: np.ndarray, docs: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions of the distinct keys, and each key's other documents linked to its least one.

    ``marks`` are keys too: the least key of the document that posted. Where a
    document has the mark of its key's least one, both meet at that mark also,
    so their link is left to it unless the key is the mark. Going to lesser keys
    this ends, so all that share a key are joined, and near copies by one link
    and not by one for each key.
    """
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    center = np.flatnonzero(first)[np.cumsum(first) - 1] if len(keys) else np.empty(0, np.int64)
    other = ~first & (docs != docs[center])
    if marks is not None and len(keys):
        marks = marks[order]
        other &= (marks != marks[center]) | (marks == keys)
    pairs = np.unique(np.stack([docs[other], docs[center][other]], 1), axis=0)
    return order[first], pairs[:, 0], pairs[:, 1]


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a graph that aren't the least of their component, and the least one of each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, compressed with their first bytes together, then their second ones and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _posted(keys: np.ndarray, docs: np.ndarray, buckets: int) -> tuple[list[tuple[int, int, bytes, bytes]], np.ndarray, np.ndarray]:
    """Packed postings of a chunk, and its own edges.

    A document's postings stand together. What the chunk's own postings join is
    posted as one document, the least, so that a passage which many of its texts
    share goes once to each bucket; the mark of a posting is the least key of
    the text that it comes from, which that document has posted as well.
    """
    if len(keys):
        runs = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        marks = np.repeat(np.minimum.reduceat(keys, runs), np.diff(np.append(runs, len(keys))))
    else:
        marks = keys
    first, u, v = _stars(keys, docs)
    u, v = contracted(u, v)
    keys, docs, marks = keys[first], docs[first], marks[first]
    if len(u):
        at = np.minimum(np.searchsorted(u, docs), len(u) - 1)
        docs = np.where(u[at] == docs, v[at], docs)
    to = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    keys, docs, marks, to = keys[order], docs[order], marks[order], to[order]
    cut = np.flatnonzero(np.diff(to)) + 1
    parts = zip(np.split(to, cut), np.split(keys, cut), np.split(docs, cut), np.split(marks, cut), strict=True)
    # A bucket's keys are in order, so their differences have fewer bits; documents of a chunk are of few.
    return [(int(x[0]), -1, squeeze(np.diff(y, prepend=np.uint64(0))), squeeze(np.concatenate([z.view(np.uint64), m]))) for x, y, z, m in parts if len(x)], u, v


def _map_postings(width: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, posted = _WordHashes(), 0
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        same: dict[bytes, int] = {}
        links: list[tuple[int, int]] = []
        sizes: list[tuple[int, int]] = []
        nulls: list[int] = []
        turn = 0

        def packed(kind: int, a, b, bucket: int) -> tuple:
            return bucket, kind, np.asarray(a, np.int64).tobytes(), np.asarray(b, np.int64).tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal posted, turn
            k, d = (np.concatenate(keys), np.concatenate(ids)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
            rows, u, v = _posted(k, d, buckets)
            turn += 1
            lone = turn * 7919 + (int(d[0]) if len(d) else 0)  # any bucket will do
            if len(u):
                rows.append(packed(_CANDIDATE, u, v, lone % buckets))
            for kind, pairs in ((_LINK, links), (_SIZE, sizes), (_NULL_ID, [(0, n) for n in nulls])):
                if pairs:
                    rows.append(packed(kind, [p[0] for p in pairs], [p[1] for p in pairs], lone % buckets))
            for x in (keys, ids, links, sizes, nulls):
                x.clear()
            same.clear()
            posted = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, _PACKED.types, strict=True)], schema=_PACKED)

        for doc, text in text_rows(batches, "doc_id", "text"):
            s = shingles(text, width, hashes)
            if doc is None:
                nulls.append(len(s))
                continue
            sizes.append((doc, len(s)))
            if len(s):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if (twin := same.setdefault(digest, doc)) != doc:
                    links.append((doc, twin))
                else:
                    p = part_keys(s, num, den)
                    keys.append(p)
                    ids.append(np.full(len(p), doc, np.int64))
                    posted += len(p)
            if posted >= CHUNK_POSTINGS or len(sizes) >= CHUNK_POSTINGS:
                yield flush()
        yield flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gathers a bucket's postings, one of a key from each chunk, and passes the other rows on."""
    keys, docs, marks = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], schema=_EDGE)

    for kind, left, right in text_rows(batches, "kind", "left", "right"):
        if kind == -1:
            keys.append(np.cumsum(unsqueeze(left), dtype=np.uint64))
            both = unsqueeze(right)
            docs.append(both[: len(both) // 2].view(np.int64))
            marks.append(both[len(both) // 2 :])
        else:
            yield rows(kind, np.frombuffer(left, np.int64), np.frombuffer(right, np.int64))
    _, u, v = _stars(np.concatenate(keys), np.concatenate(docs), np.concatenate(marks))
    yield rows(_CANDIDATE, *contracted(u, v))  # one edge of each document at most


_COUNTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_COUNTS_SQL = "bucket long, chunk long, keys binary, counts binary"


def _count_ngrams(width: int, buckets: int):
    """Counts of a chunk's n-grams, dealt into buckets, so that a frequent one is one entry per chunk."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        hashes = _WordHashes()
        k, c = np.unique(np.concatenate([shingles(x, width, hashes) for x in t.column("text").to_pylist()]), return_counts=True)
        to = (k % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        k, c, to = k[order], c[order].astype(np.int64), to[order]
        cut = np.flatnonzero(np.diff(to)) + 1
        rows = [(int(x[0]), key[0].as_py(), y.tobytes(), z.tobytes()) for x, y, z in zip(np.split(to, cut), np.split(k, cut), np.split(c, cut), strict=True) if len(x)]
        return pa.Table.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True) if rows else [()] * 4, _COUNTS, strict=True)], schema=_COUNTS)

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each chunk with the counts over all chunks of those of its n-grams that come more than once."""
    rows = list(text_rows(batches, "bucket", "chunk", "keys", "counts"))
    if not rows:
        return
    keys = [np.frombuffer(r[2], np.uint64) for r in rows]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])).astype(np.int64)[inverse]
    at = 0
    for (bucket, chunk, _, _), k in zip(rows, keys, strict=True):
        c = total[at : at + len(k)]
        at += len(k)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, chunk, k[c > 1].tobytes(), c[c > 1].tobytes()), _COUNTS, strict=True)], schema=_COUNTS)


def rarest(s: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of a set's members, rare ones first, those of which linking sets share one; members that no other set has are left out."""
    first = np.lexsort((s, counts))[: len(s) + (-len(s) * num) // den + 1]
    return s[first[counts[first] > 1]]


def _post_rarest(width: int, num: int, den: int, buckets: int):
    def run(own: pa.Table, counted: pa.Table) -> pa.Table:
        hashes, empty = _WordHashes(), np.empty(0, np.uint64)
        k = np.concatenate([empty, *(np.frombuffer(x, np.uint64) for x in counted.column("keys").to_pylist())])
        c = np.concatenate([empty.astype(np.int64), *(np.frombuffer(x, np.int64) for x in counted.column("counts").to_pylist())])
        order = np.argsort(k)
        k, c = np.append(k[order], np.uint64(0)), np.append(c[order], 1)  # the last entry stands for n-grams that come once
        keys, ids = [empty], [empty.astype(np.int64)]
        for doc, text in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist(), strict=True):
            s = shingles(text, width, hashes)
            at = np.searchsorted(k[:-1], s)
            keys.append(rarest(s, np.where(k[at] == s, c[at], 1), num, den))
            ids.append(np.full(len(keys[-1]), doc, np.int64))
        rows, u, v = _posted(np.concatenate(keys), np.concatenate(ids), buckets)
        if len(u):
            rows.append((int(u[0]) % buckets, _CANDIDATE, u.tobytes(), v.tobytes()))
        return pa.Table.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True) if rows else [()] * 4, _PACKED, strict=True)], schema=_PACKED)

    return run


def _finer(big: DataFrame, total: int, width: int, num: int, den: int) -> DataFrame:
    """Components of the texts ``big`` (doc_id, text; ``total`` n-grams) by their rarest n-grams; lone texts are absent."""
    chunks = max(1, total // CHUNK_NGRAMS)
    own = big.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("long"))
    counted = own.groupBy("chunk").applyInArrow(_count_ngrams(width, chunks), _COUNTS_SQL).repartition(chunks, "bucket").mapInArrow(_sum_counts, _COUNTS_SQL)
    posted = own.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_post_rarest(width, num, den, chunks), _PACKED_SQL)
    edges = posted.repartition(chunks, "bucket").mapInArrow(_meet, _EDGE_SQL)
    return connected_components(edges, "a", "b").withColumnsRenamed({"node": "doc_id", "component": "cluster"})


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity bitmaps: two of them differ in no more bits than their sets in members."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def tile_links(docs: list[int], sets: list[np.ndarray], groups: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the groups of a tile's texts as all links among them would."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, sets, docs = n[order], [sets[i] for i in order], [docs[i] for i in order]
    label = np.unique(np.array([groups[i] for i in order]), return_inverse=True)[1]
    bits = 1 << min(13, max(9, int(np.median(n)).bit_length())) if len(n) else 512
    maps, found = bitmaps(sets, bits), []
    for i in range(len(n)):
        if not n[i]:
            continue
        end = int(np.searchsorted(n, n[i] * den // num, side="right"))
        j = i + 1 + np.flatnonzero(label[i + 1 : end] != label[i])
        if not len(j):
            continue
        differ = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
        j = j[(n[i] + n[j] - differ) // 2 * (den + num) >= num * (n[i] + n[j])]
        for x in j.tolist():
            if label[x] == label[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
            if den * both >= num * (int(n[i]) + int(n[x]) - both):
                found.append((docs[i], docs[x]))
                label[label == label[x]] = label[i]
    return found


_TILE_SQL = "u long, v long"


def _tile(width: int, num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        hashes, by = _WordHashes(), {}
        for c, doc, group, text in zip(*(t.column(x).to_pylist() for x in ("tile", "doc_id", "grp", "text")), strict=True):
            by.setdefault(c, []).append((doc, group, text))
        found = []
        for rows in by.values():
            rows.sort(key=lambda r: r[0])
            found += tile_links([r[0] for r in rows], [shingles(r[2], width, hashes) for r in rows], [r[1] for r in rows], num, den)
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return run


def ngram_jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; link where ``den * |A & B| >= num * |A | B|``.

    ``component_id`` is the least doc_id that links reach, the row's own
    included. Rows that repeat a doc_id are one node. Rows without a doc_id or
    without words link with nothing; the former have a null component. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = 2.3 * (den - num) / num * (1 + 2 * (den - num) / num)
    buckets = max(1, int(total / _WORD_BYTES * share / CHUNK_POSTINGS) + 1)
    met = (
        texts.mapInArrow(_map_postings(width, num, den, buckets), _PACKED_SQL)
        .repartition(buckets, "bucket")
        .mapInArrow(_meet, _EDGE_SQL)
        .checkpoint()
    )
    where = connected_components(met.where(F.col("kind") == _CANDIDATE), "a", "b").withColumnsRenamed({"node": "doc_id", "component": "cluster"}).checkpoint()
    sized = where.groupBy("cluster").agg(F.count("*").alias("members"))
    dense = where.join(sized.where(F.col("members") > 2 * BLOCK).select("cluster"), "cluster", "left_semi").select("doc_id").checkpoint()
    if most := dense.count():
        total = met.where(F.col("kind") == _SIZE).join(maybe_broadcast(dense, most), F.col("a") == F.col("doc_id"), "left_semi").agg(F.sum("b")).first()[0]
        again = _finer(texts.join(maybe_broadcast(dense, most), "doc_id", "left_semi"), total, width, num, den)
        where = where.join(maybe_broadcast(dense, most), "doc_id", "left_anti").select("doc_id", "cluster").union(again.select("doc_id", "cluster")).checkpoint()
        sized = where.groupBy("cluster").agg(F.count("*").alias("members"))
    large = sized.where(F.col("members") > 2 * BLOCK)
    blocks = where.join(sized, "cluster").select("doc_id", "cluster", F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int").alias("blocks"))
    blocks = blocks.withColumn("blocks", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1)).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).checkpoint()
    many = blocks.count()
    bins = max(1, many // BLOCK)

    def settle(tiles: DataFrame, rows: int) -> DataFrame:
        """``tiles``: doc_id, tile, bin, grp."""
        own = texts.join(maybe_broadcast(tiles, rows), "doc_id")
        return own.groupBy("bin").applyInArrow(_tile(width, num, den), _TILE_SQL)

    seen = F.when(F.col("block") == 0, F.sequence(F.least(F.lit(1), F.col("blocks") - 1), F.col("blocks") - 1)).otherwise(F.array("block"))
    tiles = blocks.select("doc_id", "cluster", "blocks", F.explode(seen).alias("b")).select(
        "doc_id", F.col("doc_id").alias("grp"), F.concat_ws("/", "cluster", "b").alias("tile"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("string")).otherwise(F.concat_ws("/", "cluster", "b")).alias("bin"),
    )
    links = settle(tiles, 2 * many).union(met.where(F.col("kind") == _LINK).select("a", "b")).checkpoint()
    groups = connected_components(links)
    if large.limit(1).count():
        links = links.union(_outside(blocks.join(large.select("cluster"), "cluster", "left_semi"), groups, settle))
        groups = connected_components(links)
    labels = groups.select(F.col("node").alias("doc_id"), F.col("component"))
    sizes = met.where(F.col("kind") == _SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    lone = met.where(F.col("kind") == _NULL_ID).select(F.lit(None).cast("long").alias("doc_id"), F.col("b").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return sizes.join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).union(lone)


def _outside(blocks: DataFrame, groups: DataFrame, settle) -> DataFrame:
    """Links between a large component's texts outside its main group and all its texts."""
    now = blocks.join(groups.select(F.col("node").alias("doc_id"), F.col("component")), "doc_id", "left").select("doc_id", "cluster", "blocks", "block", F.coalesce("component", "doc_id").alias("grp")).checkpoint()
    main = now.groupBy("cluster", "grp").count().groupBy("cluster").agg(F.max_by("grp", F.struct("count", -F.col("grp"))).alias("main"))
    rest = now.join(main, "cluster").where("grp <> main")
    many = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rests"))
    rest = rest.join(many, "cluster").select("doc_id", "cluster", "grp", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), "rests").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    every = now.join(many, "cluster").select("doc_id", "cluster", "grp", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("r"), F.col("block").alias("b"))
    tiles = rest.select("doc_id", "cluster", "grp", "r", "b").union(every.select("doc_id", "cluster", "grp", "r", "b")).distinct()
    tiles = tiles.select("doc_id", "grp", F.concat_ws("/", "cluster", "r", "b").alias("tile")).withColumn("bin", F.col("tile")).checkpoint()
    return settle(tiles, tiles.count())


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that link to a row of a lesser doc_id.

    Of each group of linked rows the one with the least doc_id stays, once where
    rows repeat it with the same text. Rows that have one doc_id and different
    texts link each by its own text. Rows without a doc_id all stay. Columns
    are those of ``docs``.
    """
    prepare(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _keep_one_of_each_text(docs, width, num, den)
    groups = ngram_jaccard_groups(docs, width, num, den).where("doc_id is not null").checkpoint()
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(maybe_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def _keep_one_of_each_text(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``keep_one_of_each`` where doc_id is no key: each different text of a doc_id is a node of its own."""
    text = F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit(""))
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__digest": text})
    # Numbered once and for all: a checkpoint is read, not computed again.
    nodes = rows.where("__id is not null").select("__id", "__digest").distinct().withColumn("__node", F.monotonically_increasing_id()).checkpoint()
    texts = rows.join(nodes, ["__id", "__digest"]).select(F.col("__node").alias("doc_id"), "text")
    groups = ngram_jaccard_groups(texts, width, num, den).select(F.col("doc_id").alias("__node"), "component_id").distinct().checkpoint()
    known = groups.join(nodes, "__node")
    first = known.groupBy("component_id").agg(F.min(F.struct("__id", "__digest")).alias("first"))
    stay = known.join(first, "component_id").where(F.struct("__id", "__digest") == F.col("first")).select("__id", "__digest").checkpoint()
    kept = rows.join(maybe_broadcast(stay, stay.count()), ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"])
    return kept.select(*docs.columns).union(rows.where("__id is null").select(*docs.columns))


def oracle(width: int, num: int, den: int) -> str:
    """DuckDB SQL of ``ngram_jaccard_groups`` over ``documents``, all pairs that share an n-gram compared; for small tables whose doc_id is a key."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {width - 1}], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {width - 1}) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS d, doc_id AS k FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.k = e.a)
SELECT d AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(k) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d
"""
