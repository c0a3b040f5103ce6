"""Matching of images by their hashes against the greedy match over all scored pairs."""

import random

from pyspark.sql import functions as F

from quirekit.functions import hashing
from quirekit.operators import images

from .test_operators import greedy


def sides(spark, rows):
    df = spark.createDataFrame(rows, "g int, id long, phash string, dhash string")
    return (df.where(F.col("id") % 2 == r).withColumnRenamed("id", n) for r, n in ((0, "s"), (1, "t")))


def test_hashed_images_match_as_all_pairs_do(spark):
    r = random.Random(7)
    few = [f"{r.getrandbits(64):016x}" for _ in range(3)]  # copies, whose pairs are ties
    hash_ = lambda: r.choice(few) if r.random() < 0.4 else f"{r.getrandbits(64):016x}"
    rows = [(r.choice([1, 1, 1, 2, None]), i, hash_(), hash_()) for i in range(120)] + [(3, 200, few[0], few[0]), (4, 201, few[0], few[0])]
    s, t = sides(spark, rows)
    none, one, c = F.lit(None).cast("string"), F.lit(1.0), F.col
    both = s.select("g", "s", c("phash").alias("pa"), c("dhash").alias("da")).join(t.select("g", "t", c("phash").alias("pb"), c("dhash").alias("db")), "g")
    edges = both.select("g", "s", "t", hashing.image_score(none, none, c("pa"), c("pb"), c("da"), c("db"), one, one, one, one).alias("score"))
    pairs = edges.collect()
    for threshold in (0.0, 0.6):
        of = lambda g: greedy([(x.score, x.s, x.t) for x in pairs if x.g == g and x.score >= threshold], lambda e: (-e[0], e[1], e[2]))  # noqa: B023, E731
        want = sorted((g, *m) for g in (1, 2) for m in of(g))
        for listed, blocks in ((2, (3, 4)), (images.LISTED, (images.SOURCES, images.TARGETS))):
            got = images.match_hashed(s, t, ["g"], threshold, listed, blocks)
            assert want and got.columns == ["g", "s", "t", "score"] and sorted(map(tuple, got.collect())) == want
    assert images.match_hashed(s.limit(0), t, ["g"]).count() == 0


def test_copies_of_one_image_match_in_order_in_one_pass(spark):
    s, t = sides(spark, [(1, i, "0f" * 8, "f0" * 8) for i in range(3000)])
    got = images.match_hashed(s, t, ["g"], 0.6).collect()
    assert sorted((x.s, x.t, x.score) for x in got) == [(i, i + 1, 1.0) for i in range(0, 3000, 2)]
