"""Digests and perceptual hashes of 16 hexadecimal digits (H1, H3-H5, H8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(data: Column) -> Column:
    """H1."""
    return F.sha2(data, 256)


def hamming_distance(a: Column, b: Column) -> Column:
    """H3: differing bits; null where one is missing, not hexadecimal, or of another length."""
    ok = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$") & (F.length(a) == F.length(b))
    bits = lambda c: F.conv(c, 16, -10).cast("long")
    return F.when(ok, F.bit_count(bits(a).bitwiseXOR(bits(b))))


def hash_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    """H4: 1 less the share of differing bits; 0 where the distance is unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - hamming_distance(a, b) / float(bits)), F.lit(0.0))


def image_score(sha_a: Column, sha_b: Column, phash_a: Column, phash_b: Column, dhash_a: Column, dhash_b: Column,
                width_a: Column, height_a: Column, width_b: Column, height_b: Column, ssim: Column | None = None) -> Column:
    """H5: 1 for equal bytes, else hashes, shapes and, where it is known, structural similarity, to four digits.

    Weights of perceptual hash, difference hash, structure and shape: with
    structure 0.5, 0, 0.35, 0.15, or 0.4, 0.2, 0.3, 0.1 with a difference hash;
    without structure 0.8, 0, 0, 0.2, or 0.55, 0.25, 0, 0.2.
    """
    ssim = F.lit(None).cast("double") if ssim is None else ssim
    p, d = hash_similarity(phash_a, phash_b), F.round(hash_similarity(dhash_a, dhash_b), 4)
    shape_a, shape_b = width_a / F.greatest(F.lit(1.0), height_a), width_b / F.greatest(F.lit(1.0), height_b)
    whole = (width_a > 0) & (height_a > 0) & (width_b > 0) & (height_b > 0)
    shape = F.coalesce(F.when(whole, F.greatest(F.lit(0.0), 1 - F.abs(shape_a - shape_b) / F.greatest(shape_a, shape_b, F.lit(1e-6)))), F.lit(0.0))
    has_d = F.coalesce((dhash_a != "") & (dhash_b != ""), F.lit(False))
    with_ssim = F.when(has_d, 0.4 * p + 0.2 * d + 0.3 * ssim + 0.1 * shape).otherwise(0.5 * p + 0.35 * ssim + 0.15 * shape)
    without = F.when(has_d, 0.55 * p + 0.25 * d + 0.2 * shape).otherwise(0.8 * p + 0.2 * shape)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(ssim.isNotNull(), with_ssim).otherwise(without))), 4)
    return F.when(F.coalesce((sha_a == sha_b) & (sha_a != ""), F.lit(False)), 1.0).otherwise(score)


def content_hash(*columns: str) -> Column:
    """H8: a digest of the named columns, by name, in which nulls and empty values differ."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
