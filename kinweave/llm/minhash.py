"""MinHash banding on shingle sets, with the number of bands taken from the collision curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collision(similarity: float, bands: int, rows: int) -> float:
    """Probability that two sets of this Jaccard similarity meet in at least one band."""
    return 1.0 - (1.0 - similarity**rows) ** bands


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` hashes with which sets of at least this similarity meet with probability ``recall``."""
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - similarity**rows)))


def padded_qgrams(words: Column, q: int = 2) -> Column:
    """Distinct q-grams of the words of an array, each padded with '^' and '$'; a null or empty array gives an empty one.

    Words are treated alike wherever they stand, so reordered parts give the same set.
    """
    def grams(w: Column) -> Column:
        p = F.concat(F.lit("^" * (q - 1)), w, F.lit("$" * (q - 1)))
        return F.transform(F.sequence(F.lit(1), F.length(p) - (q - 1)), lambda i: F.substring(p, i, F.lit(q)))

    kept = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != ""))
    return F.array_distinct(F.flatten(F.transform(kept, grams)))


def with_band_keys(df: DataFrame, shingles: Column, **bandings: tuple[int, int, int]) -> DataFrame:
    """Adds one column per banding name = (bands, rows, seed): an array of one 64-bit key per band, empty for an empty or null set.

    Shingles are built and hashed once, in projections of their own; each hash function is one multiply-and-mix step over them.
    """
    df = df.withColumn("_shingles", shingles).withColumn("_hashed", F.transform("_shingles", lambda s: F.xxhash64(s)))
    functions = sorted({(seed, i) for bands, rows, seed in bandings.values() for i in range(bands * rows)})
    def mixed(k: int) -> Column:
        return F.array_min(F.transform("_hashed", lambda h: F.xxhash64(h, F.lit(k))))

    least = {f"_m{seed}_{i}": mixed(seed * 1_000_003 + i) for seed, i in functions}
    df = df.withColumns(least)
    some = F.size("_shingles") > 0
    none = F.array().cast("array<bigint>")
    out = {
        name: F.when(some, F.array(*[F.xxhash64(F.lit(b), *[F.col(f"_m{seed}_{b * rows + r}") for r in range(rows)]) for b in range(bands)])).otherwise(none)
        for name, (bands, rows, seed) in bandings.items()
    }
    return df.withColumns(out).drop("_shingles", "_hashed", *least)
