"""Most similar vectors for every vector: an exact block matrix join with int8 tiles.

Vectors of the same direction form one class, so copies never multiply. Class representatives are cut into blocks; every pair of blocks is
one task of bounded size. In a task, tiles of int8 products (run as exact integer arithmetic in float32 matrix products) give each pair a
distance with a proven error bound; pairs that may be within the bound of interest and among the best are recomputed in double precision,
and each row keeps its k best of the tile. The k best of all tiles are merged by rank. No pair can be lost: it is dropped only when its
lower distance bound exceeds the limit or the k-th best upper bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.runtime import cut, dedup_latest, parallelism

#: Rows of a block: 32,768 vectors of 64 numbers are 2 MB of int8 and 8 MB of float32.
BLOCK_ROWS = 32_768
#: Rows and columns of a tile inside a task; a tile of products is TILE_ROWS x TILE_COLS float32 = 2 MB, which stays in a core's cache.
TILE_ROWS, TILE_COLS = 256, 2_048


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error norm of each row: |unit - scale * code| <= err in the Euclidean norm."""
    scale = np.abs(unit).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    err = np.linalg.norm(unit - scale[:, None] * codes, axis=1)
    return codes, scale, err


def unit_rows(vecs: list | pd.Series, dim: int) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vecs]) if len(vecs) else np.zeros((0, dim))
    return m / np.linalg.norm(m, axis=1)[:, None]


def tile_pairs(left: np.ndarray, right: np.ndarray, limit: float, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and distances of pairs (left, right) within ``limit`` that may be among the k nearest of either side in this block pair.

    left, right: unit rows. The screening is exact integer arithmetic (64 products of at most 127 * 127 fit float32's 24 bits; wider vectors
    are summed in slices of 512 numbers). dot(u, v) differs from the product of codes by at most err_u + err_v + err_u * err_v.
    """
    (ca, sa, ea), (cb, sb, eb) = quantise(left), quantise(right)
    fa, fb = ca.astype(np.float32), cb.astype(np.float32)
    dim, out = left.shape[1], []
    for i in range(0, len(fa), TILE_ROWS):
        for j in range(0, len(fb), TILE_COLS):
            if same and j + TILE_COLS <= i:
                continue
            a, b = slice(i, i + TILE_ROWS), slice(j, j + TILE_COLS)
            dots = sum((fa[a, d : d + 512] @ fb[b, d : d + 512].T).astype(np.float64 if dim > 512 else np.float32) for d in range(0, dim, 512))
            # cos = dots * sa * sb +- (ea + eb + ea * eb); compare against row and column bars without another full matrix where possible
            bound = ea[a].max() + eb[b].max() + ea[a].max() * eb[b].max() + 1e-5
            bar = (1.0 - limit - bound) / np.float64(sb[b].max())
            hits = np.flatnonzero(dots >= (bar / sa[a]).astype(dots.dtype)[:, None]) if bar > 0 else np.arange(dots.size)
            if not len(hits):
                continue
            r, c = np.divmod(hits, dots.shape[1])
            r, c = r + i, c + j
            if same:
                keep = r < c
                r, c = r[keep], c[keep]
            approx = dots[r - i, c - j] * sa[r] * sb[c]
            keep = approx >= 1.0 - limit - (ea[r] + eb[c] + ea[r] * eb[c]) - 1e-6
            r, c = r[keep], c[keep]
            if len(r):
                exact = 1.0 - np.einsum("ij,ij->i", left[r], right[c])
                keep = exact <= limit
                out.append((r[keep], c[keep], exact[keep]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def k_best(owner: np.ndarray, other_id: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k smallest (dist, other_id)."""
    order = np.lexsort((other_id, dist, owner))
    o = owner[order]
    start = np.maximum.accumulate(np.where(np.r_[True, o[1:] != o[:-1]], np.arange(len(o)), 0)) if len(o) else np.zeros(0, dtype=np.int64)
    return order[np.arange(len(o)) - start < k]


def vector_classes(table: DataFrame, key: str, vec: str) -> DataFrame:
    """(rep, n_members, direction) per class of rows with the same direction; ``rep`` is the smallest key.

    A key delivered more than once is one vector (the latest by content hash if deliveries differ). Rows with a null key, a null vector, a
    vector with a null or non-finite number, or of zeros have no class. The direction is the vector over its norm, rounded to 7 digits for
    grouping only.
    """
    one = dedup_latest(table.select(F.col(key).alias("key"), F.col(vec).alias("vec")), "key", [])
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = one.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))).withColumn("norm", norm)
    usable = usable.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return usable.withColumn("direction", F.xxhash64(F.transform("vec", lambda x: F.round(x.cast("double") / F.col("norm"), 7) + F.lit(0.0))))


def nearest_pairs(table: DataFrame, key: str = "nn_string_ix", vec: str = "vec", k: int = 5, limit: float = 0.2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ix_1, ix_2, distance): pairs where one is among the k nearest others of the other and distance <= limit; ix_1 < ix_2, each once.

    Distance is 1 - cosine, ties go to the smaller key. Null and zero vectors take part in no pair; an empty table gives an empty result.
    All vectors must have one length. Extra columns are ignored.
    """
    spark = table.sparkSession
    members = cut(vector_classes(table, key, vec))
    by_class = Window.partitionBy("direction", "salt")
    salted = members.select("key", "direction", F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
    # The k + 1 smallest keys of a class: first per salt, then over at most 64 * (k + 1) rows, so a class of a third of all rows is no hot group.
    firsts = salted.withColumn("n", F.row_number().over(by_class.orderBy("key"))).where(F.col("n") <= k + 1)
    firsts = firsts.withColumn("place", F.row_number().over(Window.partitionBy("direction").orderBy("key"))).where(F.col("place") <= k + 1)
    classes = cut(firsts.groupBy("direction").agg(F.min("key").alias("rep"), F.sort_array(F.collect_list("key")).alias("first_keys")))
    reps = classes.select(F.col("rep").alias("key"), "direction").join(members.select("key", "vec"), "key")
    n = reps.count()
    # Enough blocks that the block pairs keep all cores busy, and never more than block_rows vectors in a block.
    n_blocks = max(1, -(-n // block_rows), int(np.ceil(np.sqrt(2 * parallelism(spark)))))
    sides = reps.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    sides = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    sides = sides.select(F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "key", "vec")

    def join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        b1, b2 = pdf["b1"].iloc[0], pdf["b2"].iloc[0]
        one, two = pdf[pdf["block"] == b1], pdf[pdf["block"] == b2]
        dim = len(pdf["vec"].iloc[0])
        ids1, u1 = one["key"].to_numpy(), unit_rows(one["vec"], dim)
        ids2, u2 = (ids1, u1) if b1 == b2 else (two["key"].to_numpy(), unit_rows(two["vec"], dim))
        r, c, d = tile_pairs(u1, u2, limit, k, b1 == b2)
        owner, other, dist = np.concatenate([ids1[r], ids2[c]]), np.concatenate([ids2[c], ids1[r]]), np.concatenate([d, d])
        best = k_best(owner, other, np.round(dist, 12), k)
        return pd.DataFrame({"owner": owner[best], "other": other[best], "dist": np.round(dist[best], 12)})

    # One group per pair of blocks: at most 2 * block_rows vectors.
    found = sides.groupBy("b1", "b2").applyInPandas(join_blocks, "owner long, other long, dist double")
    # Merge of the tiles: at most k rows per owner and block pair, k kept.
    reps_best = found.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy("dist", "other"))).where(F.col("r") <= k).drop("r")
    reps_best = cut(reps_best)

    # From classes back to members. The candidates of a member are the first k + 1 members of its own class (distance 0) and the first k
    # members of the near classes; a class of more than k + 1 members needs no other class.
    lists = classes.select("rep", "first_keys")
    near = reps_best.join(lists.select(F.col("rep").alias("other"), F.col("first_keys").alias("other_keys")), "other")
    cross = near.select(F.col("owner").alias("rep"), F.explode("other_keys").alias("cand"), "dist")
    own = lists.select("rep", F.explode("first_keys").alias("cand"), F.lit(0.0).alias("dist"))
    cand = own.unionByName(cross)
    cand = cand.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("dist", "cand"))).where(F.col("r") <= k + 1)  # one may be the member itself
    cands = cand.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("dist", "cand"))).alias("cands"))  # k + 1 at most
    cands = cands.join(classes.select("rep", "direction"), "rep").select("direction", "cands")
    # A class may hold a third of all members: spread the join by a salt, with the small side repeated.
    salts = 16
    spread = members.select("key", "direction").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    repeated = cands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = spread.join(repeated, ["direction", "salt"]).select("key", F.slice(F.filter("cands", lambda x: x["cand"] != F.col("key")), 1, k).alias("best"))
    pairs = pairs.select("key", F.explode("best").alias("b"))
    return pairs.select(F.least("key", "b.cand").alias("ix_1"), F.greatest("key", "b.cand").alias("ix_2"), F.col("b.dist").alias("distance")).groupBy("ix_1", "ix_2").agg(F.min("distance").alias("distance"))
