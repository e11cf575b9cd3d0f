"""Blocking: from names to candidate pairs of blockstrings.

The neighbours of a name are found exactly: names are unit vectors of weighted bigrams, and blocks of them, folded into fewer numbers that never
give less than the cosine, are multiplied as matrices; pairs that may be within the bar are computed again in double precision.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import Parameters
from kinweave.functions.cleaning import date_part, name_part
from kinweave.runtime import cut, parallelism, release

EPS = 1e-9
#: Numbers of a folded name, names of a block (8 MB folded), rows and columns of a tile of products, and names that one task looks for.
FOLD, BLOCK_NAMES, TILE, TILE_COLS, SLICE = 128, 16_384, 256, 2_048, 4_096
#: Bytes of a date, and dates of a name that are compared beside its vector.
DATE, MANY_DATES = 10, 8
#: Rows of a name that one task pairs with all rows of the name.
NAME_ROWS = 2_000


def split_last_names(names: DataFrame) -> DataFrame:
    """Rows (first, last, nn_string, ..) expanded: a last name with a blank also gives rows for its two halves, split at the last blank.

    nn_string_full keeps the whole name; equal rows of a record come once.
    """
    left, right = F.regexp_extract("last", r"^(.*) (\S+)$", 1), F.regexp_extract("last", r"^(.*) (\S+)$", 2)
    options = F.when(right != "", F.array_distinct(F.array("last", left, right))).otherwise(F.array("last"))
    out = names.withColumnRenamed("nn_string", "nn_string_full").withColumn("last", F.explode(options))
    return out.withColumn("nn_string", F.concat_ws("::", "first", "last"))


def expanded_strings(split: DataFrame) -> DataFrame:
    """Distinct (nn_string, nn_string_full, ed_string, absval)."""
    return split.select("nn_string", "nn_string_full", "ed_string", "absval").distinct()


def name_counts(split: DataFrame) -> DataFrame:
    """(nn_string, n_new, n_existing, n_total): one aggregation with conditional counts instead of a pivot and its extra pass."""
    new, old = (F.count_if(F.col("file_type") == k) for k in ("new", "existing"))
    return split.groupBy("nn_string").agg(new.alias("n_new"), old.alias("n_existing"), (new + old).alias("n_total"))


def commonness_penalties(last_names: DataFrame, max_penalty: float, bins: int = 1_000) -> DataFrame:
    """(last, penalty) of a column ``last``: quantile bins of the frequency, the most common bin at max_penalty, the rarest at 0.

    Bin edges are linearly interpolated quantiles of the distinct names' frequencies, equal edges once; occupied bins are spaced evenly. One
    occupied bin gives max_penalty to all. The edges, at most bins + 1 numbers, are one broadcast row.
    """
    counts = cut(last_names.groupBy("last").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    freq = counts.select("last", (F.col("n") / F.lit(total)).alias("f"))
    edges = freq.agg(F.array_distinct(F.percentile("f", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    binned = freq.join(F.broadcast(edges)).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col("f"))), F.lit(1))).drop("edges")
    levels = binned.select("bin").distinct()  # at most `bins` rows
    ranked = levels.withColumn("r", F.row_number().over(Window.orderBy(F.desc("bin")))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))
    penalty = F.when(F.col("k") == 1, F.lit(float(max_penalty))).otherwise(F.lit(float(max_penalty)) * (1 - (F.col("r") - 1) / (F.col("k") - 1)))
    return binned.join(F.broadcast(ranked), "bin").select("last", penalty.alias("penalty"))


def name_info(names: DataFrame, split: DataFrame, max_penalty: float, bins: int = 1_000) -> DataFrame:
    """(nn_string, commonness_penalty, n_new, n_existing, n_total); names whose last name is no whole one of the table get max_penalty."""
    penalties = commonness_penalties(names.select("last"), max_penalty, bins)
    info = split.groupBy("nn_string").agg(F.first("last").alias("last")).join(name_counts(split), "nn_string").join(penalties, "last", "left")
    return info.select("nn_string", F.coalesce("penalty", F.lit(float(max_penalty))).alias("commonness_penalty"), "n_new", "n_existing", "n_total")


def shingles(names: DataFrame, alpha: float = 1.4, power: float = 0.1) -> DataFrame:
    """(nn_string, shingle, w): weighted bigrams of the padded parts of first::last, both in one space.

    A part's bigrams count 1 (first) or alpha (last) over the number of its bigrams to the power. Only letters, blanks and '*' make bigrams;
    double blanks and blanks at an end make none.
    """
    parts = F.split("nn_string", "::")
    def grams(part: Column, num: float) -> Column:
        p = F.concat(F.lit("*"), F.coalesce(part, F.lit("")), F.lit("*"))
        all_of = F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2)))
        valid = F.filter(all_of, lambda g: g.rlike("^[A-Z *]{2}$") & ~g.isin("  ", "* ", " *"))
        return F.transform(valid, lambda g: F.struct(g.alias("shingle"), (F.lit(float(num)) / F.pow(F.size(valid).cast("double"), F.lit(float(power)))).alias("w")))
    both = F.concat(grams(F.try_element_at(parts, F.lit(1)), 1.0), grams(F.try_element_at(parts, F.lit(2)), alpha))
    return names.select("nn_string").distinct().select("nn_string", F.explode(both).alias("s")).groupBy("nn_string", "s.shingle").agg(F.sum("s.w").alias("w"))


def unit_vectors(weights: DataFrame) -> DataFrame:
    """(nn_string, shingle, x) of norm 1."""
    norm = weights.groupBy("nn_string").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norm, "nn_string").select("nn_string", "shingle", (F.col("w") / F.col("norm")).alias("x"))


def cosine_of_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds cos_dist to pairs (nn_string_1, nn_string_2), which must be distinct; pairs without a common bigram get 1."""
    v1, v2 = (vectors.select(F.col("nn_string").alias(f"nn_string_{i}"), "shingle", F.col("x").alias(f"x{i}")) for i in (1, 2))
    dots = pairs.select("nn_string_1", "nn_string_2").join(v1, "nn_string_1").join(v2, ["nn_string_2", "shingle"]).groupBy("nn_string_1", "nn_string_2").agg(F.sum(F.col("x1") * F.col("x2")).alias("dot"))
    return pairs.join(dots, ["nn_string_1", "nn_string_2"], "left").withColumn("cos_dist", 1.0 - F.coalesce("dot", F.lit(0.0))).drop("dot")


def _fold(mass: np.ndarray) -> np.ndarray:
    """The bucket of each bigram: heavy bigrams first, each into the lightest bucket."""
    load, bucket = np.zeros(FOLD), np.zeros(len(mass), dtype=np.int64)
    for g in np.argsort(-mass, kind="stable"):
        bucket[g] = load.argmin()
        load[bucket[g]] += mass[g]
    return bucket


class _Block:
    """Names of one block file in order: their bigrams as padded rows, and folded into unit vectors of FOLD numbers.

    A folded number is the norm of the bigrams in its bucket, so by Cauchy and Schwarz the product of two folded names is never below their cosine.
    """

    def __init__(self, file: str, bucket: np.ndarray, rows: slice = slice(None)):
        fs, path = pafs.FileSystem.from_uri(file)
        t = pq.read_table(path, filesystem=fs, columns=["nn_string", "codes", "xs", "asks"], use_threads=False, partitioning=None)[rows]
        codes, xs = (t[c].combine_chunks() for c in ("codes", "xs"))
        sizes = np.diff(codes.offsets.to_numpy())
        self.names, self.n, self.asks = t["nn_string"].combine_chunks(), len(t), t["asks"].to_numpy()
        there = np.arange(sizes.max(initial=1)) < sizes[:, None]
        self.codes, self.x = np.zeros(there.shape, dtype=np.int64), np.zeros(there.shape)
        self.codes[there], self.x[there] = codes.flatten().to_numpy(), xs.flatten().to_numpy()
        at = np.arange(self.n)[:, None] * FOLD + bucket[self.codes]
        self.folded = np.sqrt(np.bincount(at.ravel(), (self.x * self.x).ravel(), self.n * FOLD)).reshape(self.n, FOLD).astype(np.float32)

    def dense(self, a: int, b: int, n_grams: int) -> np.ndarray:
        m = np.zeros((min(b, self.n) - a, n_grams))
        np.add.at(m, (np.arange(len(m))[:, None], self.codes[a:b]), self.x[a:b])
        return m


def _near_rows(one: _Block, two: _Block, bars: np.ndarray, n_grams: int, same: bool = False):
    """Yields row numbers and distances of pairs of names of two blocks within the bar of the first; same: each pair once.

    Products of the folded names in float32 screen, double precision over the bigrams decides.
    """
    for i in range(0, one.n, TILE):
        left, dense = one.folded[i : i + TILE], None
        for j in range(i if same else 0, two.n, TILE_COLS):
            right = two.folded[j : j + TILE_COLS]
            hits = np.flatnonzero(left @ right.T >= (1.0 - bars[i : i + TILE, None] - 1e-4).astype(np.float32))
            if not len(hits):
                continue
            dense = one.dense(i, i + TILE, n_grams) if dense is None else dense
            for k in range(0, len(hits), 100_000):
                r, c = np.divmod(hits[k : k + 100_000], len(right))
                if same:
                    r, c = r[r + i < c + j], c[r + i < c + j]
                dist = 1.0 - np.einsum("ij,ij->i", dense[r[:, None], two.codes[c + j]], two.x[c + j])
                keep = dist <= bars[r + i] + EPS
                yield r[keep] + i, c[keep] + j, dist[keep]


def name_blocks(vectors: DataFrame, more: DataFrame) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Writes the names' vectors, in order of nn_string, into block files of the shared folder, each once; files and their rows, and the bucket of each bigram.

    more: nn_string, asks (whether its neighbours are looked for) and further columns. The bigrams and their mass, at most 781 rows, are collected.
    """
    spark = vectors.sparkSession
    grams = sorted((g, m) for g, m in vectors.groupBy("shingle").agg(F.sum(F.col("x") * F.col("x"))).collect())
    codes = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(grams)], "shingle string, code int")
    whole = vectors.join(F.broadcast(codes), "shingle").groupBy("nn_string").agg(F.collect_list(F.struct("code", "x")).alias("v"))
    whole = whole.select("nn_string", F.col("v.code").alias("codes"), F.col("v.x").alias("xs"))
    whole = cut(whole.join(more, "nn_string"))
    blocks = max(-(-whole.count() // BLOCK_NAMES), int(np.ceil(np.sqrt(2 * parallelism(spark)))))
    stored = cut(whole.repartitionByRange(blocks, "nn_string").sortWithinPartitions("nn_string"))
    release(whole)
    files = sorted(tuple(r) for r in stored.groupBy(F.col("_metadata.file_path").alias("f")).count().collect())  # a row per block
    return files, _fold(np.array([m for _, m in grams]))


def similar_names(vectors: DataFrame, bar: float, ordered: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """(nn_string_1, nn_string_2, cos_dist) of all pairs of different names within ``bar``; exact.

    Vectors have at most 781 dimensions and share most of them, so an inverted index hardly prunes; blocks of names are multiplied as matrices
    instead, each pair of blocks once. Tasks read the blocks from their files, so vectors are stored once, however many blocks there are.
    ordered: each pair once, by nn_string + '::'; otherwise both directions. queries: only pairs whose first name is in it (nn_string).
    """
    rows, bucket = name_blocks(vectors, vectors.select("nn_string", F.lit(True).alias("asks")).distinct())
    files = [f for f, _ in rows]
    todo = [(i, j) for i in range(len(files)) for j in range(i, len(files))]

    def run(batches):
        at, one = -1, None
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            i, j = todo[k]
            if at != i:
                at, one = i, _Block(files[i], bucket)
            two = one if i == j else _Block(files[j], bucket)
            found = _near_rows(one, two, np.full(one.n, bar), len(bucket), i == j)
            while some := list(islice(found, 256)):
                r, c, dist = (np.concatenate(x) for x in zip(*some))
                yield pa.RecordBatch.from_arrays([one.names.take(pa.array(r)), two.names.take(pa.array(c)), pa.array(dist)], ["n1", "n2", "cos_dist"])

    near = _tasks(vectors.sparkSession, len(todo)).mapInArrow(run, "n1 string, n2 string, cos_dist double")
    first = F.concat("n1", F.lit("::")) < F.concat("n2", F.lit("::"))
    if ordered:
        out = near.select(F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("nn_string_1"), F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("nn_string_2"), "cos_dist")
    else:
        turn = F.array(F.struct(F.col("n1").alias("a"), F.col("n2").alias("b")), F.struct(F.col("n2").alias("a"), F.col("n1").alias("b")))
        out = near.select(F.explode(turn).alias("p"), "cos_dist").select(F.col("p.a").alias("nn_string_1"), F.col("p.b").alias("nn_string_2"), "cos_dist")
    return out if queries is None else out.join(queries.select(F.col("nn_string").alias("nn_string_1")), "nn_string_1", "left_semi").select("nn_string_1", "nn_string_2", "cos_dist")


def _tasks(spark, n: int) -> DataFrame:
    """Numbers 0 to n - 1 over as many partitions as keep the cores evenly busy."""
    return spark.range(0, n, 1, max(1, min(n, 8 * parallelism(spark))))


class _Dates:
    """The dates of the names of a block file as bytes; empty: a name has an empty one; wild: its dates are not told here."""

    def __init__(self, file: str):
        fs, path = pafs.FileSystem.from_uri(file)
        t = pq.read_table(path, filesystem=fs, columns=["nn_string", "penalty", "dates"], use_threads=False, partitioning=None)
        self.names, self.penalty = t["nn_string"].combine_chunks(), t["penalty"].to_numpy()
        lists = t["dates"].combine_chunks()
        flat, sizes = lists.flatten().fill_null(""), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        owner, length = np.repeat(np.arange(len(t)), sizes), pc.binary_length(flat).to_numpy(zero_copy_only=False)
        count = lambda what: np.bincount(owner[what], minlength=len(t))
        self.empty = count(length == 0) > 0
        self.wild = lists.is_null().to_numpy(zero_copy_only=False) | (count((length != 0) & (length != DATE)) > 0)
        self.size = count(length == DATE)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.frombuffer("".join(flat.filter(pa.array(length == DATE)).to_pylist()).encode(), dtype=np.uint8).reshape(-1, DATE)


def _dates_may_meet(one: _Dates, p: np.ndarray, two: _Dates, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether names p and q may have dates within ``most`` (2 at most) edits: never False for those that have.

    Of strings of one length, one edit is a replaced byte; two are two of them, or one byte left out and one put in, between which bytes are shifted.
    """
    hit = np.zeros(len(p), dtype=bool)
    for k in range(0, len(p), 100_000):
        a, b = p[k : k + 100_000], q[k : k + 100_000]
        n = one.size[a] * two.size[b]
        pair = np.repeat(np.arange(len(a)), n)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        wide = two.size[b][pair]
        x, y = one.text[one.start[a][pair] + inside // np.maximum(wide, 1)], two.text[two.start[b][pair] + inside % np.maximum(wide, 1)]
        equal, bar = x == y, most[k : k + 100_000][pair]
        shifted = lambda u, v: (~(equal[:, :-1] | (u[:, 1:] == v[:, :-1]))).sum(axis=1) <= 1
        hit[k + pair[(bar >= 0) & (((~equal).sum(axis=1) <= bar) | ((bar >= 2) & (shifted(x, y) | shifted(y, x))))]] = True
    return hit


def _k_nearest(files: list[str], at: int, rows: slice, bucket: np.ndarray, bar: float, k: int) -> tuple[np.ndarray, ...]:
    """Row in the file, block, row of the block and distance of the k nearest others of some names of a file; ties (to nine digits) by name."""
    one = _Block(files[at], bucket, rows)
    bars, waiting, many = np.where(one.asks, bar, -2.0), [(np.zeros(0, dtype=np.int32),) * 3 + (np.zeros(0),)], 0

    def nearest() -> tuple[np.ndarray, ...]:
        r, b, c, d = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((c, b, np.round(d, 9), r))
        rank = np.arange(len(order)) - np.searchsorted(r[order], r[order])
        last = order[rank == k - 1]
        bars[r[last]] = np.minimum(bars[r[last]], d[last] + 1e-8)  # no farther name comes in any more
        order = order[rank < k]
        return r[order], b[order], c[order], d[order]

    if one.asks.any():
        for j, file in enumerate(files):
            two = _Block(file, bucket)
            for r, c, d in _near_rows(one, two, bars, len(bucket)):
                keep = (r + rows.start != c) | (at != j)
                waiting.append((r[keep].astype(np.int32), np.full(keep.sum(), j, dtype=np.int32), c[keep].astype(np.int32), d[keep]))
                many += len(d)
                if many > 2 * k * one.n + 100_000:
                    waiting = [nearest()]
                    many = len(waiting[0][0])
    r, *rest = nearest()
    return r + rows.start, *rest


def near_names(vectors: DataFrame, info: DataFrame, expanded: DataFrame, thresholds: dict, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(nn_string_1, nn_string_2, cos_dist): the k nearest names of each name (of each of ``queries``) within the widest bar, without those that
    ``filter_pairs`` leaves out by their penalties or dates.

    Ties (to nine digits) go by nn_string_2. A task compares some names with all blocks, so it knows their k nearest by itself, and nothing but
    pairs that may pass the bars is shuffled or stored.
    """
    spark, t = vectors.sparkSession, thresholds
    asks = F.lit(True) if queries is None else F.col("asks").isNotNull()
    more = info.select("nn_string", F.col("commonness_penalty").alias("penalty")).join(expanded.groupBy("nn_string").agg(F.collect_set("ed_string").alias("dates")), "nn_string")
    more = more if queries is None else more.join(queries.select("nn_string", F.lit(True).alias("asks")), "nn_string", "left")
    told = (F.size("dates") <= MANY_DATES) & F.lit(max(t["low_editdist_bar"], t["high_editdist_bar"]) <= 2)  # others have null: filter_pairs decides
    files, bucket = name_blocks(vectors, more.select("nn_string", "penalty", F.when(told, F.col("dates")).alias("dates"), asks.alias("asks")))
    rows = min(max(sum(n for _, n in files) // (4 * parallelism(spark)), 256), SLICE)
    todo, paths = [(i, slice(s, s + rows)) for i, (_, n) in enumerate(files) for s in range(0, n, rows)], [f for f, _ in files]
    bar = max(t["low_cosine_bar"], t["high_cosine_bar"], t["nodob_cosine_bar"])

    def run(batches):
        for at, part in (todo[n] for batch in batches for n in batch.column(0).to_pylist()):
            r, b, c, d = _k_nearest(paths, at, part, bucket, bar, k)
            one = _Dates(paths[at])
            for j in np.unique(b):
                two, p, q, dist = _Dates(paths[j]), r[b == j], c[b == j], d[b == j]
                penalty = (one.penalty[p] + two.penalty[q]) / 2 - 2 * EPS
                most = np.maximum(np.where(dist <= t["high_cosine_bar"] - penalty, t["low_editdist_bar"], -1), np.where(dist <= t["low_cosine_bar"] - penalty, t["high_editdist_bar"], -1))
                undated = dist <= t["nodob_cosine_bar"] - penalty
                keep = (undated & (one.empty[p] | two.empty[q])) | (((most >= 0) | undated) & (one.wild[p] | two.wild[q]))
                rest = np.flatnonzero(~keep & (most >= 0))
                keep[rest] = _dates_may_meet(one, p[rest], two, q[rest], most[rest])
                yield pa.RecordBatch.from_arrays([one.names.take(pa.array(p[keep])), two.names.take(pa.array(q[keep])), pa.array(dist[keep])], ["nn_string_1", "nn_string_2", "cos_dist"])

    return _tasks(spark, len(todo)).mapInArrow(run, "nn_string_1 string, nn_string_2 string, cos_dist double")


def nearest_names(pairs: DataFrame, k: int = 500) -> DataFrame:
    """The k nearest names of each nn_string_1, ties (to nine digits) by nn_string_2; pairs in both directions."""
    w = Window.partitionBy("nn_string_1").orderBy(F.round("cos_dist", 9), "nn_string_2")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def one_direction(pairs: DataFrame, queried: DataFrame | None = None) -> DataFrame:
    """Of switched pairs one stays: the one in order of nn_string + '::', or, in an incremental run, one whose second name was not queried."""
    one, two = F.concat("nn_string_1", F.lit("::")), F.concat("nn_string_2", F.lit("::"))
    in_order = pairs.where(one < two)
    if queried is None:
        return in_order
    return in_order.unionByName(pairs.where(one > two).join(queried.select(F.col("nn_string").alias("nn_string_2")), "nn_string_2", "left_anti").select(*pairs.columns))


def either_direction(pairs: DataFrame) -> DataFrame:
    """Each pair once, in order of nn_string + '::', also one that is only among the nearest of one of its names."""
    first = F.concat("nn_string_1", F.lit("::")) < F.concat("nn_string_2", F.lit("::"))
    a, b = F.col("nn_string_1"), F.col("nn_string_2")
    turned = pairs.select(F.when(first, a).otherwise(b).alias("nn_string_1"), F.when(first, b).otherwise(a).alias("nn_string_2"), "cos_dist")
    return turned.groupBy("nn_string_1", "nn_string_2").agg(F.min("cos_dist").alias("cos_dist"))


def filter_pairs(pairs: DataFrame, expanded: DataFrame, thresholds: dict, same_name: bool = False) -> DataFrame:
    """Blockstring pairs that pass one of three bars on name distance, edit distance of dates, and, without dates, difference in age.

    pairs: nn_string_1/2, cos_dist, commonness_penalty_1/2. A missing date gives edit distance -1. Name pairs that reach a blockstring pair in
    several ways count once, with their least distance. The pair is ordered by nn_string + '::'.
    """
    side = lambda i, *more: expanded.select(F.col("nn_string").alias(f"nn_string_{i}"), F.col("nn_string_full").alias(f"full_{i}"), F.col("ed_string").alias(f"ed_{i}"), F.col("absval").alias(f"abs_{i}"), *more)
    df = pairs.withColumn("p", (F.col("commonness_penalty_1") + F.col("commonness_penalty_2")) / 2)
    if same_name:  # a placeholder name with many dates is paired by many tasks
        expanded = expanded.join(expanded.groupBy("nn_string").agg((1 + F.floor(F.count(F.lit(1)) / NAME_ROWS)).cast("int").alias("salts")), "nn_string")
        one, two = side(1, F.pmod(F.xxhash64("nn_string_full", "ed_string", "absval"), "salts").cast("int").alias("salt")), side(2, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        df = df.join(one, "nn_string_1").join(two, ["nn_string_2", "salt"]).where(F.col("ed_1") <= F.col("ed_2"))
    else:
        df = df.join(side(1), "nn_string_1").join(side(2), "nn_string_2")
    edits = F.when((F.col("ed_1") == "") | (F.col("ed_2") == ""), -1).otherwise(F.levenshtein("ed_1", "ed_2"))
    df = df.withColumn("edit_dist", edits).where(F.col("edit_dist") <= max(thresholds["low_editdist_bar"], thresholds["high_editdist_bar"])).groupBy("full_1", "full_2", "ed_1", "ed_2", "edit_dist", "p", "cos_dist").agg(F.min(F.abs(F.col("abs_1") - F.col("abs_2"))).alias("absdiff"))
    c, e, p, t = F.col("cos_dist"), F.col("edit_dist"), F.col("p"), thresholds
    high = (c <= t["high_cosine_bar"] - p + EPS) & e.between(0, t["low_editdist_bar"])
    low = (c <= t["low_cosine_bar"] - p + EPS) & e.between(0, t["high_editdist_bar"])
    nodob = (c <= t["nodob_cosine_bar"] - p + EPS) & (e == -1) & (F.col("absdiff").isNull() | (F.col("absdiff") <= t["absvalue_bar"]))
    df = df.where(high | low | nodob)
    first = F.concat("full_1", F.lit("::")) <= F.concat("full_2", F.lit("::"))
    bs1, bs2 = F.concat_ws("::", "full_1", "ed_1"), F.concat_ws("::", "full_2", "ed_2")
    out = df.select(F.when(first, bs1).otherwise(bs2).alias("blockstring_1"), F.when(first, bs2).otherwise(bs1).alias("blockstring_2"), "cos_dist", "edit_dist")
    return out.groupBy("blockstring_1", "blockstring_2").agg(F.min("cos_dist").alias("cos_dist"), F.min("edit_dist").alias("edit_dist")).withColumn("covered_pair", F.lit(1))


def exact_name_pairs(info: DataFrame) -> DataFrame:
    """Each name on more than one row, paired with itself at distance 0."""
    c = info.where(F.col("n_total") > 1)
    return c.select(F.col("nn_string").alias("nn_string_1"), F.col("nn_string").alias("nn_string_2"), F.lit(0.0).alias("cos_dist"), F.col("commonness_penalty").alias("commonness_penalty_1"), F.col("commonness_penalty").alias("commonness_penalty_2"))


def candidate_pairs(names: DataFrame, params: Parameters) -> DataFrame:
    """Blocking from the blocking table (``records.blocking_table``) to distinct candidate pairs of blockstrings."""
    t, scheme = params.blocking_thresholds, params.blocking_scheme
    split = split_last_names(names) if params.split_names else names.withColumn("nn_string_full", F.col("nn_string"))
    split = cut(split)
    info = cut(name_info(names, split, t["common_name_max_penalty"]))
    expanded = cut(expanded_strings(split))
    vectors = cut(unit_vectors(shingles(info, scheme["alpha"], scheme["power"])))
    queries = info.where(F.col("n_new") > 0) if params.incremental else None
    near = cut(near_names(vectors, info, expanded, t, params.neighbours, queries))
    near = one_direction(near, queries) if params.incremental else either_direction(near)
    penalty = lambda i: info.select(F.col("nn_string").alias(f"nn_string_{i}"), F.col("commonness_penalty").alias(f"commonness_penalty_{i}"))
    near = near.join(penalty(1), "nn_string_1").join(penalty(2), "nn_string_2")
    exact = exact_name_pairs(info if queries is None else queries)
    both = filter_pairs(near, expanded, t).unionByName(filter_pairs(exact, expanded, t, same_name=True))
    return both.groupBy("blockstring_1", "blockstring_2").agg(F.min("cos_dist").alias("cos_dist"), F.min("edit_dist").alias("edit_dist"), F.max("covered_pair").alias("covered_pair"))


def true_pairs(links: DataFrame) -> DataFrame:
    """Distinct blockstring pairs of must-links between kept records."""
    return links.where((F.col("drop_from_nm_1") == 0) & (F.col("drop_from_nm_2") == 0)).select("blockstring_1", "blockstring_2").distinct()


def uncovered_pairs(candidates: DataFrame, true: DataFrame, params: Parameters) -> DataFrame:
    """True pairs of unequal blockstrings that blocking missed, with exact cosine and edit distance; covered_pair is 0."""
    missed = true.where(F.col("blockstring_1") != F.col("blockstring_2")).join(candidates.select("blockstring_1", "blockstring_2"), ["blockstring_1", "blockstring_2"], "left_anti")
    missed = missed.withColumns({f"nn_string_{i}": name_part(F.col(f"blockstring_{i}")) for i in (1, 2)} | {f"ed_{i}": date_part(F.col(f"blockstring_{i}")) for i in (1, 2)})
    missed = cut(missed)
    named = missed.select(F.col("nn_string_1").alias("nn_string")).unionByName(missed.select(F.col("nn_string_2").alias("nn_string")))
    vectors = unit_vectors(shingles(named, params.blocking_scheme["alpha"], params.blocking_scheme["power"]))
    distances = cosine_of_pairs(missed.select("nn_string_1", "nn_string_2").distinct(), vectors)
    return missed.join(distances, ["nn_string_1", "nn_string_2"]).select("blockstring_1", "blockstring_2", "cos_dist", F.levenshtein("ed_1", "ed_2").alias("edit_dist"), F.lit(0).alias("covered_pair"))


def add_uncovered(candidates: DataFrame, uncovered: DataFrame) -> DataFrame:
    return candidates.unionByName(uncovered)


def pair_completeness(candidates: DataFrame, true: DataFrame) -> DataFrame:
    """One row: pc_eq_cos, pc_eq_cosed, pc_neq_cos, pc_neq_cosed (three digits), n_true_pairs and n_uncovered. Null where nothing is to be found."""
    names = lambda df: df.withColumns({f"nn_{i}": name_part(F.col(f"blockstring_{i}")) for i in (1, 2)})
    cand = candidates.select("blockstring_1", "blockstring_2")
    seen_pairs = cand.withColumn("hit", F.lit(1))
    seen_names = names(cand).select("nn_1", "nn_2").distinct().withColumn("hit_name", F.lit(1))
    df = names(true).join(seen_pairs, ["blockstring_1", "blockstring_2"], "left").join(seen_names, ["nn_1", "nn_2"], "left")
    both, unequal = F.concat_ws(" ", "nn_1", "nn_2"), F.col("blockstring_1") != F.col("blockstring_2")
    agg = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(unequal).alias("n_neq"), F.count_if(unequal & F.col("hit").isNull()).alias("miss"),
        F.count_distinct(both).alias("nn"), F.count_distinct(F.when(F.col("nn_1") != F.col("nn_2"), both)).alias("nn_neq"), F.count_distinct(F.when(F.col("hit_name").isNull(), both)).alias("nn_miss"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.bround(1 - F.col(a) / F.col(b), 3))
    return agg.select(share("nn_miss", "nn").alias("pc_eq_cos"), share("miss", "n").alias("pc_eq_cosed"), share("nn_miss", "nn_neq").alias("pc_neq_cos"), share("miss", "n_neq").alias("pc_neq_cosed"), F.col("n").alias("n_true_pairs"), F.col("miss").alias("n_uncovered"))


def decile_histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, share) of values in (0, 1]: right-closed tenths, numbered 1 to 10; 0 and values outside are in no bin and in no denominator."""
    inside = df.where((F.col(column) > 0) & (F.col(column) <= 1)).select(F.ceil(F.round(F.col(column) * 10, 9)).cast("int").alias("bin"))
    counts = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # ten rows
