"""Per-key processing without imbalance: exact offset chunking.

Every row gets an exact position in the order (key, input partition, place in the partition). Positions come from counts per (key,
input partition) and prefix sums over them, so no task ever sorts or holds a whole key. Rows are then cut into chunks of equal size by
position: a chunk holds many small keys or one slice of a large key. Chunks are processed independently; what a chunk says about a key
is a small *state*, and only the states of keys that cross chunk borders have to be merged, in order of the chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.runtime import cut, parallelism

#: Rows of a chunk. 100 k narrow rows are a few MB, whatever their keys.
CHUNK_ROWS = 100_000


def running_total(df: DataFrame, order: list[str], value: str, out: str, kind: str = "long") -> DataFrame:
    """Exclusive prefix sum of ``value`` over the total order ``order``, as column ``out`` of type ``kind``; ``order`` must be unique.

    Range partitions are summed one by one; only one sum per partition reaches the driver, and a window per partition adds the rest.
    An empty table stays empty. Null values count as 0.
    """
    spark = df.sparkSession
    parts = parallelism(spark)
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()))
    sums = ranged.groupBy("_pid").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("s")).collect()  # at most `parts` rows
    bases, base = {}, 0
    for r in sorted(sums, key=lambda r: r["_pid"]):
        bases[r["_pid"]] = base
        base += r["s"]
    base_of = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv])[F.col("_pid")] if bases else F.lit(0)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(out, (base_of + F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(w), F.lit(0))).cast(kind)).drop("_pid")


def number_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``key_pos`` (0-based place of the row within its key) and ``pos`` (place over all rows in order of the keys).

    Nulls form a key of their own. Repeated rows get different places. Columns named _part, _mid, _off are reserved.
    """
    ranked = df.withColumn("_mid", F.monotonically_increasing_id())
    ranked = cut(ranked.withColumn("_part", F.shiftright(F.col("_mid"), 33).cast("int")))  # fixes which rows form an input partition
    counts = ranked.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # A key has at most one count per input partition, so this window is bounded by the number of partitions.
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = cut(offsets)
    starts = running_total(offsets.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys, "_total", "_start").drop("_total")
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    places = offsets.alias("o").join(starts.alias("s"), same("o", "s", keys)).select(*[F.col(f"o.{k}") for k in keys], "_part", "_off", "_start")
    within = Window.partitionBy(*keys, "_part").orderBy("_mid")  # bounded by one input partition
    ranked = ranked.withColumn("_rn", F.row_number().over(within) - 1)
    joined = ranked.alias("r").join(places.alias("p"), same("r", "p", [*keys, "_part"]))
    out = joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_off") + F.col("_rn")).alias("key_pos"), (F.col("_start") + F.col("_off") + F.col("_rn")).alias("pos"))
    return out


def chunked_aggregate(
    df: DataFrame,
    keys: list[str],
    state: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per-key results from equal-sized chunks.

    state: name -> aggregate over the rows of one key inside one chunk. merge: name -> function from the name of the state column to the
    aggregate that joins the states of a key; states carry ``chunk`` for merges that depend on the order (``F.max_by(c, "chunk")`` is the
    last state). Null keys are kept as a key. Empty input gives an empty result.
    """
    chunked = number_rows(df, keys).withColumn("chunk", F.floor(F.col("pos") / F.lit(chunk_rows)))
    states = chunked.repartition(F.col("chunk")).groupBy("chunk", *keys).agg(*[c.alias(n) for n, c in state.items()])
    # One state per key and chunk: a key of R rows has at most R / chunk_rows + 2 of them.
    return states.groupBy(*keys).agg(*[merge[n](n).alias(n) for n in state])


def key_weights(an: DataFrame, nn: DataFrame) -> DataFrame:
    """Rows (field_name, key_value, weight): each row of ``an`` weighs 1 for its blockstring, each of ``nn`` its n_total (null: 0)."""
    blocks = an.select(F.lit("blockstring").alias("field_name"), F.col("blockstring").alias("key_value"), F.lit(1).cast("long").alias("weight"))
    names = nn.select(F.lit("nn_string").alias("field_name"), F.col("nn_string").alias("key_value"), F.coalesce(F.col("n_total"), F.lit(0)).cast("long").alias("weight"))
    return blocks.unionByName(names)


def count_by_key(an: DataFrame, nn: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """field_name, key_value, n_rows, total for every value of both fields, null included, by exact offset chunking."""
    return chunked_aggregate(
        key_weights(an, nn), ["field_name", "key_value"],
        {"n_rows": F.count(F.lit(1)), "total": F.sum("weight")}, {"n_rows": F.sum, "total": F.sum}, chunk_rows,
    )


def heavy_keys(an: DataFrame, nn: DataFrame, share: float = 0.01, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(field_name, key_value) of the non-null values holding at least ``share`` of their field's whole weight.

    Every row counts as delivered, repeats and null keys too (in the whole). Nothing comes out of a field whose whole is 0.
    """
    counts = cut(count_by_key(an, nn, chunk_rows))
    whole = counts.groupBy("field_name").agg(F.sum("total").alias("whole"))  # two rows
    return (
        counts.join(F.broadcast(whole), "field_name")
        .where(F.col("key_value").isNotNull() & (F.col("whole") > 0) & (F.col("total") >= share * F.col("whole")))
        .select("field_name", "key_value")
    )
