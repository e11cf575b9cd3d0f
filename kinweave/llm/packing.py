"""Filling containers of fixed capacity: mixture-controlled packing.

Every source is a queue of items. Deficit round-robin gives each window of containers a quantum of tokens per source and carries what a
source over- or underspent into the next window. Over whole queues this has a closed form: the window of an item is the number of quanta
that the tokens before it in its queue fill, so deficits are carried exactly across all windows and partitions, and windows are found by
prefix sums instead of one sequential pass. Windows are packed independently (best fit, largest item first); the least filled containers of
each window go on to a next level that joins the leftovers of many windows, until one group is left. Every group of every level is bounded.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.bpe import encode_corpus
from kinweave.runtime import cut, parallelism, plain_strings

CAPACITY = 2_048
#: Containers a window is meant to fill, and windows whose leftovers one group of the next level joins.
WINDOW_CONTAINERS, FAN_IN = 64, 64
#: Containers of a window that may go on to the next level; bounds the groups there by FAN_IN * CARRIED containers.
CARRIED = 2
#: Items of size 0 in a window.
EMPTY_PER_WINDOW = 50_000


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item: largest first, each into the fullest container that still takes it."""
    free: list[tuple[int, int]] = []  # (space left, container), sorted
    place, n = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            left, c = free.pop(at)
        else:
            left, c, n = capacity, n, n + 1
        place[i] = c
        insort(free, (left - sizes[i], c))
    return place


def round_robin(pdf: pd.DataFrame) -> pd.DataFrame:
    """Order of a window: the sources' queues in turn, by the share of its tokens each source has spent."""
    spent = pdf.groupby("source", sort=False)["size"].cumsum() - pdf["size"]
    whole = pdf.groupby("source", sort=False)["size"].transform("sum").clip(lower=1)
    return pdf.assign(turn=spent / whole).sort_values(["turn", "source", "key"], kind="stable")


def windows_of(items: DataFrame, capacity: int, mixture: dict[str, float] | None) -> tuple[DataFrame, int]:
    """items(key, source, piece, start, size) with ``win`` added, and the number of windows."""
    spark = items.sparkSession
    total, n_items, n_empty = items.agg(F.sum("size"), F.count(F.lit(1)), F.count_if(F.col("size") == 0)).first()
    per_window = WINDOW_CONTAINERS * capacity
    n_windows = max(1, -(-(total or 0) // per_window), -(-n_empty // EMPTY_PER_WINDOW))
    slices = max(parallelism(spark), n_items // 200_000 + 1)
    queued = items.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
    parts = queued.groupBy("source", "slice").agg(F.sum("size").alias("tokens"))  # one row per source and slice
    by_source = Window.partitionBy("source")
    parts = parts.withColumn("before", F.sum("tokens").over(by_source.orderBy("slice")) - F.col("tokens")).withColumn("all", F.sum("tokens").over(by_source))
    weight: Column = F.lit(None).cast("double")
    if mixture:
        norm = sum(mixture.values())
        for s, v in mixture.items():
            weight = F.when(F.col("source") == s, v / norm).otherwise(weight)
    # Without a target a source's share is its share of all tokens, and then every queue ends in the last window.
    share = F.coalesce(weight, F.col("all") / F.lit(max(total or 0, 1)))
    parts = parts.withColumn("quantum", F.greatest(share * per_window, F.lit(1e-9))).select("source", "slice", "before", "quantum")
    within = Window.partitionBy("source", "slice").orderBy(F.xxhash64("key", F.lit(1)), "key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    queued = queued.withColumn("cum", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["source", "slice"])
    win = F.floor((F.col("before") + F.col("cum")) / F.col("quantum")).cast("long")
    win = F.when(F.col("size") == 0, F.pmod(F.xxhash64("key"), F.lit(n_windows))).otherwise(win)
    return queued.withColumn("win", win).drop("slice", "before", "cum", "quantum"), n_windows


def packer(capacity: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The packing of one window; its loosest containers are marked as carried, except on the last level."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = round_robin(pdf).reset_index(drop=True)
        place = pd.Series(best_fit(pdf["size"].tolist(), capacity))
        fill = pdf["size"].groupby(place).sum()
        loose = [] if last else fill[fill < capacity].nsmallest(CARRIED).index
        return plain_strings(pdf.assign(carried=place.isin(loose), container=[f"{level}-{w}-{c}" for w, c in zip(pdf["win"], place)])[["key", "source", "piece", "start", "size", "win", "carried", "container"]])

    return pack


def pack_items(items: DataFrame, capacity: int = CAPACITY, mixture: dict[str, float] | None = None) -> DataFrame:
    """items(key, source, size) -> (key, piece, start, size, container).

    An item larger than the capacity is cut into full containers and a rest, which is packed like an item; all others stay whole. Items of
    size 0 go into a container too. A null size counts as 0, a null source is a source of its own. ``mixture`` maps sources to target shares
    of the tokens of a window; sources not named get their natural share. No item is dropped; no container exceeds the capacity. Repeated
    keys are items of their own. An empty table gives an empty result.
    """
    cap = F.lit(capacity)
    sized = items.select("key", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    full = (
        sized.where(F.col("size") >= cap)
        .select("key", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / cap).cast("int") - 1)).alias("piece"))
        .select("key", "piece", (F.col("piece") * cap).cast("long").alias("start"), cap.cast("long").alias("size"), F.concat_ws("-", F.lit("full"), F.monotonically_increasing_id(), "key", "piece").alias("container"))
    )
    pieces = F.floor(F.col("size") / cap).cast("int")
    rest = sized.where((F.col("size") == 0) | (F.col("size") % cap > 0)).select("key", "source", pieces.alias("piece"), (pieces * cap).cast("long").alias("start"), (F.col("size") % cap).alias("size"))
    queued, n_windows = windows_of(cut(rest), capacity, mixture)
    kind = dict(items.dtypes)["key"]
    done: list[DataFrame] = []
    level, last = 1, False
    while not last:
        last = n_windows <= 1

        # By the number of windows, not by bytes: packing costs much per row, and small tables would end in a single task.
        queued = queued.repartition(min(n_windows, parallelism(queued.sparkSession)), "win")
        packed = cut(queued.groupBy("win").applyInPandas(packer(capacity, level, last), f"key {kind}, source string, piece int, start long, size long, win long, carried boolean, container string"))
        done.append(packed.where(~F.col("carried")))
        queued = packed.where("carried").select("key", "source", "piece", "start", "size", F.floor(F.col("win") / F.lit(FAN_IN)).cast("long").alias("win"))
        n_windows, level = -(-n_windows // FAN_IN), level + 1
        if not last and mixture and n_windows <= 1:  # with a target mixture, queues may run on past the expected number of windows
            n_windows = (queued.agg(F.max("win")).first()[0] or 0) + 1
    out = full
    for d in done:
        out = out.unionByName(d.select("key", "piece", "start", "size", "container"))
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, mixture: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, container_id) of the texts of ``docs``, sizes in tokens of the vocabulary at ``path``."""
    lens = cut(encode_corpus(docs, path=path, lengths_only=True, carry=["source"]))
    packed = pack_items(lens.select(F.col("doc_id").alias("key"), "source", F.col("n_tokens").alias("size")), capacity, mixture)
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def mixture_report(docs: DataFrame, mixture: dict[str, float], capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(win, source, n_tokens, share): the tokens of each source in each window of the target ``mixture``, and their share of the window.

    While all queues last, shares follow the mixture up to one item; windows after the end of a queue hold what the others have left.
    """
    lens = cut(encode_corpus(docs, path=path, lengths_only=True, carry=["source"]))
    items = lens.select(F.col("doc_id").alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("n_tokens").cast("long").alias("size"))
    queued, _ = windows_of(items, capacity, mixture)
    by = queued.groupBy("win", "source").agg(F.sum("size").alias("n_tokens"))
    return by.select("win", "source", "n_tokens", (F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("win"))).alias("share"))  # a row per source
