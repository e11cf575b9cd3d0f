"""Consolidating pairwise matches into groups: hash-to-min.

Each vertex keeps a cluster set, at first itself and its neighbours. Every round it sends its whole set to the set's minimum and that
minimum to all members; sets are kept as rows (vertex, member), so even the set that gathers a third of all records is spread over the
cluster. Rows of a vertex whose minimum is known meet that minimum by a shuffle join, the rows of hot vertices by a broadcast whose size
is bounded (see ``runtime.hot_keys``). The rounds end when no set changes; the number of rounds is logarithmic in practice, also on chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import HOT_ROWS, MAX_HOT_KEYS, cut, join_hot, release


def clean_edges(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct edges (a, b) with a < b; edges with a null or empty end and edges of a record to itself link nothing."""
    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    ok = edges.where(a.isNotNull() & b.isNotNull() & (a != "") & (b != "") & (a != b))
    return ok.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def hash_to_min(edges: DataFrame, max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(record_id, group_id) for every vertex of ``edges`` (columns a, b); group_id is the smallest vertex of its component.

    State: rows (v, u), u a member of the set of v. A round computes m = min(set of v) and emits (m, u) and (u, m). It is a fixpoint when
    the number of rows and their hash sum stay the same. ``max_rounds`` only guards against a defect: it raises, it never returns a part.
    """
    state = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))))
    seen = None
    for _ in range(max_rounds):
        least = cut(state.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        total = least.agg(F.sum("n")).first()[0] or 0
        hot = least.where(F.col("n") > max(hot_rows, total // MAX_HOT_KEYS)).select("v")
        both = join_hot(state, least.drop("n"), "v", hot)
        # v itself is a member of its own set: (m, v) and (v, m) come from the last term.
        sent = both.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        own = least.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("v").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e"))
        before, state = state, cut(sent.unionByName(own).select("e.v", "e.u").where(F.col("v") != F.col("u")).distinct())
        release(before, least)
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == seen:
            return state.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("group_id")).withColumnRenamed("v", "record_id")
        seen = now
    raise RuntimeError("hash-to-min did not settle")


def group_records(records: DataFrame, edges: DataFrame, record: str = "record_id", left: str = "record_id_1", right: str = "record_id_2") -> DataFrame:
    """(group_id, record_id): one row for each distinct non-null record id.

    A record without links is its own group. Repeated records and edges count once. Ends that are in no row of ``records`` still carry
    links but get no row. Empty tables give an empty result (or every record on its own).
    """
    ids = records.select(F.col(record).cast("string").alias("record_id")).where(F.col("record_id").isNotNull()).distinct()
    groups = hash_to_min(clean_edges(edges, left, right))
    return ids.join(groups, "record_id", "left").select(F.coalesce("group_id", "record_id").alias("group_id"), "record_id")
