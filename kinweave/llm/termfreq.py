"""Frequency of every distinct term: heavy-light aggregation.

Heavy terms are found with a Misra-Gries summary per input partition (bounded), merged and kept if they may hold more than a given share of
all terms. Their number is bounded by 1 / share, so they are broadcast; every partition counts them in exact arrays of that length and sends
one row per heavy term instead of one per occurrence. Only the remaining terms are shuffled. Both tables are united; counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import plain_strings

#: A term is heavy when it may make up this share of all occurrences; at most 1 / HEAVY_SHARE terms are broadcast.
HEAVY_SHARE = 0.002


def split_terms(name: Column) -> Column:
    """Parts of the upper-cased text between white space and hyphens; no empty parts."""
    return F.filter(F.split(F.upper(name), r"[\s -]+"), lambda t: t != "")


def heavy_terms(terms: DataFrame, share: float = HEAVY_SHARE) -> list[str]:
    """Terms of column ``term`` that may hold more than ``share`` of all rows: all that do, few that don't, at most 2 / share."""
    k = int(2 / share)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = pd.Series(dtype="int64"), 0
        for pdf in batches:
            kept = kept.add(pdf["term"].value_counts(), fill_value=0).astype("int64")
            n += len(pdf)
            if len(kept) > k:  # Misra-Gries: subtract the (k + 1)-th largest count; what remains is off by at most n / k
                kept = kept - np.partition(kept.to_numpy(), -k - 1)[-k - 1]
                kept = kept[kept > 0]
        if len(kept):
            yield plain_strings(pd.DataFrame({"term": kept.index.astype(str), "n": kept.to_numpy(), "rows": 0}))
        yield pd.DataFrame({"term": [""], "n": [0], "rows": [n]})

    merged = terms.select("term").mapInPandas(summarise, "term string, n long, rows long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    total = merged.agg(F.sum("rows")).first()[0] or 0
    # An undercount is at most rows / k = share / 2 of all rows, so every heavy term passes half the bar; at most 2 / share terms can.
    return [r["term"] for r in merged.where((F.col("term") != "") & (F.col("n") >= F.lit(total * share / 2)) & (F.col("n") > 0)).select("term").orderBy("term").collect()]


def heavy_light_counts(terms: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """terms(term, value, holds) -> (term, total, n_records): sums of ``value`` and ``holds`` per term.

    ``holds`` is 1 on one of a record's occurrences of the term and 0 on its others, so its sum is the number of records holding the term.
    Null values add 0. An empty table gives an empty result.
    """
    spark = terms.sparkSession
    heavy = heavy_terms(terms, share)
    known = spark.sparkContext.broadcast(pd.Index(heavy))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = known.value
        totals, holds, seen = (np.zeros(len(index), dtype="int64") for _ in range(3))
        for pdf in batches:
            at = index.get_indexer(pdf["term"])
            is_heavy = at >= 0
            a = at[is_heavy]
            np.add.at(totals, a, pdf["value"].to_numpy()[is_heavy])
            np.add.at(holds, a, pdf["holds"].to_numpy()[is_heavy])
            np.add.at(seen, a, 1)
            light = pdf[~is_heavy]
            if len(light):
                yield plain_strings(light.groupby("term", as_index=False)[["value", "holds"]].sum().rename(columns={"value": "total", "holds": "n_records"}).assign(heavy=False))
        some = seen > 0
        yield plain_strings(pd.DataFrame({"term": index[some].astype(str), "total": totals[some], "n_records": holds[some], "heavy": True}))

    counted = terms.select("term", F.coalesce("value", F.lit(0)).cast("long").alias("value"), F.col("holds").cast("long")).mapInPandas(local, "term string, total long, n_records long, heavy boolean")
    # Rows of heavy terms are already one per partition; light terms have few rows. No key of this shuffle is hot.
    return counted.groupBy("term").agg(F.sum("total").cast("long").alias("total"), F.sum("n_records").cast("long").alias("n_records"))


def name_term_counts(last_names: DataFrame) -> DataFrame:
    """(term, total, n_records, n_rows): counts of every term of last_name; n_rows is the number of rows left, the same on every row.

    Rows equal in all columns count once; rows with a null or blank last_name are left out; null ln_count adds 0; a term that occurs
    twice in a name adds its count twice but the row once.
    """
    rows = last_names.distinct().where(F.coalesce(F.regexp_replace("last_name", r"[\s ]", ""), F.lit("")) != "")
    parts = split_terms(F.col("last_name"))
    # A row's occurrences of one term differ only in their place: the first one holds the row.
    terms = rows.select(F.posexplode(parts).alias("at", "term"), parts.alias("all"), F.col("ln_count").alias("value")).select(
        "term", "value", (F.array_position("all", F.col("term")) == F.col("at") + 1).cast("long").alias("holds")
    )
    n_rows = rows.count()
    return heavy_light_counts(terms).withColumn("n_rows", F.lit(n_rows).cast("long"))


def marked_terms(last_names: DataFrame, common_share: float = 0.02, rare_below: int = 5) -> DataFrame:
    """(term, mark): 'common' if the term is in at least ``common_share`` of the rows left, else 'rare' if its total is below ``rare_below``."""
    mark = F.when(F.col("n_records") >= common_share * F.col("n_rows"), "common").when(F.col("total") < rare_below, "rare")
    return name_term_counts(last_names).select("term", mark.alias("mark")).where(F.col("mark").isNotNull())
