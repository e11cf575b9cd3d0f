"""Queries of this subpackage, and the SQL that checks them where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import address, bpe, components, names, packing, quality, softlink, termfreq, vectors
from kinweave.runtime import cut
from kinweave.runtime import read_table as t


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return softlink.matched_pairs(t(spark, d, "an"), t(spark, d, "nicknames"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_confidence(spark, d).select("record_id_1", "record_id_2")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(t(spark, d, "raw_data"), t(spark, d, "nicknames"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_records(t(spark, d, "all_names_clustering"), t(spark, d, "gt_edges_clustering"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.marked_terms(t(spark, d, "last_names"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.name_term_counts(t(spark, d, "last_names")).select("term", "total", "n_records")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return address.same_location_pairs(t(spark, d, "raw_data"), t(spark, d, "street_types"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_pairs(t(spark, d, "name_vectors")).select(F.col("ix_1").alias("nn_string_ix_1"), F.col("ix_2").alias("nn_string_ix_2"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(t(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(t(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Windows filled to equal shares of tokens of the six languages, by label; texts of other labels get their natural share."""
    docs = t(spark, d, "documents").withColumn("source", F.lower(F.coalesce("lang", F.lit(""))))
    return packing.mixture_report(docs, dict.fromkeys(("en", "de", "fr", "es", "ru", "zh"), 1.0))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.no_prose(t(spark, d, "documents"), t(spark, d, "common_words"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.tail_scores(cut(quality.document_statistics(t(spark, d, "documents"), t(spark, d, "common_words"))))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_confidence, p2_found, p3_found, p4_found, p4_counts, p5_found, p7_found, p8_ids, p9_packed, p9_mixture, p10_found, p10_stats)}


TERMS = r"""
terms AS (SELECT n.id, upper(x.term) AS term, n.ln_count FROM names n, unnest(regexp_split_to_array(n.last_name, '[\s -]+')) AS x(term) WHERE x.term <> ''),
counts AS (SELECT term, CAST(sum(coalesce(ln_count, 0)) AS BIGINT) AS total, count(DISTINCT id) AS n_records FROM terms GROUP BY term)
"""
NAMES = r"""names AS (SELECT row_number() OVER () AS id, last_name, ln_count FROM (SELECT DISTINCT * FROM last_names) WHERE trim(coalesce(last_name, '')) <> '')"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
WITH RECURSIVE e AS (
  SELECT record_id_1 AS a, record_id_2 AS b FROM gt_edges_clustering WHERE record_id_1 <> '' AND record_id_2 <> ''
  UNION SELECT record_id_2, record_id_1 FROM gt_edges_clustering WHERE record_id_1 <> '' AND record_id_2 <> ''),
r AS (SELECT DISTINCT record_id AS root, record_id AS v FROM all_names_clustering WHERE record_id IS NOT NULL
  UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.v)
SELECT min(root) AS group_id, v AS record_id FROM r WHERE v IN (SELECT record_id FROM all_names_clustering) GROUP BY v""",
        "p4_found": f"""
WITH {NAMES}, {TERMS}
SELECT term, mark FROM (SELECT term, CASE WHEN n_records >= 0.02 * (SELECT count(*) FROM names) THEN 'common' WHEN total < 5 THEN 'rare' END AS mark FROM counts)
WHERE mark IS NOT NULL""",
        "p4_counts": f"WITH {NAMES}, {TERMS} SELECT term, total, n_records FROM counts",
        "p7_found": """
WITH v AS (SELECT nn_string_ix AS ix, any_value(vec) AS vec FROM name_vectors WHERE nn_string_ix IS NOT NULL AND vec IS NOT NULL GROUP BY nn_string_ix),
u AS (SELECT ix, vec::DOUBLE[64] AS vec FROM v WHERE list_sum([x * x for x in vec]) > 0),
d AS (SELECT a.ix AS a, b.ix AS b, round(1 - array_cosine_similarity(a.vec, b.vec), 12) AS dist FROM u a JOIN u b ON a.ix <> b.ix),
k AS (SELECT a, b, dist, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS r FROM d)
SELECT DISTINCT least(a, b) AS nn_string_ix_1, greatest(a, b) AS nn_string_ix_2 FROM k WHERE r <= 5 AND dist <= 0.2""",
    }
