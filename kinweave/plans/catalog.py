"""Queries of the core over whole tables, each beside the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import Parameters, Schema
from kinweave.functions import cleaning as C
from kinweave.functions.similarity import jaro_winkler, jw_distance, nysiis, soundex_key
from kinweave.operators import blocking, clustering, evaluation, features, mustlinks, nameprob, records, skew
from kinweave.operators.components import connected_components
from kinweave.plans import sql as S
from kinweave.plans.pipeline import LinkagePipeline
from kinweave.runtime import cut, shared_folder
from kinweave.runtime import read_table as t
from kinweave.sources import files

PARAMS = Parameters()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def an(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "an")


def names(spark: SparkSession, d: str) -> DataFrame:
    return records.blocking_table(an(spark, d), PARAMS)


def split(spark: SparkSession, d: str) -> DataFrame:
    return blocking.split_last_names(names(spark, d))


def info(spark: SparkSession, d: str) -> DataFrame:
    n = names(spark, d)
    return blocking.name_info(n, blocking.split_last_names(n), 0.1)


def tallies(spark: SparkSession, d: str) -> DataFrame:
    """nn_string_info summed over batches: one row per name; the penalty is the greatest given one."""
    return t(spark, d, "nn_string_info").where(F.col("nn_string").isNotNull()).groupBy("nn_string").agg(F.coalesce(F.max("commonness_penalty"), F.lit(0.1)).alias("commonness_penalty"), F.sum("n_new").alias("n_new"), F.sum("n_existing").alias("n_existing"), F.sum("n_total").alias("n_total"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Stored neighbour pairs with a distance, each direction of a pair once, with its least distance and greatest penalties."""
    df = t(spark, d, "near_neighbors_df").where(F.col("nn_string_1").isNotNull() & F.col("nn_string_2").isNotNull() & F.col("cos_dist").isNotNull())
    return df.groupBy("nn_string_1", "nn_string_2").agg(F.min("cos_dist").alias("cos_dist"), *[F.coalesce(F.max(f"commonness_penalty_{i}"), F.lit(0.1)).alias(f"commonness_penalty_{i}") for i in (1, 2)])


def people(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (record_id, blockstring, drop_from_nm, file_type, uid) of an; null as ''."""
    return an(spark, d).select("record_id", C.text("blockstring").alias("blockstring"), "drop_from_nm", C.text("file_type").alias("file_type"), C.text("uid").alias("uid")).distinct()


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a made-up probability, outcome, weight and exactmatch, the same in every engine."""
    li = t(spark, d, "lineitem")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131
    outcome = ((k % 1000) + (F.col("l_partkey") % 7) * 60 > 600).cast("int")
    return li.select(((k % 1000) / 1000).alias("phat"), outcome.alias("outcome"), (1 + F.col("l_linenumber") % 3).cast("double").alias("weight"), (F.col("l_suppkey") % 5 == 0).cast("int").alias("exactmatch"))


# -- sources and cleaning ----------------------------------------------------------------------------------------------------------------


@query(S.CLEAN_NAMES)
def clean_names(spark, d):
    raw = t(spark, d, "raw_data")
    up = lambda c: C.check_default(F.col(c))
    return raw.select("row_id", C.clean_name(up("firstname")).alias("first_name"), C.clean_name(C.check_default(C.last_name_prep(F.col("lastname")))).alias("last_name"))


@query(S.SET_MISSING)
def set_missing_and_drop(spark, d):
    raw = t(spark, d, "raw_data")
    first, last = (C.check_default(C.set_missing(C.check_default(F.col(c)), ["UNKNOWN", "WITHHELD"])) for c in ("firstname", "lastname"))
    out = raw.select("row_id", first.alias("first_name"), last.alias("last_name"))
    rules = [{"first_name": "TEST", "last_name": "ENTRY"}, {"first_name": "BABY", "last_name": "BOY"}]
    return out.withColumn("drop_from_nm", (C.in_drop_list(F.col("last_name"), ["NAME", "GIRL"]) | C.auto_drop(rules)).cast("int"))


@query(S.CHECKS)
def checked_values(spark, d):
    return t(spark, d, "raw_data").select("row_id", C.check_date(F.col("birthdate"), "%m/%d/%Y").alias("dob"), C.check_numeric(F.col("age_2021")).alias("age"), C.check_categorical(F.col("gender"), ["m", "f"]).alias("gender"))


@query(S.TWO_FIGURE_YEARS)
def two_figure_years(spark, d):
    return t(spark, d, "raw_data").select("row_id", C.check_date(F.col("birthdate"), "%m/%d/%y").alias("dob"))


@query(S.GEO)
def geo_columns(spark, d):
    return t(spark, d, "raw_data").select("row_id", C.geo_single(F.col("latlon")).alias("geo"), C.geo_pair(F.col("lat"), F.col("lon")).alias("geo_pair"))


@query(S.ADDRESSES)
def parsed_addresses(spark, d):
    p = C.parse_address(F.col("address"))
    return t(spark, d, "raw_data").select("row_id", p["number"].alias("number"), p["name"].alias("name"), p["type"].alias("type"))


@query(S.KEYS)
def blockstrings(spark, d):
    b = C.joined_key([F.col("first_name"), F.col("last_name"), F.col("dob")])
    return an(spark, d).select("record_id", b.alias("blockstring")).distinct().withColumns({"nn_string": C.name_part(F.col("blockstring")), "ed_string": C.date_part(F.col("blockstring"))})


@query("SELECT count(*) AS n, count(*) FILTER (record_id IS NULL OR record_id = '') AS n_null, count(DISTINCT record_id) AS n_distinct, count(*) FILTER (NOT starts_with(record_id, 'intake__')) AS n_unprefixed FROM an")
def source_ids(spark, d):
    return files.id_report(an(spark, d), "record_id", "intake")


@query(S.STACKED)
def stacked_sources(spark, d):
    """raw_data as a source of its own, through the whole cleaning projection."""
    schema = Schema.of(RAW_CONFIG)
    raw = t(spark, d, "raw_data")
    df = raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in raw.columns])
    out = records.stack({"intake": df}, Parameters.of(RAW_CONFIG), schema)
    return out.select("record_id", "file_type", "dataset", "first_name", "last_name", "dob", "gender", "age", "drop_from_nm", "blockstring", "tmp_raw__first_name")


RAW_CONFIG = {
    "data_files": {"intake": {"filepath": "", "record_id_col": "row_id"}},
    "variables": [
        {"name": "first_name", "compare_type": "String", "intake": "firstname"}, {"name": "last_name", "compare_type": "LastName", "intake": "lastname", "drop": ["NAME"]},
        {"name": "dob", "compare_type": "Date", "check": "Date - %m/%d/%Y", "intake": "birthdate"}, {"name": "gender", "compare_type": "Categorical", "intake": "gender", "set_missing": ["u"]},
        {"name": "age", "compare_type": "Numeric", "check": "Numeric", "intake": "age_2021"}, {"name": "address", "compare_type": "Address", "intake": "address"}, {"name": "uid", "compare_type": "UniqueID", "intake": "uid"},
    ],
}


# -- must-links and labels ---------------------------------------------------------------------------------------------------------------


@query(S.MUST_LINKS)
def must_links(spark, d):
    return mustlinks.must_links(people(spark, d), ["uid"])


@query(S.MUST_LINKS_INCREMENTAL)
def must_links_incremental(spark, d):
    return mustlinks.must_links(people(spark, d), ["uid"], incremental=True)


@query(S.MUST_LINKS_TWO)
def must_links_two_ids(spark, d):
    """A second identifier of blockstring and house number, unknown without a number or a date."""
    number = C.text("address_street_number")
    key2 = F.when((number != "") & C.text("blockstring").rlike(r"\d$"), F.concat_ws("|", "blockstring", number)).otherwise("")
    two = an(spark, d).select("record_id", C.text("blockstring").alias("blockstring"), "drop_from_nm", C.text("file_type").alias("file_type"), C.text("uid").alias("uid"), key2.alias("key2")).distinct()
    return mustlinks.must_links(two, ["uid", "key2"]).select("record_id_1", "record_id_2")


@query("SELECT uid, n_records, CASE WHEN n_records > 3 THEN 'error' ELSE 'warning' END AS level FROM (SELECT CAST(uid AS VARCHAR) AS uid, count(DISTINCT record_id) AS n_records FROM an WHERE uid IS NOT NULL GROUP BY 1) WHERE n_records > 2")
def uid_sizes(spark, d):
    return mustlinks.uid_sizes(an(spark, d), "uid", warn=2, error=3)


def close_pairs(spark, d):
    """Record pairs of one name and address number, side by side."""
    cols = ["record_id", "first_name", "last_name", "dob", "gender", "age", "uid", "address_street_number", "address_street_name", "file_type"]
    one = an(spark, d).where((F.col("drop_from_nm") == 0) & F.col("address_street_number").isNotNull() & (F.col("last_name") != "")).groupBy("record_id").agg(*[F.max(c).alias(c) for c in cols[1:]])
    side = lambda i: one.select(*[F.col(c).alias(f"{c}_{i}") for c in cols])
    return side(1).join(side(2), (F.col("last_name_1") == F.col("last_name_2")) & (F.col("address_street_number_1") == F.col("address_street_number_2")) & (F.col("record_id_1") < F.col("record_id_2")))


@query(S.LABELS)
def pair_labels(spark, d):
    p = close_pairs(spark, d)
    return p.select("record_id_1", "record_id_2", mustlinks.label([("uid_1", "uid_2")]).alias("label"), mustlinks.label([("uid_1", "uid_2")], 1).alias("label_leven"), mustlinks.label([("uid_1", "uid_2"), ("dob_1", "dob_2")]).alias("label_two"))


# -- blocking ----------------------------------------------------------------------------------------------------------------------------


@query(S.SPLIT_NAMES)
def split_last_names(spark, d):
    return blocking.expanded_strings(split(spark, d))


@query(S.NAME_COUNTS)
def name_counts(spark, d):
    return blocking.name_counts(split(spark, d))


@query(S.PENALTIES)
def commonness_penalties(spark, d):
    return blocking.commonness_penalties(names(spark, d).select("last"), 0.1).select("last", F.round("penalty", 9).alias("penalty"))


@query(S.NAME_INFO)
def name_info(spark, d):
    return info(spark, d).withColumn("commonness_penalty", F.round("commonness_penalty", 9))


@query(S.SHINGLES)
def shingle_weights(spark, d):
    return blocking.shingles(split(spark, d)).select("nn_string", "shingle", F.round("w", 9).alias("w"))


@query(S.SIMILAR)
def similar_names(spark, d):
    vectors = cut(blocking.unit_vectors(blocking.shingles(split(spark, d))))
    return blocking.similar_names(vectors, PARAMS.blocking_thresholds["low_cosine_bar"]).select("nn_string_1", "nn_string_2", F.abs(F.round("cos_dist", 6)).alias("cos_dist"))


@query(S.COSINES)
def cosine_of_pairs(spark, d):
    n = cut(neighbours(spark, d).select("nn_string_1", "nn_string_2"))
    both = n.select(F.col("nn_string_1").alias("nn_string")).unionByName(n.select(F.col("nn_string_2").alias("nn_string")))
    return blocking.cosine_of_pairs(n, blocking.unit_vectors(blocking.shingles(both))).select("nn_string_1", "nn_string_2", F.abs(F.round("cos_dist", 6)).alias("cos_dist"))


@query(S.NEAREST)
def nearest_names(spark, d):
    return blocking.nearest_names(neighbours(spark, d), PARAMS.neighbours).select("nn_string_1", "nn_string_2", "cos_dist", "rank")


@query(S.ONE_DIRECTION)
def one_direction(spark, d):
    return blocking.one_direction(neighbours(spark, d)).select("nn_string_1", "nn_string_2")


@query(S.ONE_DIRECTION_INCREMENTAL)
def one_direction_incremental(spark, d):
    return blocking.one_direction(neighbours(spark, d).select("nn_string_1", "nn_string_2"), tallies(spark, d).where("n_new > 0"))


@query(S.EXACT_NAMES)
def exact_name_pairs(spark, d):
    return blocking.exact_name_pairs(tallies(spark, d)).select("nn_string_1", "nn_string_2", "cos_dist", "commonness_penalty_1")


@query(S.FILTERED)
def filtered_pairs(spark, d):
    """Stored neighbours through the three bars."""
    near = blocking.one_direction(neighbours(spark, d))
    return blocking.filter_pairs(near, blocking.expanded_strings(split(spark, d)), PARAMS.blocking_thresholds).withColumn("cos_dist", F.round("cos_dist", 9))


@query(S.CANDIDATES)
def candidate_pairs(spark, d):
    """Blocking as a whole."""
    return blocking.candidate_pairs(names(spark, d), PARAMS).select("blockstring_1", "blockstring_2", F.abs(F.round("cos_dist", 6)).alias("cos_dist"), "edit_dist")


@query(S.TRUE_PAIRS)
def true_pairs(spark, d):
    return blocking.true_pairs(mustlinks.must_links(people(spark, d), ["uid"]))


def stored_candidates(spark, d):
    """Blockstring pairs of records that share a date and a last name."""
    p = people(spark, d).where((F.col("drop_from_nm") == 0) & F.col("blockstring").rlike(r"\d$"))
    k = p.select("blockstring", F.regexp_extract("blockstring", "::(.*)$", 1).alias("k")).distinct()
    return k.select(F.col("blockstring").alias("blockstring_1"), "k").join(k.select(F.col("blockstring").alias("blockstring_2"), "k"), "k").where(F.col("blockstring_1") <= F.col("blockstring_2")).drop("k")


@query(S.UNCOVERED)
def uncovered_pairs(spark, d):
    out = blocking.uncovered_pairs(stored_candidates(spark, d), cut(true_pairs(spark, d)), PARAMS)
    return out.withColumn("cos_dist", F.abs(F.round("cos_dist", 6)))


@query(S.COMPLETENESS)
def pair_completeness(spark, d):
    return blocking.pair_completeness(stored_candidates(spark, d), true_pairs(spark, d))


@query("WITH x AS (SELECT CAST(ceil(round(cos_dist * 10, 9)) AS INT) AS bin FROM near_neighbors_df WHERE cos_dist > 0 AND cos_dist <= 1) SELECT bin, count(*) / (SELECT count(*) FROM x) AS share FROM x GROUP BY bin")
def cosine_histogram(spark, d):
    return blocking.decile_histogram(t(spark, d, "near_neighbors_df"), "cos_dist")


# -- names and features ------------------------------------------------------------------------------------------------------------------


def whole_names(spark, d):
    return an(spark, d).where("drop_from_nm = 0").select("record_id", "first_name", "last_name").distinct().select(nameprob.name_key(F.col("first_name"), F.col("last_name")).alias("name"))


@query(S.PERCENTILES)
def name_percentiles(spark, d):
    return nameprob.percentiles(whole_names(spark, d), "name")


@query(S.NGRAMS)
def ngram_counts(spark, d):
    return nameprob.ngram_counts(whole_names(spark, d))


@query(S.NAME_PROBS)
def name_probabilities(spark, d):
    n = cut(whole_names(spark, d))
    p = nameprob.name_probabilities(n, nameprob.ngram_counts(n))
    log = lambda c: F.round(F.log10(c + 1e-300), 5)
    return p.select("name", log(F.col("prob")).alias("log_prob"), F.round(nameprob.surprisal(F.col("prob"), 1_000), 5).alias("surprisal"))


@query(S.STRING_FEATURES)
def string_features(spark, d):
    p = close_pairs(spark, d).withColumns({"_jw_first_name": F.lit(0.0), "_nysiis_first_name": F.lit(False)})
    got = features.compare_strings("first_name")
    return p.select("record_id_1", "record_id_2", *[got[f"first_name_{k}"].alias(k) for k in ("missing", "edit_dist", "exact_match", "exact_match_1st", "exact_match_1st2nd3rd")])


@query()
def sound_features(spark, d):
    p = features.with_slow_strings(close_pairs(spark, d), ["first_name"])
    got = features.compare_strings("first_name")
    a, b = features.sides("first_name")
    return p.select("record_id_1", "record_id_2", *[got[f"first_name_{k}"].alias(k) for k in ("soundex", "nysiis", "jw_dist")], F.round(jaro_winkler(a, b), 6).alias("jaro_winkler"), nysiis(a).alias("code"), soundex_key(a).alias("key"), jw_distance(a, b).alias("far"))


@query(S.OTHER_FEATURES)
def other_features(spark, d):
    got = features.compare_dates("dob") | features.compare_numbers("age") | features.compare_categories("gender")
    return close_pairs(spark, d).select("record_id_1", "record_id_2", *[c.alias(n) for n, c in got.items()])


@query(S.GEO_FEATURES)
def geo_features(spark, d):
    raw = t(spark, d, "raw_data").where(F.col("latlon").contains(",")).groupBy("uid").agg(F.min("latlon").alias("g_1"), F.max("latlon").alias("g_2")).where("uid IS NOT NULL AND NOT isnan(uid)")
    got = features.compare_geographies("g")
    return raw.select("uid", got["g_missing"].alias("missing"), F.round(got["g_geog_dist"], 6).alias("geog_dist"))


@query(S.EXACT)
def exact_matches(spark, d):
    exact, var_exact = features.exact_match(["first_name", "last_name", "dob"], ["gender"])
    return close_pairs(spark, d).select("record_id_1", "record_id_2", exact.alias("exactmatch"), var_exact.alias("var_exact_match"))


@query(S.SWAPS)
def swapped_names(spark, d):
    one = an(spark, d).where("drop_from_nm = 0 AND uid IS NOT NULL").groupBy("record_id").agg(F.max("first_name").alias("first_name"), F.max("last_name").alias("last_name"), F.max("uid").alias("uid"))
    side = lambda i: one.select(*[F.col(c).alias(f"{c}_{i}") for c in one.columns], (F.length("record_id") / 100).alias(f"prob_name_{i}"))
    p = side(1).join(side(2), (F.col("uid_1") == F.col("uid_2")) & (F.col("record_id_1") < F.col("record_id_2")))
    out = features.swap_names(p, "first_name", "last_name")
    return out.select("record_id_1", "record_id_2", *[F.coalesce(F.col(f"{c}_{i}"), F.lit("")).alias(f"{c}_{i}") for c in ("first_name", "last_name") for i in (1, 2)])


@query(S.SIDE_BY_SIDE)
def side_by_side(spark, d):
    p = people(spark, d)
    pairs = blocking.true_pairs(mustlinks.must_links(p, ["uid"]))
    out = features.side_by_side(pairs, p, incremental=True)
    return features.same_side_labels(out, ["uid"]).select("record_id_1", "record_id_2", "uid_1", "uid_2")


@query(S.ELIGIBLE)
def train_eligible(spark, d):
    p = close_pairs(spark, d).withColumn("labeled_data", (mustlinks.label([("uid_1", "uid_2")]) != "").cast("int"))
    rec = an(spark, d).groupBy("record_id").agg(F.max("dataset").alias("dataset"))
    params = Parameters.of({"match_train_criteria": {"data_rows": {"gender_1": ["m", "M"]}, "all_names": {"dataset": ["intake", "permits"]}}})
    return features.with_eligibility(p, rec, params).select("record_id_1", "record_id_2", "match_train_eligible")


@query(S.MODEL_TO_USE)
def model_choice(spark, d):
    got = features.compare_dates("dob") | features.compare_numbers("age")
    p = close_pairs(spark, d).select("record_id_1", "record_id_2", *[c.alias(f"var_{n}") for n, c in got.items()])
    return p.select("record_id_1", "record_id_2", features.model_to_use({"no_dob": F.col("var_dob_missing") == 1, "no_age": F.col("var_age_missing") == 1}).alias("model_to_use"))


# -- evaluation --------------------------------------------------------------------------------------------------------------------------


@query(S.METRICS)
def pair_metrics(spark, d):
    return rounded(evaluation.pair_metrics(scored(spark, d), 0.6, 0.5))


@query(S.BY_UNIVERSE)
def metrics_by_universe(spark, d):
    return rounded(evaluation.by_universe(scored(spark, d), 0.6, 0.5))


@query(S.THRESHOLDS)
def threshold_table(spark, d):
    return rounded(evaluation.threshold_table(scored(spark, d), 0.5))


@query(S.BEST)
def best_threshold(spark, d):
    return evaluation.best_threshold(scored(spark, d), 0.5).select("threshold", F.round("fscore", 9).alias("fscore"))


@query(S.AUC)
def roc_auc(spark, d):
    return evaluation.auc(scored(spark, d)).select(F.round("auc", 9).alias("auc"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# -- clusters ----------------------------------------------------------------------------------------------------------------------------


@query(S.COMPONENTS)
def must_link_groups(spark, d):
    links = mustlinks.must_links(people(spark, d), ["uid"])
    return connected_components(an(spark, d).select(F.col("record_id").alias("id")), links.select(F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b")))


@query(S.INITIAL)
def initial_clusters(spark, d):
    return clustering.initial_clusters(people(spark, d), mustlinks.must_links(people(spark, d), ["uid"])).withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(S.INITIAL_EXISTING)
def initial_clusters_existing(spark, d):
    return clustering.initial_clusters(people(spark, d).select("record_id", "uid").groupBy("record_id").agg(F.max("uid").alias("uid")), None, existing_id="uid")


@query(S.VALID)
def valid_edges(spark, d):
    p = close_pairs(spark, d)
    one = clustering.valid_edges(p, ["uid"]).select("record_id_1", "record_id_2", F.lit("one").alias("rule"))
    leven = clustering.valid_edges(p, ["uid"], leven=1).select("record_id_1", "record_id_2", F.lit("leven").alias("rule"))
    two = clustering.valid_edges(p, ["uid", "dob"], existing_id="gender").select("record_id_1", "record_id_2", F.lit("two").alias("rule"))
    return one.unionByName(leven).unionByName(two)


@query()
def greedy_clusters(spark, d):
    """Links between records of one last name and house number, merged greedily under the rule of one uid per cluster."""
    p = cut(close_pairs(spark, d))
    links = p.select("record_id_1", "record_id_2", (1 - F.levenshtein(C.text("first_name_1"), C.text("first_name_2")) / 20.0).alias("phat")).where("phat >= 0.7")
    rec = cut(an(spark, d).groupBy("record_id").agg(F.max("uid").cast("string").alias("uid"), F.max("dob").alias("dob")))
    start = cut(clustering.initial_clusters(rec, None))
    edges = cut(clustering.cluster_edges(links, rec, ["uid"], clustering.Constraints()))
    return clustering.greedy_clusters(start, edges, rec, ["uid"])


def uid_clusters(spark, d):
    """record_id -> cluster_id by uid, and a made-up other clustering."""
    return an(spark, d).where("uid IS NOT NULL").groupBy("record_id").agg(F.max("uid").alias("entity")).select("record_id", "entity", F.floor(F.col("entity") / 14).cast("long").alias("cluster_id"))


@query(S.QUALITY)
def cluster_quality(spark, d):
    c = uid_clusters(spark, d)
    return rounded(evaluation.cluster_quality(c.select("record_id", "cluster_id"), c.select("record_id", "entity")))


@query(S.SHAPE)
def cluster_shape(spark, d):
    return clustering.cluster_shape(uid_clusters(spark, d).select("record_id", "cluster_id"))


@query(S.OUTPUT)
def cluster_output(spark, d):
    c = uid_clusters(spark, d).select("record_id", F.col("cluster_id").cast("string").alias("cluster_id"))
    a = an(spark, d).select("record_id", "first_name", "drop_from_nm", "blockstring", F.lower("first_name").alias("tmp_raw__first_name")).distinct()
    return files.all_names_output(a, c)


@query()
def linkage(spark, d):
    """The whole run over the stacked table, all stages with a small forest; returns record_id and cluster_id."""
    config = {
        "data_files": {"an": {"filepath": "", "record_id_col": "record_id", "use_record_id_as_is": True}}, "trees": 20, "max_depth": 10, "min_leaf": [25], "folds": 1, "missingness_model": "dob",
        "variables": [
            {"name": "first_name", "compare_type": "String", "an": "first_name", "drop": ["UNKNOWN", "BABY", "TEST", "WITHHELD"]}, {"name": "last_name", "compare_type": "LastName", "an": "last_name"},
            {"name": "dob", "compare_type": "Date", "an": "dob", "check": "Date - %Y-%m-%d"}, {"name": "age", "compare_type": "Numeric", "an": "age", "check": "Numeric"},
            {"name": "address_name", "compare_type": "String", "an": "address_street_name"}, {"name": "uid", "compare_type": "UniqueID", "an": "uid"},
        ],
    }
    one = an(spark, d).groupBy("record_id").agg(*[F.coalesce(F.max(c).cast("string"), F.lit("")).alias(c) for c in ("first_name", "last_name", "dob", "age", "address_street_name", "uid")])
    run = LinkagePipeline(spark, config, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}", tables={"an": one})
    return run.run(until="clusters").table("clusters")


# -- hot keys ----------------------------------------------------------------------------------------------------------------------------

WEIGHTS = """WITH w AS (
SELECT 'blockstring' AS field_name, blockstring AS key_value, 1 AS weight FROM an
UNION ALL SELECT 'nn_string', nn_string, coalesce(n_total, 0) FROM nn_string_info),
c AS (SELECT field_name, key_value, count(*) AS n_rows, CAST(sum(weight) AS BIGINT) AS total FROM w GROUP BY ALL)
"""


@query(WEIGHTS + "SELECT field_name, key_value FROM c JOIN (SELECT field_name, sum(total) AS whole FROM c GROUP BY 1) USING (field_name) WHERE key_value IS NOT NULL AND total >= 0.01 * whole")
def p6_found(spark, d):
    return skew.heavy_keys(an(spark, d), t(spark, d, "nn_string_info"))


@query(WEIGHTS + "SELECT field_name, key_value, n_rows, total FROM c")
def p6_counts(spark, d):
    return skew.count_by_key(an(spark, d), t(spark, d, "nn_string_info"))


def entry(spark: SparkSession, directory: str) -> DataFrame:
    """Flagship: records, their must-link groups and how large those are."""
    groups = must_link_groups(spark, directory)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n_records"))
    return groups.join(sizes, "component").select(F.col("id").alias("record_id"), F.col("component").alias("group_id"), "n_records")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
