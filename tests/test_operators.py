import math
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.config import Parameters
from kinweave.operators import blocking, clustering, evaluation, features, model, mustlinks, nameprob, records, skew
from kinweave.operators.components import connected_components
from kinweave.runtime import dedup_latest, hot_keys, join_hot

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_dedup_latest(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", None, 7), (None, 1, 8)], "k string, o int, v int")
    assert rows(dedup_latest(df, "k", ["o"]), "k", "v") == [("a", 6), ("b", 7)]


def test_join_hot(spark, rows):
    large = spark.createDataFrame([(i % 3 if i > 50 else 0, i) for i in range(90)], "k int, v int")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k int, w string")
    hot = hot_keys(large, "k", hot_rows=40)
    assert rows(hot) == [(0,)]
    assert rows(join_hot(large, small, "k", hot), "k", "v", "w") == rows(large.join(small, "k"), "k", "v", "w")


@pytest.mark.parametrize("chunk", [1, 3, 1_000])
def test_chunked_aggregate(spark, rows, chunk):
    data = [("hot", i) for i in range(40)] + [("a", 1), ("a", 1), (None, 5), (None, None), ("b", 7)]
    df = spark.createDataFrame(data, "k string, v long").repartition(5)
    got = skew.chunked_aggregate(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum, "s": F.sum}, chunk)
    assert rows(got, "k", "n", "s") == rows(df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")), "k", "n", "s")


def test_number_rows(spark):
    df = spark.createDataFrame([("hot",)] * 30 + [("a",), (None,), ("a",)], "k string").repartition(4)
    got = skew.number_rows(df, ["k"]).toPandas()
    assert sorted(got["pos"]) == list(range(33))
    for _, g in got.groupby(got["k"].fillna("?")):
        assert sorted(g["key_pos"]) == list(range(len(g))) and g["pos"].max() - g["pos"].min() == len(g) - 1


def test_heavy_keys_edge_cases(spark, rows):
    an = spark.createDataFrame([("x", "u")] * 3 + [(None, "u")] * 97, "blockstring string, extra string")
    nn = spark.createDataFrame([("n", None), ("n", 5), (None, 95), ("m", 0)], "nn_string string, n_total long")
    assert rows(skew.heavy_keys(an, nn, chunk_rows=10)) == [("blockstring", "x"), ("nn_string", "n")]
    assert rows(skew.heavy_keys(an.limit(0), nn.limit(0))) == []


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "k int, v int").repartition(7)
    got = skew.running_total(df, ["k"], "v", "s").orderBy("k").toPandas()
    assert got["s"].tolist() == [sum(j % 5 for j in range(i)) for i in range(100)]


def find_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components(spark, edges):
    v = spark.createDataFrame([(i,) for i in range(15)], "id long")
    e = spark.createDataFrame(edges, "a long, b long")
    got = dict(connected_components(v, e).collect())
    assert [got[i] for i in range(15)] == find_components(15, edges)


def test_components_of_eight(spark):
    edges = [("A", "B"), ("A", "C"), ("B", "C"), ("E", "F"), ("F", "G"), ("G", "E"), (None, "A"), ("H", "H")]
    got = connected_components(spark.createDataFrame([(c,) for c in "ABCDEFGH"], "id string"), spark.createDataFrame(edges, "a string, b string"))
    assert len({r["component"] for r in got.collect()}) == 4


def test_labels(spark):
    pairs = [("1234", "1234"), ("bbcd", ""), ("mm252", "zj890"), ("rh125", "rj125"), (None, "a"), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(mustlinks.label([("a", "b")])).collect()] == ["1", "", "0", "0", "", ""]
    assert [r[0] for r in df.select(mustlinks.label([("a", "b")], 1)).collect()] == ["1", "", "0", "", "", ""]


def test_valid_edges(spark):
    df = spark.createDataFrame([("1", "1", "x", "y"), ("1", "2", "x", "x"), ("1", "2", "x", "y"), ("1", "", None, "y"), ("11", "12", "", "")], "u_1 string, u_2 string, w_1 string, w_2 string")
    assert clustering.valid_edges(df, ["u"]).count() == 2
    assert clustering.valid_edges(df, ["u"], leven=1).count() == 5
    assert clustering.valid_edges(df, ["u", "w"]).count() == 3
    assert clustering.valid_edges(df, ["u"], several_uids=True).count() == 5


def test_similar_names_against_all_pairs(spark):
    random.seed(5)
    words = ["".join(random.choice("ABCDE") for _ in range(random.randint(2, 7))) for _ in range(40)]
    names = sorted({f"{random.choice(words)}::{random.choice(words)}" for _ in range(60)} | {"::", "A::", "::B"})
    vec = blocking.unit_vectors(blocking.shingles(spark.createDataFrame([(n,) for n in names], "nn_string string")))
    table = {}
    for r in vec.collect():
        table.setdefault(r[0], {})[r[1]] = r[2]
    want = {(a, b) for a in table for b in table if a + "::" < b + "::" and 1 - sum(x * table[b].get(g, 0) for g, x in table[a].items()) <= 0.4 + 1e-9}
    assert {(r[0], r[1]) for r in blocking.similar_names(vec, 0.4).collect()} == want
    both = blocking.similar_names(vec, 0.4, ordered=False)
    assert both.count() == 2 * len(want)
    assert blocking.nearest_names(both, 1).groupBy("nn_string_1").count().where("count > 1").count() == 0


def test_similar_names_store_vectors_once(spark):
    vec = blocking.unit_vectors(blocking.shingles(spark.createDataFrame([(f"ANN::LEE{c}",) for c in "ABC"], "nn_string string")))
    assert "Exchange" not in blocking.similar_names(vec, 0.4)._jdf.queryExecution().executedPlan().toString()


def some_names(spark, n=150):
    random.seed(7)
    words, dates = ["".join(random.choice("ABC") for _ in range(random.randint(2, 5))) for _ in range(25)], ["", "1990-01-01", "1990-01-10", "1909-01-01", "1990-02-03", "2001-12-31", "199-01-01"]
    rows = [(f"r{i}", random.choice(["new", "existing"]), random.choice(words), random.choice(words), random.choice(dates), random.choice([None, 3.0, 20.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "record_id string, file_type string, first string, last string, ed_string string, absval double")
    return df.withColumns({"nn_string": F.concat_ws("::", "first", "last"), "blockstring": F.concat_ws("::", "first", "last", "ed_string")})


@pytest.mark.parametrize("incremental", [False, True])
def test_near_names_are_the_nearest_that_may_pass(spark, rows, monkeypatch, incremental):
    monkeypatch.setattr(blocking, "BLOCK_NAMES", 30)
    names, t, k = some_names(spark), Parameters().blocking_thresholds, 4
    split = blocking.split_last_names(names)
    info, expanded = blocking.name_info(names, split, 0.1).cache(), blocking.expanded_strings(split).cache()
    vec = blocking.unit_vectors(blocking.shingles(info)).cache()
    asked = info.where("n_new > 0") if incremental else None
    near = blocking.near_names(vec, info, expanded, t, k, asked).cache()
    nearest = blocking.nearest_names(blocking.similar_names(vec, 0.4, ordered=False, queries=asked), k).drop("rank").cache()
    assert 0 < near.count() < nearest.count() and near.join(nearest, ["nn_string_1", "nn_string_2"], "left_anti").count() == 0
    penalty = lambda i: info.select(F.col("nn_string").alias(f"nn_string_{i}"), F.col("commonness_penalty").alias(f"commonness_penalty_{i}"))
    kept = lambda df: rows(blocking.filter_pairs(df.join(penalty(1), "nn_string_1").join(penalty(2), "nn_string_2"), expanded, t).withColumn("cos_dist", F.round("cos_dist", 9)))
    assert kept(near) == kept(nearest)


def test_same_names_in_parts(spark, rows, monkeypatch):
    names, t = some_names(spark), Parameters().blocking_thresholds
    split = blocking.split_last_names(names)
    exact, expanded = blocking.exact_name_pairs(blocking.name_info(names, split, 0.1)), blocking.expanded_strings(split)
    want = rows(blocking.filter_pairs(exact, expanded, t, same_name=True))
    monkeypatch.setattr(blocking, "NAME_ROWS", 2)
    assert rows(blocking.filter_pairs(exact, expanded, t, same_name=True)) == want != []


def test_shingle_mass(spark):
    df = spark.createDataFrame([("PETER::HICKS",), ("ANN::LEE",)], "nn_string string")
    assert [round(r[0], 9) for r in blocking.shingles(df, alpha=0.5, power=1).groupBy("nn_string").agg(F.sum("w")).select("sum(w)").collect()] == [1.5, 1.5]


def test_split_and_counts(spark, rows):
    df = spark.createDataFrame([("r1", "new", "BEN", "SMITH JONES", "", None), ("r2", "new", "BEN", "SMITH", "", 3.0), ("r3", "existing", "BEN", "SMITH", "", 3.0)], "record_id string, file_type string, first string, last string, ed_string string, absval double")
    df = df.withColumn("nn_string", F.concat_ws("::", "first", "last"))
    s = blocking.split_last_names(df)
    assert rows(blocking.name_counts(s)) == [("BEN::JONES", 1, 0, 1), ("BEN::SMITH", 2, 1, 3), ("BEN::SMITH JONES", 1, 0, 1)]
    pen = dict(blocking.commonness_penalties(df.select("last"), 0.4).collect())
    assert pen["SMITH"] == 0.4 and pen["SMITH JONES"] == 0.0
    assert dict(blocking.commonness_penalties(df.limit(1).select("last"), 0.4).collect()) == {"SMITH JONES": 0.4}


def test_empty_blocking(spark):
    empty = spark.createDataFrame([], "record_id string, file_type string, first_name string, last_name string, dob string, age long, drop_from_nm int, blockstring string")
    assert blocking.candidate_pairs(records.blocking_table(empty, Parameters()), Parameters()).count() == 0


def test_percentiles_and_probabilities(spark):
    names = spark.createDataFrame([("*ANN LEE*",)] * 3 + [("*BO X*",), ("*ANNA LEE*",), ("*A*",)], "name string")
    p = {r[0]: r[1] for r in nameprob.percentiles(names, "name").collect()}
    assert p == {"*ANN LEE*": 1.0, "*BO X*": 0.25, "*ANNA LEE*": 0.25, "*A*": 0.25}
    probs = {r[0]: r[1] for r in nameprob.name_probabilities(names, nameprob.ngram_counts(names)).collect()}
    assert probs["*A*"] == 0.0 and probs["*ANN LEE*"] > probs["*ANNA LEE*"] > 0
    pairs = spark.createDataFrame([("ANN", "ANNA"), ("ANN", "ANN"), ("BO", "BA")], "name_1 string, name_2 string")
    cond = {(r[0], r[1]): r["cond"] for r in nameprob.conditional_probabilities(pairs, nameprob.edit_counts(pairs)).collect()}
    assert cond["ANN", "ANN"] == 1.0 and math.isclose(cond["BO", "BA"], 0.5 + 0.001)


def test_string_features(spark):
    df = spark.createDataFrame([("HICKS", "HACKS"), ("1665", "1865"), ("", "X"), (None, None)], "n_1 string, n_2 string")
    got = features.with_slow_strings(df, ["n"]).select(*[c.alias(k) for k, c in features.compare_strings("n").items()]).toPandas()
    assert got["n_edit_dist"].tolist()[:2] == [1, 1] and got["n_missing"].tolist() == [0, 0, 1, 1]
    assert got["n_soundex"].tolist() == [1, 1, 0, 0] and got["n_nysiis"].tolist()[1:] == [0, 0, 0]
    assert [round(x, 2) for x in got["n_jw_dist"][:2]] == [0.12, 0.15] and got["n_jw_dist"][2:].isna().all()


def test_swap(spark):
    df = spark.createDataFrame([("LEE", "ANN", "ANN", "LEE", 0.1, 0.2), ("LEE", "ANN", "ANN", "LEE", 0.2, 0.1), ("ANN", "LEE", "ANN", "LEA", 0.1, 0.2)], "f_1 string, l_1 string, f_2 string, l_2 string, prob_name_1 double, prob_name_2 double")
    got = [tuple(r)[:4] for r in features.swap_names(df, "f", "l").select("f_1", "l_1", "f_2", "l_2").collect()]
    assert got == [("ANN", "LEE", "ANN", "LEE"), ("LEE", "ANN", "LEE", "ANN"), ("ANN", "LEE", "ANN", "LEA")]


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1, 1.0), (0.8, 0, 2.0), (0.3, 1, 1.0), (0.1, 0, 1.0)], "phat double, outcome int, weight double")
    m = evaluation.pair_metrics(df, 0.5).first()
    assert (m["precision"], m["recall"], m["fpr"], m["accuracy"]) == (1 / 3, 0.5, 2 / 3, 0.4)
    assert evaluation.auc(df).first()[0] == pytest.approx((1 * 3 + 1 * 1) / (2 * 3))
    assert evaluation.best_threshold(df, 0.5).first()["threshold"] == 0.9
    assert evaluation.pair_metrics(df.limit(0), 0.5).first()["precision"] is None
    assert evaluation.best_threshold(df.limit(0)).first()["threshold"] is None


def sequential(records, edges):
    return clustering.merge_greedily(records, edges, ["uid"], None, False, None, None)[0]


@SLOW
@given(st.integers(0, 10_000))
def test_clustering_by_component_equals_one_loop(spark, seed):
    rng = random.Random(seed)
    ids = [f"r{i:02d}" for i in range(24)]
    rec = pd.DataFrame({"record_id": ids, "cluster_id": range(24), "uid": [rng.choice(["", "", "a", "b", "c"]) for _ in ids]})
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(30)})
    edges = pd.DataFrame([(a, b, 0, rng.choice([0.7, 0.8, 0.9, 0.95])) for a, b in pairs], columns=["record_id_1", "record_id_2", "gt", "phat"])
    names = spark.createDataFrame(rec[["record_id", "uid"]])
    ordered = clustering.cluster_edges(spark.createDataFrame(edges), names, ["uid"], clustering.Constraints())
    got = clustering.greedy_clusters(spark.createDataFrame(rec[["record_id", "cluster_id"]]), ordered, names, ["uid"])
    valid = {(r[0], r[1]) for r in ordered.collect()}
    seq = edges[[(a, b) in valid for a, b in zip(edges["record_id_1"], edges["record_id_2"])]].assign(o=lambda d: -d["phat"]).sort_values(["o", "record_id_1", "record_id_2"])
    want = sequential(rec, seq)
    assert dict(got.collect()) == {r: str(c) for r, c in zip(want["record_id"], want["cluster_id"])}
    uids = pd.DataFrame(got.collect(), columns=["record_id", "c"]).merge(rec, on="record_id")
    assert (uids[uids["uid"] != ""].groupby("c")["uid"].nunique() <= 1).all()


def test_user_constraints(spark):
    names = spark.createDataFrame([(f"r{i}", "", i) for i in range(4)], "record_id string, uid string, size int")
    links = spark.createDataFrame([("r0", "r1", 0.9), ("r1", "r2", 0.8), ("r2", "r3", 0.7)], "record_id_1 string, record_id_2 string, phat double")
    rule = clustering.Constraints(valid_cluster=lambda df, phat: len(df) <= 2 or df["size"].max() < 3, columns=("size",), types={"size": "int"})
    start = clustering.initial_clusters(names, None)
    got = dict(clustering.greedy_clusters(start, clustering.cluster_edges(links, names, ["uid"], rule), names, ["uid"], rule).collect())
    assert got["r0"] == got["r1"] == got["r2"] != got["r3"]
    assert clustering.Constraints(columns=("all",)).read(names, ["uid"]).columns == ["record_id", "uid", "size"]
    no_link = clustering.Constraints(valid_link=F.col("phat") > 0.75)
    assert clustering.cluster_edges(links, names, ["uid"], no_link).count() == 2


def test_existing_ids_stay(spark):
    names = spark.createDataFrame([("a", "7"), ("b", ""), ("c", "3"), ("d", "")], "record_id string, eid string")
    start = clustering.initial_clusters(names, None, existing_id="eid")
    assert dict(start.collect()) == {"a": 7, "c": 3, "b": 8, "d": 9}
    links = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.99), ("c", "d", 0.8)], "record_id_1 string, record_id_2 string, phat double")
    edges = clustering.cluster_edges(links, names, [], clustering.Constraints(), existing_id="eid")
    assert dict(clustering.greedy_clusters(start, edges, names, [], existing_id="eid").collect()) == {"a": "7", "b": "7", "c": "3", "d": "3"}


def test_leven_cluster_rule():
    assert clustering.cluster_ok([{"a1", "a2"}], set(), False, 1) and not clustering.cluster_ok([{"a1", "b9"}], set(), False, 1)
    assert not clustering.cluster_ok([{"a", "b"}], set(), False, None) and clustering.cluster_ok([{"a", "b"}], set(), True, None)
    assert not clustering.cluster_ok([], {"1", "2"}, True, None)


def test_refused_merges_are_counted(spark):
    names = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "2"), ("d", "")], "record_id string, uid string")
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.7)], "record_id_1 string, record_id_2 string, phat double")
    edges = clustering.cluster_edges(links, names, ["uid"], clustering.Constraints())
    got = clustering.greedy_clusters(clustering.initial_clusters(names, None), edges, names, ["uid"], with_refused=True)
    assert got.agg(F.sum("refused")).first()[0] == 1 and {r[0]: r[1] for r in got.collect()} == {"a": "0", "b": "0", "c": "2", "d": "2"}


def test_nearest_names_of_either_side(spark):
    near = spark.createDataFrame([("b", "a", 0.1), ("a", "b", 0.1), ("c", "a", 0.2)], "nn_string_1 string, nn_string_2 string, cos_dist double")
    assert {tuple(r) for r in blocking.either_direction(near).select("nn_string_1", "nn_string_2").collect()} == {("a", "b"), ("a", "c")}


def test_hash_split_is_stable(spark):
    df = spark.range(1_000).select(F.col("id").cast("string").alias("dr_id"))
    a, b = model.hash_split(df, 0.9, 7)
    assert a.count() + b.count() == 1_000 and 850 < a.count() < 950
    assert {r[0] for r in a.collect()} == {r[0] for r in model.hash_split(df.repartition(9), 0.9, 7)[0].collect()}
