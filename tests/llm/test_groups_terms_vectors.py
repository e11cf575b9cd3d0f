import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinweave.llm import components, minhash, termfreq, vectors

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def groups(records, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r in records:
        if r is not None:
            find(r)
    for a, b in edges:
        if a and b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((find(r), r) for r in set(records) if r is not None)


def grouped(spark, records, edges, hot_rows=None):
    r = spark.createDataFrame([(x, 1) for x in records], "record_id string, group_id int")
    e = spark.createDataFrame(edges, "record_id_1 string, record_id_2 string")
    return sorted(tuple(x) for x in components.group_records(r, e).select("group_id", "record_id").collect())


def test_chain_star_and_dirt(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"s{i:03d}") for i in range(150)]
    dirt = [(None, "c000"), ("", "hub"), ("hub", None), ("s001", "s001"), ("s001", "hub"), ("zz", "")]
    records = [x for e in chain + star for x in e] + ["alone", "alone", "", None, "zz"]
    assert grouped(spark, records, chain + star + dirt) == groups(records, chain + star + dirt)


def test_hot_vertices_take_the_broadcast_way(spark):
    edges = spark.createDataFrame([("hub", f"s{i}") for i in range(60)] + [("s1", "t"), ("x", "y")], "a string, b string")
    got = dict(components.hash_to_min(edges, hot_rows=20).collect())
    assert {got[f"s{i}"] for i in range(60)} == {"hub"} and got["t"] == "hub" and got["y"] == "x"


def test_empty_groups(spark):
    assert grouped(spark, [], []) == [] and grouped(spark, ["a", "b"], []) == [("a", "a"), ("b", "b")] and grouped(spark, [], [("a", "b")]) == []


@SLOW
@given(st.lists(st.tuples(st.sampled_from("abcdefghij"), st.sampled_from("abcdefghij")), max_size=12))
def test_random_groups(spark, edges):
    assert grouped(spark, list("abcdefghij"), edges) == groups(list("abcdefghij"), edges)


def test_term_counts(spark, rows):
    data = [("Lee", 3, 1), ("LEE", 3, 1), ("Lee", 3, 1), ("Lee - Lee", 4, 2), (" kim-LEE  ", None, 3), (None, 9, 4), ("  ", 9, 5), ("", 9, 6), ("Ito", 2, 7), ("Oda", 5, 8)]
    df = spark.createDataFrame([(*d, "x") for d in data], "last_name string, ln_count long, place_no long, term string")
    assert rows(termfreq.name_term_counts(df), "term", "total", "n_records", "n_rows") == [("ITO", 2, 1, 6), ("KIM", 0, 1, 6), ("LEE", 14, 4, 6), ("ODA", 5, 1, 6)]
    assert rows(termfreq.marked_terms(df, common_share=0.5)) == [("ITO", "rare"), ("KIM", "rare"), ("LEE", "common")]
    assert rows(termfreq.marked_terms(df.limit(0))) == []


def test_heavy_terms_are_bounded_and_counts_exact(spark):
    random.seed(1)
    words = ["HOT"] * 4_000 + ["WARM"] * 900 + [f"W{random.randrange(3_000)}" for _ in range(5_000)]
    random.shuffle(words)
    df = spark.createDataFrame([(w, 1, 1) for w in words], "term string, value long, holds int").repartition(6)
    heavy = termfreq.heavy_terms(df, 0.05)
    assert {"HOT", "WARM"} <= set(heavy) and len(heavy) <= 40
    got = {r["term"]: r["total"] for r in termfreq.heavy_light_counts(df, 0.05).collect()}
    assert got == Counter(words)


def nearest(vecs, k=5, limit=0.2):
    ids = sorted(i for i, v in vecs.items() if v is not None and np.linalg.norm(v) > 0)
    u = {i: np.asarray(vecs[i], dtype=np.float64) / np.linalg.norm(np.asarray(vecs[i], dtype=np.float64)) for i in ids}
    out = set()
    for a in ids:
        best = sorted((round(1 - float(u[a] @ u[b]), 9), b) for b in ids if b != a)[:k]
        out |= {(min(a, b), max(a, b)) for d, b in best if d <= limit}
    return sorted(out)


def found(spark, vecs, repeat=(), **kw):
    data = [(i, None if v is None else [float(np.float32(x)) for x in v], "x") for i, v in [*vecs.items(), *((i, vecs[i]) for i in repeat)]]
    df = spark.createDataFrame(data, "nn_string_ix long, vec array<float>, direction string")
    return sorted((r[0], r[1]) for r in vectors.nearest_pairs(df, **kw).collect())


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    vecs = {i: (centre[i % 12] + rng.normal(scale=0.35, size=16)) * 10.0 ** rng.integers(-3, 4) for i in range(150)}
    for i in range(150, 165):
        vecs[i] = vecs[3] * 2.0 ** (i % 3)  # copies, more than k + 1 of them
    vecs |= {200: None, 201: np.zeros(16), 202: vecs[5], 203: vecs[5] * 0.5}
    vecs = {i: None if v is None else np.asarray(v, dtype=np.float32) for i, v in vecs.items()}
    assert found(spark, vecs, repeat=[0, 7, 150], block_rows=40) == nearest(vecs)


def test_vectors_nothing_to_find(spark):
    assert found(spark, {}) == [] and found(spark, {1: None, 2: np.zeros(4)}) == [] and found(spark, {1: np.ones(4)}) == []
    assert found(spark, {1: np.ones(4), 2: np.ones(4) * 3, 3: -np.ones(4)}) == [(1, 2)]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    codes, scale, err = vectors.quantise(u)
    approx = (codes.astype(np.float64) @ codes.T) * scale[:, None] * scale
    assert (np.abs(approx - u @ u.T) <= err[:, None] + err + err[:, None] * err + 1e-12).all()


def test_collision_curve(spark):
    assert minhash.collision(0.4, minhash.bands_for(0.4, 0.97, 2), 2) >= 0.97
    df = spark.createDataFrame([(1, ["MARTIN"]), (2, ["MARTIN"]), (3, []), (4, None), (5, [None, ""]), (6, ["ZQX"])], "i int, w array<string>")
    got = {r["i"]: r["k"] for r in minhash.with_band_keys(df, minhash.padded_qgrams(df["w"]), k=(6, 2, 0)).collect()}
    assert got[1] == got[2] and len(got[1]) == 6 and got[3] == got[4] == got[5] == [] and not set(got[1]) & set(got[6])


@pytest.mark.parametrize("words,n", [(["AB"], 3), (["AB", "AB"], 3), ([""], 0)])
def test_qgrams(spark, words, n):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert len(df.select(minhash.padded_qgrams(df["w"])).first()[0]) == n


@pytest.mark.parametrize("same", [True, False])
def test_tiles_stay_in_a_cache_and_lose_no_pair(same):
    assert vectors.TILE_ROWS * vectors.TILE_COLS * 4 <= 2**21
    rng = np.random.default_rng(3)
    u = rng.standard_normal((vectors.TILE_COLS + 300, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = u if same else u[::-1][:700]
    near = 1 - np.einsum("id,jd->ij", u, v) <= 0.001
    r, c, _ = vectors.tile_pairs(u, v, 0.001, 5, same)
    assert set(zip(r.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1) if same else near))))
