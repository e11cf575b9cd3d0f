import base64
import math

import pytest
import tiktoken

from kinweave.llm import bpe, packing, quality

TEXTS = [
    None, "", " ", "Hello, world! It's 2024.", "aaaa aaaaa  aaaaaaaa\n\n\tb", "<|endoftext|> is text", "了解 了解了解，это тест — ça va?", "\x00\x01﻿​ ퟿", "🙂🙃👩‍👩‍👧‍👦 é",
    "x" * 5_001, "ab" * 4_000, "word " * 3_000, "0123456789" * 500, "{\"k\": [1, 2, 3]}\r\n" * 50,
]


def known():
    data = bpe.vocabulary_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("known", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, source(i), 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, ids int")


def test_encoding(spark):
    enc = known()
    got = dict(bpe.encode_corpus(documents(spark, TEXTS)).collect())
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert all(enc.decode(got[i]) == t for i, t in enumerate(TEXTS) if t)
    lens = dict(bpe.encode_corpus(documents(spark, TEXTS), lengths_only=True).collect())
    assert lens == {i: len(v) for i, v in got.items()}
    assert bpe.encode_corpus(documents(spark, [])).count() == 0


def test_bytes_that_are_no_text(spark):
    df = documents(spark, ["a"]).selectExpr("doc_id", "CAST(X'61FF62' AS STRING) AS text")
    assert bpe.encode_corpus(df).first()["ids"] == known().encode_ordinary("a�b")


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    enc, want = bpe.Encoder(bpe.vocabulary_bytes()), known()
    texts = [f"w{i} and w{i + 1} or {i}" for i in range(30)]
    assert [list(x) for t in texts for x in enc.encode([t])] == [want.encode_ordinary(t) for t in texts]


def packed(spark, sizes, sources=None, capacity=100, **kw):
    items = spark.createDataFrame([(i, (sources or ["a"] * len(sizes))[i], s, "x") for i, s in enumerate(sizes)], "key long, source string, size long, win string")
    return packing.pack_items(items, capacity, **kw).toPandas()


def holds(got, sizes, capacity=100):
    total = got.groupby("key")["size"].sum().to_dict()
    assert total == {i: s or 0 for i, s in enumerate(sizes)}
    fill = got.groupby("container")["size"].sum()
    assert fill.max() <= capacity
    assert (got.groupby("key").size()[[i for i, s in enumerate(sizes) if (s or 0) <= capacity]] == 1).all()
    for k, g in got.groupby("key"):
        g = g.sort_values("start")
        assert g["start"].tolist() == g["size"].cumsum().shift(fill_value=0).tolist()
    return len(fill)


def test_packing(spark):
    sizes = [(i * 37) % 60 + 1 for i in range(900)] + [250, 100, 101, 0, 0, None, 99]
    n = holds(packed(spark, sizes, [f"s{i % 7}" if i % 5 else None for i in range(len(sizes))]), sizes)
    assert n <= math.ceil(sum(s or 0 for s in sizes) / 100) + 2


def test_packing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_CONTAINERS", 4)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    sizes = [(i * 31) % 47 + 3 for i in range(1_500)]
    n = holds(packed(spark, sizes, ["big"] * 500 + [f"s{i % 40}" for i in range(1_000)]), sizes)
    assert n <= math.ceil(sum(sizes) / 100) * 1.02 + 1


def test_large_items_cannot_share(spark):
    sizes = [60] * 300
    assert holds(packed(spark, sizes), sizes) == 300


def test_mixture_targets(spark):
    sizes = [10] * 1_000
    got = packed(spark, sizes, ["a"] * 500 + ["b"] * 500, mixture={"a": 3.0, "b": 1.0})
    assert holds(got, sizes) == 100
    assert packed(spark, []).empty and holds(packed(spark, [0, 0]), [0, 0]) == 1


def test_windows_keep_proportions(spark):
    items = spark.createDataFrame([(i, "a" if i % 4 else "b", 1, 0, 20) for i in range(4_000)], "key long, source string, piece int, start long, size long")
    w, n = packing.windows_of(items, 100, None)
    per = w.groupBy("win").pivot("source").sum("size").toPandas()
    assert n == 13 and ((per["a"] / (per["a"] + per["b"])).iloc[:-1] - 0.75).abs().max() < 0.02


def test_mixture_report(spark):
    docs = documents(spark, ["one two three four five"] * 900, lambda i: "a" if i % 3 else "b")
    got = packing.mixture_report(docs, {"a": 1.0, "b": 1.0}, capacity=20).toPandas().pivot(index="win", columns="source", values="share").fillna(0.0)
    assert len(got) > 1 and (got.iloc[0] - 0.5).abs().max() < 0.02 and got["b"].iloc[-1] < 0.5  # b runs out first, a fills the rest
    assert packing.mixture_report(documents(spark, []), {"a": 1.0}).count() == 0


PROSE = [
    "At noon, the old miller painted the yellow bicycle in the market. The judge watched it.", "- Without a word, the clerk opened the door.\n- The mayor carried a lamp near the river.", "THE JUDGE FOUND THE KEY IN THE MARKET, BUT THE MAYOR LOST IT.",
    "1. Why didn't Dazon see that Fonul had it?\n2. The postman needed the old clock on the hill.", "the apprentice found two letters at the harbour. the tailor hid them.", "Der müde Wächter trug die schwere Tür im Rathaus; denn der Richter vergaß das Register.",
    "终于，最后一位旅客买下了城市地图。为什么Liran没看见Pusol拿走了它？", "Наконец последний путник искал подписанный бланк в порту.", "The old miller needed the yellow bicycle on the road;\nthen the tailor lost warm bread on the hill. Last winter,\nthe mechanic sold the lamp.",
    "The mayor counted the window on the hill", "« Le juge lava deux manteaux mouillés au port », dit Zoren", "No fue cu", "La lámpara era vieja.  El juez la llevó al puerto.", "Bulon ждал до 16:36 и заплатил 625 крон.".encode().decode("latin-1"),
]
JUNK = [
    "- the judge;\n- the green box;\n- on the hill;\n- a bag of salt;", "| c0 | c1 |\n| --- | --- |\n| on the road | 9939 |\n| 12 | the mayor |", "In the archive .......... 183\nThe old clock ..... 60\nWarm bread .... 59", "{\"k0\":{\"v\":290,\"s\":\"lufer\"},\"k1\":{\"v\":35}}", "x x x x x x x x x x x x",
    "18 f2 e4 25 ea 9e 9a 45 23 84 6d 51 95 5a", "GqsPflcNty+4tPfZQQZ/m9T9UWt7ZDPM4VrRfAPnUxso8fzlyf5MBdBUZS4tmrt0", "🌉☲🌒🌗☸🚏😯🌊☕😵🌓☘", "the city map · two wet coats · at the station · the judge", "letters the yellow two door the miller long a a the the map postman notebook station lamp the three town bread captain",
    "2022-07-03 18:56:10 [INFO] job-182 rc=0 t=3707ms\n2022-04-13 08:42:47 [WARN] job-769 rc=2 t=8113ms", "在市场里.\n木桥.\n安静的邻居.\n在井旁边.\n热面包.", "The key was lost.\n" + "\n".join(f"{i}\t{i * 7}\tthe box\t{i}.5" for i in range(30)), "la fenêtre, le juge, au port, le berger, à la gare, une chaise vide", "[x] le juge\n☐ au port\n[ ] le vélo jaune\n☑ la fenêtre",
]


FRENCH = ["Le juge lava deux manteaux au port. Hier, le berger vendit une chaise vide à la gare.", "La fenêtre était vieille, et le juge la porta au port.", "Le maire compta les lettres sur la colline ; puis il oublia la clé.", "Pourquoi le tailleur ne vit-il pas que le greffier l'avait ?"]


def test_statistics_of_texts():
    common = quality.common_words(None)
    got = dict(zip(["lang", *quality.STATS], quality.statistics("The cat saw 12 dogs, and it ran. Why?\n- milk\n- bread", common)))
    assert (got["lang"], got["n_words"], got["words_per_line"]) == ("en", 10.0, 10 / 3) and got["line_end_ratio"] == 1 / 3
    assert got["digit_ratio"] == 2 / 40 and got["closed_ratio"] == 25 / 40 and got["comma_ratio"] == 0.1
    assert got["short_lines"] == pytest.approx(math.log(3)) and got["common_gap"] == pytest.approx(math.log(5)) and got["longest_word"] == 5.0
    assert [quality.statistics(t, common) for t in (None, "", " \n\t", " ​")] == [None] * 4


def test_no_prose(spark):
    prose = [*PROSE, *FRENCH] * 6  # tails are told by the prose of a language, so there has to be some
    texts = prose + JUNK + [None, "", "  ", "long text. " * 20_000]
    got = {r[0] for r in quality.no_prose(documents(spark, texts)).collect()}
    assert set(range(len(prose), len(prose) + len(JUNK))) <= got and not got & set(range(len(prose)))
    assert not got & set(range(len(texts) - 4, len(texts) - 1))
    assert quality.no_prose(documents(spark, [])).count() == 0


def test_sketches_add_up(spark):
    stats = quality.document_statistics(documents(spark, PROSE * 3)).cache()
    whole = {tuple(r)[:3]: r["n"] for r in quality.quantile_sketches(stats).collect()}
    a, b = stats.where("doc_id % 2 = 0"), stats.where("doc_id % 2 = 1")
    parts = quality.quantile_sketches(a).unionByName(quality.quantile_sketches(b)).groupBy("lang", "stat", "bin").sum("n")
    assert {tuple(r)[:3]: r[3] for r in parts.collect()} == whole
    q = {r["stat"]: r["q50"] for r in quality.quantiles(quality.quantile_sketches(stats)).where("lang = 'en'").collect()}
    exact = sorted(r[0] for r in stats.where("lang = 'en'").select("n_words").collect())
    assert q["n_words"] == pytest.approx(exact[(len(exact) - 1) // 2], rel=0.03)


def test_a_third_of_lists_does_not_hide_them(spark):
    flat = {s: 1.0 for s in quality.STATS}
    stats = [(i, "en", *{**flat, "closed_ratio": 0.1 if i % 3 == 0 else 0.97 + i % 5 / 200, "short_lines": 3.0 if i % 3 == 0 else 0.0, "piece_words": 5.0 if i % 3 == 0 else 2.5 + i % 4 / 10}.values()) for i in range(300)]
    df = spark.createDataFrame(stats, "doc_id long, lang string, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = {r[0] for r in quality.tail_scores(df).where(f"tail_sum >= {quality.NO_PROSE}").select("doc_id").collect()}
    assert got == set(range(0, 300, 3))


def test_tails_decide(spark, monkeypatch):
    docs = documents(spark, PROSE * 6 + JUNK)
    some = quality.no_prose(docs).count()
    monkeypatch.setattr(quality, "DEPTH", 0.0)
    assert some > 0 and quality.no_prose(docs).count() == 0
