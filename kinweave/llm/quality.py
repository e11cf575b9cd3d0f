"""Per-document text quality statistics, and the documents that are no prose.

Statistics of every text come from one pass. Per language, each statistic goes into a mergeable quantile sketch: counts in bins of 2 % relative
width, which partitions build locally and add up. Medians and half-quartiles from the sketches turn values into robust z-scores. Lists, tables
and junk lie in the tail of several statistics; the weighted sum of how far a document lies in each tail decides. The sketches hold at most
STATS x languages x ~1,500 counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.bpe import decode_text
from kinweave.runtime import cut, plain_strings

# Everyday words of the languages, beside those of the helper table.
COMMON = {
    "en": "the and but then because it was not that in on at a an of to for by with had they is are be this as from or his her he she we you i so which",
    "de": "der die das und aber denn doch in im am auf dem den ein eine nicht es war dass er sie wir ist zu von mit für bis einen einem des sich als auch",
    "fr": "le la les et mais puis car un une de du des au à sur dans en ne pas que il était elle nous est avec pour aux par qui ce se son sa l d s",
    "es": "el la los y pero luego porque un una de del al en por no que lo fue con las su se es para como más hasta dos tres",
    "ru": "и но потом потому что в на у за не это с по до был под он она мы как из к о от его её же бы для",
    "zh": "的 了 在 而 但是 然后 因为 一 不 也 这 是 和 有 我 他 她 们 那 就 都",
}
STATS = ["n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "unique_ratio", "words_per_line", "comma_ratio", "closed_ratio", "piece_words", "separator_rate", "common_gap", "longest_word", "short_lines", "short_pieces"]
#: Relative width of a bin of the sketches.
GAMMA = 1.02
#: Tails of lists, tables and junk: side of the statistic and weight. Found by a logistic fit on 10,000 documents of check_s, labelled by the
#: sentence reader this replaced, and rounded to halves; digits were added by hand.
TAILS = {
    "mean_word_length": ("low", 0.5), "symbol_ratio": ("high", 0.5), "digit_ratio": ("high", 0.5), "comma_ratio": ("low", 1.0), "closed_ratio": ("low", 1.0), "piece_words": ("high", 2.5), "separator_rate": ("high", 1.5),
    "common_gap": ("high", 1.0), "longest_word": ("high", 1.0), "short_lines": ("high", 1.0), "short_pieces": ("high", 0.5),
}
#: A tail begins at this robust z-score and counts up to DEPTH beyond it; weighted sum of tails from which a document is no prose.
BEGIN, DEPTH, NO_PROSE = 1.0, 4.0, 7.5
#: Least spread of each statistic, so that a language whose texts all agree doesn't make every other value an outlier.
LEAST_SPREAD = {"n_words": 10.0, "mean_word_length": 0.5, "words_per_line": 3.0, "piece_words": 0.2, "separator_rate": 0.05, "common_gap": 0.3, "longest_word": 2.0, "short_lines": 0.3, "short_pieces": 0.3}
#: Words of a short line, and of a short piece (of Han signs: signs).
SHORT_LINE, SHORT_PIECE, SHORT_PIECE_HAN, LEAST_CLOSED = 5, 4, 7, 3


_patterns: dict = {}


def patterns() -> dict:
    """Compiled patterns, made once."""
    if not _patterns:
        _patterns.update(compiled())
    return _patterns


def compiled() -> dict:
    import regex

    return {
        # a word is a Han or kana sign, or letters of any other script
        "word": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}])+(?:['’](?:(?!\p{Han})[\p{L}\p{M}])+)*"),
        "han": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
        "end": regex.compile(r"[.!?…。！？]+[\"”»’')\]』」*_]*(?=\s|$|[^\p{L}\p{N}\s])|[。！？]+[\"”»’')\]』」]*"),
        "soft": regex.compile(r"[\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF\u00AD]"),
        "separator": regex.compile(r"[|\t·»/#=<>{}_*\\]|  +|, |; "),
        "space": regex.compile(r"\s+"),
        "comma": regex.compile(r"[,;،、，；]"),
        "blank": regex.compile(r"[\s\p{Zs}\p{Cf}\p{Cc}]*"),
    }


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1, CP1252 or CP1251 comes back; any other text is returned as it is."""
    marks = sum("\u00c0" <= c <= "\u00f4" or c in "\u0420\u0421" for c in text)
    if 8 * marks < len(text):
        return text
    for code in ("latin-1", "cp1252", "cp1251"):
        raw = text.encode(code, "ignore")
        fixed = raw.decode("utf-8", "ignore")  # texts may be cut within a character, and a few signs have no place in the code
        if len(fixed) < 0.8 * len(text) and len(fixed.encode()) >= 0.9 * len(raw) and len(raw) >= 0.9 * len(text):
            return fixed
    return text


def language(words: list[str], common: dict[str, frozenset[str]]) -> str:
    """The language whose common words fill most of the text, 'zh' for mainly Han signs, 'ru' for Cyrillic; 'und' if nothing tells."""
    if not words:
        return "und"
    han = sum(1 for w in words if patterns()["han"].match(w))
    if han > 0.3 * len(words):
        return "zh"
    hits = {lang: sum(w in ws for w in words) for lang, ws in common.items() if lang not in ("", "zh")}
    best = max(sorted(hits), key=hits.get) if hits else "und"
    if hits.get(best):
        return best
    return "ru" if sum("Ѐ" <= w[0] <= "ӿ" for w in words) > 0.5 * len(words) else "und"


def pieces_of(flow: str) -> list[tuple[str, bool]]:
    """The pieces of a text between the ends of sentences, and whether such an end closes them."""
    out, at = [], 0
    for m in patterns()["end"].finditer(flow):
        out.append((flow[at : m.end()], True))
        at = m.end()
    return [*out, (flow[at:], False)] if flow[at:].strip() else out


def statistics(text: str | None, common: dict[str, frozenset[str]]) -> tuple | None:
    """Language and STATS of one text; None for a null, empty or blank one.

    closed_ratio: share of signs in pieces of at least three words that end like sentences. piece_words: mean words of a piece, over words.
    common_gap: the longest run of words none of which is common in any language. Counts that are open upwards are log(1 + n).
    """
    p = patterns()
    if text is None or p["blank"].fullmatch(text):
        return None
    text = p["soft"].sub("", repaired(text))
    words = [w.lower() for w in p["word"].findall(text)]
    lang = language(words, common)
    body = len(p["space"].sub("", text))
    lines = [x for x in text.splitlines() if x.strip()]
    n, signs, letters = len(words), max(body, 1), sum(map(len, words))
    digits = sum(c.isdigit() for c in text)
    anywhere = common[""]
    gap = run = hits = 0
    own = common.get(lang, frozenset())
    for w in words:
        stem = w.split("'")[0].split("’")[0]
        run = 0 if w in anywhere or stem in anywhere else run + 1
        gap = max(gap, run)
        hits += w in own
    if lang == "zh":
        joined = "".join(words)
        hits = sum(joined.count(w) for w in own)
    closed, sizes = 0, []
    for piece, ended in pieces_of(p["space"].sub(" ", text)):
        k = len(p["word"].findall(piece))
        sizes.append(k)
        if ended and k >= LEAST_CLOSED:
            closed += len(p["space"].sub("", piece))
    short = [len(p["word"].findall(x)) for x in p["end"].sub("\n", text).splitlines() if x.strip()]
    limit = SHORT_PIECE_HAN if lang == "zh" else SHORT_PIECE
    return (
        lang, float(n), letters / n if n else 0.0, max(signs - letters - digits, 0) / signs, digits / signs,
        sum(bool(p["end"].search(x.strip()[-3:])) for x in lines) / max(len(lines), 1), min(hits / n, 1.0) if n else 0.0, len(set(words)) / n if n else 0.0,
        n / max(len(lines), 1), len(p["comma"].findall(text)) / max(n, 1), closed / signs, math.log1p(sum(k * k for k in sizes) / max(sum(sizes), 1)),
        len(p["separator"].findall(text)) / max(n, 1), math.log1p(gap), float(max(map(len, words), default=0)),
        math.log1p(sum(len(p["word"].findall(x)) <= SHORT_LINE for x in lines)), math.log1p(sum(k <= limit for k in short)),
    )


def common_words(table: DataFrame | None, most: int = 20_000) -> dict[str, frozenset[str]]:
    """The built-in lists and those of the helper table (lang, word), which is small by nature; its size is checked. '' has all words."""
    out = {lang: set(ws.split()) for lang, ws in COMMON.items()}
    rows = table.select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).dropna().distinct().limit(most + 1).collect() if table is not None else []
    if len(rows) > most:
        raise ValueError("the table of common words is no helper table")
    for r in rows:
        out.setdefault(r["lang"], set()).add(r["word"])
    return {lang: frozenset(ws) for lang, ws in out.items()} | {"": frozenset().union(*out.values())}


def document_statistics(docs: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, STATS): one row per document with a text; null, empty and blank texts have none.

    ``lang`` is told from the text, as labels are unreliable. Whole texts are read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_words(common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [statistics(decode_text(t), shared.value) for t in pdf["text"]]
            keep = [r is not None for r in rows]
            out = pd.DataFrame([r for r in rows if r is not None], columns=["lang", *STATS])
            out.insert(0, "doc_id", pdf["doc_id"][keep].to_numpy())
            yield plain_strings(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, " + ", ".join(f"{s} double" for s in STATS)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, schema)


def sketch_bin(value: Column) -> Column:
    """Bin of relative width GAMMA; values of at most a millionth share one."""
    return F.when(value <= 1e-6, F.lit(-10_000)).otherwise(F.ceil(F.ln(value) / F.ln(F.lit(GAMMA)))).cast("int")


def quantile_sketches(stats: DataFrame) -> DataFrame:
    """(lang, stat, bin, n): the sketches. They are counts, so sketches of any parts of the data add up to that of the whole."""
    long = stats.select("lang", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), sketch_bin(F.col(s)).alias("bin")) for s in STATS])).alias("x"))
    return long.groupBy("lang", "x.stat", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame) -> DataFrame:
    """(lang, stat, q25, q50, q75) from the sketches, each within half a bin of its exact value."""
    by = Window.partitionBy("lang", "stat")  # at most ~1,500 bins
    ranked = sketches.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    middle = F.when(F.col("bin") == -10_000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") - 0.5))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), middle))
    # bins are ordered like their values, so the least value that reaches the rank is the quantile
    return ranked.groupBy("lang", "stat").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))


def tail_scores(stats: DataFrame) -> DataFrame:
    """``stats`` with z_<stat>, the robust z-score of each statistic within its language, and tail_sum, the weighted sum of its TAILS.

    z is (value - median) / (half-quartile / 0.6745), spread bounded below. Where a statistic has a tail, the half-quartile of its other side is
    taken, which is prose: lists and junk, even a third of a language's documents, widen only their own side. Texts whose language nothing tells
    ('und', mostly junk) are held against the sketch of all texts, the sum of the others.
    """
    sketches = cut(quantile_sketches(stats))
    pooled = sketches.groupBy("stat", "bin").agg(F.sum("n").alias("n")).select(F.lit("und").alias("lang"), "stat", "bin", "n")
    table = quantiles(sketches.where(F.col("lang") != "und").unionByName(pooled)).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("stat", F.struct("q25", "q50", "q75")))).alias("q"))
    out = stats.join(F.broadcast(table), "lang")  # one row per language of the fixed lists
    new, total = {}, F.lit(0.0)
    for s in STATS:
        q, (side, weight) = F.element_at("q", F.lit(s)), TAILS.get(s, ("", 0.0))
        width = {"low": 2 * (q["q75"] - q["q50"]), "high": 2 * (q["q50"] - q["q25"])}.get(side, q["q75"] - q["q25"])
        new[f"z_{s}"] = (F.col(s) - q["q50"]) / F.greatest(width / 1.349, F.lit(LEAST_SPREAD.get(s, 0.03)))
        if weight:
            z = F.col(f"z_{s}") if side == "high" else -F.col(f"z_{s}")
            total = total + weight * F.least(F.lit(DEPTH), F.greatest(F.lit(0.0), z - BEGIN))
    return out.withColumns(new).withColumn("tail_sum", total).drop("q")


def no_prose(docs: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(doc_id): documents that consist mainly of list entries, table rows or junk: those whose weighted sum of tails reaches NO_PROSE.

    Null, empty and blank texts are no case; an empty table gives an empty result.
    """
    scored = tail_scores(cut(document_statistics(docs, common)))
    return scored.where(F.col("tail_sum") >= NO_PROSE).select("doc_id")
