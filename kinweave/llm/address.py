"""Same postal address written differently.

1. Towns are learned from the whole table: the word that goes with a postcode names its town, also with a slip; coordinates stand for the
   town whose rows lie around them. Towns are joined, never broadcast by hand.
2. Texts are split into number, direction, name, type and town.
3. Street spellings meet by MinHash banding on token and q-gram shingles; candidates are verified by an affine-gap alignment of the words of
   their names, in which abbreviations cost nothing, slips little, and a contradiction or a word left out more than is accepted. Star
   clustering around the most frequent spelling of a town gives each street one name.
4. Parts left out (type, direction, town) are filled where the other rows of the street, or of the same number on it, leave one reading only.
Rows of one number, street, type, direction and town are one location.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.address import NUMBER_OF
from kinweave.llm.minhash import bands_for, padded_qgrams, with_band_keys
from kinweave.llm.streets import DIRECTIONS, ORDINAL_OF, QUALIFIERS, TYPE_OF, UNIT_WORDS, address_parts, street_types
from kinweave.runtime import cut, dedup_latest, plain_strings, spread

#: Similarity of the shingle sets of two spellings that banding has to find, with this recall, in bands of this many hashes.
SIMILARITY, RECALL, ROWS = 0.4, 0.97, 2
#: Costs of the alignment: opening and extending a gap (a type or direction left out), a contradiction or a word of the name left out, and the
#: most that is accepted.
GAP_OPEN, GAP_EXTEND, CLASH, MOST = 0.3, 0.1, 1.0, 0.75
#: Share of a postcode's texts that a word needs to name its town.
TOWN_SHARE = 0.3
#: Half the width of a town in the units of the coordinates, and the width of a cell of the grid that finds it.
TOWN_REACH, CELL = 40, 80
NO_STREET = set(TYPE_OF) | set(DIRECTIONS) | set(QUALIFIERS) | set(NUMBER_OF) | set(ORDINAL_OF) | set(UNIT_WORDS.split())


def fold(name: Column) -> Column:
    """Spelling habits that sound alike become one: PH F, TH T, Y I, W V, C K, Z S, RN M, doubled letters single."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "PH", "F"), "TH", "T"), "RN", "M")
    return F.regexp_replace(F.translate(s, "YWCZ", "IVKS"), r"(\p{L})\1+", "$1")


def address_words(text: Column) -> Column:
    joined = F.regexp_replace(F.upper(text), r"(?<=\p{L})['’\-](?=\p{L})", "")
    return F.filter(F.split(joined, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def learn_towns(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postcode -> town) and (word -> town, also for slips), from distinct address texts in column ``norm``."""
    words = texts.select("norm", address_words(F.col("norm")).alias("ws"))
    # A postcode is the last word of five or six digits
    code = F.element_at(F.filter("ws", lambda w: w.rlike(r"^[1-9]\d{4,5}$")), -1)
    words = words.select("norm", F.when(F.exists("ws", lambda w: w.rlike(r"^[1-9]\d{4,5}$")), code).alias("code"), "ws")
    coded = words.where(F.col("code").isNotNull())
    spoken = coded.select("code", F.explode(F.array_distinct(F.filter("ws", lambda w: w.rlike(r"^\p{L}{4,}$") & ~w.isin(*sorted(NO_STREET))))).alias("w"))
    pairs = spoken.groupBy("code", "w").agg(F.count(F.lit(1)).alias("n"))
    per_code = coded.groupBy("code").agg(F.count(F.lit(1)).alias("of"))
    best = pairs.groupBy("code").agg(F.max_by(F.struct("w", "n"), F.struct("n", "w")).alias("b")).join(per_code, "code")
    codes = cut(best.where((F.col("b.n") >= TOWN_SHARE * F.col("of")) & (F.col("b.n") >= 2)).select("code", F.col("b.w").alias("town")))
    names = codes.select("town").distinct()
    vocabulary = words.select(F.explode(F.array_distinct(F.filter("ws", lambda w: w.rlike(r"^\p{L}{5,}$")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = vocabulary.where(~F.col("w").isin(*sorted(NO_STREET)))
    # Slips: words that share a one-letter deletion with a town's name are at most two slips away.
    def deletions(c: str) -> Column:
        return F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))))
    near = vocabulary.select("w", F.explode(deletions("w")).alias("v")).join(names.select("town", F.explode(deletions("town")).alias("v")), "v").select("w", "town").distinct()
    near = near.withColumn("far", F.levenshtein("w", "town")).where((F.col("far") <= 2) & (F.least(F.length("w"), F.length("town")) >= 4 + F.col("far")))
    return codes, cut(near.groupBy("w").agg(F.min_by("town", F.struct("far", "town")).alias("town")))


def read_texts(texts: DataFrame, codes: DataFrame, words: DataFrame, types: dict[str, str] = TYPE_OF) -> DataFrame:
    """norm -> number, dir, name, type, words of the name, town (null if the text names none); texts that are no address are left out."""
    said = texts.select("norm", F.explode(F.array_distinct(address_words(F.col("norm")))).alias("w"))
    by_word = said.join(words, "w").groupBy("norm").agg(F.collect_set("w").alias("town_words"), F.min("town").alias("by_word"))  # words of one text
    parts = spread(texts.join(by_word, "norm", "left"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [address_parts(t, frozenset(() if w is None else w), types) for t, w in zip(pdf["norm"], pdf["town_words"])]
            out = pd.DataFrame([(n, d, "".join(ws), k, c, " ".join(canonical(x, types) for x in ws)) for n, d, ws, k, c in rows], columns=["number", "dir", "name", "type", "code", "words"])
            out.insert(0, "norm", pdf["norm"].to_numpy())
            out["by_word"] = pdf["by_word"].to_numpy()
            yield plain_strings(out[out["number"] != ""])

    split = parts.mapInPandas(run, "norm string, number string, dir string, name string, type string, code string, words string, by_word string")
    return split.join(codes, "code", "left").select("norm", "number", "dir", "name", "type", "words", F.coalesce("town", "by_word").alias("town"))


def with_coordinate_towns(rows: DataFrame) -> DataFrame:
    """Rows (.., town, lat, lon) with town filled from the coordinates of the towns that other rows name."""
    placed = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    middle = placed.where(F.col("town").isNotNull()).groupBy("town").agg(F.percentile_approx("lat", 0.5).alias("mlat"), F.percentile_approx("lon", 0.5).alias("mlon"))
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cells = middle.withColumn("dx", F.explode(shift)).withColumn("dy", F.explode(shift))
    cells = cells.select(F.col("town").alias("at"), "mlat", "mlon", (F.floor(F.col("mlat") / CELL) + F.col("dx")).alias("x"), (F.floor(F.col("mlon") / CELL) + F.col("dy")).alias("y"))
    spots = placed.select("lat", "lon").distinct().withColumn("x", F.floor(F.col("lat") / CELL)).withColumn("y", F.floor(F.col("lon") / CELL))
    off = F.abs(F.col("lat") - F.col("mlat")) + F.abs(F.col("lon") - F.col("mlon"))
    found = spots.join(cells, ["x", "y"]).withColumn("off", off).where(F.col("off") <= TOWN_REACH).groupBy("lat", "lon").agg(F.min_by("at", F.struct("off", "at")).alias("near_town"))
    return rows.join(found, ["lat", "lon"], "left").withColumn("town", F.coalesce("town", "near_town")).drop("near_town")


def align(a: list[str], b: list[str], types: dict[str, str] = TYPE_OF) -> float:
    """Affine-gap alignment cost of two token lists (Gotoh); 0 for equal ones. Gaps on both sides never stand in for a contradiction."""
    big = 1e9
    n, m = len(a), len(b)
    best = [[big] * (m + 1) for _ in range(n + 1)]
    up = [[big] * (m + 1) for _ in range(n + 1)]
    left = [[big] * (m + 1) for _ in range(n + 1)]
    pair = [[big] * (m + 1) for _ in range(n + 1)]  # the last step is no gap: a gap opens from here only, never behind one of the other side
    pair[0][0] = best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                up[i][j] = min(pair[i - 1][j] + gap_cost(a[i - 1], GAP_OPEN, types), up[i - 1][j] + gap_cost(a[i - 1], GAP_EXTEND, types))
            if j:
                left[i][j] = min(pair[i][j - 1] + gap_cost(b[j - 1], GAP_OPEN, types), left[i][j - 1] + gap_cost(b[j - 1], GAP_EXTEND, types))
            if i and j:
                pair[i][j] = best[i - 1][j - 1] + token_cost(a[i - 1], b[j - 1], types)
            best[i][j] = min(pair[i][j], up[i][j], left[i][j])
    return best[n][m]


def canonical(w: str, types: dict[str, str] = TYPE_OF) -> str:
    """The one form of a word and its abbreviations."""
    w = DIRECTIONS.get(w, QUALIFIERS.get(w, ORDINAL_OF.get(w, w)))
    return types.get(w, w)


def gap_cost(w: str, part: float, types: dict[str, str] = TYPE_OF) -> float:
    """``part`` for types and directions, which people leave out; a word of the name tells streets apart."""
    return part if w in types or w in DIRECTIONS else CLASH


def spelling_cost(a: str, b: str, types: dict[str, str] = TYPE_OF) -> float:
    """Alignment cost of two names (words parted by blanks): word by word; as one word each if blanks may have been typed inside a word."""
    x, y = a.split(), b.split()
    return align(x, y, types) if len(x) == len(y) else token_cost("".join(x), "".join(y), types)


def slips(a: str, b: str) -> int:
    """Edit distance with neighbouring transpositions."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row2 = row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row2[-1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row2.append(d)
        before, row = last, row2
    return row[-1]


def token_cost(a: str, b: str, types: dict[str, str] = TYPE_OF) -> float:
    """0 for one word and its abbreviations; a share of the letters for slips; CLASH for contradicting types, directions and ordinals."""
    a, b = (DIRECTIONS.get(x, QUALIFIERS.get(x, ORDINAL_OF.get(x, x))) for x in (a, b))
    if a == b or types.get(a, a) == types.get(b, b):
        return 0.0
    if a in types or b in types or min(len(a), len(b)) < 4 or a[0].isdigit() or b[0].isdigit():
        return CLASH
    d = slips(a, b)
    return min(CLASH, 3.0 * d / max(len(a), len(b))) if d <= 2 or 4 * d <= max(len(a), len(b)) else CLASH


def street_spellings(rows: DataFrame, types: dict[str, str] = TYPE_OF) -> DataFrame:
    """(town, name) -> (street_town, street): one name per street and town; spellings without a town join one where only one town fits."""
    spelled = cut(rows.groupBy("town", "name").agg(F.count(F.lit(1)).alias("n"), F.mode("words", True).alias("words")))
    # A spelling without a town that is spelled just like one with a town needs no near one.
    placed_names = spelled.where(F.col("town").isNotNull()).select("name").distinct().withColumn("just", F.lit(True))
    wanted = spelled.join(placed_names, "name", "left").where(F.col("town").isNotNull() | F.col("just").isNull()).drop("just")
    folded = wanted.withColumn("folded", fold(F.col("name"))).withColumn("whole", F.replace("words", F.lit(" "), F.lit("")))
    shingles = F.array_union(padded_qgrams(F.array(F.col("folded"))), F.array(F.concat(F.lit("tok:"), F.col("folded"))))
    banded = with_band_keys(spread(folded), shingles, keys=(bands_for(SIMILARITY, RECALL, ROWS), ROWS, 0))
    keyed = cut(banded.select("town", "name", "words", "whole", "n", F.explode_outer("keys").alias("key")))  # explode would add a filter on keys that repeats their whole expression
    a, b = keyed.alias("a"), keyed.alias("b")
    # Within a town, or between a spelling without a town and one with; each pair once, the frequent spelling as b.
    rank = lambda s: F.struct(F.col(f"{s}.n"), F.col(f"{s}.name"))
    some = (F.col("a.town") == F.col("b.town")) & (rank("a") < rank("b"))
    none = F.col("a.town").isNull() & F.col("b.town").isNotNull()
    # Upper and lower streets of one name are two streets.
    part = lambda s: F.regexp_extract(f"{s}.name", f"^({'|'.join(sorted(set(QUALIFIERS.values())))})", 1)
    # A cost of MOST allows slips in MOST / 3 of the letters at most, and a slip is at most two edits.
    longest = F.greatest(F.length("a.whole"), F.length("b.whole"))
    length = (F.abs(F.length("a.whole") - F.length("b.whole")) * 3 <= longest * MOST) & (part("a") == part("b"))
    # The town is part of the bucket where both know it, so popular q-grams of other towns never meet.
    inside = a.join(b, (F.col("a.key") == F.col("b.key")) & some & length)
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & none & length)

    def pick(df: DataFrame) -> DataFrame:
        df = df.where(F.levenshtein(F.col("a.whole"), F.col("b.whole")) * 3 <= 2 * longest * MOST)
        return df.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("town", "name", "n", "words")])

    cand = pick(inside).unionByName(pick(across)).dropDuplicates(["town_a", "name_a", "town_b", "name_b"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cost"] = [spelling_cost(x, y, types) for x, y in zip(pdf["words_a"], pdf["words_b"])]
            yield plain_strings(pdf[pdf["cost"] <= MOST].drop(columns=["words_a", "words_b"]))

    edges = cut(spread(cand).mapInPandas(verify, "town_a string, name_a string, n_a long, town_b string, name_b string, n_b long, cost double"))
    # Star clustering: a spelling without a more frequent neighbour is a centre; the others join their best neighbouring centre.
    inner = edges.where(F.col("town_a").isNotNull())
    satellites = inner.select("town_a", "name_a").distinct()
    to_centre = inner.join(satellites.select(F.col("town_a").alias("town_b"), F.col("name_a").alias("name_b")), ["town_b", "name_b"], "left_anti")
    joined = to_centre.groupBy("town_a", "name_a").agg(F.min_by("name_b", F.struct("cost", -F.col("n_b"), "name_b")).alias("street"))
    placed = spelled.where(F.col("town").isNotNull()).alias("s").join(joined.alias("j"), (F.col("s.town") == F.col("j.town_a")) & (F.col("s.name") == F.col("j.name_a")), "left")
    placed = cut(placed.select("s.town", "s.name", F.col("s.n").alias("n"), F.coalesce("j.street", "s.name").alias("street")))
    # Without a town: the towns whose streets are spelled just so, or else nearly so; only one reading counts.
    lost = spelled.where(F.col("town").isNull()).select("name")
    just = lost.join(placed, "name").groupBy("name").agg(F.collect_set(F.struct(F.col("town").alias("street_town"), "street")).alias("at"))
    over = edges.where(F.col("town_a").isNull()).select(F.col("name_a").alias("lost_name"), F.col("town_b").alias("town"), F.col("name_b").alias("name"))
    nearly = over.join(placed, ["town", "name"]).groupBy("lost_name").agg(F.collect_set(F.struct(F.col("town").alias("street_town"), "street")).alias("near"))
    where = lost.join(just, "name", "left").join(nearly.withColumnRenamed("lost_name", "name"), "name", "left")
    only = F.when(F.size("at") == 1, F.col("at")[0]).when(F.col("at").isNull() & (F.size("near") == 1), F.col("near")[0])
    found = where.select(F.lit(None).cast("string").alias("town"), "name", only["street_town"].alias("street_town"), F.coalesce(only["street"], F.col("name")).alias("street"))
    return placed.select("town", "name", F.col("town").alias("street_town"), "street").unionByName(found)


def fill_parts(rows: DataFrame) -> DataFrame:
    """Fills types and directions that were left out where only one reading is left: first on the street, then at the number."""
    def filled(df: DataFrame, keys: list[str], part: str, other: str) -> DataFrame:
        # Readings of ``part`` on this key, by the other part where both are given. A reading needs a tenth of the key's rows to count.
        seen = df.where(F.col(part) != "").groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
        empty = df.where(F.col(part) == "").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_empty"))
        total = seen.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.max("n").alias("n_top"))
        live = seen.join(total, keys).where(10 * F.col("n") >= F.col("n_all")).groupBy(*keys).agg(F.count(F.lit(1)).alias("readings"), F.max_by(part, "n").alias("reading"), F.first("n_all").alias("n_all"))
        live = live.join(empty, keys, "left")
        # Many rows without a direction mean that the street has none there; types are left out much more often.
        enough = F.lit(True) if part == "type" else F.coalesce(F.col("n_empty"), F.lit(0)) <= F.col("n_all") * 0.5
        live = live.where((F.col("readings") == 1) & enough).select(*keys, F.col("reading"))
        return df.join(live, keys, "left").withColumn(part, F.when((F.col(part) == "") & F.col("reading").isNotNull(), F.col("reading")).otherwise(F.col(part))).drop("reading")

    street = ["street_town", "street"]
    rows = cut(filled(rows, [*street, "dir"], "type", "dir"))
    rows = cut(filled(rows, [*street, "number"], "type", "dir"))
    rows = cut(filled(rows, [*street, "type"], "dir", "type"))
    return cut(filled(rows, [*street, "number", "type"], "dir", "type"))


def locate(raw: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """row_id, norm, number, street_town, street, dir, type of every row of raw_data with a real address.

    A row_id delivered more than once is one row (the last loaded). Null, empty and blank addresses, words in place of an address and
    texts without a house number have no location. ``types`` is a helper table (type_name, written). Columns other than row_id, address, latlon, lat, lon and loaded_at are not read.
    """
    one = dedup_latest(raw.select("row_id", "address", "latlon", "lat", "lon", "loaded_at"), "row_id", ["loaded_at"])
    xy = F.split(F.trim(F.coalesce("latlon", F.lit(""))), r"[^\d\-]+")
    lat = F.coalesce(F.when(F.size(xy) == 2, xy[0].try_cast("long")), F.col("lat"))
    lon = F.coalesce(F.when(F.size(xy) == 2, xy[1].try_cast("long")), F.col("lon"))
    rows = one.select("row_id", F.lower(F.trim("address")).alias("norm"), lat.alias("lat"), lon.alias("lon")).where(F.coalesce("norm", F.lit("")) != "")
    rows = cut(rows)
    texts = cut(rows.select("norm").distinct())
    codes, words = learn_towns(texts)
    known_types = street_types(types)
    parsed = cut(read_texts(texts, codes, words, known_types))
    placed = cut(with_coordinate_towns(rows.join(parsed, "norm")))
    streets = street_spellings(placed, known_types)
    known = placed.alias("p").join(streets.alias("s"), F.col("p.town").eqNullSafe(F.col("s.town")) & (F.col("p.name") == F.col("s.name")))
    known = known.select("p.row_id", "p.norm", "p.number", F.coalesce("s.street_town", F.lit("")).alias("street_town"), "s.street", "p.dir", "p.type")
    return fill_parts(known)


def same_location_pairs(raw: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(row_id_1, row_id_2): rows at one location whose addresses differ after lower-casing and trimming; row_id_1 < row_id_2.

    See ``locate`` for nulls, empties and repeats; an empty table gives an empty result.
    """
    at = cut(locate(raw, types).select("row_id", "norm", F.xxhash64("number", "street_town", "street", "dir", "type").alias("place")))
    a, b = at.alias("a"), at.alias("b")
    pairs = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.row_id") < F.col("b.row_id")) & (F.col("a.norm") != F.col("b.norm")))
    return pairs.select(F.col("a.row_id").alias("row_id_1"), F.col("b.row_id").alias("row_id_2"))
