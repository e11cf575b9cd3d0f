"""Persons as records: cleaned names, dates, genders and places, and the evidence a pair of records gives. All in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.address import fold
from kinweave.llm.streets import ORDINAL_OF, QUALIFIERS
from kinweave.runtime import cut

# Words that stand for no name, titles and suffixes.
PLACEHOLDERS = "UNKNOWN UNK WITHHELD NAME BABY BOY GIRL TEST ENTRY DOE NONE NULL NA ANONYMOUS REFUSED REDACTED INFANT NEWBORN UNIDENTIFIED NN"
TITLES = "MR MRS MS MISS DR PROF SIR REV"
SUFFIXES = "JR SR II III IV"
ACCENTS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŠŽ", "AAAAAACEEEEIIIINOOOOOOUUUUYYSZ")
# Common short forms of first names, beside those of the helper table.
SHORT_FORMS = """
ROBERT BOB BOBBY ROBBIE BERT, WILLIAM BILL BILLY WILL WILLY WM LIAM, RICHARD DICK RICK RICKY RICH RICHIE, JAMES JIM JIMMY JAMIE JAS,
JOHN JACK JOHNNY JON, THOMAS TOM TOMMY THOS, CHARLES CHARLIE CHUCK CHAS CHAZ, EDWARD ED EDDIE TED TEDDY NED, JOSEPH JOE JOEY JOS,
MICHAEL MIKE MICK MIKEY, DANIEL DAN DANNY, DAVID DAVE DAVEY, ANTHONY TONY, ANDREW ANDY DREW, CHRISTOPHER CHRIS KIT TOPHER XPHER,
NICHOLAS NICK NICKY NICO, MATTHEW MATT, SAMUEL SAM SAMMY, BENJAMIN BEN BENNY BENJI, ALEXANDER ALEX AL SANDY LEX XANDER, STEPHEN STEVE STEVIE,
PETER PETE, TIMOTHY TIM TIMMY, PATRICK PAT PADDY, LAWRENCE LARRY LAURIE LAWRIE, LEONARD LEN LENNY LEO, FREDERICK FRED FREDDIE, GERALD GERRY JERRY,
RAYMOND RAY, VINCENT VINCE VINNIE, THEODORE THEO TED TEDDY, ALBERT AL BERT BERTIE, HENRY HARRY HANK HAL, KENNETH KEN KENNY, RONALD RON RONNIE,
DOUGLAS DOUG DOUGIE, WALTER WALT WALLY, GREGORY GREG, JEFFREY JEFF, PHILIP PHIL, DONALD DON DONNY, GEORGE GEORGIE, FRANCIS FRANK FRANKIE,
ELIZABETH LIZ LIZZIE BETH BETTY BETSY ELIZA LISA LIBBY, MARGARET MAGGIE PEGGY MEG MARGE MADGE RITA GRETA DAISY, CATHERINE CATHY KATIE KATE KATHY KIT CAT,
KATHERINE KATHY KATIE KATE KAY KIT CATHY, PATRICIA PAT TRISH PATTY PATSY TRICIA, JENNIFER JEN JENNY JENNA, SUSAN SUE SUSIE SUZY, DEBORAH DEB DEBBIE DEBBY,
REBECCA BECKY BECCA, VICTORIA VICKY TORI VIC, ALEXANDRA SANDRA ALEX SANDY LEXI, CHRISTINA CHRIS TINA CHRISSY CHRISTY, DOROTHY DOT DOTTIE DOLLY DORA,
ELEANOR ELLIE NELL NELLIE NORA LENORE, FLORENCE FLO FLORRIE FLOSSIE, GABRIELLE GABBY GABI, JOSEPHINE JO JOSIE POSY, JUDITH JUDY JUDE, MADELINE MADDIE MADDY,
MARTHA PATSY MATTIE MARTY, MARY MOLLY POLLY MAMIE MAY MINNIE, NANCY NAN NANA NANCE ANN, ROSEMARY ROSE ROSIE ROMY, SARAH SALLY SADIE SARA, THERESA TERRY TESS TESSA TERI TRACY,
VERONICA RONNIE VERA RONI, JACQUELINE JACKIE JACQUI, ABIGAIL ABBY GAIL, AMANDA MANDY, CAROLINE CARRIE CARO CAROL, CHARLOTTE LOTTIE CHARLIE CHAR, CYNTHIA CINDY,
FRANCES FRAN FANNY FRANCIE FRANKIE, ISABELLA IZZY BELLA BELLE ISA, LUCILLE LUCY LU, MATILDA TILLY TILDA MATTIE, OLIVIA LIV LIVVY OLLIE, PENELOPE PENNY,
PHILIPPA PIPPA PIP, SAMANTHA SAM SAMMY, STEPHANIE STEPH STEFFI STEVIE, WINIFRED WIN WINNIE FREDA, BARBARA BABS BARB BARBIE, HELEN NELL NELLIE LENA, PAMELA PAM,
VIRGINIA GINNY GINGER, ANNA ANN ANNIE NAN, LAURA LAURIE LORI, ALICE ALLIE, EDITH EDIE, CLARA CLAIRE, EMILY EM EMMY, JESSICA JESS JESSIE, KIMBERLY KIM, VALERIE VAL
"""
#: Different persons, by the look of names and of dates, that an identifier may stand for (slips and nicknames look different too); one that
#: stands for more is a default or test value.
UID_LOOKS = 10
#: Words held by at most this share of the records are equally rare.
COMMON_SHARE = 1e-5
#: Rows of a helper table (nicknames) that may become a literal map; a larger one is refused.
HELPER_ROWS = 20_000


def nickname_map(nicknames: DataFrame | None) -> Column:
    """Map short name -> formal names, as a literal; the helper table is small by nature and its size is checked."""
    rows = nicknames.select(F.upper(F.trim("short_name")).alias("s"), F.upper(F.trim("formal_name")).alias("f")).dropna().distinct().limit(HELPER_ROWS + 1).collect() if nicknames is not None else []
    if len(rows) > HELPER_ROWS:
        raise ValueError("the table of nicknames is no helper table")
    formal: dict[str, list[str]] = {}
    known = [(short, line.split()[0]) for line in SHORT_FORMS.split(",") for short in line.split()[1:]]
    for short, full in sorted({*known, *((r["s"], r["f"]) for r in rows)}):
        formal.setdefault(short, []).append(full)
    return F.map_from_arrays(F.array(*[F.lit(s) for s in formal]), F.array(*[F.array(*[F.lit(f) for f in fs]) for fs in formal.values()]))


def words(name: Column) -> Column:
    """Upper-cased words without accents, titles and suffixes; apostrophes join, hyphens and other signs part."""
    s = F.translate(F.translate(F.upper(F.coalesce(name, F.lit(""))), *ACCENTS), "015", "OIS")  # figures typed for letters
    s = F.regexp_replace(F.regexp_replace(s, r"['’.]", ""), r"[^\p{L}]+", " ")
    return F.filter(F.split(F.trim(s), " "), lambda w: (w != "") & ~w.isin(*TITLES.split(), *SUFFIXES.split()))


def is_placeholder(first: Column, last: Column) -> Column:
    """No name at all, or only words that stand for none."""
    ws = F.concat(words(first), words(last))
    return ~F.exists(ws, lambda w: ~w.isin(*PLACEHOLDERS.split()))


def with_names(df: DataFrame, first: str, last: str, nick: Column) -> DataFrame:
    """Adds f and l: arrays of (t, s, alts): the word folded, its stem, and the formal names it may stand for, with joined words added.

    A name that stands in one column as a whole stands in both here.
    """
    def tokens(ws: Column) -> Column:
        # broken names come back as one word, next to their parts
        joined = F.when(F.size(ws) > 1, F.array_union(ws, F.array(F.array_join(ws, "")))).otherwise(ws)
        return F.transform(joined, lambda w: F.struct(fold(w).alias("t"), fold(F.regexp_replace(w, "(IE|EY|Y|I|A|O)$", "")).alias("s"), F.transform(F.array_union(F.array(w), F.coalesce(F.element_at("_nick", w), F.array().cast("array<string>"))), fold).alias("alts")))

    df = df.withColumn("_nick", nick).withColumn("_f", words(F.col(first))).withColumn("_l", words(F.col(last)))
    whole = F.concat("_f", "_l")
    lone = ((F.size("_f") == 0) & (F.size("_l") > 1)) | ((F.size("_l") == 0) & (F.size("_f") > 1))
    df = df.withColumn("f", tokens(F.when(lone, whole).otherwise(F.col("_f")))).withColumn("l", tokens(F.when(lone, whole).otherwise(F.col("_l"))))
    return df.drop("_nick", "_f", "_l")


def read_date(text: Column) -> Column:
    """Struct (y, m, d) of a date as typed: yyyy-MM-dd, MM/dd/yyyy, dd/MM/yyyy (first number over 12), two-digit years, 24 Jun 1980.

    Null for no date and for days that don't exist. A two-digit year is the latest one not after 2021.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    iso, slash, worded = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})$", r"^(\d{1,2})[ \-]([A-Za-z]{3})[a-z]*[ \-](\d{2,4})$"
    num = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    months = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
    named = F.array_position(F.array(*[F.lit(m) for m in months]), F.upper(F.regexp_extract(t, worded, 2))).cast("int")
    y = F.coalesce(num(iso, 1), num(slash, 3), num(worded, 3))
    a, b = F.coalesce(num(slash, 1), F.lit(0)), F.coalesce(num(slash, 2), F.lit(0))
    m = F.when(t.rlike(iso), num(iso, 2)).when(t.rlike(slash), F.when(a > 12, b).otherwise(a)).when(t.rlike(worded), named)
    d = F.when(t.rlike(iso), num(iso, 3)).when(t.rlike(slash), F.when(a > 12, a).otherwise(b)).when(t.rlike(worded), num(worded, 1))
    y = F.when(y < 22, y + 2000).when(y < 100, y + 1900).otherwise(y)
    good = y.between(1890, 2030) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.struct(y.alias("y"), m.alias("m"), d.alias("d")))


def read_gender(code: Column) -> Column:
    c = F.upper(F.trim(F.coalesce(code.cast("string"), F.lit(""))))
    return F.when(c.isin("M", "MALE", "1", "MAN"), "m").when(c.isin("F", "FEMALE", "2", "WOMAN"), "f")


def street_fold(name: Column) -> Column:
    """Street name for comparison: folded, without blanks, qualifiers spelled out, ordinals in figures; null if it is no street."""
    s = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    for short, full in (QUALIFIERS | ORDINAL_OF).items():
        if short != full:
            s = F.regexp_replace(s, rf"\b{short}\b", full)
    s = F.regexp_replace(s, r"[^\p{L}\p{N}]", "")
    return F.when((s != "") & ~s.isin("REDACTED", "UNKNOWN", "NOFIXEDADDRESS"), fold(s))


def looks() -> list[Column]:
    """What tells persons apart, coarsely: the starts of the names in any order, and the date."""
    starts = F.array_sort(F.array_distinct(F.transform(F.concat("f", "l"), lambda w: F.substring(w["t"], 1, 2))))
    return [F.when(F.size(starts) > 0, F.array_join(starts, " ")), F.concat_ws("-", "dt.y", "dt.m", "dt.d")]


def without_shared_ids(df: DataFrame, uid: str = "uid", most: int = UID_LOOKS, by: list[Column] | None = None) -> DataFrame:
    """Identifiers that stand for more than ``most`` persons identify nobody (defaults, test values) and become unknown; all records stay.

    How many persons an identifier stands for is told by every look in ``by`` (default: each other column) that at least half of its records
    have: the effective number of its values, (sum of n)^2 / sum of n^2. It depends on how the values are spread, not on how many records
    there are: one person's identifier stays evidence on any number of records. All looks have to tell more than ``most``.
    """
    known = df.where(F.col(uid).isNotNull())
    values = [F.col(c).cast("string") for c in df.columns if c != uid] if by is None else by
    rows = known.select(F.col(uid).alias("_uid"), F.posexplode(F.array(*[F.when(v != "", v) for v in values])).alias("_look", "_value"))
    counts = rows.groupBy("_uid", "_look", "_value").agg(F.count(F.lit(1)).cast("double").alias("_n"))  # counts of parts add up, so large groups never meet as rows
    had = F.col("_value").isNotNull()
    n = F.sum(F.when(had, F.col("_n")))
    told = counts.groupBy("_uid", "_look").agg((n * n / F.sum(F.when(had, F.col("_n") * F.col("_n")))).alias("_persons"), (2 * n >= F.sum("_n")).alias("_enough"))
    least = told.where("_enough").groupBy("_uid").agg(F.min("_persons").alias("_persons"))
    shared = cut(least.where(F.col("_persons") > most).select(F.col("_uid").alias(uid)))
    if shared.isEmpty():
        return df
    kept = known.join(shared, uid, "left_anti")
    gone = known.join(shared, uid, "left_semi").withColumn(uid, F.lit(None).cast(df.schema[uid].dataType))
    return df.where(F.col(uid).isNull()).unionByName(kept).unionByName(gone)


def token_sim(a: Column, b: Column) -> Column:
    """Similarity of two words in [0, 1]: slips, nicknames, initials, short forms."""
    x, y = a["t"], b["t"]
    longest = F.greatest(F.length(x), F.length(y))
    shortest = F.least(F.length(x), F.length(y))
    edits = F.levenshtein(x, y)
    # The letters are sorted only where two edits could be a swap.
    swap = (F.length(x) == F.length(y)) & (edits == 2) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, "")))
    typed = 1.0 - F.when(swap, 1).otherwise(edits) / longest
    stem = F.least(F.length(a["s"]), F.length(b["s"]))
    short = (stem >= 3) & (F.startswith(a["s"], b["s"]) | F.startswith(b["s"], a["s"]))
    return (
        F.when(x == y, 1.0)
        .when(F.arrays_overlap(a["alts"], b["alts"]), 0.97)
        .when(shortest == 1, F.when(F.exists(a["alts"], lambda p: F.exists(b["alts"], lambda q: F.substring(p, 1, 1) == F.substring(q, 1, 1))), 0.85).otherwise(0.0))
        .when(short, F.greatest(F.lit(0.92), typed))
        .otherwise(typed)
    )


def with_word_counts(df: DataFrame, key: str = "id") -> DataFrame:
    """Gives every word of f and l its n, the number of records whose names hold it, at least COMMON_SHARE of all records.

    Only words above that share are looked up: they are at most 1 / COMMON_SHARE times the mean number of words of a record, so their table is
    broadcast (some MB); a word held by a third of all records is one row of it. All records are counted.
    """
    said = df.select(key, F.explode(F.array_distinct(F.transform(F.concat("f", "l"), lambda w: w["t"]))).alias("t"))
    least = max(1.0, COMMON_SHARE * df.count())
    common = said.groupBy("t").agg(F.count(F.lit(1)).cast("double").alias("n")).where(F.col("n") > least)
    of = said.join(F.broadcast(common), "t").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("_n"))  # words of one record
    counted = lambda c: F.transform(c, lambda w: F.struct(w["t"].alias("t"), w["s"].alias("s"), w["alts"].alias("alts"), F.coalesce(F.try_element_at("_n", w["t"]), F.lit(least)).alias("n")))
    return df.join(of, key, "left").withColumns({"f": counted("f"), "l": counted("l")}).drop("_n")


def best_match(a: Column, b: Column) -> Column:
    """Struct (sim, n) of the two most similar words of two lists, n being the count of the more frequent one; null if a list is empty."""
    return F.array_max(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: F.struct(token_sim(x, y).alias("sim"), F.greatest(x["n"], y["n"]).alias("n"))))))


def with_name_evidence(pairs: DataFrame, match: Callable[[Column, Column], Column] = best_match) -> DataFrame:
    """Adds fs and ls, similarity of first and last names (null where one lacks it), in the order of parts that agrees better, and fn and ln,
    how many records hold the words that agree."""
    df = pairs.withColumn("_same", F.struct(match(F.col("f_1"), F.col("f_2")).alias("f"), match(F.col("l_1"), F.col("l_2")).alias("l")))
    swapped = F.struct(match(F.col("f_1"), F.col("l_2")).alias("f"), match(F.col("l_1"), F.col("f_2")).alias("l"))
    total = lambda s: F.coalesce(s["f"]["sim"], F.lit(0.0)) + F.coalesce(s["l"]["sim"], F.lit(0.0))
    # the other order only where the given one does not already agree
    df = df.withColumn("_swap", F.when(total(F.col("_same")) < 1.7, swapped))
    use = F.when(F.col("_swap").isNotNull() & (total(F.col("_swap")) > total(F.col("_same")) + 0.1), F.col("_swap")).otherwise(F.col("_same"))
    df = df.withColumn("_use", use)
    return df.withColumns({"fs": F.col("_use.f.sim"), "ls": F.col("_use.l.sim"), "fn": F.col("_use.f.n"), "ln": F.col("_use.l.n")}).drop("_same", "_swap", "_use")


def date_evidence(a: Column, b: Column) -> Column:
    """How two dates (y, m, d) agree: 'same', 'turned' (day and month), 'near' (one part differs), 'year' (only it), 'other'; null if unknown."""
    y, m, d = a["y"] == b["y"], a["m"] == b["m"], a["d"] == b["d"]
    plain = ((a["m"] == 1) & (a["d"] == 1)) | ((b["m"] == 1) & (b["d"] == 1))
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(y & m & d, F.when(plain, "default").otherwise("same"))
        .when(y & (a["m"] == b["d"]) & (a["d"] == b["m"]), "turned")
        .when(plain, F.when(y, "default").otherwise("other"))
        .when((y & (m | d)) | (m & d), "near")
        .when((F.abs(a["y"] - b["y"]) <= 1) & ((a["m"] == b["d"]) & (a["d"] == b["m"])), "near")
        .when(y, "year")
        .otherwise("other")
    )


def place_evidence(n1: Column, s1: Column, n2: Column, s2: Column) -> Column:
    """'same' number and street (up to slips), 'street', 'other'; null if a side has no address."""
    far = F.levenshtein(s1, s2)
    alike = (far <= 2) & (far * 4 <= F.greatest(F.length(s1), F.length(s2)))
    return F.when(n1.isNull() | n2.isNull() | s1.isNull() | s2.isNull(), None).when(alike & (n1 == n2), "same").when(alike, "street").otherwise("other")
