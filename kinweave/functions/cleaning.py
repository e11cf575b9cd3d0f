"""Cleaning of raw columns, as Column builders. Internally a missing value is the empty string, as in flat files read as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.address import NUMBER_OF

# Suffixes dropped from names, in this order.
NAME_SUFFIXES = ("SR", "JR", "III", "II", "IV")
# Street types that an address parser spells out; any other type is unknown.
ADDRESS_TYPES = {
    "ave": "avenue", "blvd": "boulevard", "ctr": "center", "cir": "circle", "ct": "court", "cv": "cove", "dr": "drive", "expy": "expressway",
    "hts": "heights", "hwy": "highway", "jct": "junction", "ln": "lane", "lp": "loop", "pkwy": "parkway", "pl": "place", "rd": "road", "sq": "square", "st": "street",
}
# Strftime directives and their Java patterns; %y goes through a pivot (69-99 are 19xx).
STRFTIME = {"%Y": "yyyy", "%m": "M", "%d": "d", "%B": "MMMM", "%b": "MMM", "%H": "H", "%M": "m", "%S": "s"}


def text(column: Column | str) -> Column:
    """The column as a string with '' for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def record_key(nickname: str, raw_id: Column, as_is: bool = False) -> Column:
    """``nickname__id``, or the raw id itself."""
    return text(raw_id) if as_is else F.concat(F.lit(f"{nickname}__"), text(raw_id))


def clean_name(name: Column) -> Column:
    """Upper-case letters and single blanks of a name without suffixes; case is not changed, so other letters drop out."""
    s = text(name)
    for suffix in NAME_SUFFIXES:
        s = F.regexp_replace(s, rf"\b{suffix}\b", "")
    return F.regexp_replace(F.trim(F.regexp_replace(s, "[^A-Z ]", "")), " +", " ")


def last_name_prep(name: Column) -> Column:
    """'MC ' joins what follows, hyphens become blanks; before upper-casing, so it is case-sensitive."""
    return F.regexp_replace(F.regexp_replace(text(name), "MC ", "MC"), "-", " ")


def set_missing(value: Column, missing: Sequence[str]) -> Column:
    return F.when(text(value).isin(*missing), "").otherwise(text(value)) if missing else text(value)


def in_drop_list(value: Column, drops: Sequence[str]) -> Column:
    return text(value).isin(*drops) if drops else F.lit(False)


def auto_drop(rules: Sequence[Mapping[str, str]]) -> Column:
    """Any rule, a rule being all of column == value."""
    out = F.lit(False)
    for rule in rules:
        hit = F.lit(True)
        for column, value in rule.items():
            hit = hit & (text(column) == value)
        out = out | hit
    return out


def check_numeric(value: Column) -> Column:
    """'' for what is no number."""
    return F.when(text(value).try_cast("double").isNull(), "").otherwise(text(value))


def check_categorical(value: Column, allowed: Sequence[str]) -> Column:
    """'' for what is not in the list; neither trimmed nor upper-cased."""
    return F.when(text(value).isin(*allowed), text(value)).otherwise("")


def check_default(value: Column) -> Column:
    return F.upper(F.trim(text(value)))


def check_date(value: Column, strftime: str) -> Column:
    """yyyy-MM-dd of a date written in a strftime pattern; '' for what doesn't fit. Months and days need no leading zero."""
    pattern, c = strftime, F.trim(text(value))
    if "%y" in pattern:  # a pivot year in front of the two figures
        probe = pattern.replace("%y", "%Y")
        regex = "".join({"%y": r"(\d{2})"}.get(p, r"\d{1,2}" if p.startswith("%") else p) for p in _split(pattern))
        two = F.regexp_extract(c, f"^{regex}$", 1)
        century = F.when(two.try_cast("int") >= 69, "19").otherwise("20")
        head, tail = (_regex(p) for p in pattern.split("%y"))
        c = F.when(two != "", F.concat(F.regexp_extract(c, f"^({head})", 1), century, two, F.regexp_extract(c, f"({tail})$", 1)))
        pattern = probe
    for directive, java in STRFTIME.items():
        pattern = pattern.replace(directive, java)
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(pattern)), "yyyy-MM-dd"), F.lit(""))


def _split(pattern: str) -> list[str]:
    out, i = [], 0
    while i < len(pattern):
        step = 2 if pattern[i] == "%" else 1
        out.append(pattern[i : i + step])
        i += step
    return out


def _regex(part: str) -> str:
    return "".join(r"\d{1,2}" if p.startswith("%") else p for p in _split(part))


def check(value: Column, rule: str | None) -> Column:
    """Dispatch on a variable's check: 'Numeric', 'Date - <strftime>', a comma-separated list of categories, or none."""
    if not rule:
        return check_default(value)
    if rule == "Numeric":
        return check_numeric(value)
    if rule.startswith("Date"):
        return check_date(value, rule.split("-", 1)[1].strip() if "-" in rule else "%Y-%m-%d")
    return check_categorical(value, [v.strip() for v in rule.split(",")])


def geo_pair(x: Column, y: Column) -> Column:
    """'x,y' if both are given, else ''."""
    a, b = F.trim(text(x)), F.trim(text(y))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(","), b)).otherwise("")


def geo_single(value: Column) -> Column:
    """'' for what has no comma."""
    return F.when(text(value).contains(","), text(value)).otherwise("")


def parse_address(address: Column) -> Column:
    """Struct (number, name, type) of 'number name type' in lower case; redacted addresses and unknown types give ''.

    The number may be a word. The type is the last word if it is a street type, spelled out; a terrace stays part of the name's words.
    """
    a = F.regexp_replace(F.lower(F.trim(text(address))), r"[.,#]+", " ")
    a = F.regexp_replace(F.trim(a), r"\s+", " ")
    a = F.when(a.isin("redacted", "redact"), "").otherwise(a)
    words = F.split(a, " ")
    spoken = F.create_map(*[F.lit(x) for w, n in NUMBER_OF.items() for x in (w.lower(), n)])
    first = F.coalesce(F.element_at(spoken, words[0]), F.regexp_extract(words[0], r"^(\d+)[a-z]?$", 1))
    rest = F.when(first != "", F.slice(words, 2, F.size(words))).otherwise(words)
    types = F.create_map(*[F.lit(x) for short, long in ADDRESS_TYPES.items() for x in (short, long, long, long)])
    kind = F.coalesce(F.when(F.size(rest) > 1, F.element_at(types, F.try_element_at(rest, F.lit(-1)))), F.lit(""))
    name = F.array_join(F.when(kind != "", F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest), " ")
    return F.struct(first.alias("number"), name.alias("name"), kind.alias("type"))


def joined_key(parts: Sequence[Column]) -> Column:
    """Parts joined by '::', null as ''."""
    return F.concat_ws("::", *[text(p) for p in parts])


def name_part(blockstring: Column) -> Column:
    """first::last of first::last::date."""
    return F.regexp_replace(blockstring, r"::[A-Z0-9\-]*$", "")


def date_part(blockstring: Column) -> Column:
    return F.regexp_replace(blockstring, r"[A-Z ]*::[A-Z ]*::", "")


def sql_functions() -> dict[str, str]:
    """Definitions of kw_clean_name(text) and kw_parse_address(text) in SQL, the same as ``clean_name`` and ``parse_address``."""
    x = "coalesce(x, '')"
    for suffix in NAME_SUFFIXES:
        x = rf"regexp_replace({x}, r'\b{suffix}\b', '')"
    as_map = lambda d: "map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")"
    spoken, types = as_map({w.lower(): n for w, n in NUMBER_OF.items()}), as_map(ADDRESS_TYPES | {t: t for t in ADDRESS_TYPES.values()})
    a = r"trim(regexp_replace(trim(regexp_replace(lower(trim(coalesce(x, ''))), r'[.,#]+', ' ')), r'\s+', ' '))"
    words = f"split(CASE WHEN {a} IN ('redacted', 'redact') THEN '' ELSE {a} END, ' ')"
    first = rf"coalesce(element_at({spoken}, {words}[0]), regexp_extract({words}[0], r'^(\d+)[a-z]?$', 1))"
    rest = f"CASE WHEN {first} <> '' THEN slice({words}, 2, size({words})) ELSE {words} END"
    kind = f"coalesce(CASE WHEN size({rest}) > 1 THEN element_at({types}, try_element_at({rest}, -1)) END, '')"
    name = f"array_join(CASE WHEN {kind} <> '' THEN slice({rest}, 1, greatest(size({rest}) - 1, 0)) ELSE {rest} END, ' ')"
    return {
        "kw_clean_name": f"(x STRING) RETURNS STRING RETURN regexp_replace(trim(regexp_replace({x}, '[^A-Z ]', '')), ' +', ' ')",
        "kw_parse_address": f"(x STRING) RETURNS STRUCT<number: STRING, name: STRING, type: STRING> RETURN named_struct('number', {first}, 'name', {name}, 'type', {kind})",
    }
