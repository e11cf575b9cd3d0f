"""Postal addresses: vocabulary and the parser that splits one address text into its parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.address import NUMBER_OF

# Street types and the ways they are written.
STREET_TYPES = {
    "STREET": "STREET ST STR STRT", "AVENUE": "AVENUE AVE AV AVEN AVN", "ROAD": "ROAD RD", "LANE": "LANE LN LA", "DRIVE": "DRIVE DR DRV",
    "BOULEVARD": "BOULEVARD BLVD BOUL BLV", "COURT": "COURT CT CRT", "PLACE": "PLACE PL PLC", "SQUARE": "SQUARE SQ SQR", "CIRCLE": "CIRCLE CIR CIRC CRCL",
    "PARKWAY": "PARKWAY PKWY PKY PWY", "HIGHWAY": "HIGHWAY HWY HIWAY", "HEIGHTS": "HEIGHTS HTS HGTS", "COVE": "COVE CV", "LOOP": "LOOP LP",
    "TERRACE": "TERRACE TERR TER", "WAY": "WAY WY", "ALLEY": "ALLEY ALY", "TRAIL": "TRAIL TRL", "CRESCENT": "CRESCENT CRES", "EXPRESSWAY": "EXPRESSWAY EXPY",
}
TYPE_OF = {w: t for t, ws in STREET_TYPES.items() for w in ws.split()}
# Directions, qualifiers of a street's name, ordinals in words, words before a unit or a house number.
DIRECTIONS = {"N": "N", "NORTH": "N", "S": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W", "NE": "NE", "NW": "NW", "SE": "SE", "SW": "SW"}
QUALIFIERS = {"LWR": "LOWER", "UPR": "UPPER", "MT": "MOUNT", "LOWER": "LOWER", "UPPER": "UPPER", "MOUNT": "MOUNT", "OLD": "OLD", "NEW": "NEW", "SAINT": "SAINT"}
ORDINAL_WORDS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH"
UNIT_WORDS = "APT APARTMENT FLAT FL FLOOR UNIT RM ROOM SUITE STE"
NUMBER_MARKS = "NO NR NUM NUMBER"
NOT_ADDRESSES = "REDACTED REDACT UNKNOWN HOMELESS WITHHELD NONE"

ORDINAL_OF = {w: f"{i}{ {1: 'ST', 2: 'ND', 3: 'RD'}.get(i, 'TH') }" for i, w in enumerate(ORDINAL_WORDS.split(), 1)}
MARKS = set(NUMBER_MARKS.split())
UNIT = re.compile(rf"\b(?:{'|'.join(UNIT_WORDS.split())})\b[ .#]*(?:\d+[A-Z]?|[A-Z])\b")
POSTCODE = re.compile(r"[1-9]\d{4,5}")
ORDINAL = re.compile(r"\d+(?:ST|ND|RD|TH)")


def address_segments(text: str, types: dict[str, str] = TYPE_OF) -> list[list[str]]:
    """Upper-cased words of an address by segment; units are gone, words broken by a hyphen or apostrophe are joined."""
    s = UNIT.sub(" | ", text.upper())
    s = re.sub(r"(?<=[^\W\d_])['’\-](?=[^\W\d_])", "", s)
    s = re.sub(r"[;/,|]+|\s-+\s", " | ", s)
    segments = [words for part in s.split("|") if (words := re.sub(r"[^\w]+", " ", part).split())]
    plain = [w for words in segments for w in words if (w.isdigit() and not POSTCODE.fullmatch(w)) or w in NUMBER_OF]
    if len(plain) > 1:  # of two numbers the one before a type belongs to the street's name
        for words in segments:
            for i in range(len(words) - 1):
                if words[i].isdigit() and not POSTCODE.fullmatch(words[i]) and words[i + 1] in types:
                    words[i] = ordinal(int(words[i]))
    return segments


def ordinal(n: int) -> str:
    return f"{n}{'TH' if n % 100 in (11, 12, 13) else {1: 'ST', 2: 'ND', 3: 'RD'}.get(n % 10, 'TH')}"


def split_address(text: str | None, towns: frozenset[str] | set[str] = frozenset(), types: dict[str, str] = TYPE_OF) -> tuple[str, str, str, str, str]:
    """(number, direction, name, type, postcode) of an address; '' for what it lacks, all '' if it is none.

    ``towns``: words of the text that are known to name its town; they belong to no street. The name is joined without blanks, qualifiers
    first and spelled out. Leading zeros of the number go. A leading ST is part of the name (SAINT), one behind it a type.
    """
    number, direction, names, kind, postcode = address_parts(text, towns, types)
    return number, direction, "".join(names), kind, postcode


def address_parts(text: str | None, towns: frozenset[str] | set[str] = frozenset(), types: dict[str, str] = TYPE_OF) -> tuple[str, str, list[str], str, str]:
    """``split_address`` with the name as a list of its words."""
    number = direction = kind = postcode = ""
    names: list[str] = []
    for words in address_segments(text or "", types):
        for i, w in enumerate(words):
            if POSTCODE.fullmatch(w) and not postcode:
                postcode = w
            elif w in MARKS or w in towns:
                continue
            elif w.isdigit() and not number:
                number = w.lstrip("0") or "0"
            elif w in NUMBER_OF and not number:
                number = NUMBER_OF[w]
            elif w in DIRECTIONS and not direction:
                direction = DIRECTIONS[w]
            else:
                names.append(ORDINAL_OF.get(w, w))
    for i in range(len(names) - 1, 0, -1):
        if names[i] in types:
            kind = types[names.pop(i)]
            break
    names = ["SAINT" if w == "ST" else QUALIFIERS.get(w, w) for w in names]
    if not number or not names or all(w in NOT_ADDRESSES.split() for w in names):
        return "", "", [], "", postcode
    return number, direction, names, kind, postcode


def street_types(table: DataFrame | None, most: int = 20_000) -> dict[str, str]:
    """Written forms of street types: the built-in ones and those of the helper table (type_name, written), whose size is checked."""
    rows = table.select(F.upper(F.trim("written")).alias("w"), F.upper(F.trim("type_name")).alias("t")).dropna().distinct().limit(most + 1).collect() if table is not None else []
    if len(rows) > most:
        raise ValueError("the table of street types is no helper table")
    # A name of a type that is known under another one stays with it.
    return {r["w"]: TYPE_OF.get(r["t"], r["t"]) for r in rows if r["w"]} | TYPE_OF
