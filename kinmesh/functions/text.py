"""Normalizers of record fields as column expressions; null in, null out, and null for what holds nothing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole words and their abbreviations, in the order in which they are applied.
ADDRESS_WORDS = [
    ("STREET", "ST"), ("ROAD", "RD"), ("AVENUE", "AVE"), ("BOULEVARD", "BLVD"), ("DRIVE", "DR"), ("LANE", "LN"), ("COURT", "CT"), ("APARTMENT", "APT"),
    ("SUITE", "STE"), ("BUILDING", "BLDG"), ("FLOOR", "FL"), ("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"), ("WEST", "W"),
]
EMPTY_WORDS = ["", "N/A", "NA", "NULL", "NONE", "-", "—"]
# Date patterns in the order in which they are tried.
DATE_PATTERNS = ["yyyy-M-d", "d-M-yyyy", "M-d-yyyy", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy"]
YEARS = (1900, 2030)


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a base letter and marks, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _accent_table()


#: White space of all kinds; plain \\s knows the ASCII ones only.
SPACE = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), r"\p{Mn}", "")


def is_empty(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(*EMPTY_WORDS), F.lit(True))


def some(c: Column) -> Column:
    """The trimmed text, null where it holds nothing."""
    return F.when(~is_empty(c), strip(c))


def _squeeze(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def normalize_name(c: Column) -> Column:
    bare = F.regexp_replace(strip_accents(F.upper(strip(c))), r"[^\p{L}\p{N}_\s\p{Z}-]", "")
    return _squeeze(F.translate(bare, "-", " "))


def normalize_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(10)))


def normalize_email(c: Column) -> Column:
    mail = F.lower(strip(c))
    return F.when(F.contains(mail, F.lit("@")) & F.contains(F.substring_index(mail, "@", -1), F.lit(".")), mail)


def email_domain(c: Column) -> Column:
    """Domain of a normalized address."""
    return F.when(F.contains(c, F.lit("@")), F.substring_index(c, "@", -1))


def normalize_dob(c: Column) -> Column:
    text = F.trim(F.regexp_replace(c, f"{SPACE}+", " "))
    tries = [F.try_to_date(text, p) for p in DATE_PATTERNS]
    return F.date_format(F.coalesce(*[F.when(F.year(t).between(*YEARS), t) for t in tries]), "yyyy-MM-dd")


def normalize_address(c: Column) -> Column:
    text = strip_accents(F.upper(strip(c)))
    for word, short in ADDRESS_WORDS:
        text = F.regexp_replace(text, rf"\b{word}\b", short)
    return _squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\s\p{Z}]", " "))


def normalize_natid(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def record_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def tokens(c: Column, least: int = 2) -> Column:
    return F.filter(F.split(c, " "), lambda t: F.length(t) >= least)


def soundex(c: Column) -> Column:
    """Soundex of words that begin with a letter, else null."""
    return F.when(c.rlike("^[A-Z]"), F.soundex(c))
