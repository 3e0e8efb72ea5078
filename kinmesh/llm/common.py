"""Column expressions shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is neither letter, digit nor combining mark.
NOISE = r"[^\p{L}\p{N}\p{M}]+"


def folded(c: Column) -> Column:
    """Case folded text; upper before lower turns ß into ss, as writers of capitals do."""
    return F.lower(F.upper(c))


def squeezed(c: Column) -> Column:
    """Letters and digits only, case folded, '' for null."""
    return F.coalesce(F.regexp_replace(folded(c), NOISE, ""), F.lit(""))


def words(c: Column) -> Column:
    """Case folded words; apostrophes join, other punctuation separates; empty array for null."""
    t = F.regexp_replace(F.regexp_replace(folded(c), r"['’`´ʼ]", ""), NOISE, " ")
    return F.coalesce(F.filter(F.split(F.trim(t), " "), lambda w: w != ""), F.array().cast("array<string>"))


def label(c: Column) -> Column:
    """One spelling of a code word: upper case letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
