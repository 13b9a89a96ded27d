"""Person names: normal form, matching, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """Lower case; separators become spaces; what is not a-z, 0-9 or space goes (accented letters as well); single spaces."""
    low = F.regexp_replace(F.lower(name), r"[-_./\\]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]", ""), r"\s+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Of normal forms: equal; or both have two words and one holds the other as text or by words."""
    x, y = F.split(a, " "), F.split(b, " ")
    inside = F.contains(a, b) | F.contains(b, a)
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    both = (a != "") & (b != "")
    return both & ((a == b) | ((F.size(x) >= 2) & (F.size(y) >= 2) & (inside | subset)))


def mask_name(name: Column, suppressed_at: Column) -> Column:
    return F.when(suppressed_at.isNotNull(), F.lit("[name withdrawn]")).otherwise(name)


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))
