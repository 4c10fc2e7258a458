"""Small string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode blanks.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Lower-cased whitespace-separated words."""
    return F.filter(F.split(F.lower(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def money(value: Column) -> Column:
    return F.format_number(value, 0)


def searchable_text(*parts: str, separator: str = " ") -> Column:
    return F.concat_ws(separator, *parts)


def display_name(name: Column) -> Column:
    """social_welfare -> Social Welfare"""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
