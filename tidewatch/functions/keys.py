"""Keys of stores and targets from their many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?<!\d)(\d{4,5})(?!\d)"
INTRODUCED = r"(?<![A-Za-z])[Ss]tore(?:Id)?[\"'\s_:=-]{0,6}(\d{4,5})(?!\d)"
STORE_TARGET = r"(?i)^\s*(?:store[\s_]*)?(\d{4,5})(?!\d)"


def _padded(text: Column, pattern: str) -> Column:
    digits = F.regexp_extract(text, pattern, 1)
    return F.when(digits != "", F.lpad(digits, 5, "0"))


def store_key(text: Column) -> Column:
    """The number of four or five digits in a written store id or entity, padded to five; null where there is none."""
    return _padded(text, NUMBER)


def store_in_line(text: Column) -> Column:
    """As store_key, but only a number that the text introduces as a store (Store, store, storeId)."""
    return _padded(text, INTRODUCED)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def target_key(text: Column) -> Column:
    """Key of a recommendation's target: the store for store targets, else the trimmed lower-case text; null where blank."""
    plain = F.lower(strip(text))
    return F.coalesce(_padded(text, STORE_TARGET), F.when(plain != "", plain))
