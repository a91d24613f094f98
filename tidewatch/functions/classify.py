"""Columns that classify a log line by the ordered patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import patterns


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_match(cases: dict[str, Column]) -> Column:
    """The name of the first condition that holds; null for none."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in cases.items()])


def error_category(line: Column, low: Column | None = None) -> Column:
    """The first category with a phrase in the line. low is the line in lower case, where there is a column of it: dozens of
    conditions use it, and written out each would make it anew."""
    low = F.lower(line) if low is None else low
    return first_match({k: _any(low.contains(x.lower()) for x in v) for k, v in patterns.CATEGORIES.items()})


def severity(line: Column, low: Column | None = None) -> Column:
    low = F.lower(line) if low is None else low
    return first_match({k: low.contains(v) for k, v in patterns.SEVERITIES.items()})


def internal_subtype(line: Column, category: Column) -> Column:
    """Only of lines whose category starts with internal_error."""
    return F.when(category.startswith("internal_error"), first_match({k: line.rlike(v) for k, v in patterns.SUBTYPES.items()}))


def reasons(line: Column, low: Column | None = None) -> Column:
    """All reasons whose pattern the line has, in their order; none unless it has one of the keywords."""
    low = F.lower(line) if low is None else low
    labels = F.filter(F.array(*[F.when(line.rlike("(?i)" + v), F.lit(k)) for k, v in patterns.REASONS.items()]), lambda x: x.isNotNull())
    return F.when(_any(low.contains(k) for k in patterns.REASON_KEYWORDS), labels).otherwise(F.array().cast("array<string>"))
