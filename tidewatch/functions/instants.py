"""One UTC instant from texts of mixed form, precision and zone.

All forms are one regular expression, an alternation with named groups. It runs once per text: its replacement writes the
components, whichever branch matched, into fixed places. Components are checked against the calendar, and the instant is
assembled by integer day arithmetic in microseconds since 1970 UTC, never by a parser or the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes east of UTC that a zone abbreviation states, by the region of the machine that wrote it; "" is
# any region, also none. Abbreviations that several regions use have no "" entry.
ABBREVIATIONS = {
    "UTC": {"": 0}, "GMT": {"": 0}, "Z": {"": 0}, "UT": {"": 0}, "WET": {"": 0}, "WEST": {"": 60}, "CET": {"": 60}, "CEST": {"": 120},
    "EET": {"": 120}, "EEST": {"": 180}, "MSK": {"": 180}, "EDT": {"": -240}, "CDT": {"": -300}, "MST": {"": -420}, "MDT": {"": -360},
    "PST": {"": -480}, "PDT": {"": -420}, "AKST": {"": -540}, "AKDT": {"": -480}, "HST": {"": -600}, "JST": {"": 540}, "KST": {"": 540},
    "AEST": {"": 600}, "AEDT": {"": 660}, "ACST": {"": 570}, "AWST": {"": 480}, "NZST": {"": 720}, "NZDT": {"": 780}, "SGT": {"": 480}, "HKT": {"": 480},
    "EST": {"Australia/": 600, "": -300}, "CST": {"America/Havana": -300, "America/": -360, "US/": -360, "Asia/": 480},
    "IST": {"Asia/Jerusalem": 120, "Asia/Tel_Aviv": 120, "Asia/": 330, "Europe/": 60}, "BST": {"Asia/": 360, "Europe/": 60},
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_FRACTION = r"(?:[.,](?<f{n}>\d{{1,9}}))?"
_CLOCK = r"(?<h{n}>\d{{1,2}}):(?<i{n}>\d{{2}})(?::(?<s{n}>\d{{2}})" + _FRACTION + ")?"
_ZONE = r"(?<z{n}>Z|[+-]\d{{2}}(?::?\d{{2}})?|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)*)"
_BRANCHES = (
    r"(?<y1>\d{{4}})(?<q1>[-/])(?<m1>\d{{2}})\k<q1>(?<d1>\d{{2}})[T ]" + _CLOCK + r" ?" + _ZONE + "?",
    r"(?<y2>\d{{4}})(?<m2>\d{{2}})(?<d2>\d{{2}})T(?<h2>\d{{2}})(?<i2>\d{{2}})(?:(?<s2>\d{{2}})" + _FRACTION + ")?" + _ZONE + "?",
    r"(?<m3>\d{{1,2}})/(?<d3>\d{{1,2}})/(?<y3>\d{{4}}),? " + _CLOCK + r"(?: ?(?<p3>[AaPp])\.?[Mm]\.?)?(?: " + _ZONE + ")?",
    r"(?<d4>\d{{1,2}})\.(?<m4>\d{{1,2}})\.(?<y4>\d{{4}}),? " + _CLOCK + r"(?: ?" + _ZONE + ")?",
    r"(?:[A-Za-z]{{3,9}}, ?)?(?<d5>\d{{1,2}})[- /](?<m5>[A-Za-z]{{3}})[- /](?<y5>\d{{4}})[ :]" + _CLOCK + r"(?: ?" + _ZONE + ")?",
    r"(?<e6>\d{{9,19}})",
    r"(?<k7>\d{{1,6}}\.\d+)",
)
ALTERNATION = "^\\s*(?:" + "|".join(b.format(n=i) for i, b in enumerate(_BRANCHES, 1)) + ")\\s*$"
#: The places of the components in the replacement, each with the branches that have it.
PLACES = {"y": "12345", "m": "12345", "d": "12345", "h": "12345", "i": "12345", "s": "12345", "f": "12345", "p": "3", "z": "12345", "e": "6", "k": "7"}
_SEPARATOR = "\x01"
_REPLACEMENT = _SEPARATOR + _SEPARATOR.join("".join(f"${{{c}{n}}}" for n in branches) for c, branches in PLACES.items())


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers: years begin in March, so leap days come last."""
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    month = F.pmod(m + 9, F.lit(12))
    era_year = F.floor(shifted / 4) - F.floor(shifted / 100) + F.floor(shifted / 400)
    return (shifted * 365 + era_year + F.floor((month * 153 + 2) / 5) + d - 1 - 719_468).cast("bigint")


def _is_zone(name: Column) -> Column:
    """Whether a text names a zone; to use another as one would fail a query instead of giving no instant."""
    return name.rlike(r"^[A-Za-z+-]\S*$") & F.concat(F.lit("2000-01-01 00:00:00 "), name).try_cast("timestamp").isNotNull()


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _stated_offset(zone: Column, region: Column) -> Column:
    """Minutes of an abbreviation as the region reads it; null for none or one that the region doesn't settle."""
    out = None
    for name, by_region in ABBREVIATIONS.items():
        value = None
        for prefix, minutes in by_region.items():
            cond = F.lit(True) if prefix == "" else region.startswith(prefix)
            value = F.when(cond, minutes) if value is None else value.when(cond, minutes)
        out = F.when(zone == name, value) if out is None else out.when(zone == name, value)
    return out


def _wall_clock(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _settled(df: DataFrame, name: str, *values: Column) -> DataFrame:
    """df with the array column name of values, computed once: a filter above isn't pushed below it, which would spell out
    the values in the filter, theirs in turn, and so on, an expression that doubles with every step."""
    return df.select("*", F.explode(F.array(F.array(*values))).alias(name))


def _settled_texts(df: DataFrame, name: str, texts: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(texts)).alias(name))


def _at(name: str, k: int) -> Column:
    return F.get(F.col(name), F.lit(k))


def _local_to_utc(df: DataFrame, wall: str, zone: str, tmp: str) -> DataFrame:
    """df with {tmp}_l, the one instant at which zone's clocks show wall; null where there is none (a gap) or are two (an overlap).

    The offsets in force a day before and a day after are the only candidates, as no zone changes twice within two days.
    """
    w, z, day = F.col(wall), F.col(zone), 86_400_000_000
    df = _settled(df, f"{tmp}_u", *[w - (_wall_clock(w + x, z) - (w + x)) for x in (-day, day)])
    a, b = _at(f"{tmp}_u", 0), _at(f"{tmp}_u", 1)
    df = _settled(df, f"{tmp}_x", _wall_clock(a, z) == w, (a != b) & (_wall_clock(b, z) == w))
    x, y = _at(f"{tmp}_x", 0), _at(f"{tmp}_x", 1)
    return df.withColumn(f"{tmp}_l", F.when(x & ~y, a).when(y & ~x, b)).drop(f"{tmp}_u", f"{tmp}_x")


def with_instant(df: DataFrame, text: str, zone: str, out: str) -> DataFrame:
    """df with the column out, bigint microseconds since 1970 UTC, read from the column text; null where no single instant is meant.

    zone is the column with the writer's IANA zone: texts without a zone and sheet day numbers (days since 1899-12-30,
    read to the millisecond) are its local time, and abbreviations are read in its region. A null or unknown zone leaves
    such texts without an instant, as do local times that a clock change skips or repeats, dates not in the calendar,
    empty, blank and null texts. With slashes the month comes first (or the year of four digits), with dots the day; bare digits count seconds (9-11
    digits), milliseconds (12-14), microseconds (15-17) or nanoseconds from 1970 UTC. Fractions are cut to microseconds.
    """
    tmp = f"_{out}"
    parts = _settled_texts(df, f"{tmp}_c", F.split(F.regexp_replace(F.col(text), ALTERNATION, _REPLACEMENT), _SEPARATOR))
    place = {c: k for k, c in enumerate(PLACES, 1)}
    c = lambda k: _at(f"{tmp}_c", place[k])
    number = lambda k: c(k).try_cast("bigint")
    month = number("m")
    for k, name in enumerate(MONTHS, 1):
        month = F.when(F.lower(c("m")) == name, k).otherwise(month)
    hour = F.when(c("p") == "", number("h")).when(number("h").between(1, 12), number("h") % 12 + F.when(F.lower(c("p")) == "p", 12).otherwise(0))
    second = F.when(c("s") == "", 0).otherwise(number("s"))
    parts = _settled(parts, f"{tmp}_n", number("y"), month, number("d"), hour, number("i"), second)
    y, m, d, h, i, s = (_at(f"{tmp}_n", k) for k in range(6))
    valid = m.between(1, 12) & (d >= 1) & (d <= _days_in_month(y, m)) & h.between(0, 23) & i.between(0, 59) & s.between(0, 59)
    micros = F.rpad(F.left(c("f"), F.lit(6)), 6, "0").try_cast("bigint")
    wall = (days_from_civil(y, m, d) * 86_400 + h * 3_600 + i * 60 + s) * F.lit(1_000_000) + micros
    sheet = (F.round(c("k").try_cast("double") * 86_400_000).cast("bigint") - F.lit(25_569 * 86_400_000)) * 1_000
    digits, e = F.length(c("e")), c("e").try_cast("bigint")
    epoch = F.when(digits <= 11, e * 1_000_000).when(digits <= 14, e * 1_000).when(digits <= 17, e).otherwise(F.floor(e / 1_000))
    z, own = c("z"), F.col(zone)
    sign = F.when(F.left(z, F.lit(1)) == "-", -1).otherwise(1)
    minutes = F.when(F.length(z) > 3, F.right(z, F.lit(2)).try_cast("int")).otherwise(0)
    numeric = sign * (F.substring(z, 2, 2).try_cast("int") * 60 + minutes)
    stated = F.when(z.rlike("^[+-]"), F.when(F.abs(numeric) <= 18 * 60, numeric)).otherwise(_stated_offset(F.upper(z), F.coalesce(own, F.lit(""))))
    named = F.when(z == "", own).when(z.contains("/"), z)
    parts = _settled(parts, f"{tmp}_t", F.when(c("k") != "", sheet).when(valid, wall), F.when(c("e") != "", epoch), stated.cast("bigint"))
    w, e, o = (_at(f"{tmp}_t", k) for k in range(3))
    parts = parts.select("*", F.when(_is_zone(named), named).alias(f"{tmp}_z")).select("*", F.when(F.col(f"{tmp}_z").isNotNull() & o.isNull(), w).alias(f"{tmp}_v"))
    parts = _local_to_utc(parts, f"{tmp}_v", f"{tmp}_z", tmp)
    instant = F.coalesce(e, w - o * 60_000_000, F.col(f"{tmp}_l"))
    return parts.withColumn(out, instant).drop(*[f"{tmp}_{x}" for x in "cntvzl"])
