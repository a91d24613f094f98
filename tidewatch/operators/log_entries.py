"""Entries with fields from the lines of many programs' logs, by a template tree of fixed depth.

1. Variables of every line are masked: instants, levels, priorities, numbers. A line is its tokens between single blanks.
2. The tree routes a masked line by its number of tokens and its leading DEPTH tokens to a leaf. Equal masked lines are
   counted before any shuffle. In a leaf similar ones (SIMILAR of their tokens equal) merge into a template, whose
   differing positions are open. A leaf of more than LEAF of them is several, by hash, so that free text in which no two
   lines are alike doesn't make a task that grows with its square; fields are positions in front of the message, which
   lines of one form share in whatever leaf they are.
3. A template's positions are mapped to fields once: where the instant, the level, the component and the message stand. A
   template with both an instant with a time of day and a level in front of its message begins an entry.
4. Lines get their template's map by the masked line's digest; the rest is native columns.

Which entry a line belongs to is a running maximum over the file, taken in blocks of lines first and then over the blocks'
maxima, so a file with a third of all lines isn't one task's.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.classify import error_category
from tidewatch.functions.instants import with_instant
from tidewatch.functions.keys import store_in_line
from tidewatch.session import written

DEPTH, SIMILAR, BLOCK = 3, 0.5, 20_000
LEAF = 4_096  # masked lines that a task merges at once
HEADS_BROADCAST = 500_000  # masked lines that begin entries, of 32 bytes each, up to which they are broadcast; counted before
HEAD = 8  # the tokens among which an instant and a level count as in front of the message

_GLUE = "\x02"  # for a blank inside an instant
# Forms of an instant with a time of day.
_AT = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
_TAIL = rf"(?:{_GLUE}(?:[AaPp][Mm]|[+-]\d{{2}}:?\d{{2}}|UTC|GMT|Z)(?![A-Za-z]))?"
_ISO = rf"\d{{4}}-\d{{2}}-\d{{2}}[T{_GLUE}]\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,9}})?(?:Z|[+-]\d{{2}}:?\d{{2}})?{_TAIL}"
_DATED = rf"(?:\d{{4}}/\d{{2}}/\d{{2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{1,2}}-[A-Z][a-z]{{2}}-\d{{4}}),?{_GLUE}{_AT}{_TAIL}"
_CLF = rf"\d{{2}}/[A-Z][a-z]{{2}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}(?:{_GLUE}[+-]\d{{4}})?"
_SYSLOG = rf"[A-Z][a-z]{{2}}{_GLUE}{{1,2}}\d{{1,2}}{_GLUE}\d{{2}}:\d{{2}}:\d{{2}}"
_CLOCK = r"(?<![\d:.T])\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?![\d:])"
_EPOCH = r"(?:(?<=\"time\": |\"ts\": |\"timestamp\": )|^)\d{10}(?:\d{3}){0,2}(?![\d.:/-])"
#: What a line begins with if an instant opens it, with only a priority or its key before it.
_OPENS = r'^(?:<\d{1,3}> ?[A-Z][a-z]{2} |(?:<\d{1,3}> ?)?[\[({"]*(?:[A-Za-z_]+(?:=|": ?)"?)?\d)'
# Names of levels, from least to gravest.
LEVELS = {
    "trace": 0,
    "debug": 1,
    "info": 2,
    "information": 2,
    "notice": 2,
    "warn": 3,
    "warning": 3,
    "err": 4,
    "error": 4,
    "severe": 4,
    "crit": 5,
    "critical": 5,
    "fatal": 5,
    "alert": 5,
    "emerg": 5,
    "panic": 5,
}
LETTERS = {"T": 0, "D": 1, "I": 2, "N": 2, "W": 3, "E": 4, "C": 5, "F": 5}
NAMES = ("trace", "debug", "info", "warning", "error", "fatal")
PRIORITIES = (5, 5, 5, 4, 3, 2, 2, 1)  # of a syslog priority's remainder by 8
_LEVEL = r"(?i)(?<![A-Za-z0-9_.-])(?:" + "|".join(sorted(LEVELS, key=len, reverse=True)) + r")(?![A-Za-z0-9_-]| ?:? ?[A-Za-z]+\))"


def _glued(line: Column) -> Column:
    """The line without a byte order mark and carriage return; blanks inside an instant are glue, a priority stands alone."""
    text = F.rtrim(F.ltrim(line, F.lit("﻿")), F.lit("\r"))
    text = F.regexp_replace(text, r"^<(\d{1,3})>", "<$1> ")
    text = F.regexp_replace(text, r"^(<\d{1,3}> )([A-Z][a-z]{2}) ( ?\d{1,2}) (\d{2}:\d{2}:\d{2}) ", f"$1$2{_GLUE}$3{_GLUE}$4 ")
    text = F.replace(text, F.lit(f"{_GLUE} "), F.lit(f"{_GLUE}{_GLUE}"))
    text = F.regexp_replace(text, r"(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}) ([+-]\d{4})", f"$1{_GLUE}$2")
    date = r"(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}-[A-Z][a-z]{2}-\d{4}),?"
    text = F.regexp_replace(text, rf"^(\[?{date}) (\d{{1,2}}:\d{{2}}:\d{{2}})", f"$1{_GLUE}$2")
    return F.regexp_replace(text, rf"^(\[?{date}[T{_GLUE}]{_AT}) ([AaPp][Mm]|[+-]\d{{2}}:?\d{{2}}|UTC|GMT|Z)(?![A-Za-z])", f"$1{_GLUE}$2")


def _timed(glued: Column) -> Column:
    """The instant that opens the line as <T>, a priority before it as <P>; tokens stay where they are. Instants further on can't
    begin an entry, they are masked as other numbers are."""
    text = F.regexp_replace(glued, r"^<\d{1,3}>(?= )", "<P>")
    before = r'^((?:<P> )?[\[({"]*(?:[A-Za-z_]+(?:=|": ?)"?)?)'
    return F.regexp_replace(text, f"{before}(?:{'|'.join((_ISO, _DATED, _CLF, _SYSLOG, _EPOCH, _CLOCK))})", "$1<T>")


def _masked(timed: Column) -> Column:
    """Levels as <L> and anything with a digit as <*>, of lines that an instant opens; others begin no entry and are null."""
    rest = F.regexp_replace(F.regexp_replace(timed, r"\[[TDINWECF]\]", "[<L>]"), _LEVEL, "<L>")
    return F.when(timed.contains("<T>"), F.regexp_replace(rest, r"(?<![\w.])[\w.&&[^\d]]*+\d[\w.]*+", "<*>"))


_COMPONENT_KEY = re.compile(r'^[{\[]?"?(?:component|logger|comp|module|source)"?[:=]')
_MESSAGE_KEY = re.compile(r'^"?(?:message|msg)"?[:=]')
_MARK, _WORD = re.compile("<[TLP]>"), re.compile(r"[\w*]")
_KEY = re.compile(r'[{\["]*\w+"?[:=]')
_ONLY_A_KEY = re.compile(r'^[{\[]?"?\w+"?[:=]$')
_TIME_KEY = re.compile(r'^[\[{("]*(?:[A-Za-z_]+=)?"?<T>')


def head_of(template: Sequence[str]) -> tuple[int, int, int, int] | None:
    """The positions (instant, level, component, message) of an entry's first line; component -1 where there is none.

    None unless an instant opens the line, with only its key or a priority before it, and a level (or the priority) stands
    in front of the message.
    """
    t = next((i for i, x in enumerate(template[:3]) if _TIME_KEY.match(x)), None)
    if t is None or any(not re.fullmatch(r'<P>|\{?"[A-Za-z_]+":', x) for x in template[:t]):
        return None
    message = next((i for i, x in enumerate(template) if _MESSAGE_KEY.match(x)), None)
    if message is not None and _ONLY_A_KEY.match(template[message]):
        message += 1
    end = message if message is not None else min(len(template), HEAD)
    level = 0 if template[0] == "<P>" else next((i for i in range(t + 1, end) if "<L>" in template[i]), None)
    if level is None:
        return None
    keyed = next((i for i in range(t + 1, end) if _COMPONENT_KEY.match(template[i])), None)
    if keyed is not None:
        component = keyed + 1 if _ONLY_A_KEY.match(template[keyed]) else keyed
    elif template[0] == "<P>":
        component = next((i for i in range(t + 1, end) if template[i].endswith(":")), -1)
    else:
        component = next((i for i in range(t + 1, end) if i != level and re.search(r"[\w*]", template[i])), -1)
    if message is None:
        between = max(level, t) if template[0] != "<P>" else t
        # a component after the level belongs to the head only where marks set it off
        if template[0] != "<P>" and component > between + 1 and not all(x in ("", "|", "-") for x in template[between + 1 : component]):
            component = -1
        message = max(between, component) + 1
        while message < len(template) and template[message] in ("|", "-", ""):
            message += 1
    return t, level, component, message


def _form(token: str) -> str:
    """What of a token must be alike in all lines of a template: a mark, a separator, the key of a field; nothing of a plain word."""
    if _MARK.search(token) or not _WORD.search(token):
        return token
    key = _KEY.match(token)
    return key[0] if key else "word"


def merge_leaf(lines: Sequence[Sequence[str]]) -> list[list[str]]:
    """The template of each masked line of a leaf (all of one length): of the templates with its marks (instant, level, priority,
    separators and keys of fields, in front of the message) at its places the one that shares most tokens with it, SIMILAR of them at least, whose other positions open up; else itself.
    Keys of fields in front of the message are never opened."""
    if not len(lines):
        return []
    code: dict[str, int] = {"<*>": 0}
    matrix = np.array([[code.setdefault(x, len(code)) for x in tokens] for tokens in lines], dtype=np.int32)
    kept = np.array(["<" in x or x.endswith((":", "=")) or '"' in x for x in code])
    in_head = np.arange(matrix.shape[1]) < HEAD
    groups: dict[tuple, list[int]] = {}
    for row, tokens in enumerate(lines):
        groups.setdefault(tuple(map(_form, tokens[:HEAD])), []).append(row)
    found: list[np.ndarray | None] = [None] * len(lines)
    for rows in groups.values():
        templates, n, of = np.empty((len(rows), matrix.shape[1]), dtype=np.int32), 0, []
        for row in rows:
            same = (templates[:n] == matrix[row]).sum(axis=1)
            best = int(same.argmax()) if n else 0
            if not n or same[best] < SIMILAR * matrix.shape[1]:
                best, n = n, n + 1
                templates[best] = matrix[row]
            else:
                t = templates[best]
                templates[best] = np.where((t == matrix[row]) | (in_head & kept[t]), t, 0)
            of.append(best)
        for row, k in zip(rows, of, strict=True):
            found[row] = templates[k]
    names = list(code)
    return [[names[x] for x in t] for t in found]


_MAP = "low bigint, high bigint, template string, at_time int, at_level int, at_component int, at_message int"


def _leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "masked"], ascending=[False, True])
    tokens = [x.split(" ") for x in pdf["masked"]]
    out = []
    for low, high, template in zip(pdf["low"], pdf["high"], merge_leaf(tokens), strict=True):
        at = head_of(template)
        if at is not None:
            out.append((low, high, " ".join(template), *at))
    return pd.DataFrame(out, columns=["low", "high", "template", "at_time", "at_level", "at_component", "at_message"])


def template_map(lines: DataFrame) -> DataFrame:
    """Of the masked lines (masked, low, high) those that begin entries, with their template and its positions."""
    counted = lines.where("masked is not null").groupBy("low", "high", "masked").agg(F.count(F.lit(1)).alias("n"))
    tokens = F.split("masked", " ")
    routed = counted.withColumn("_n", F.size(tokens)).withColumn("_lead", F.array_join(F.slice(tokens, 1, DEPTH), " "))
    leaves = routed.groupBy("_n", "_lead").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("_parts"))
    part = F.pmod(F.xxhash64(F.lit(3), "masked"), "_parts").alias("_part")
    keys = ["_n", "_lead", "_part"]
    parts = routed.join(leaves, ["_n", "_lead"]).select("*", part)
    # in a number of tasks of its own: the few bytes of masked lines would be put into one, but each leaf takes its time
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, *keys).groupBy(*keys).applyInPandas(_leaf, _MAP)


def masked_lines(lines: DataFrame) -> DataFrame:
    """server, file, line_no, line of every row with a file and number, with masked and its digest in two halves, null for lines that
    no instant opens. Written once: masking costs more than reading it again."""
    # explode: each step takes the last one's text as it is instead of making it again
    step = lines.where("file is not null and line_no is not null").select("server", "file", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    opens = F.ltrim(F.col("line"), F.lit("﻿")).rlike(_OPENS)
    step = step.select("*", F.explode(F.array(F.when(opens, _glued(F.col("line"))))).alias("_g"))
    step = step.select("server", "file", "line_no", "line", F.explode(F.array(_timed(F.col("_g")))).alias("_t"))
    step = step.select("server", "file", "line_no", "line", F.explode(F.array(_masked(F.col("_t")))).alias("masked"))
    low, high = F.xxhash64("masked"), F.xxhash64(F.lit(7), "masked")
    return written(step.select("*", *[F.when(F.col("masked").isNotNull(), x).alias(n) for n, x in (("low", low), ("high", high))]), "masked")


_PLACES = ["at_time", "at_level", "at_component", "at_message"]


def _with_places(text: DataFrame) -> DataFrame:
    """masked_lines with the positions of their templates, null for lines that begin no entry."""
    heads = written(template_map(text).select("low", "high", *_PLACES), "heads")
    if heads.count() <= HEADS_BROADCAST:
        return text.join(F.broadcast(heads), ["low", "high"], "left")
    # lines that no instant opens, perhaps most, don't go through the shuffle, where they would all have the same key
    found = text.where("low is not null").join(heads, ["low", "high"], "left")
    return found.unionByName(text.where("low is null"), allowMissingColumns=True)


def _assigned(lines: DataFrame) -> DataFrame:
    """Every line once with its place in its file: `_o` is twice the number of the last line at or above it that begins an entry, and
    one, or twice the number of the last `*` line, whichever is later; log_day and log_zone are what headers said last.

    Whole lines are shuffled once, by file and block: repeated rows meet there (the least line counts), and the order runs there.
    """
    row = F.struct("line", "server", *_PLACES).alias("_m")
    rows = _with_places(masked_lines(lines)).select("file", F.expr(f"line_no div {BLOCK}").alias("block"), "line_no", row)
    # said here, as the join below says it on one side only, and the two uses of these rows would be two shuffles
    rows = rows.where("file is not null and block is not null")
    one = rows.repartition("file", "block").groupBy("file", "block", "line_no").agg(F.min("_m").alias("_m")).select("file", "block", "line_no", "_m.*")
    star, blank = F.col("line").rlike(r"(?U)^[﻿\s]*\*"), ~F.col("line").rlike(r"(?U)[^﻿\s]")
    found = one.select("*", star.alias("star"), blank.alias("blank"))
    code = F.when(F.col("star"), F.col("line_no") * 2).when(F.col("at_time").isNotNull(), F.col("line_no") * 2 + 1)
    day = F.when(F.col("star"), F.regexp_extract("line", r"[Dd]ate (\d{4}-\d{2}-\d{2})", 1))
    zone = F.when(F.col("star"), F.regexp_extract("line", r"Zone=(\S+)", 1))
    said = lambda x: F.when(x != "", F.struct("line_no", x.alias("said")))
    marked = found.select("*", F.struct(code.alias("line_no"), F.lit("").alias("said")).alias("_c"), said(day).alias("_d"), said(zone).alias("_z"))
    marked = marked.withColumn("_c", F.when(F.col("_c.line_no").isNotNull(), F.col("_c")))
    block = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = ("_c", "_d", "_z")
    carried = marked.groupBy("file", "block").agg(*[F.max(x).alias(x) for x in names]).select(
        "file",
        "block",
        *[F.max(x).over(earlier).alias(f"{x}b") for x in names],
    )
    running = marked.select(*[x for x in marked.columns if x not in names], *[F.max(x).over(block).alias(x) for x in names]).join(carried, ["file", "block"])
    owner = F.coalesce("_c.line_no", "_cb.line_no")
    return running.select("*", owner.alias("_o"), F.coalesce("_d.said", "_db.said").alias("log_day"), F.coalesce("_z.said", "_zb.said").alias("log_zone"))


def unowned(lines: DataFrame) -> DataFrame:
    """(file, lines, first_line, last_line): the lines of a file that are in no entry though they aren't blank or `*` lines: those
    above its first entry and between a `*` line and the next entry. Files without such lines have no row."""
    loose = _assigned(lines).where("not star and not blank and coalesce(_o, 0) % 2 = 0")
    return loose.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def entries(lines: DataFrame) -> DataFrame:
    """The entries of lines(server, file, line_no, line), one row each.

    Columns: server, file, first_line, last_line, time_text, instant_us, level (trace, debug, info, warning, error or fatal),
    component, message (of the first line), store_id (named anywhere in the entry), error_category (of the whole entry).
    Lines without a file or number are none's; null lines are blank ones. What is in no entry is counted by `unowned`. `*` lines belong to no entry and end one; blank
    lines at an entry's end are not in it. An instant without date takes it from the last `* Log date` line above, else
    from the file's name; one without zone takes the file header's Zone. Repeated rows count once. An empty table gives none.
    """
    owned = _assigned(lines).where("_o % 2 = 1 and not star")
    owned = owned.withColumn("first_line", F.expr("_o div 2"))
    is_head = F.col("line_no") == F.col("first_line")
    owned = owned.select("*", F.explode(F.array(F.when(is_head, _glued(F.col("line"))))).alias("glued"), F.lower("line").alias("low_line"))
    tokens = F.split("glued", " ")
    token = lambda c: F.get(tokens, F.col(c))
    fields = owned.select(
        "server", "file", "line_no", "first_line", "line", "blank",
        F.when(is_head, token("at_time")).alias("time_token"), F.when(is_head, token("at_level")).alias("level_token"),
        F.when(is_head & (F.col("at_component") >= 0), token("at_component")).alias("component_token"),
        F.when(is_head, F.array_join(F.slice(tokens, F.col("at_message") + 1, F.greatest(F.size(tokens), F.lit(1))), " ")).alias("message"),
        F.when(is_head, F.col("log_day")).alias("log_day"), F.when(is_head, F.col("log_zone")).alias("log_zone"),
        store_in_line(F.col("line")).alias("store"), error_category(F.col("line"), F.col("low_line")).alias("category"),
    )
    kept = lambda c: F.max(c).alias(c)
    at = F.when(F.col("store").isNotNull(), F.struct("line_no", "store"))
    named = F.when(F.col("category").isNotNull(), F.struct("line_no", "category"))
    one = fields.groupBy("file", "first_line").agg(
        kept("server"), F.max(F.when(~F.col("blank"), F.col("line_no"))).alias("last_line"), *[kept(c) for c in ("time_token", "level_token", "component_token", "message", "log_day", "log_zone")],
        F.min(at)["store"].alias("store_id"), F.min(named)["category"].alias("error_category"),
    )
    return _typed(one)


def _level(token: Column) -> Column:
    word = F.lower(F.regexp_replace(F.regexp_replace(token, r"^[A-Za-z]+=", ""), r"[^A-Za-z]", ""))
    letter = F.regexp_extract(token, r"^\[?([A-Z])\]?$", 1)
    rank = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[word]
    by_letter = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])[letter]
    priority = F.regexp_extract(token, r"^<(\d{1,3})>$", 1)
    by_priority = F.get(F.array(*[F.lit(x) for x in PRIORITIES]), (priority.try_cast("int") % 8))
    return F.get(F.array(*[F.lit(x) for x in NAMES]), F.coalesce(by_priority, by_letter, rank))


def _typed(one: DataFrame) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("time_token", _GLUE + "+", " "), r'^[\[{("]*(?:[A-Za-z_]+=)?"?', ""), r'[\]})",]+$', "")
    named = F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1)
    day = F.coalesce(F.nullif("log_day", F.lit("")), F.nullif(named, F.lit("")))
    syslog = r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2})$"
    full = F.when(plain.rlike(r"^\d{2}:\d{2}:\d{2}"), F.concat_ws(" ", day, plain)).when(
        plain.rlike(syslog),
        F.concat(
            F.regexp_extract(plain, syslog, 2),
            F.lit("-"),
            F.regexp_extract(plain, syslog, 1),
            F.lit("-"),
            F.left(day, F.lit(4)),
            F.lit(" "),
            F.regexp_extract(plain, syslog, 3),
        ),
    ).otherwise(plain)
    timed = with_instant(one.withColumn("time_text", full), "time_text", "log_zone", "instant_us")
    component = F.regexp_replace(F.regexp_replace(F.regexp_replace("component_token", r'^[{\["]*(?:[A-Za-z_]+=)?"?', ""), r'[\]}",:]+$', ""), r"\[\d+\]?$", "")
    message = F.regexp_replace(F.regexp_replace(F.regexp_replace("message", _GLUE + "+", " "), r'^(?:msg|message)=', ""), r'^"(.*?)"?\}?$', "$1")
    return timed.select(
        "server",
        "file",
        "first_line",
        "last_line",
        "time_text",
        "instant_us",
        _level(F.col("level_token")).alias("level"),
        component.alias("component"),
        message.alias("message"),
        "store_id",
        "error_category",
    )
