"""Reading log files: plain, zipped and zipped within zips, with the number of every line.

Plain files are text that Spark splits: of whatever size, they are read by as many tasks as they have blocks, and line
numbers are put together from the blocks' counts. An archive is read by one task, which takes its members a stretch of lines at
a time; only archives within archives are held in memory, one at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME = r"RoleGroup|Federation"
LINES = "server string, file string, container string, line_no bigint, line string"
IN_MEMORY = 1 << 30  # bytes of an archive up to which Spark hands it over as a whole; larger ones are opened where they lie
LINES_AT_ONCE = 50_000


def members(archive: IO[bytes], name: str, container: str | None = None) -> Iterator[tuple[str, str | None, IO[bytes]]]:
    """(name, container, open file) of the .log files in a zip and in zips within it; macOS leftovers and broken archives give none."""
    try:
        opened = zipfile.ZipFile(archive)
    except zipfile.BadZipFile:
        return
    here = name if container is None else f"{container}!/{name}"
    for info in opened.infolist():
        if info.is_dir() or "__MACOSX" in info.filename:
            continue
        if info.filename.lower().endswith(".zip"):
            yield from members(io.BytesIO(opened.read(info)), info.filename, here)
        elif info.filename.lower().endswith(".log"):
            with opened.open(info) as f:
                yield info.filename, here, f


def lines_of(content: IO[bytes]) -> Iterator[list[str]]:
    """Decoded lines without line ends and byte order mark, some at a time; bad bytes become U+FFFD."""
    some: list[str] = []
    for line in io.TextIOWrapper(content, encoding="utf-8-sig", errors="replace", newline="\n"):
        some.append(line.removesuffix("\n").removesuffix("\r"))
        if len(some) >= LINES_AT_ONCE:
            yield some
            some = []
    if some:
        yield some


def _listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The files below path, by names and lengths alone where the content isn't asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def _server(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(MS\d+)", 1), F.lit("")), F.lit("Unknown"))


def _plain(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain files. A block of a file is one task's, in its order; before it lie the lines of the blocks before."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{log,LOG}").option("lineSep", "\n").text(path)
    found = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    blocks = found.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # the ids of a block follow one another, so that no order has to be made again
    numbered = found.join(blocks, ["file", "_block"])
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    line = F.regexp_replace(F.make_valid_utf8("value"), "\r$", "")
    line = F.when(number == 1, F.regexp_replace(line, "^\ufeff", "")).otherwise(line)
    return numbered.select(
        _server(F.col("file")).alias("server"),
        "file",
        F.lit(None).cast("string").alias("container"),
        number.alias("line_no"),
        line.alias("line"),
    )


def _opened(path: str) -> IO[bytes]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _zipped(spark: SparkSession, path: str) -> DataFrame:
    def rows(path_: str, archive: IO[bytes]) -> Iterator[pd.DataFrame]:
        for name, container, data in members(archive, path_):
            server, number = re.search(r"MS\d+", container or "") or re.search(r"MS\d+", name), 1
            for lines in lines_of(data):
                yield pd.DataFrame(
                    {
                        "server": server[0] if server else "Unknown",
                        "file": name,
                        "container": container,
                        "line_no": range(number, number + len(lines)),
                        "line": lines,
                    }
                )
                number += len(lines)

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                yield from rows(path_, io.BytesIO(content))

    def large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_ in batch["path"]:
                with _opened(path_) as f:
                    yield from rows(path_, f)

    found = _listing(spark, path, "*.{zip,ZIP}")
    whole = found.where(F.col("length") <= IN_MEMORY).select("path", "content").mapInPandas(small, LINES)
    return whole.unionByName(found.where(F.col("length") > IN_MEMORY).select("path").mapInPandas(large, LINES))


def read_logs(spark: SparkSession, path: str, only_named: bool = True) -> DataFrame:
    """(server, file, container, line_no from 1, line) of all .log files under path, also in .zip files at any depth.

    server is the MS number in the path, else Unknown. only_named keeps files named after a role group or the federation, or all
    files where there are none such; whether there are is seen from names, and in archives only where no plain file has one.
    """
    every = _plain(spark, path).unionByName(_zipped(spark, path))
    if not only_named:
        return every
    has = lambda c: F.regexp_extract(c, r"([^/]*)$", 1).rlike(NAME)
    if _listing(spark, path, "*.{log,LOG}").select("path").where(has("path")).isEmpty():
        inside = _zipped(spark, path).select("file").where(has("file"))
        if inside.isEmpty():
            return every
    return every.where(has("file"))


def newest(spark: SparkSession, path: str, pattern: str = "*.{log,zip,xlsx}", most: int = 20) -> DataFrame:
    """(path, length, modified): the files below path that changed last, from names and times alone."""
    found = _listing(spark, path, pattern).select("path", "length", F.col("modificationTime").alias("modified"))
    return found.orderBy(F.desc("modified"), "path").limit(most)


def extract(spark: SparkSession, path: str, out: str) -> None:
    """Write all lines under path as Parquet, by server. Files of one name in several archives keep apart by their container."""
    read_logs(spark, path, only_named=False).write.partitionBy("server").parquet(out)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> list[list[str | None]]:
    """The cells of a workbook's sheet as texts."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = [
            "".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall("m:si", _NS)
        ]
    rows = []
    for row in ElementTree.fromstring(archive.read(sheet)).iter(f"{{{_NS['m']}}}row"):
        cells: list[str | None] = []
        for c in row.findall("m:c", _NS):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            cells.extend([None] * (at - 1 - len(cells)))
            v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
            text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else v.text if v is not None else None
            cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
        rows.append(cells)
    return rows


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """(source_entity, event_timestamp, health_event, machine), all texts, of health sheets under path (.xlsx, first sheet, or .csv)."""
    names = {"Source entity": "source_entity", "Event timestamp": "event_timestamp", "Health event": "health_event", "Machine": "machine"}
    books = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = sheet_rows(content)
                if rows:
                    width = len(rows[0])
                    yield pd.DataFrame([(r + [None] * width)[:width] for r in rows[1:]], columns=rows[0]).reindex(columns=list(names)).rename(columns=names)

    sheets = books.mapInPandas(run, ", ".join(f"{x} string" for x in names.values()))
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(", ".join(f"`{x}` string" for x in names)).csv(path, header=True)
    return sheets.unionByName(texts.withColumnsRenamed(names))
