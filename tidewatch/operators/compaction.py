"""Consolidating far too many tiny files into a few well-sized ones, nothing lost, joined or doubled.

Files are split into records and digested once, beside which a staging table keeps the records. Which files are copies (equal
records in equal order) is decided on digests alone. The records of the kept files then go through the adaptive REBALANCE
hint: rows are shuffled, and the sizes measured at run time merge small output partitions and split large ones near a target
size. They become the table only after a multiset checksum of what was written equals that of what was read; until then they
lie under another name. A copy is listed with the file that is kept, not written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import delete, exists, fresh_path, move, session_with, temporary

PAIRS_UP_TO = 64  # members of a class of copies that are expanded into all their pairs
KEEP_BROADCAST = 1_000_000  # kept files, a bigint each, up to which their list is broadcast; counted before


class ChecksumError(RuntimeError):
    """The written multiset of records isn't the one that was read; nothing was committed."""


@dataclass(frozen=True)
class Compacted:
    """A committed consolidation: the records (file_id, seq, record) and the members (file_id, kept_file_id) of classes of copies."""

    path: str
    records: DataFrame
    members: DataFrame
    checksum: tuple


def records_of(content: Column) -> Column:
    """A file's records: its lines that aren't blank, without line ends (LF, CRLF, CR) and a leading byte order mark; null for null."""
    return F.filter(F.split(F.regexp_replace(content, "^﻿", ""), "\r\n|\n|\r"), lambda x: x.rlike(r"(?U)\S"))


def multiset_checksum(df: DataFrame) -> tuple:
    """(rows, xor of hashes, sum of hashes, sum of second hashes): equal for equal multisets of rows, whatever order or partitions."""
    a, b = F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)
    wide = lambda x: F.sum(x.cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)), F.bit_xor(a), wide(a), wide(b)).first()
    return tuple(None if x is None else str(x) for x in row)


def _sums(file_id: str, records: str) -> Column:
    """Of one file the parts of multiset_checksum over its rows (file_id, seq, record), from its array of records."""
    hashes = lambda *first: F.transform(records, lambda r, i: F.xxhash64(*first, F.col(file_id), i, r))
    added = lambda h: F.aggregate(h, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + x.cast("decimal(38,0)")).cast("decimal(38,0)"))
    xor = F.aggregate(hashes(), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))
    return F.struct(F.size(records).cast("bigint").alias("n"), xor.alias("x"), added(hashes()).alias("a"), added(hashes(F.lit(1))).alias("b"))


def read_files(files: DataFrame, file_id: str, content: str) -> DataFrame:
    """(file_id, records, digest, n, x, a, b, row): the readable files with a record, one row each row, with a 256-bit digest of
    the records and the parts of the checksum of its rows (file_id, seq, record). row tells redelivered rows apart."""
    one = files.select(F.col(file_id).alias("file_id"), records_of(F.col(content)).alias("records")).where("file_id is not null and size(records) > 0")
    digest = F.sha2(F.concat_ws("\n", "records"), 256)
    return one.select("*", digest.alias("digest"), _sums("file_id", "records").alias("s")).select(
        "file_id",
        "records",
        "digest",
        "s.*",
        F.monotonically_increasing_id().alias("row"),
    )


def file_classes(read: DataFrame) -> DataFrame:
    """(file_id, digest, row, n, x, a, b, kept_file_id) of read_files, each file_id once.

    Files of equal records in equal order have the same kept_file_id, the least of theirs; no file meets another, only their
    digests do. Of a file_id with differing contents the least digest counts.
    """
    ids = read.groupBy("file_id").agg(F.min(F.struct("digest", "row", "n", "x", "a", "b")).alias("m")).select("file_id", "m.*")
    kept = ids.groupBy("digest").agg(F.min("file_id").alias("kept_file_id"))
    return ids.join(kept, "digest")


def compact(files: DataFrame, file_id: str, content: str, path: str | None = None, target_bytes: int = 128 << 20) -> Compacted:
    """Consolidate files (one row per file) into few files of about target_bytes under path.

    Nothing may be under path yet: FileExistsError otherwise, whether it was there before or came while this ran. Without a path
    the result lies in the shared folder and is deleted with the other temporary tables. Rows with the same id count once; null
    contents (unreadable) and files without records leave nothing. Extra columns are not looked at. An empty table gives an
    empty, committed result. Raises ChecksumError, leaving path untouched, if the written records aren't those read. What was
    staged is deleted in any case.
    """
    spark = files.sparkSession
    chosen = path is not None
    path = (path or fresh_path(spark, "compacted")).rstrip("/")
    if exists(spark, path):
        raise FileExistsError(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        done = _stage(files, file_id, content, staging, target_bytes)
        delete(spark, f"{staging}/read")
        move(spark, staging, path)
    finally:
        delete(spark, staging)
    if not chosen:
        temporary(spark, path)
    under = lambda df, name: spark.read.schema(df.schema).parquet(f"{path}/{name}")
    return Compacted(path, under(done.records, "records"), under(done.members, "members").select("file_id", "kept_file_id"), done.checksum)


def _stage(files: DataFrame, file_id: str, content: str, staging: str, target_bytes: int) -> Compacted:
    """The consolidation under staging, its checksum compared."""
    spark = files.sparkSession
    scanned = read_files(files, file_id, content)
    scanned.write.option("compression", "zstd").parquet(f"{staging}/read")
    own = session_with(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes)})
    read = own.read.schema(scanned.schema).parquet(f"{staging}/read")
    file_classes(read).drop("digest").write.parquet(f"{staging}/members")
    members = own.read.parquet(f"{staging}/members")
    kept = members.where("file_id = kept_file_id")
    facts = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("x"), F.sum("a"), F.sum("b")).first()
    rows = kept.select("row")
    some = read.select("file_id", "row", "records").join(F.broadcast(rows) if facts[0] <= KEEP_BROADCAST else rows, "row", "left_semi")
    records = some.select("file_id", F.posexplode("records").alias("seq", "record"))
    records.hint("rebalance").write.parquet(f"{staging}/records")
    wrote = own.read.schema(records.schema).parquet(f"{staging}/records")
    expected, got = tuple(None if x is None else str(x) for x in facts[1:]), multiset_checksum(wrote)
    if expected != got:
        raise ChecksumError(f"read {expected}, wrote {got}")
    return Compacted(staging, wrote, members, got)


def copy_pairs(members: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(file_a, file_b), file_a < file_b: files of the same class.

    A class of at most pairs_up_to files gives all its pairs. A larger one, up to a third of all files, gives its kept file
    with each of the others: the same class in linear size, from which every pair follows.
    """
    members = members.select("file_id", "kept_file_id")
    sizes = members.groupBy("kept_file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = members.where("file_id is not null").join(sizes, "kept_file_id")
    small, large = sized.where(F.col("n") <= pairs_up_to), sized.where((F.col("n") > pairs_up_to) & (F.col("file_id") != F.col("kept_file_id")))
    pairs = small.select("kept_file_id", F.col("file_id").alias("file_a")).join(
        small.select("kept_file_id", F.col("file_id").alias("file_b")),
        "kept_file_id",
    ).where("file_a < file_b")
    return pairs.select("file_a", "file_b").unionByName(large.select(F.col("kept_file_id").alias("file_a"), F.col("file_id").alias("file_b")))


def manifest(done: Compacted) -> str:
    """What was committed, as JSON."""
    return json.dumps({"path": done.path, "rows": done.checksum[0], "checksum": done.checksum[1:]})
