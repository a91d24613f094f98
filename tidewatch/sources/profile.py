"""Sizes and counts of a set of log files, and the way of analysing that the sizes suggest."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.logs import IN_MEMORY, NAME


def profile_files(files: DataFrame) -> DataFrame:
    """Per server of files(file_id, server, path, container, n_bytes, content): bytes, files, logs, archives and inner archives. Each file_id once."""
    one = files.groupBy("file_id").agg(
        *[F.min(c).alias(c) for c in ("server", "path", "container", "n_bytes")],
        F.max(F.col("content").isNotNull().cast("int")).alias("readable"),
    )
    inner = F.when(F.col("container").contains("!/"), F.col("container"))
    return one.groupBy("server").agg(
        F.sum("n_bytes").alias("total_size_bytes"), (F.count(F.lit(1)) + F.countDistinct("container")).alias("total_files"), F.count_if(F.col("path").endswith(".log")).alias("log_files"),
        F.countDistinct(F.regexp_replace("container", "!/.*$", "")).alias("zip_files"), F.countDistinct(inner).alias("nested_zip_files"), F.count_if(F.col("readable") == 0).alias("unreadable"),
    )


PACKED = 7  # fixed value: times its size for an archive that can't be opened


def profile_folder(spark: SparkSession, path: str) -> DataFrame:
    """The same counts of a folder's files, with the size of what archives hold (unpacked_bytes; of logs their own) and the number of
    files named after a role group or the federation. Only archives are opened, and of these the list of members is read."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    held = zipfile.ZipFile(io.BytesIO(content)).infolist()
                    out.append((at, sum(x.file_size for x in held), sum(x.filename.endswith(".zip") for x in held)))
                except zipfile.BadZipFile:
                    out.append((at, PACKED * len(content), 0))
            yield pd.DataFrame(out, columns=["path", "held", "inner"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listing = files.load(path).select("path", "length")
    archives = files.option("pathGlobFilter", "*.{zip,ZIP}").load(path).where(F.col("length") < IN_MEMORY).select("path", "content").mapInPandas(
        unpacked,
        "path string, held bigint, inner bigint",
    )
    zipped, logs = F.lower("path").endswith(".zip"), F.col("path").endswith(".log")
    server = F.coalesce(F.nullif(F.regexp_extract("path", r"(MS\d+)", 1), F.lit("")), F.lit("Unknown"))
    held = F.when(zipped, F.coalesce("held", F.col("length") * PACKED)).when(logs, F.col("length"))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(NAME)
    return listing.join(archives, "path", "left").groupBy(server.alias("server")).agg(
        F.sum("length").alias("total_size_bytes"), F.count(F.lit(1)).alias("total_files"), F.count_if(logs).alias("log_files"), F.count_if(zipped).alias("zip_files"),
        F.coalesce(F.sum("inner"), F.lit(0)).alias("nested_zip_files"), F.coalesce(F.sum(held), F.sum("length")).alias("unpacked_bytes"), F.count_if(named).alias("named_files"),
    )


def memory_gb(spark: SparkSession) -> float:
    """What the running executors have for storage, in GB; of the driver where it is the only one."""
    found = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    return sum(x.totalOnHeapStorageMemory() for x in found) / 1e9


# The sizes and shares of memory in the rules below.
def analyzer_for(size_gb: Column, files: Column, unpacked_gb: Column, memory_gb: Column) -> Column:
    """streaming, batch or full, by size, number of files and memory (100 bytes for each 200 of text)."""
    needed = unpacked_gb / 2
    return (
        F.when((unpacked_gb > 50) | (files > 10_000), "streaming").when(needed > memory_gb * 0.7, "streaming").when((size_gb > 10) | (files > 2_000), "streaming")
        .when((size_gb > 1) | (files > 500), F.when(needed < memory_gb * 0.5, "full").otherwise("batch")).otherwise("full")
    )
