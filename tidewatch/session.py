"""Session settings and the shared folder that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidewatch") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only on one machine (tests), where none is set, a temporary one;
    on a cluster that is an error, as another machine couldn't read it."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a path and all below it; false if there was none."""
    files, at = _hadoop(spark, path)
    return bool(files.delete(at, True))


def listing(spark: SparkSession, path: str) -> dict[str, int]:
    """The lengths of the files below a path, by their names relative to it."""
    files, at = _hadoop(spark, path)
    base = files.makeQualified(at).toUri().getPath()
    found, every = {}, files.listFiles(at, True)
    while every.hasNext():
        status = every.next()
        found[status.getPath().toUri().getPath()[len(base) + 1 :]] = status.getLen()
    return found


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename source to target, where nothing may be. FileExistsError otherwise, also if another writer comes between: a rename onto
    a directory would put source inside of it, so the files under target are compared with those that were moved."""
    files, at = _hadoop(spark, source)
    _, to = _hadoop(spark, target)
    if files.exists(to):
        raise FileExistsError(target)
    before = listing(spark, source)
    if not files.rename(at, to):
        raise FileExistsError(target) if files.exists(to) else OSError(f"{source} can't be renamed to {target}")
    if listing(spark, target) != before:
        delete(spark, f"{target}/{source.rstrip('/').rsplit('/', 1)[1]}")
        raise FileExistsError(target)


_WRITTEN: list[str] = []


def temporary(spark: SparkSession, path: str) -> None:
    """Note a written path as one that clear_written, or at the latest the end of the application, deletes."""
    _WRITTEN.append(path)
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and return the table read back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Delete the tables that `written` has made in this process; to be called when their results are no longer used."""
    n = 0
    while _WRITTEN:
        n += delete(spark, _WRITTEN.pop())
    return n


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with the settings of spark and some of its own; spark's stay as they are."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    for name, value in settings.items():
        own.conf.set(name, value)
    return own
