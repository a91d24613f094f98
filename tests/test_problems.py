"""The core operators on small cases: nulls, empty tables, ties, repeated rows, clashing names, and brute force."""

import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.functions.instants import with_instant
from tidewatch.functions.keys import store_in_line, store_key, target_key
from tidewatch.operators import compaction, coverage, log_entries
from tidewatch.operators.compaction import compact, copy_pairs
from tidewatch.operators.eager_aggregate import Measure, eager_join_aggregate, hot_keys, once
from tidewatch.operators.log_entries import entries
from tidewatch.plans import problems


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_keys(spark):
    texts = ["02291", " 2291 ", "Store_2291 (vNVR)", "Store 123", None, "", "x 1234567", "Site / Store 40369"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(store_key(F.col("t"))).collect()] == ["02291", "02291", "02291", None, None, None, None, "40369"]
    targets = ["Store 2291 ", "store_02291", " FEDNODE-B1 ", "  ", None]
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    assert [r[0] for r in df.select(target_key(F.col("t"))).collect()] == ["02291", "02291", "fednode-b1", None, None]
    df = spark.createDataFrame([('  "storeId": "02291",',), ("code 02291",), ("store=Store_2291 x",), ("Store 7123456",)], "t string")
    assert [r[0] for r in df.select(store_in_line(F.col("t"))).collect()] == ["02291", None, "02291", None]


def test_eager_join_equals_the_join(spark):
    rnd = random.Random(3)
    left = [(i, rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randint(1, 9), "l") for i in range(300)]
    right = [(i, rnd.choice(["hot"] * 8 + ["a", "c", None]), rnd.randint(1, 9), "r") for i in range(200)]
    a, b = spark.createDataFrame(left, "id int, key string, v int, extra string"), spark.createDataFrame(right, "id int, key string, v int, extra string")
    got = eager_join_aggregate(a, b, ["key"], [Measure("lv", "sum", F.col("v"))], [Measure("rv", "max", F.col("v"))])
    joined = a.alias("a").join(b.alias("b"), "key").groupBy("key").agg(F.count("*").alias("joined_rows"), F.sum("a.v").alias("joined_lv"), F.max("b.v").alias("rv"))
    assert rows(got.select("key", "joined_rows", "joined_lv", "rv")) == rows(joined)
    full = eager_join_aggregate(a, b, ["key"], how="full")
    assert rows(hot_keys(full, "key", {"l": "left_rows", "r": "right_rows"}, 0.5)) == [("l", "hot"), ("r", "hot")]
    assert eager_join_aggregate(a.limit(0), b, ["key"]).count() == 0
    with pytest.raises(ValueError):
        eager_join_aggregate(a, b, ["key"], [Measure("key", "sum", F.col("v"))])
    again = a.select("id", "key").union(a.select("id", "key"))
    assert once(again, "id", "key").count() == 300


INSTANTS = [
    ("2025-02-02T19:22:15.264-06:00", None, datetime(2025, 2, 3, 1, 22, 15, 264000)), ("2025-02-02T19:00:04,859-0800", None, datetime(2025, 2, 3, 3, 0, 4, 859000)), ("2025-02-03T01:31:06.575074Z", None, datetime(2025, 2, 3, 1, 31, 6, 575074)),
    ("20250203T010715Z", None, datetime(2025, 2, 3, 1, 7, 15)), ("1738544015", None, datetime(2025, 2, 3, 0, 53, 35)), ("1738546202606", None, datetime(2025, 2, 3, 1, 30, 2, 606000)),
    ("Mon, 03 Feb 2025 04:00:50 -0800", None, datetime(2025, 2, 3, 12, 0, 50)), ("02/03/2025 12:12:51 AM", "UTC", datetime(2025, 2, 3, 0, 12, 51)), ("02.03.2025 12:12:51", "UTC", datetime(2025, 3, 2, 12, 12, 51)),
    ("1-Jul-2025 10:46:46 CST", "America/Chicago", datetime(2025, 7, 1, 16, 46, 46)), ("2-Jun-2025 05:42:34 IST", "Asia/Kolkata", datetime(2025, 6, 2, 0, 12, 34)), ("2-Jun-2025 05:42:34 IST", None, None),
    ("2025-06-03T19:07:36.287 America/Chicago", None, datetime(2025, 6, 4, 0, 7, 36, 287000)), ("2025-06-03 10:00:00", "America/New_York", datetime(2025, 6, 3, 14)), ("2025-06-03 10:00:00", None, None),
    ("2025-03-09 02:54:07", "America/New_York", None), ("2025-11-02 01:30:00", "America/New_York", None), ("2025-11-02 01:30:00", "America/Phoenix", datetime(2025, 11, 2, 8, 30)), ("45691.5000000000", "UTC", datetime(2025, 2, 3, 12)),
    ("2025-02-30 08:15:00Z", None, None), ("2025-06-14T25:61:00Z", None, None), ("0000-00-00 00:00:00", "UTC", None), ("06:12:44", "UTC", None), ("pending", None, None), ("", None, None), ("  ", None, None), (None, None, None),
    ("2024-02-29T00:00:00Z", None, datetime(2024, 2, 29)), ("2025-06-03T10:00:00 Mars/Olympus", None, None), ("2025-06-03 10:00:00", "No/Zone", None), ("2025-06-03 10:00:00", "", None), ("2025/06/03 10:00:00", "Europe/Paris", datetime(2025, 6, 3, 8)), ("2025-06/03 10:00:00", "UTC", None), ("2025-06-03 10:00:00 A/B/C", "UTC", None), ("2025-06-03 10:00:00", " ", None), ("2025-06-03 10:00:00", "12:30", None), ("2025-06-03 10:00:00", "+05:30", datetime(2025, 6, 3, 4, 30)), ("2025-06-03 10:00:00", "Europe/Paris x", None), ("13/03/2025 01:00:00 PM", "UTC", None), ("x" * 100_000, None, None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(INSTANTS)], "i int, t string, z string")
    got = {r.i: r.us for r in with_instant(df, "t", "z", "us").where("us is not null or us is null").collect()}
    want = {i: None if w is None else round(w.replace(tzinfo=timezone.utc).timestamp() * 1e6) for i, (_, _, w) in enumerate(INSTANTS)}
    assert got == want
    assert with_instant(df.limit(0), "t", "z", "us").count() == 0


def brute_periods(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def test_coverage(spark):
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "a", "a", "b"]), s, s + rnd.choice([1, 5, 40, 300])) for s in (rnd.randint(0, 3000) for _ in range(250))]
    data += [("c", 10, 20), ("c", 20, 30), ("d", 5, None), (None, 1, 2), ("e", 9, 9), ("f", -250, 350), ("f", 400, 401)]
    df = spark.createDataFrame([*data, *data[:20]], "k string, s bigint, e bigint").withColumn("shard", F.lit("clash"))
    by = {}
    for k, s, e in data:
        if k is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    want = {k: brute_periods(v) for k, v in by.items()}
    got = coverage.periods(df, ["k"], F.col("s"), F.col("e"), shard_us=100)
    assert rows(got.select("k", "period_start", "period_end")) == sorted([(k, s, e) for k, v in want.items() for s, e in v], key=str)
    g = coverage.gaps(df, ["k"], F.col("s"), F.col("e"), shard_us=100)
    assert rows(g) == sorted([(k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:])], key=str)
    assert coverage.gaps(df.limit(0), ["k"], F.col("s"), F.col("e")).count() == 0
    assert coverage.periods(df.limit(0), ["k"], F.col("s"), F.col("e")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_coverage_of_long_intervals(spark, seed):
    """Intervals over many shards among short ones, at shard edges too: brute force."""
    rnd = random.Random(seed)
    data = []
    for _ in range(120):
        s = rnd.choice([rnd.randint(-400, 4000), rnd.randint(-4, 40) * 100])
        data.append((rnd.choice("aaab"), s, s + rnd.choice([1, 30, 100, 200, 250, rnd.randint(1, 900)])))
    df = spark.createDataFrame(data, "k string, s bigint, e bigint")
    want = {k: brute_periods([(s, e) for x, s, e in data if x == k]) for k in "ab"}
    got = coverage.periods(df, ["k"], F.col("s"), F.col("e"), shard_us=100)
    assert rows(got) == sorted([(k, s, e) for k, v in want.items() for s, e in v], key=str)
    got = coverage.gaps(df, ["k"], F.col("s"), F.col("e"), shard_us=100)
    assert rows(got) == sorted([(k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:])], key=str)


def test_keys_of_intervals_may_have_any_name(spark):
    df = spark.createDataFrame([("a", "b", 1, 5), ("a", "b", 7, 9), ("a", "b", 7, 9), (None, "b", 1, 2), ("a", None, 1, 2)], "s string, shard string, run bigint, e bigint")
    assert rows(coverage.gaps(df, ["s", "shard"], F.col("run"), F.col("e"))) == [("a", "b", 5, 7)]
    assert rows(coverage.periods(df, ["s", "shard"], F.col("run"), F.col("e"))) == [("a", "b", 1, 5), ("a", "b", 7, 9)]
    assert coverage.gaps(df, [], F.col("run"), F.col("e")).count() == 1 and coverage.periods(df, [], F.col("run"), F.col("e")).count() == 2
    with pytest.raises(ValueError):
        coverage.gaps(df.withColumnRenamed("s", "gap_end"), ["gap_end"], F.col("run"), F.col("e"))


def test_instants_beside_columns_of_their_names(spark):
    df = spark.createDataFrame([("2025-02-03 12:00:00Z", "UTC", "kept", 7)], "t string, z string, _us_c string, us int")
    assert [tuple(r) for r in with_instant(df.drop("us"), "t", "z", "at").collect()] == [("2025-02-03 12:00:00Z", "UTC", "kept", 1738584000000000)]
    assert with_instant(df.drop("_us_c"), "t", "z", "us").first().us == 1738584000000000


def test_centuries_are_two_rows(spark, tmp_path):
    day = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    spans = [("a", day(0), None, 3000 * 31_556_952.0), ("a", day(90), day(91), None), ("b", day(0), datetime(9999, 12, 31), None), ("b", day(400), day(401), 5.0), ("c", day(0), None, float("inf"))]
    spans += [("c", day(9), None, -1e300), ("d", day(0), None, 1e300), ("e", day(0), day(1), None), ("e", day(5), day(90), None), ("e", day(40), day(41), float("nan"))]
    df = spark.createDataFrame([(i, "S", f"Store 1{ord(k):04d}", s, e, d) for i, (k, s, e, d) in enumerate(spans)], "span_id bigint, server string, store_id string, store_last_disconnect timestamp, reconnect_at timestamp, store_duration_s double")
    df.write.parquet(str(tmp_path / "outage_spans.parquet"))
    assert [(r.gap_end_s - r.gap_start_s) for r in problems.p3_found(spark, str(tmp_path)).collect()] == [4 * 86_400]
    assert problems.p3_periods(spark, str(tmp_path)).count() == 6
    assert coverage._clipped(df, ["store_id"], F.unix_micros("store_last_disconnect"), F.unix_micros("reconnect_at"), coverage.WEEK_US).count() <= 2 * len(spans)


def test_compaction(spark):
    files = [(1, "a\r\nb\n"), (2, "﻿a\nb"), (3, "b\na"), (4, None), (5, ""), (6, " \n\t\n"), (7, "a\n\n\nb\r\n"), (7, "a\n\n\nb\r\n"), (8, "ab"), (None, "a\nb")]
    df = spark.createDataFrame(files, "file_id bigint, content string").withColumn("records", F.lit(1))
    done = compact(df, "file_id", "content")
    assert rows(done.records.select("file_id", "record")) == [(1, "a"), (1, "b"), (3, "a"), (3, "b"), (8, "ab")]
    assert rows(copy_pairs(done.members)) == [(1, 2), (1, 7), (2, 7)]
    assert rows(copy_pairs(done.members, pairs_up_to=2)) == [(1, 2), (1, 7)]
    assert compact(df.limit(0), "file_id", "content").records.count() == 0


def test_nothing_is_committed_on_a_wrong_checksum(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a\nb")], "file_id bigint, content string")
    monkeypatch.setattr(compaction, "multiset_checksum", lambda _: ("1", "0", "0", "0"))
    with pytest.raises(compaction.ChecksumError):
        compact(df, "file_id", "content", f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_nothing_is_committed_onto_another_table(spark, tmp_path):
    a, b = (spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id bigint, content string") for texts in (["a", "b"], ["c\nd", "e"]))
    path = f"file://{tmp_path}/out"
    done = compact(a, "file_id", "content", path)
    with pytest.raises(FileExistsError):
        compact(b, "file_id", "content", path)
    assert rows(done.records.select("record")) == [("a",), ("b",)]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out"] and sorted(x.name for x in (tmp_path / "out").iterdir()) == ["members", "records"]
    (tmp_path / "late.staging").mkdir()
    (tmp_path / "late.staging" / "x").write_text("x")
    (tmp_path / "late").mkdir()
    with pytest.raises(FileExistsError):
        session.move(spark, f"file://{tmp_path}/late.staging", f"file://{tmp_path}/late")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    own = compact(b, "file_id", "content", target_bytes=1 << 20)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert session.exists(spark, own.path) and own.records.count() == 3
    session.clear_written(spark)
    assert not session.exists(spark, own.path)


def test_a_writer_that_comes_between_is_seen(spark, tmp_path, monkeypatch):
    """A rename onto a directory that appeared meanwhile puts the source inside of it; that isn't a commit."""
    source, target = tmp_path / "new.staging-1", tmp_path / "new"
    for at in (source, target):
        at.mkdir()
    (source / "records").write_text("mine")
    (target / "records").write_text("another's")
    found, at = session._hadoop(spark, f"file://{source}")

    class Blind:
        def exists(self, _):
            return False

        def rename(self, a, b):
            source.rename(target / source.name)
            return True

        def __getattr__(self, name):
            return getattr(found, name)

    plain = session._hadoop
    monkeypatch.setattr(session, "_hadoop", lambda s, p: (Blind() if p.endswith("staging-1") else plain(s, p)[0], plain(s, p)[1]))
    with pytest.raises(FileExistsError):
        session.move(spark, f"file://{source}", f"file://{target}")
    assert (target / "records").read_text() == "another's" and not (target / source.name).exists()


def test_a_cluster_names_the_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_checksum_tells_multisets_apart(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "i int, t string")
    assert compaction.multiset_checksum(a) == compaction.multiset_checksum(a.repartition(3).orderBy("t"))
    for other in ([(1, "a"), (2, "b")], [(1, "a"), (2, "b"), (2, "b")], [(1, "b"), (1, "a"), (2, "a")], []):
        assert compaction.multiset_checksum(a) != compaction.multiset_checksum(spark.createDataFrame(other, "i int, t string"))


def test_entries(spark):
    log = [
        "* Log date 2025-10-03", "* x Zone=America/Phoenix", "loose line", "2025-10-03T20:00:11.1-07:00 Core (Error) lost", "  (was serving Store_2291)", "", "* mark", "Store 9999 after mark",
        '{"time": 1743450246708, "level": "CRITICAL", "component": "Sync", "message": "Store 11111 timed out"}', "{", '  "storeId": "x",', "}", "   ", "<11>Oct  3 20:12:32 box-7 hub[123]: link 5 error (Store 22222)", "10:00:00,123 | WARN  | f.c.X | Store 33333 slow",
        "[03/Oct/2025:20:09:39 -0700] [relayd] [F] bye [Store 44444]\r", "2025-11-18 maintenance window (Error) still listed", 'ts=2025-11-18T07:06:33Z lvl=info comp=a store=Store_55555 msg="ok"', None,
    ]
    df = spark.createDataFrame([("MS1", "f/Federation_2025-10-04_1.log", i, x) for i, x in enumerate(log, 1)] * 2, "server string, file string, line_no bigint, line string").withColumn("store_id", F.lit("clash"))
    got = {r.first_line: r for r in entries(df).collect()}
    assert {k: (r.last_line, r.level, r.store_id, r.component) for k, r in got.items()} == {
        4: (5, "error", "02291", "Core"), 9: (12, "fatal", "11111", "Sync"), 14: (14, "error", "22222", "hub"), 15: (15, "warning", "33333", "f.c.X"), 16: (17, "fatal", "44444", "relayd"), 18: (18, "info", "55555", "a")
    }
    assert got[9].error_category == "connection_timeout" and got[9].message == "Store 11111 timed out"
    assert got[15].instant_us == round(datetime(2025, 10, 3, 17, 0, 0, 123000, timezone.utc).timestamp() * 1e6)
    assert got[14].instant_us == round(datetime(2025, 10, 4, 3, 12, 32, tzinfo=timezone.utc).timestamp() * 1e6)
    assert entries(df.limit(0)).count() == 0


HEADS = {
    "2024/01/04 21:06:39 ERROR Store 10001 down": (2024, 1, 4, 21, 6, 39), "01/04/2024 09:06:40 PM ERROR Store 10002 down": (2024, 1, 4, 21, 6, 40), "04.01.2024 21:06:41 ERROR Store 10003 down": (2024, 1, 4, 21, 6, 41),
    "1704402402 ERROR Store 10004 down": (2024, 1, 4, 21, 6, 42), "[2024/01/04 21:06:43.5] [ERROR] Store 10005 down": (2024, 1, 4, 21, 6, 43), "04-Jan-2024 21:06:44 core (Error) Store 10006 down": (2024, 1, 4, 21, 6, 44),
    "2024-01-04 21:06:45 UTC ERROR Store 10007 down": (2024, 1, 4, 21, 6, 45), "1/4/2024, 21:06:46 FATAL Store 10008 down": (2024, 1, 4, 21, 6, 46), "2024-01-04 23:06:47,250 +0200 core ERROR Store 10009 down": (2024, 1, 4, 21, 6, 47),
}
NO_HEADS = ["2024/01/04 maintenance ERROR Store 10011 down", "01/04/2024 ERROR Store 10012", "17044024021234567890 ERROR x", "at 2024/01/04 21:06:39 ERROR Store 10013", "2024/01/04 21:06:39 no level here", "1704402402:5 ERROR x"]


def test_forms_of_heads(spark):
    """Every form of an instant with a time of day begins an entry; a date alone, or an instant further on, doesn't."""
    lines = ["above all", *HEADS, *NO_HEADS, "* mark", "behind the mark", " ", "and this"]
    df = spark.createDataFrame([("MS1", "f/Federation_1.log", i, x) for i, x in enumerate(lines, 1)] + [("MS1", "g.log", 1, "* Zone=UTC"), ("MS1", "f/Federation_1.log", 90, "* Zone=UTC")], "server string, file string, line_no bigint, line string")
    df = df.withColumn("line", F.when((F.col("file") != "g.log") & (F.col("line_no") == 1), "* Zone=UTC").otherwise(F.col("line"))).unionByName(spark.createDataFrame([("MS1", "f/Federation_1.log", 0, "above all")], "server string, file string, line_no bigint, line string"))
    got = sorted(entries(df).collect(), key=lambda r: r.first_line)
    assert [r.first_line for r in got] == list(range(2, 2 + len(HEADS)))
    assert got[-1].last_line == 1 + len(HEADS) + len(NO_HEADS)
    assert [r.level for r in got] == ["error"] * 7 + ["fatal", "error"] and [r.store_id for r in got] == [f"1000{i}" for i in range(1, 10)]
    assert [datetime.fromtimestamp(r.instant_us // 1_000_000, timezone.utc).timetuple()[:6] for r in got] == list(HEADS.values())
    assert [tuple(r) for r in log_entries.unowned(df).collect()] == [("f/Federation_1.log", 3, 0, len(lines))]


def test_a_leaf_of_lines_that_are_all_different(spark):
    """100,000 masked lines of free text in one leaf: all are heads, and no task merges more than LEAF of them."""
    word = lambda k: F.translate(F.left(F.md5(F.concat(F.col("id").cast("string"), F.lit(k))), F.lit(6)), "0123456789", "ghijklmnop")
    masked = F.concat_ws(" ", F.lit("<T> core (<L>)"), *[word(k) for k in "abcd"])
    df = spark.range(100_000).select(masked.alias("masked")).select("*", F.xxhash64("masked").alias("low"), F.xxhash64(F.lit(7), "masked").alias("high"))
    found = log_entries.template_map(df).select("at_time", "at_level", "at_component", "at_message")
    assert [(*r[:4], r["count"]) for r in found.groupBy(*found.columns).count().collect()] == [(0, 2, 1, 3, 100_000)]


def test_merging_of_templates():
    lines = [x.split(" ") for x in ("<T> a (<L>) one two three", "<T> a (<L>) one two four", "<T> b (<L>) six seven eight", "<T> a <L> one two three", "<T> a (<L>) x: two three", "<T> a (<L>) y z w")]
    got = [" ".join(x) for x in log_entries.merge_leaf(lines)]
    merged = "<T> a (<L>) <*> <*> <*>"  # marks elsewhere or less than half of the tokens alike: another template
    assert got == [merged, merged, "<T> b (<L>) six seven eight", "<T> a <L> one two three", "<T> a (<L>) x: two three", merged]
    keyed = [x.split(" ") for x in ('ts=<T> lvl=<L> comp=a msg="b c d"', "ts=<T> lvl=<L> comp=a store=<*> msg=\"b c\"", "<T> | <L> | f.c two words", "<T> | <L>  | f.c words")]
    assert [log_entries.head_of(t) for t in log_entries.merge_leaf(keyed[:2])] == [(0, 1, 2, 3), (0, 1, 2, 4)]
    assert [log_entries.head_of(t) for t in log_entries.merge_leaf(keyed[2:])] == [(0, 2, 4, 5), (0, 2, 5, 6)]
    assert log_entries.merge_leaf([]) == []


def _brute_instant(text, zone):
    """By the standard library: None for no or no single instant. Only the forms of the test tables."""
    own = {"PST": -8, "PDT": -7, "MST": -7, "CST": -6, "CDT": -5, "EST": -5, "EDT": -4, "GMT": 0, "UTC": 0, "CET": 1, "CEST": 2, "BST": 1, "IST": 5.5}
    text = (text or "").strip()

    def local(naive, name):
        if name is None:
            return None
        both = {naive.replace(tzinfo=ZoneInfo(name), fold=f).astimezone(timezone.utc) for f in (0, 1)}
        fits = {x for x in both if x.astimezone(ZoneInfo(name)).replace(tzinfo=None) == naive}
        return fits.pop() if len(fits) == 1 else None

    if re.fullmatch(r"\d{10}|\d{13}", text):
        return datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=int(text) * (1000 if len(text) == 10 else 1))
    if re.fullmatch(r"\d{5}\.\d+", text):
        return local(datetime(1899, 12, 30) + timedelta(milliseconds=round(float(text) * 86_400_000)), zone)
    for form in ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S,%f%z", "%Y%m%dT%H%M%S%z", "%a, %d %b %Y %H:%M:%S %z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S%z"):
        try:
            return datetime.strptime(text, form).astimezone(timezone.utc)
        except ValueError:
            pass
    head, _, tail = text.rpartition(" ")
    for t, form in ((head, "%Y-%m-%dT%H:%M:%S.%f"), (head, "%d-%b-%Y %H:%M:%S"), (text, "%Y-%m-%d %H:%M:%S"), (text, "%m/%d/%Y %I:%M:%S %p"), (text, "%d.%m.%Y %H:%M:%S")):
        try:
            naive = datetime.strptime(t, form)
        except ValueError:
            continue
        if t is text:
            return local(naive, zone)
        return (naive - timedelta(hours=own[tail])).replace(tzinfo=timezone.utc) if tail in own else local(naive, tail)
    return None


@pytest.mark.parametrize(("name", "column", "key"), [("conn_events", "timestamp_raw", "event_id"), ("health_events", "event_timestamp", "health_id")])
def test_instants_of_a_table(spark, name, column, key):
    folder = "/root/testdata/sf0.001"
    zones = {r.machine: r.tz_name for r in spark.read.parquet(f"{folder}/machines.parquet").collect()}
    find = problems.conn_instants if name == "conn_events" else problems.health_instants
    for r in find(spark, folder).collect():
        want = _brute_instant(r[column], zones.get(r.machine))
        got = None if r.instant_us is None else datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=r.instant_us)
        assert got == want, (r[column], r.machine)
