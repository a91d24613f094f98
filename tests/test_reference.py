"""Reference operators: hand-checked fixtures, sources, streaming, and the queries against SQL on a small scale."""

import io
import random
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.functions.classify import error_category, reasons, severity
from tidewatch.operators import greedy, learning, outages, parse, series, together
from tidewatch.operators.sticky import carry_forward, sliced_lag
from tidewatch.sources import logs
from tidewatch.sources.logs import extract, lines_of, newest, read_health, read_logs, sheet_rows
from tidewatch.sources.profile import memory_gb, profile_folder
from tidewatch.sources.sinks import as_json, bars, report
from tidewatch.streaming import incidents as streaming

DATA = Path("/root/testdata/sf0.001")


def test_sliced_orders_equal_plain_windows(spark):
    rnd = random.Random(8)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b"]), rnd.randint(0, 400), i, rnd.choice(["x", "y", None])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, at bigint, id bigint, v string")
    w = Window.partitionBy("k").orderBy("at", "id")
    plain = df.withColumn("va", F.lag("v").over(w)).withColumn("vb", F.lag("at").over(w))
    assert sorted(map(str, sliced_lag(df, ["k"], "at", "id", {"va": "v", "vb": "at"}, 7).collect())) == sorted(map(str, plain.collect()))
    every = df.withColumn("vb", F.lag("at").over(Window.partitionBy().orderBy("at", "id")))
    assert sorted(map(str, sliced_lag(df, [], "at", "id", {"vb": "at"}, 7).collect())) == sorted(map(str, every.collect()))
    last = df.select("k", "at", "id", F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("v"))
    got = carry_forward(df, "k", "id", ["v"], block=11).select("k", "at", "id", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, last.collect()))
    assert sliced_lag(df.limit(0), ["k"], "at", "id", {"vb": "at"}, 7).count() == 0 and carry_forward(df.limit(0), "k", "id", ["v"]).count() == 0


def plain_scan(rows, width, qualifies):
    """Windows of sorted (time, store) rows, one after the other: start, end, rows, stores."""
    out, i = [], 0
    while i < len(rows):
        j = next((k for k in range(i, len(rows)) if rows[k][0] > rows[i][0] + width), len(rows))
        if qualifies(rows[i:j]):
            out.append((rows[i][0], rows[j - 1][0], j - i, len({s for _, s in rows[i:j]})))
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize(("seed", "step"), [(1, 3), (2, 9), (3, 40), (4, 1)])
def test_greedy_windows_equal_the_plain_scan(spark, monkeypatch, seed, step):
    """Unbroken sessions over many blocks, ties, negative times: the same windows as from one scan over all rows."""
    monkeypatch.setattr(greedy, "BLOCK", 2)
    rnd = random.Random(seed)
    times = [-3_000]
    while len(times) < 900:
        times.append(times[-1] + rnd.choice([0, 0, 1, step, 2 * step]))
    data = sorted((t, rnd.choice("aaaabcdefg")) for t in times)
    df = spark.createDataFrame([(i, s, "m", "x", t) for i, (t, s) in enumerate(data)], "event_id bigint, store_id string, machine string, category string, sec bigint").repartition(5)
    got = sorted((r.start, r.end, r.events, r.stores) for r in greedy.cascades(df, "sec", 20, 4).collect())
    assert got == plain_scan(data, 20, lambda w: len({s for _, s in w}) >= 4)
    got = sorted((r.store_id, r.start, r.end, r["count"]) for r in greedy.bursts(df, "store_id", "sec", 20, 3).collect())
    assert got == sorted((k, *x[:3]) for k in "abcdefg" for x in plain_scan([r for r in data if r[1] == k], 20, lambda w: len(w) >= 3))
    assert greedy.cascades(df.limit(0), "sec", 20, 4).count() == greedy.bursts(df.limit(0), "store_id", "sec", 20, 3).count() == 0


def test_an_unbroken_session_is_many_tasks_work(spark, monkeypatch):
    """No run of rows that a task takes at once has more than a block's share, though no pause cuts the rows."""
    sizes = []
    plain = greedy._candidates
    monkeypatch.setattr(greedy, "_candidates", lambda t, *rest: (sizes.append(len(t)), plain(t, *rest))[1])
    pdf = [{"_block": b, "k": "hot", "sec": t} for b in range(50) for t in range(b * 320, b * 320 + 340, 2)]
    import pandas as pd

    runs = list(greedy._runs(iter([pd.DataFrame(pdf[a : a + 1_000]) for a in range(0, len(pdf), 1_000)]), ["k", "_block"]))
    assert len(runs) == 50 and {len(r["sec"]) for r in runs} == {170}
    for r in runs:
        greedy._candidates(r["sec"], 160, int(r["_block"][0]) * 320, 20, lambda ends: ends - range(160) >= 5)
    assert max(sizes) == 170


def test_missing_values_in_cascades(spark):
    rows = [(i, s, m, c, 10 * i) for i, (s, m, c) in enumerate([("a", None, None), (None, None, "x"), ("b", None, "x"), ("c", "m", None)])] + [(9, "d", "m", "x", None)]
    df = spark.createDataFrame(rows, "event_id bigint, store_id string, machine string, category string, sec bigint").withColumn("start", F.lit("clash"))
    assert [(r.start, r.end, r.stores, r.machines, r.dominant) for r in greedy.cascades(df, "sec", 100, 3).collect()] == [(0, 30, 4, 2, "None")]


def test_outage_pairs(spark):
    marks = [(0, "disconnect"), (10, "disconnect"), (40, "reconnect"), (50, "reconnect"), (60, "disconnect"), (60, "reconnect"), (100, "disconnect")]
    df = spark.createDataFrame([("a", t, i, k) for i, (t, k) in enumerate(marks)] + [("b", 0, 0, "disconnect"), ("b", 604800, 1, "reconnect")], "store_id string, sec bigint, event_id bigint, kind string")
    assert [tuple(r) for r in outages.pairs(df).collect()] == [("a", 10, 40, 30)]


def test_bursts_and_cascades(spark):
    df = spark.createDataFrame([("a", m * 60) for m in (0, 1, 2, 3, 10, 11)], "store_id string, sec bigint")
    assert [tuple(r) for r in greedy.bursts(df, "store_id", "sec", 600, 5).collect()] == [("a", 0, 600, 5)]
    c = spark.createDataFrame([(i, s, "m", "x", t) for i, (t, s) in enumerate([(0, "a"), (30, "b"), (60, "c"), (61, "d"), (62, "e")])], "event_id bigint, store_id string, machine string, category string, sec bigint")
    got = greedy.cascades(c, "sec", 60, 3).collect()
    assert [(r.start, r.end, r.stores) for r in got] == [(0, 60, 3)]
    pairs = spark.createDataFrame([("a", 0), ("a", 10), ("b", 3)], "k string, m bigint")
    assert [tuple(r) for r in together.co_failures(pairs, "k", "m").collect()] == [("a", "b", 1, 1.0)]


def test_series_edges(spark):
    flat = spark.createDataFrame([(i, i, 6.0) for i in range(10)], "idx bigint, hour bigint, x double")
    assert series.change_points(flat).count() == 0
    assert {(round(r.value, 6), r.low, r.high) for r in series.forecast(flat).collect()} == {(6.0, 3.0, 9.0)}
    assert series.outliers(flat.limit(0)).count() == 0


LINES = [
    "2024-01-04T21:06:38.339-08:00 Federation (Info) Store 51389 (vNVR) connected successfully", "2024-01-04T21:07:15.123-08:00 Federation (Error) Store 05139 connection attempt failed: timed out",
    "2024-01-04T21:08:22.456-08:00 Federation (Warning) Store_12345 TlsConnectionException: error completing the handshake", "Invalid line without timestamp", "2024-13-01T00:00:00.000-08:00 Store 123",
]


def test_parsing(spark):
    raw = parse.raw_lines(spark.createDataFrame([("s", "f", i, x) for i, x in enumerate(LINES)], "server string, file string, line_no bigint, line string"))
    got = {r.line_no: r for r in parse.parsed(raw).collect()}
    assert [got[i].category for i in range(5)] == [None, "connection_timeout", "tls_handshake_error", None, None]
    assert [got[i].store_id for i in range(5)] == ["51389", "05139", "12345", None, None]
    assert [got[i].severity for i in range(5)] == [None, "error", "warning", None, None]
    assert got[3].ts is None and got[4].ts is None and str(got[0].ts) == "2024-01-04 21:06:38"
    one = spark.createDataFrame([("No route to host",)], "t string")
    assert one.select(error_category(F.col("t")), severity(F.col("t")), F.size(reasons(F.col("t")))).first()[:] == ("host_unreachable", None, 0)


def _zip(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in names.items():
            z.writestr(k, v)
    return out.getvalue()


def test_log_files(spark, tmp_path):
    inner = _zip({"deep/Federation_b.log": "x\ny", "skip.txt": "no"})
    (tmp_path / "MS10001").mkdir()
    (tmp_path / "MS10001/a.zip").write_bytes(_zip({"in.zip": inner, "__MACOSX/Federation_z.log": "no"}))
    (tmp_path / "MS10001/Federation_a.log").write_bytes("﻿one\r\ntwo\r\n".encode())
    (tmp_path / "MS10001/broken.zip").write_bytes(b"nothing")
    got = {(r.server, r.line_no, r.line) for r in read_logs(spark, str(tmp_path)).collect()}
    assert got == {("MS10001", 1, "one"), ("MS10001", 2, "two"), ("MS10001", 1, "x"), ("MS10001", 2, "y")}
    assert list(lines_of(io.BytesIO(b"\xff\n"))) == [["�"]] and list(lines_of(io.BytesIO(b""))) == []
    (tmp_path / "other.log").write_bytes(b"z")
    assert read_logs(spark, str(tmp_path)).count() == 4 and read_logs(spark, str(tmp_path), only_named=False).count() == 5
    found = {r.server: r.asDict() for r in profile_folder(spark, str(tmp_path)).collect()}
    one = found["MS10001"]
    assert (one["total_files"], one["log_files"], one["zip_files"], one["nested_zip_files"], one["named_files"]) == (3, 1, 2, 1, 1)
    assert one["unpacked_bytes"] == len("﻿one\r\ntwo\r\n".encode()) + len(inner) + 2 + 7 * len(b"nothing") and found["Unknown"]["log_files"] == 1
    assert memory_gb(spark) > 0 and {r.path.rsplit("/", 1)[1] for r in newest(spark, str(tmp_path)).collect()} == {"a.zip", "broken.zip", "Federation_a.log", "other.log"}
    extract(spark, str(tmp_path), str(tmp_path / "out.parquet"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).where("server = 'MS10001'").count() == 4
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4.5</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Machine</t></si></sst>'
    assert sheet_rows(_zip({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared})) == [["Machine", None, "4.5"]]


def test_numbers_of_lines_over_blocks(spark, tmp_path):
    """A plain file is split into blocks that several tasks read; its lines keep their numbers, blank ones and a last without end too."""
    lines = [f"line {i} " + "x" * (i % 40) if i % 17 else "" for i in range(1, 3_000)] + ["last"]
    (tmp_path / "Federation_a.log").write_text("\n".join(lines))
    (tmp_path / "Federation_b.log").write_bytes(b"\xef\xbb\xbfone\r\n\xff\r\n\r\n")
    (tmp_path / "Federation_c.log").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = read_logs(spark, str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
        assert df.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["Federation_a.log"] == dict(enumerate(lines, 1))
    assert got["Federation_b.log"] == {1: "one", 2: "�", 3: ""} and "Federation_c.log" not in got


def test_large_archives_are_opened_in_place(spark, tmp_path, monkeypatch):
    (tmp_path / "MS7").mkdir()
    (tmp_path / "MS7/a.zip").write_bytes(_zip({"Federation_x.log": "a\nb", "y.zip": _zip({"Federation_z.log": "c"})}))
    monkeypatch.setattr(logs, "IN_MEMORY", 10)
    monkeypatch.setattr(logs, "LINES_AT_ONCE", 1)
    got = {(r.server, r.file, r.line_no, r.line) for r in read_logs(spark, str(tmp_path)).collect()}
    assert got == {("MS7", "Federation_x.log", 1, "a"), ("MS7", "Federation_x.log", 2, "b"), ("MS7", "Federation_z.log", 1, "c")}


def test_health_sheets(spark, tmp_path):
    """The first sheet of a workbook, columns in any order and cells left out, and the same as CSV."""
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'
    head = "".join(cell(f"{c}1", x) for c, x in zip("ABCDE", ["Health event", "Source entity", "Extra", "Event timestamp", "Machine"]))
    body = cell("A2", "Connection failed") + cell("B2", "Store 2291 (vNVR)") + '<c r="D2"><v>45691.5</v></c>' + cell("E2", "M1")
    last = cell("B3", "Directory")
    sheet = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{head}</row><row>{body}</row><row>{last}</row></sheetData></worksheet>'
    (tmp_path / "a.xlsx").write_bytes(_zip({"xl/worksheets/sheet1.xml": sheet}))
    (tmp_path / "b.csv").write_text("Source entity,Event timestamp,Health event,Machine\nStore 77,2025-02-03 10:00:00,Clock skew,\n")
    got = sorted(map(tuple, read_health(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("Store 2291 (vNVR)", "45691.5", "Connection failed", "M1"), ("Directory", None, None, None), ("Store 77", "2025-02-03 10:00:00", "Clock skew", None)], key=str)


def test_recurring_patterns_and_importance(spark):
    values = [float(10 * (h % 24 > 12) + (h // 24 % 2) * 3 * (h % 24)) for h in range(240)]
    s = spark.createDataFrame([(i, i, x) for i, x in enumerate(values)], "idx bigint, hour bigint, x double")
    found = learning.recurring_patterns(series.windows(s), 5).collect()
    assert sum(r.windows for r in found) == 240 - 24 and len(found) == 5
    rows = [(i % 7, float(i % 5), int(i % 5 > 2)) for i in range(200)]
    got = {r.feature: r.importance for r in learning.importance(spark.createDataFrame(rows, "a int, b double, label int"), ["a", "b"], "label").collect()}
    assert got["b"] > 0.9 and abs(sum(got.values()) - 1) < 1e-9


def test_sinks(spark):
    df = spark.createDataFrame([("a", 4), ("b", 2)], "k string, n int")
    assert [r.bar for r in bars(df, "n", 4, "#").orderBy("k").collect()] == ["####", "##"]
    assert as_json(df).first().json == '{"k":"a","n":4}'
    assert report(df, "T").splitlines()[2].split() == ["k", "n"]


def test_streaming(spark, tmp_path):
    day = "2024-01-04T21:{:02d}:00.000-08:00 Federation (Error) Store 51389 {}"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("\n".join([day.format(1, "logged off"), day.format(9, "logon"), day.format(9, "logon"), "x"]))
    (tmp_path / "in/2.txt").write_text("2024-01-06T21:00:00.000-08:00 Federation (Error) Store 51389 logged off\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    query = streaming.outages(streaming.parsed_lines(stream)).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.store_id, r.duration) for r in spark.table("closed").collect()] == [("51389", 480)]
    query = streaming.hourly(streaming.once(streaming.parsed_lines(stream))).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(r.n for r in spark.table("hours").collect()) >= 2


def test_bursts_of_a_stream(spark, tmp_path):
    """The same bursts as in batch once the watermark has passed them, also of lines that arrive out of order."""
    line = "2024-01-04T{:02d}:{:02d}:00.000-08:00 Federation (Error) Store {} logged off"
    times = {"10001": [0, 1, 2, 3, 10, 11, 30, 31, 32, 33, 34, 50], "10002": [5, 6, 7, 8]}
    rows = [(store, m) for store, minutes in times.items() for m in minutes]
    (tmp_path / "in").mkdir()
    for n, part in enumerate((rows[::2], rows[1::2]), 1):
        (tmp_path / f"in/{n}.txt").write_text("\n".join(line.format(21, m, store) for store, m in part))
    for n in (3, 4):
        (tmp_path / f"in/{n}.txt").write_text(line.format(20 + n, 59, "10003"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    found = streaming.bursts(streaming.parsed_lines(stream))
    query = found.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(((r.store_id, (r.end - r.start) // 60, r["count"]) for r in spark.table("bursts").collect()))
    assert got == [("10001", 4, 5), ("10001", 10, 5)]


FAST = ["p1_found", "p2_found", "p2_instants", "p3_found", "p5_found", "p4_found", "top_stores_excl_max", "sticky_context", "reason_totals", "outage_stats_store", "cusum_scores", "forecast24", "cascades", "bursts", "cofailure_pairs", "dbscan_noise", "feature_corr", "machine_health"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, str(DATA))
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    text = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    assert sorted(cols) == sorted(df.columns)
    assert sorted([text(r[c]) for c in cols] for r in df.collect()) == sorted([text(v) for v in r] for r in cur.fetchall())
