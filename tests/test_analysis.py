"""The battery on lines and on health rows."""

from tidewatch import analysis
from tidewatch.session import clear_written, written


def test_battery_on_lines(spark):
    lines, number = [], 0
    for store in range(30):
        for k in range(6):
            at = f"2024-01-{1 + k:02d}T{store % 24:02d}:{k:02d}"
            lines += [f"{at}:00.000-08:00 Federation (Error) Store {10000 + store} logged off from federated proxy 10.0.0.{store}:55", f"{at}:40.000-08:00 Federation (Info) Store {10000 + store} logon accepted"]
    lines = ["* SBUXSCRoleGroup7 MachineName=HOST1", *lines, lines[0], "noise", ""]
    df = spark.createDataFrame([("MS1", "f", i, x) for i, x in enumerate(lines, 1)], "server string, file string, line_no bigint, line string")
    inc = analysis.incidents_from_lines(df)
    assert inc.count() == 360 and {(r.fed_group, r.machine) for r in inc.collect()} == {("SBUXSCRoleGroup7", "HOST1")}
    found = analysis.analyze(inc)
    got = {k: v.count() for k, v in found.items()}
    assert got["stores"] == 30 and got["outages"] == 180 and got["servers"] == 2 and got["forecast"] == 24
    assert analysis.page(found["stores"], 2, 20).count() == 10
    assert analysis.page(found["stores"], store="10005").first().longest_s == 40
    assert analysis.anomalies(inc).count() == 30
    assert analysis.incidents_from_lines(df.limit(0)).count() == 0


def test_health(spark):
    rows = [("Store 2291 (vNVR)", "2025-02-03 10:00:00", "Connection failed", "M"), ("Directory", "2025-02-03 10:00:00", "Connection failed", "M"), ("Store 2291", None, "Connection failed", None), ("Store 2291", "2025-02-03 10:00:00", "Clock skew", "M")]
    df = spark.createDataFrame(rows, "source_entity string, event_timestamp string, health_event string, machine string")
    got = analysis.incidents_from_health(df).collect()
    assert [(r.store_id, str(r.ts)) for r in got] == [("02291", "2025-02-03 10:00:00")]


def test_written_tables_are_cleared(spark):
    t = written(spark.range(5).toDF("n"), "t")
    assert t.count() == 5 and clear_written(spark) >= 1 and clear_written(spark) == 0
