"""Requests over results, results kept and loaded, the logger, and the batteries."""

import io
import json
import logging

import pytest
from pyspark.sql import functions as F

from tidewatch import analysis, log, serving


def _incidents(spark):
    lines = []
    for store in range(24):
        for k in range(6):
            at = f"2024-01-{1 + k:02d}T{store:02d}:{k:02d}"
            lines += [
                f"{at}:00.000-08:00 Federation (Error) Store {10000 + store} connection attempt failed: timed out federated proxy 10.0.0.{store}:55",
                f"{at}:40.000-08:00 Federation (Info) Store {10000 + store} logon accepted",
            ]
    lines = ["* SBUXSCRoleGroup7 MachineName=HOST1", *lines]
    df = spark.createDataFrame([(f"MS{1 + i // 2 % 2}", f"f{i // 2 % 2}", i, x) for i, x in enumerate(lines, 1)], "server string, file string, line_no bigint, line string")
    return analysis.incidents_from_lines(df)


def test_service(spark, tmp_path):
    found = analysis.analyze(_incidents(spark))
    kept = {k: found[k] for k in ("stores", "servers", "fed_groups", "forecast", "machine_health", "root_causes", "store_categories")}
    recs = spark.createDataFrame([(1, 2, "a", 0.5), (2, 1, "b", 0.4), (3, 1, "c", 0.9), (4, 1, "d", None)], "rec_id bigint, priority int, target string, confidence double")
    votes = spark.createDataFrame([("10001", 2, -1), ("10002", 3, -1), ("10003", 0, 1)], "store_id string, votes int, label int")
    serving.save(kept | {"recommendations": recs, "anomalies": votes}, str(tmp_path / "r"))
    again = serving.load(spark, str(tmp_path / "r"))
    assert set(again) == {*kept, "recommendations", "anomalies"}
    s = serving.Service(again)
    first = json.loads(s.call("stores", page_number=2, size=20))
    assert (len(first["data"]), first["total"], first["pages"]) == (20, 48, 3) and {r["disconnects"] for r in first["data"]} == {3}
    down = json.loads(s.call("stores", size=3, by="store_id", ascending=True, least=1, server="MS2"))
    assert {r["server"] for r in down["data"]} == {"MS2"} and [r["store_id"] for r in down["data"]] == sorted(r["store_id"] for r in down["data"])
    assert s.stores(store="1000")["total"] == 20 and s.stores(store="10005", server="MS1")["total"] == 1 and s.stores(store="nope")["pages"] == 0
    groups = {r["fed_group"] for r in s.fed_groups()}
    assert sum(s.stores(fed_group=g)["total"] for g in groups) == 48 and s.stores(fed_group="other")["total"] == 0
    assert s.summary()["stores"] == 24 and s.summary()["disconnects"] == 144
    assert {r["server"] for r in s.servers()} == {"MS1", "MS2", None} and len(s.forecast()) == 24
    assert [r["target"] for r in s.recommendations()] == ["c", "b", "d", "a"] and [r["rec_id"] for r in s.recommendations(priority=2)] == [1]
    assert [r["store_id"] for r in s.anomalous_stores()] == ["10002", "10001"] and len(s.anomalous_stores(limit=1)) == 1
    details = s.store_details("10001")
    assert {r["category"]: r["n"] for r in details["store_categories"]}["connection_timeout"] == 6 and s.store_details("1") == {}
    assert {r["machine"] for r in s.machine_health()} <= {"HOST1"}
    with pytest.raises(KeyError):
        s.call("drop")
    empty = serving.Service({})
    assert all(json.loads(empty.call(name)) is not None for name in empty.requests if name != "store_details")
    with pytest.raises(ValueError):
        serving.rows_of(spark.range(serving.MOST_ROWS + 1))
    text = analysis.report({k: again[k] for k in ("servers", "root_causes")}, 5)
    assert "Root causes" in text and "network_issue" in text


def test_logger():
    out = io.StringIO()
    logger = log.configure("INFO", stream=out)
    log.get_logger("part").info("said %d", 3)
    log.get_logger().debug("not said")
    assert out.getvalue() == "said 3\n"
    out = io.StringIO()
    log.configure(logging.DEBUG, structured=True, stream=out)
    try:
        raise RuntimeError("broken")
    except RuntimeError:
        log.get_logger("part").exception("went wrong")
    got = json.loads(out.getvalue())
    assert (got["level"], got["logger"], got["message"]) == ("ERROR", "tidewatch.part", "went wrong") and "broken" in got["exception"]
    assert len(logger.handlers) == 1


def test_batteries(spark):
    inc = _incidents(spark)
    learnt = analysis.learn(inc)
    assert learnt["anomalies"].count() == 24 == learnt["weighted"].count()
    assert {r.method for r in learnt["agreement"].collect()} == {"iforest", "lof", "dbscan", "zscore", "ensemble"}
    assert abs(sum(r.importance for r in learnt["importance"].collect()) - 1) < 1e-6 or learnt["anomalies"].where("label = -1").count() == 0
    health = spark.createDataFrame([(f"Store {10000 + i % 30}", f"2025-02-0{1 + i % 5} {i % 24:02d}:00:00", "Connection failed", f"M{i % 3}") for i in range(600)], "source_entity string, event_timestamp string, health_event string, machine string")
    found = analysis.analyze_health(analysis.incidents_from_health(health))
    assert found["clusters"].count() == 30 and found["machine_health"].count() == 3 and found["features"].where(F.col("bursts") >= 0).count() == 30
    assert {r.cause for r in found["root_causes"].collect()} >= {"network_latency", "server_overload"} and found["forecast"].count() == 24
