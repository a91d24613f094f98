"""The driver's contract, also without the optional subpackage or what it needs."""

import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_a_package_of_the_subpackage(monkeypatch):
    """A package that only the subpackage needs is absent: its queries are, and no others."""
    for name in [x for x in sys.modules if x.startswith("tidewatch.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "regex", None)
    names = set(entry.queries())
    assert {"p1_found", "p5_found", "cascades"} <= names and not any(x.startswith(("p6_", "p7_", "p8_", "p9_")) for x in names)
    assert set(entry.oracle_sql()) <= names


def test_nothing_else_imports_the_subpackage():
    before = {x for x in sys.modules if x.startswith("tidewatch.llm")}
    for name in before:
        sys.modules.pop(name)
    for name in entry.MODULES:
        importlib.reload(importlib.import_module(name))
    assert not any(x.startswith("tidewatch.llm") for x in sys.modules)
