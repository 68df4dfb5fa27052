import importlib
import sys


def test_contract():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_package(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    for name in [m for m in sys.modules if m.startswith("lodespark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodespark.llm", None)
    assert "p1_found" in entry.queries() and not any(n.startswith("p7_") for n in entry.queries())
