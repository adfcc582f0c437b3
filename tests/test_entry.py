"""The driver contract holds without the training-data subpackage."""

import importlib
import sys

import __spark_entry__ as entry


def test_core_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tavla.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tavla.llm.queries", None)  # an import of it now fails
    core = {n for m in entry.PLANS for n in importlib.import_module(m).QUERIES}
    assert set(entry.queries()) == core
    assert set(entry.oracle_sql()) <= core


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
