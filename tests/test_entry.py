"""The driver's contract, with and without the corpus operators."""

import importlib
import sys

import __spark_entry__
from streamloom import queries


def test_every_engine_query_has_sql():
    assert set(queries.oracle_sql()) == set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(queries.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_entry_imports_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("streamloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "streamloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert set(entry.queries()) == set(queries.queries())
        assert set(entry.oracle_sql()) == set(queries.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
