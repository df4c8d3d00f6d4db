"""The entry point works with and without the training-data operators."""

import importlib
import sys

import __spark_entry__


def test_other_queries_stay_when_an_import_of_the_operators_fails(monkeypatch):
    from parcelflow.queries import QUERIES

    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    for name in [m for m in sys.modules if m.startswith("parcelflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert set(importlib.reload(__spark_entry__).queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_every_answer_in_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
