"""The driver's contract, with and without the corpus operators."""

import builtins
import importlib

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 30


def test_without_corpus_operators(monkeypatch):
    real = builtins.__import__

    def no_corpus(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("peakflow.llm"):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", no_corpus)
    bare = importlib.reload(__spark_entry__)
    assert bare.corpus is None and bare.corpus_pipeline is None
    assert bare.queries() and not any(n.startswith("op") or n == "pipeline" for n in bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
