import importlib

import __spark_entry__ as entry


def test_registered():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p3_found", "sketch_knn"} <= set(q)


def test_core_works_without_the_subpackage(monkeypatch):
    real = importlib.import_module

    def without(name, *a):
        if name.startswith("graphweft.llm"):
            raise ModuleNotFoundError(name, name="graphweft.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert "p1_found" in entry.queries() and "p7_ids" not in entry.queries()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["node", "neighbour", "distance", "rank"] and df.count() > 0
