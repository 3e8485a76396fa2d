"""Every registered query that has SQL, against it, on the smallest tables."""

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"

from heartwood.plans import catalog  # noqa: E402


def norm(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else (round(float(v), 6) if isinstance(v, float) else (v.item() if hasattr(v, "item") else v))
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for name in os.listdir(D):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{D}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, views, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = views.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)


@pytest.mark.parametrize("gone", [("heartwood.llm", "corpus_pipeline"), ("corpus_pipeline",), ("numpy",)])
def test_entry_works_without_the_optional_part(spark, monkeypatch, gone):
    """Its folders deleted, the pipeline alone, or a library that it needs."""
    import builtins
    import sys

    lost = [m for m in sys.modules if m.startswith(("heartwood.llm", "corpus_pipeline")) or m == "__spark_entry__"]
    for m in lost:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def refuse(name, *a, **k):
        if name.split(".")[0] in gone and (a and (a[0] or {}).get("__name__", "").startswith("heartwood.llm")):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", refuse)
    for m in gone:
        if m != "numpy":
            monkeypatch.setitem(sys.modules, m, None)
    import __spark_entry__ as bare

    assert set(catalog.QUERIES) <= set(bare.queries()) and "pipeline" not in bare.queries() and set(bare.oracle_sql()) <= set(bare.queries())
    assert (set(bare.queries()) == set(catalog.QUERIES)) == (bare.llm is None)
    assert bare.llm is None or "heartwood.llm" not in gone
    assert bare.entry(spark).count() > 0
