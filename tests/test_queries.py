"""Every registered array query at the smallest scale, against its SQL."""

import math

import duckdb
import numpy as np
import pytest

from arrayloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_gram_matrix_whole(spark, con):
    x = np.stack(con.sql("SELECT embedding FROM embeddings").fetchnumpy()["embedding"]).astype(float)
    got = catalog.QUERIES["gram_matrix_whole"](spark, SF).toPandas()
    assert len(got) == 64 * 64
    assert np.abs((x.T @ x)[got.i, got.j] - got.v).max() < 1e-5


def test_wavelet_haar_project_whole(spark):
    """Every point counts: energy is kept, and the last coefficient is the whole series' scaled sum."""
    from arrayloom.plans.tables import embeddings

    e = embeddings(spark, SF).toPandas().groupby(["run_id", "vox"]).value.agg(["sum", "size", lambda x: (x**2).sum()])
    got = catalog.QUERIES["wavelet_haar_project_whole"](spark, SF).toPandas().sort_values("k").groupby(["run_id", "vox"]).value.agg(["last", "size", lambda x: (x**2).sum()])
    assert (got["size"] >= e["size"]).all() and (got["size"] < 2 * e["size"]).all()
    assert np.allclose(got.iloc[:, 2], e.iloc[:, 2], atol=1e-3)
    assert np.allclose(got["last"], e["sum"] / np.sqrt(got["size"]), atol=1e-4)


def test_wavelet_haar_project_whole_and_sql():
    """On 16 points, the coefficients of the basis that wavelet_haar_project uses."""
    import pandas as pd

    from arrayloom.functions import bases
    from arrayloom.plans.kernel_queries import _haar_of_series

    x = np.random.default_rng(1).normal(size=16)
    got = _haar_of_series(pd.DataFrame({"run_id": "run-01", "t": np.arange(16), "vox": 0, "value": x})).value
    assert np.allclose(got, x @ bases.basis_matrix("wavelet", 16, 16, wavelet="haar"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 16
    assert set(entry.oracle_sql()) <= set(entry.queries())
