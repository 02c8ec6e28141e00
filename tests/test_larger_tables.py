"""Queries on tables that are larger, or other, than the driver's smallest."""

import os

import duckdb
import pytest

from arrayloom.plans import catalog
from arrayloom.plans.tables import DIMS, space

SF = "/root/testdata/sf0.001"


def same_rows(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    """Parts twice, the second time at the end of 16 x 16 x 4096 voxels and beyond it."""
    folder = tmp_path_factory.mktemp("deep")
    n = DIMS[0] * DIMS[1] * DIMS[2]
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/part.parquet' UNION ALL SELECT * REPLACE (p_partkey + {n} - 100 AS p_partkey) FROM '{SF}/part.parquet') TO '{folder}/part.parquet'")
    return folder


def test_space_holds_all_parts(spark, deep):
    assert space(spark, SF) == DIMS
    assert space(spark, str(deep))[2] > DIMS[2]


@pytest.mark.parametrize("name", ["edge_map", "sobel_magnitude", "sobel_by_windows", "haar_inverse", "roi_detail_indices", "haar_forward", "connected_components_by_rounds"])
def test_parts_beyond_the_least_space(spark, deep, name):
    same_rows(spark, deep, name)


@pytest.mark.parametrize("name", ["modwt_bayes_shrink", "modwt_roundtrip"])
def test_coefficients_are_not_broadcast(spark, name):
    """What tasks make of few packed rows has no size that the optimiser knows."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "vox" in line]


def test_fine_centres_meet_near_voxels_only(spark):
    """Centres of two sizes: atoms are those of each size alone, and cells are as small as the kernel of each."""
    from arrayloom.operators import spatial

    dims = (16, 16, 200)
    voxels = spark.range(16 * 16 * 200).selectExpr("cast(id AS int) AS vox")
    schema = "k int, level int, vox int, cx double, cy double, cz double, sigma double"
    wide, fine = (0, 0, 0, 8.0, 8.0, 100.0, 4.0), (1, 1, 0, 3.0, 9.0, 31.0, 1.0)
    both = spatial.atoms(voxels, dims, spark.createDataFrame([wide, fine], schema))
    alone = [spatial.atoms(voxels, dims, spark.createDataFrame([c], schema)) for c in (wide, fine)]
    rows = lambda df: {(r.k, r.vox): round(r.w, 12) for r in df.collect()}
    assert rows(both) == rows(alone[0]) | rows(alone[1])
