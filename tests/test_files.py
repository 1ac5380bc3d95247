"""Files: side-cars, matrices, ASCII grids, realizations of a grid; ranges over many partitions."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithospark.operators import frame
from lithospark.sources import geoeas, sidecar
from lithospark.spec import GridSpec


def text_of(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_side_cars(spark, tmp_path):
    points = sidecar.TableInfo(1, 2, 3, "-999.25", {5: 4}, {6: (4, "table.trn")}, {7: "rocks"})
    sidecar.write_sidecar(spark, points, str(tmp_path / "p"))
    assert text_of(tmp_path / "p").split("\n")[:5] == ["metadata", "X:1", "Y:2", "Z:3", "NDV:-999.25"] and "NSCORE:4>6=table.trn" in text_of(tmp_path / "p")
    assert sidecar.read_sidecar(spark, str(tmp_path / "p")) == points
    grid = sidecar.TableInfo(ndv="-1", categories={2: "facies list"}, spec=GridSpec(3, 4, 2, 10.0, -5.0, 0.5, 2.0, 1.0, 0.25), rotation=30.0, realizations=7)
    sidecar.write_sidecar(spark, grid, str(tmp_path / "g"))
    assert "X0:11\nY0:-4.5\nZ0:0.625\nNX:3\n" in text_of(tmp_path / "g") and sidecar.read_sidecar(spark, str(tmp_path / "g")) == grid
    (tmp_path / "odd.md").write_text("a file\nversion=1\nX:2\n\nUNKNOWN:3\nNDV:\nZ: 1 \nX:3\n")
    odd = sidecar.read_sidecar(spark, str(tmp_path / "odd.md"))
    assert odd == sidecar.TableInfo(x=3, z=1)
    table = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, -999.25, 5.0, 6.0)], "row_id int, a double, b double, c double")
    named = points.places(points.known(table)).orderBy("row_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in named] == [(1.0, 2.0, 3.0), (None, 5.0, 6.0)] and points.name(table, 2) == "b"


def test_matrices(spark, tmp_path):
    (tmp_path / "m.txt").write_text('\t"red sand"\tclay\n"red sand"\t0\t3.5\nclay\t2\tx\nbroken\t1\n')
    got = {(r["from"], r["to"]): r["n"] for r in sidecar.read_matrix(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {("red sand", "red sand"): 0.0, ("red sand", "clay"): 3.5, ("clay", "red sand"): 2.0, ("clay", "clay"): None}
    made = spark.createDataFrame([("clay", "red sand", 2.0), ("red sand", "clay", 1.0), ("red sand", "clay", 2.5), ("other", "clay", 9.0)], "from string, to string, n double")
    sidecar.write_matrix(made, ["red sand", "clay"], str(tmp_path / "w"))
    assert text_of(tmp_path / "w") == '\t"red sand"\tclay\n"red sand"\t0\t3.5\nclay\t2\t0\n'
    assert {(r["from"], r["to"]): r["n"] for r in sidecar.read_matrix(spark, str(tmp_path / "w")).collect()}["red sand", "clay"] == 3.5
    (tmp_path / "e.txt").write_text("")
    assert sidecar.read_matrix(spark, str(tmp_path / "e.txt")).count() == 0
    long = geoeas.matrix_to_long(spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "from string, a int, b int"))
    assert sorted(map(tuple, long.collect())) == [("a", "a", 1), ("a", "b", 2), ("b", "a", 3), ("b", "b", 4)]
    assert sorted(map(tuple, geoeas.long_to_matrix(long, ["a", "b"]).collect())) == [("a", 1, 2), ("b", 3, 4)]


def test_ascii_grids(spark, tmp_path):
    grid = spark.createDataFrame([(i, j, None if (i, j) == (1, 1) else i + 10.5 * j) for i in range(3) for j in range(4) if j != 2], "i int, j int, v double")
    sidecar.write_grd(grid, GridSpec(3, 4, x0=100.0, dx=2.5), str(tmp_path / "g"), ndv=-9.0)
    assert text_of(tmp_path / "g").split("\n") == ["DSAA", "3 4", "100 107.5", "0 4", "0 33.5", "0 1 2", "10.5 -9 12.5", "-9 -9 -9", "31.5 32.5 33.5", ""]
    assert [r["line"] for r in geoeas.grd_rows(grid.where("j = 0"), GridSpec(3, 1)).collect()] == ["0 1 2"]


def test_realizations_of_a_grid_file(spark, tmp_path):
    (tmp_path / "g.dat").write_text("grid\n1\nv\n" + "".join(f"{n}\n" for n in range(24)))
    spec = GridSpec(2, 2, 2)
    every = geoeas.read_grid(spark, str(tmp_path / "g.dat"), spec)
    assert every.count() == 24 and [tuple(r) for r in every.where("row_id = 13").select("real", "i", "j", "k", "v").collect()] == [(1, 1, 0, 1, 13.0)]
    some = geoeas.read_grid(spark, str(tmp_path / "g.dat"), spec, realizations=[0, 2])
    assert {r["real"] for r in some.collect()} == {0, 2} and some.count() == 16


@pytest.mark.parametrize("partitions", [1, 3, 150])
def test_ranges_over_many_partitions(spark, partitions):
    rng = np.random.default_rng(partitions)
    values = np.round(rng.normal(0, 50, 30_000), 1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(float(v), n) for n, v in enumerate(values)], "v double, n int")
        keys = geoeas.with_row_id(df, ["v", "n"]).select("row_id", "v", "n").toPandas().sort_values("row_id")
        table = frame.cdf_table(df, "v").toPandas().sort_values("value")
        ranges = df.select(geoeas.range_bucket(df, ["v", "n"]).alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = np.lexsort((np.arange(len(values)), values))
    assert (keys["n"].to_numpy() == order).all() and (keys["row_id"].to_numpy() == np.arange(len(values))).all()
    kinds, w = np.unique(values, return_counts=True)
    assert np.allclose(table["value"], kinds) and np.allclose(table["p"], (np.cumsum(w) - w / 2) / len(values))
    assert len(ranges) == partitions if partitions < 100 else len(ranges) > 100
    assert max(r["count"] for r in ranges) < 6 * len(values) / partitions + 1


def test_columns_of_a_longer_table(spark):
    a, b = spark.createDataFrame([(0, 1.0)], "row_id int, a double"), spark.createDataFrame([(0, 5.0), (1, 6.0)], "row_id int, b double")
    assert sorted(map(tuple, frame.append_column_from(a, b, "b").collect())) == [(0, 1.0, 5.0), (1, None, 6.0)]
