"""Raw grids as a source and a sink."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineflow.sources import grids


def table(df):
    return {(r["y"], r["x"]): r["v"] for r in df.collect()}


def frame(spark, a, fill):
    return spark.createDataFrame([(int(y), int(x), int(a[y, x])) for y, x in np.argwhere(a != fill)], "y bigint, x bigint, v int").repartition(5)


@pytest.mark.parametrize(("dtype", "lo", "hi", "fill"), [("int16", -300, 300, -32768), ("uint8", 0, 200, 255), ("int32", -(10**6), 10**6, -(2**31))])
def test_round_trip_as_blocks_and_as_one_file(spark, tmp_path, dtype, lo, hi, fill):
    a = np.random.default_rng(hi % 7).integers(lo, hi, (23, 17)).astype(grids.DTYPES[dtype])
    a[3:9] = fill  # a block of which no cell is given
    a[12, 4] = fill
    path, one = f"file://{tmp_path}/grid", f"file://{tmp_path}/one.raw"
    grids.write(frame(spark, a, fill), path, 17, 23, dtype, fill, 3, header=json.dumps({"cellSizeFt": 1, "geotransform": [0, 1, 0, 9, 0, -1]}))
    want = {(int(y), int(x)): int(a[y, x]) for y, x in np.argwhere(a != fill)}
    assert table(grids.read(spark, path)) == want
    assert json.loads((tmp_path / "grid" / "grid.json").read_text())["cellSizeFt"] == 1
    grids.joined(spark, path, one)
    assert np.array_equal(np.fromfile(tmp_path / "one.raw", a.dtype).reshape(a.shape), a)
    assert table(grids.read(spark, one, width=17, height=23, dtype=dtype, fill=fill, block_rows=4)) == want
    assert grids.read(spark, one, width=17, height=23, dtype=dtype).count() == a.size
    window = dict(first_y=2, last_y=20, first_x=5, last_x=11, step=5, phase=2)
    picked = {k: v for k, v in want.items() if 2 <= k[0] <= 20 and 5 <= k[1] <= 11 and k[0] % 5 == 2 and k[1] % 5 == 2}
    for source in (grids.read(spark, path, **window), grids.read(spark, one, width=17, height=23, dtype=dtype, fill=fill, **window)):
        assert table(source) == picked
    # Written again: other blocks take the place of all.
    grids.write(frame(spark, a, fill).where("y < 4"), path, 17, 23, dtype, fill, 3)
    assert table(grids.read(spark, path)) == {k: v for k, v in want.items() if k[0] < 4}
    assert len(list((tmp_path / "grid").glob("rows-*"))) == 1


def test_window_and_stride_read_their_byte_ranges_only():
    a = np.arange(100 * 60, dtype="<i2").reshape(100, 60)
    raw, asked = a.tobytes(), []

    def read_at(offset, n):
        asked.append(n)
        return raw[offset : offset + n]

    shape = grids.Shape(60, 100, "int16", None)
    rows, columns = grids.selected({"step": "5", "phase": "2"}, shape)
    got = [r for b in grids.cells(read_at, grids.Rows("f", 0, 0, 100), shape, rows, columns) for r in b.to_pylist()]
    assert [r["v"] for r in got] == a[2::5, 2::5].ravel().tolist() and sum(asked) <= len(raw) / 5
    asked.clear()
    rows, columns = grids.selected({"first_y": "10", "last_y": "12", "first_x": "7", "last_x": "9"}, shape)
    got = [r["v"] for b in grids.cells(read_at, grids.Rows("f", 0, 0, 100), shape, rows, columns) for r in b.to_pylist()]
    assert got == a[10:13, 7:10].ravel().tolist() and asked == [6, 6, 6]


def test_blocks_outside_the_window_are_no_partitions(spark, tmp_path):
    a = np.ones((40, 4), "<i2")
    a.tofile(tmp_path / "one.raw")
    whole = grids.read(spark, f"file://{tmp_path}/one.raw", width=4, height=40, dtype="int16", block_rows=8)
    assert whole.rdd.getNumPartitions() == 5
    some = grids.read(spark, f"file://{tmp_path}/one.raw", width=4, height=40, dtype="int16", block_rows=8, first_y=17, last_y=23)
    assert some.rdd.getNumPartitions() == 1 and some.count() == 28
    none = grids.read(spark, f"file://{tmp_path}/one.raw", width=4, height=40, dtype="int16", first_y=30, last_y=20)
    assert none.count() == 0
    (tmp_path / "short.raw").write_bytes(a.tobytes()[:-2])
    with pytest.raises(Exception, match="cut short"):
        grids.read(spark, f"file://{tmp_path}/short.raw", width=4, height=40, dtype="int16").count()


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/grid"
    rows = spark.range(400).select((F.col("id") / 4).cast("bigint").alias("y"), (F.col("id") % 4).alias("x"), F.lit(1).alias("v"))
    broken = rows.withColumn("v", F.when(F.col("y") == 99, F.raise_error("lost")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost|ABORTED|failed"):
        grids.write(broken, path, 4, 100, block_rows=10)
    assert not list(tmp_path.glob("grid/*"))
    grids.write(rows, path, 4, 100, block_rows=10)
    with pytest.raises(Exception, match="lost|beyond"):
        grids.write(rows.withColumn("x", F.col("x") + 1), path, 4, 100, block_rows=10)
    assert grids.read(spark, path).count() == 400
