"""Tiled scans against the whole-image kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corymb.operators import masks, runs, tiles


def whole(df, shape, tile):
    out = np.zeros(shape, np.uint8)
    for r in df.collect():
        y, x = r["ty"] * tile, r["tx"] * tile
        part = np.frombuffer(r["data"], np.uint8).reshape(tile, tile)[: max(0, shape[0] - y), : max(0, shape[1] - x)]
        if y >= 0 and x >= 0 and part.size:
            out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def table(spark, a):
    return spark.createDataFrame([("s", *map(int, p), int(a[tuple(p)])) for p in np.argwhere(a)], "image string, y long, x long, v int").repartition(3)


@pytest.mark.parametrize("how", ["dilated", "eroded", "opened", "closed"])
@pytest.mark.parametrize("size", [3, 7])
def test_tiles_equal_the_whole(spark, how, size):
    rng = np.random.default_rng(size)
    a = np.zeros((90, 110), np.uint8)
    a[12:78, 12:98] = rng.random((66, 86)) < 0.8
    got = whole(tiles.morphed(tiles.from_pixels(table(spark, a), 16), how, size, 16), a.shape, 16)
    want = {"dilated": masks.dilate, "eroded": masks.erode, "opened": masks.opened, "closed": masks.closed}[how](a > 0, masks.ellipse(size))
    assert (got == want).all()


def test_filters_equal_the_whole(spark):
    rng = np.random.default_rng(4)
    a = np.zeros((60, 50), np.uint8)
    a[5:55, 5:45] = rng.integers(1, 256, (50, 40))
    t = tiles.from_pixels(table(spark, a), 16, "v")
    assert (whole(t, a.shape, 16) == a).all()
    want = np.array([[np.pad(a.astype(int), 2)[y : y + 5, x : x + 5].sum() // 25 for x in range(50)] for y in range(60)])
    assert (whole(tiles.blurred(t, 5, 16), a.shape, 16) == want).all()
    assert (whole(tiles.thresholded(t, 200, 16), a.shape, 16) == (a >= 200)).all()


def test_runs_cross_tiles(spark):
    a = np.zeros((40, 70), np.uint8)
    a[3:37, 5:66] = 1
    a[20, 30] = 0
    r = tiles.to_runs(tiles.from_pixels(table(spark, a), 16), 16)
    assert r.count() == 35
    assert [c["area"] for c in runs.component_table(runs.labelled(r)).collect()] == [34 * 61 - 1]


def test_a_large_scan_is_worked_tile_by_tile(spark):
    """36 million pixels: no row is larger than a tile with its halo, and the result is the kernel's."""
    side, tile = 6000, 1024

    def decode(raw: bytes) -> np.ndarray:
        a = np.zeros((side, side), np.uint8)
        for i in range(10):
            for j in range(6):
                a[i * 600 + 40 : i * 600 + 500, j * 1000 + 40 : j * 1000 + 900] = 1
                a[i * 600 + 100 : i * 600 + 103, j * 1000 : j * 1000 + 1000] = 1
                a[i * 600 + 200 : i * 600 + 204, j * 1000 + 300 : j * 1000 + 320] = 0
        return a

    t = tiles.from_arrays(spark.createDataFrame([("s", bytearray(b"x"))], "image string, content binary"), decode, tile)
    assert t.agg(F.max(F.length("data"))).first()[0] == tile * tile
    got = tiles.to_runs(tiles.morphed(tiles.morphed(t, "closed", 7, tile), "opened", 7, tile), tile)
    a = np.pad(decode(b"")[:1300, :2100] > 0, 8)
    want = masks.opened(masks.closed(a, masks.ellipse(7)), masks.ellipse(7))[8:-8, 8:-8]
    inner = got.where("y < 1200 AND x0 < 2000").select("y", F.col("x0"), F.least("x1", F.lit(2000)).alias("x1"))
    out = np.zeros((1200, 2000), bool)
    for r in inner.where("y >= 0").collect():
        out[r["y"], max(0, r["x0"]) : r["x1"]] = True
    assert (out == want[:1200, :2000]).all()


def test_bad_halos_and_nothing(spark):
    none = tiles.from_pixels(spark.createDataFrame([], "image string, y long, x long"), 16)
    assert tiles.to_runs(tiles.morphed(none, "closed", 5, 16), 16).count() == 0
    with pytest.raises(ValueError, match="halo"):
        tiles.worked(none, lambda a: a, 17, 16)
