"""Queries over tiled scans: the line items of a return flag are the pixels of one large scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from corymb.operators import runs, tiles
from corymb.plans.base import table
from corymb.plans.registry import query
from corymb.plans.runs import _morphology_sql

SIDE, TILE = 512, 128
_PX = f"li AS (SELECT l_returnflag AS image, (l_orderkey * 7 % {SIDE})::BIGINT AS y, (l_partkey * 11 % {SIDE})::BIGINT AS x, l_quantity AS gain FROM lineitem)"


def _tiles(spark, sf_dir, value: bool = False):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image"), (F.col("l_orderkey") * 7 % SIDE).alias("y"), (F.col("l_partkey") * 11 % SIDE).alias("x"), F.col("l_quantity").cast("int").alias("gain"))
    return tiles.from_pixels(p, TILE, "gain" if value else None)


def _sums(d, what: str):
    n = F.col("x1") - F.col("x0")
    return d.groupBy("image").agg(F.lit(what).alias("what"), F.sum(n).alias("area"), F.sum(n * (F.col("x0") + F.col("x1") - 1) / 2).cast("long").alias("sx"), F.sum(n * F.col("y")).alias("sy"))


_SUM = "SELECT image, '{what}' AS what, count(*) AS area, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM {source} GROUP BY image"


@query("tiled_morphology", f"WITH {_PX}, {_morphology_sql(runs.ellipse_rows(5))} {_SUM.format(what='closed', source='closed')} UNION ALL {_SUM.format(what='dilated', source='g')}")
def tiled_morphology(spark, sf_dir):
    """Closing and dilation of large scans, tile by tile with halos: area and sums of coordinates."""
    t = _tiles(spark, sf_dir)
    out = [_sums(tiles.to_runs(tiles.morphed(t, how, 5, TILE), TILE), how) for how in ("closed", "dilated")]
    return out[0].unionByName(out[1])


@query("tiled_threshold", f"WITH {_PX}, m AS (SELECT image, y, x, max(gain)::INTEGER AS v FROM li GROUP BY ALL), b AS (SELECT image, y + dy AS y, x + dx AS x, sum(v) // 9 AS v FROM m, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) GROUP BY ALL), d AS (SELECT * FROM b WHERE v >= 5) {_SUM.format(what='bright', source='d')}")
def tiled_threshold(spark, sf_dir):
    """Where the mean of three by three pixels reaches a bound."""
    t = tiles.blurred(_tiles(spark, sf_dir, True), 3, TILE)
    return _sums(tiles.to_runs(tiles.thresholded(t, 5, TILE), TILE), "bright")
