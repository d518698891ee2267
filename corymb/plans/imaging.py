"""Queries of whole-image operators on the suppliers' masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corymb.operators import imaging, pixels
from corymb.plans.pixels import _pixels
from corymb.plans.registry import query
from corymb.sources.scratch import written


def _masks(spark, sf_dir, column: str = "roi"):
    return imaging.mask_column(_pixels(spark, sf_dir), column)


@query("mask_shapes")
def mask_shapes(spark, sf_dir):
    return imaging.shapes(_masks(spark, sf_dir), 0.5)


@query("mask_axes")
def mask_axes(spark, sf_dir):
    return imaging.axes(_masks(spark, sf_dir))


@query("mask_components")
def mask_components(spark, sf_dir):
    return imaging.components(_masks(spark, sf_dir, "pat"), 3)


@query("mask_registration")
def mask_registration(spark, sf_dir):
    return imaging.registered(_masks(spark, sf_dir), _masks(spark, sf_dir, "other"))


@query("photo_matches")
def photo_matches(spark, sf_dir):
    """Silhouettes matched, four a sheet, one to one with the hand masks of the same sheet; a test knows the answer for shifted copies."""
    own = lambda name, c: _masks(spark, sf_dir, c).select(F.concat(F.lit("sheet_"), F.floor(F.col("image_id") / 4).cast("string")).alias("sheet"), F.col("image_id").cast("string").alias(name), "h", "w", "mask")
    return imaging.match_photos(own("photo", "other"), own("corolla_id", "roi").withColumns({"hand_length": F.lit(2.0), "hand_width": F.lit(1.0)}))


def _with_pattern(spark, sf_dir):
    return _masks(spark, sf_dir).join(_masks(spark, sf_dir, "pat").select("image_id", F.col("mask").alias("pattern")), "image_id")


@query("upright_frames")
def upright_frames(spark, sf_dir):
    """Each flower's upright frame: its size, and how many of its pixels are pattern."""
    count = lambda c: F.length(F.regexp_replace(F.hex(c), "00", "")) / 2
    return imaging.upright_frames(_with_pattern(spark, sf_dir)).select("image_id", "h", "w", count("mask").cast("long").alias("roi_px"), count("pattern").cast("long").alias("pattern_px"))


@query("midline_metrics")
def midline_metrics(spark, sf_dir):
    """Guide pixels against all pixels of each flower, by distance to the midline."""
    d = written(imaging.midline_distances(_with_pattern(spark, sf_dir)), "midline")  # drawn once, read for each metric
    return pixels.spatial_metrics(d.select("image_id", "pattern", (F.col("y") / 96.0).alias("pos"), "dist"))
