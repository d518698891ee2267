import numpy as np
import pytest

from corymb import api


def test_library_surface():
    image, roi, spots = api.synthetic_flower(160)
    again = api.synthetic_flower(160)
    assert all((a == b).all() for a, b in zip((image, roi, spots), again, strict=True))
    assert image.dtype == roi.dtype == np.uint8 and ((spots > 0) <= (roi > 0)).all()
    p = api.measure_pattern(spots, roi)
    assert 0 < p["coverage_pct"] < 20 and p["component_count"] >= 4 and 0 <= p["centroid_x_rel"] <= 1
    s = api.measure_shape(roi, 0.5)
    assert s["major_axis_mm"] >= s["minor_axis_mm"] and 0 < s["circularity"] < 1.2
    assert len(api.width_profile(roi)) > len(api.width_profile(roi, "minor")) * 0.8
    assert api.width_at(roi, 0.7) > 0
    for bad in (lambda: api.width_profile(roi, "x"), lambda: api.width_at(roi, 2), lambda: api.synthetic_flower(50), lambda: api.measure_shape(roi, -1), lambda: api.ColorPatternModel(channels=("z",))):
        with pytest.raises(ValueError):
            bad()


def test_tubular_traits_double_for_folded():
    _, roi, _ = api.synthetic_flower(200)
    a, b = api.tubular_traits(roi), api.tubular_traits(roi, width_factor=2)
    assert b["throat_width_mm"] == 2 * a["throat_width_mm"] and b["corolla_length_mm"] == a["corolla_length_mm"]
    assert a["mouth_width_mm"] > a["throat_width_mm"]


def test_colour_model_finds_the_spots():
    image, roi, spots = api.synthetic_flower(160)
    noisy = np.clip(image + np.random.default_rng(0).normal(0, 4, image.shape), 0, 255).astype(np.uint8)
    m = api.ColorPatternModel(n_components=2)
    with pytest.raises(RuntimeError):
        m.posterior(noisy[..., ::-1], roi)
    with pytest.raises(ValueError):
        m.fit([], [])
    m.fit([noisy[..., ::-1]], [roi])
    guide = int((m.component_centres_[:, 0] - m.component_centres_[:, 1]).argmax())
    found = m.segment(noisy[..., ::-1], roi, guide)
    assert ((found > 0) == (spots > 0)).mean() > 0.995
    with pytest.raises(ValueError):
        m.segment(noisy[..., ::-1], roi, 5)


def test_lab_matches_the_column_expression(spark):
    from pyspark.sql import functions as F

    from corymb.functions.scalars import cielab

    rgb = np.random.default_rng(1).integers(0, 256, (50, 3))
    d = spark.createDataFrame([tuple(map(int, r)) for r in rgb], "r int, g int, b int")
    got = np.array([tuple(r) for r in d.select(*cielab(F.col("r"), F.col("g"), F.col("b"))).collect()])
    assert np.allclose(got, api._lab(rgb.reshape(50, 1, 3))[:, 0])
