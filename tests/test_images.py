import re

import numpy as np
import pytest

from corymb import api, catalog, presets
from corymb.operators import imaging, mixture, pixels
from corymb.operators import masks as mk
from corymb.plans.pixels import _pixels
from corymb.sources import tables


def disc(n=41, r=15):
    y, x = np.mgrid[:n, :n] - n // 2
    return x * x + y * y <= r * r


def test_rectangle_shape():
    m = np.zeros((20, 30), np.uint8)
    m[5:15, 8:28] = 1
    s = mk.shape(m, 0.5)
    assert s["area"] == 50.0 and s["major"] >= s["minor"] and s["aspect"] >= 1
    for bad in (np.zeros((3, 3)), np.ones(4)):
        with pytest.raises(ValueError):
            mk.shape(bad)
    with pytest.raises(ValueError):
        mk.shape(m, 0)


def test_two_spots():
    roi, p = np.zeros((10, 10)), np.zeros((10, 10))
    roi[1:9, 1:9] = 1
    p[2:4, 2:4] = p[6:8, 6:8] = 1
    r = mk.pattern(p, roi)
    assert r["coverage_pct"] == 12.5 and r["n_components"] == 2 and 0 <= r["centroid_x"] <= 1
    assert np.isnan(mk.pattern(np.zeros((10, 10)), roi)["dispersion"])


def test_labels_and_holes():
    m = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 1]])
    assert mk.labels(m)[1] == 3 and mk.labels(m, eight=False)[1] == 5
    ring = disc() & ~disc(r=9)
    assert (mk.filled(ring) == disc()).all()
    assert mk.without_small(m, 2).sum() == 3


def test_morphology_against_loops():
    rng = np.random.default_rng(0)
    m, k = rng.random((15, 17)) < 0.4, mk.ellipse(5)
    grown = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m), strict=True):
        for dy, dx in zip(*np.nonzero(k), strict=True):
            a, b = y + dy - 2, x + dx - 2
            if 0 <= a < 15 and 0 <= b < 17:
                grown[a, b] = True
    assert (mk.dilate(m, k) == grown).all()
    assert (mk.opened(m, k) <= m).all() and (mk.closed(np.pad(m, 3), k)[3:-3, 3:-3] >= m).all()


def test_distance_is_exact():
    rng = np.random.default_rng(1)
    m = rng.random((12, 14)) < 0.8
    zeros = np.argwhere(~m)
    want = np.array([[np.sqrt(((zeros - [y, x]) ** 2).sum(1).min()) for x in range(14)] for y in range(12)])
    assert np.allclose(mk.distance(m), want)


def test_skeleton_lengths_and_box():
    line = np.zeros((9, 30), bool)
    line[4, 3:27] = True
    assert mk.edge_length(mk.skeleton(line)) == 23.0
    assert mk.chord(line)[2] == 23.0
    diamond = np.array([[10.0, 0], [0, 10], [10, 20], [20, 10]])
    a, b, _ = mk.oriented_box(diamond)
    assert a == pytest.approx(200**0.5) and b == pytest.approx(200**0.5)
    assert mk.thinned(disc()).sum() < 10


def test_axis_of_a_tall_ellipse_and_repairs():
    y, x = np.mgrid[:240, :160]
    m = ((x - 80) / 40) ** 2 + ((y - 120) / 100) ** 2 <= 1
    a = mk.medial_axis(m)
    assert abs(a["angle_deg"] - 90) < 5 and a["length_mm"] > a["width_mm"] and a["roi_repair"] == ""
    assert mk.medial_axis(m, 90.0)["length_mm"] == pytest.approx(200 * 25.4 / 300, abs=0.05)
    ring = m & ~mk.erode(m, np.ones((5, 5), bool))
    ring[115:122, :60] = False
    assert mk.solid(ring)[1] == "sealed"


def test_pair_is_split():
    y, x = np.mgrid[:800, :300]
    two = ((x - 150) ** 2 + (y - 200) ** 2 <= 180**2) | ((x - 150) ** 2 + (y - 590) ** 2 <= 180**2) | ((abs(x - 150) < 20) & (abs(y - 395) < 30))
    assert len(mk.split_pair(two)) == 2 and len(mk.split_pair(disc())) == 1


def test_registration_finds_flip_and_scale():
    m = np.zeros((60, 60), bool)
    m[10:50, 15:30] = m[10:20, 15:45] = True
    v, _, flip, _ = mk.register(mk.crop(m)[0][::-1], m)
    assert v > 0.95 and flip == 1


def test_png_round_trip_and_silhouette():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (7, 9, 3)).astype(np.uint8)
    assert (imaging.decode(imaging.encode(image)) == image).all()
    assert (imaging.decode(b"P6\n# c\n9 7\n255\n" + image.tobytes()) == image).all()
    with pytest.raises(ValueError):
        imaging.decode(b"GIF89a")
    page = np.full((30, 30, 3), 255, np.uint8)
    page[8:20, 5:25] = 100
    assert imaging.silhouette(page).shape == (12, 20)


def test_strokes_flowers_and_flags():
    rng = np.random.default_rng(3)
    raw = np.full((420, 420, 3), 240.0) + rng.normal(0, 3, (420, 420, 3))
    y, x = np.mgrid[:420, :420]
    inside = ((x - 200) / 120) ** 2 + ((y - 210) / 170) ** 2 <= 1
    raw[inside] = [210, 190, 205]
    raw = np.clip(raw, 0, 255).astype(np.uint8)
    ann = raw.copy()
    ring = inside & ~mk.erode(inside, mk.ellipse(9))
    ann[ring] = [230, 20, 20]
    red, green = imaging.strokes(raw, ann)
    assert red.sum() > 0.8 * ring.sum() and green.sum() == 0
    rows = imaging.measured_rows("s", raw, ann)
    assert len(rows) == 1 and rows[0]["fold_state"] == "folded_half"
    assert rows[0]["corolla_width_fulleq_mm"] == pytest.approx(2 * rows[0]["corolla_width_obs_mm"], abs=0.02)
    assert imaging.quality_flags({"roi_repair": "hull", "fill_ratio": 0.1, "length_mm": 60}, manual=True, trimmed=False, split=True) == ["manual_axis", "length_outlier", "roi_open_outline", "split_from_merged_pair"]


def test_overlays():
    image, roi, pattern = api.synthetic_flower(128)
    before = image.copy()
    for out in (api.overlay_roi(image, roi), api.overlay_morphology(image, roi), api.overlay_pattern(image, roi, pattern)):
        assert out.shape == image.shape and out.dtype == np.uint8 and (out != image).any() and (image == before).all()
    assert (api.overlay_roi(image, roi) == api.overlay_roi(image[..., ::-1], roi, input_order="BGR")).all()
    spill = pattern.copy()
    spill[:10, :10] = 1
    assert (api.overlay_pattern(image, roi, pattern, alpha=0.5) == api.overlay_pattern(image, roi, spill, alpha=0.5)).all()
    assert api.overlay_pattern(np.full(roi.shape, 180, np.uint8), roi, pattern).shape == (128, 128, 3)
    assert (api.overlay_roi(image, roi, line_width=4) != image).sum() > (api.overlay_roi(image, roi, line_width=1) != image).sum()
    inner = pattern.astype(bool) & (api.overlay_roi(image, roi) == image).all(2)
    assert (api.overlay_pattern(image, roi, pattern, alpha=1.0)[inner] == imaging.PATTERN).all()
    for bad in (lambda: api.overlay_pattern(image, roi, pattern, alpha=2), lambda: api.overlay_roi(image, roi[:5]), lambda: api.overlay_roi(image, 0 * roi), lambda: api.overlay_roi(image, roi, input_order="xyz"), lambda: api.overlay_roi(image[..., :2], roi)):
        with pytest.raises(ValueError):
            bad()


def test_audit_pictures_and_pieces():
    image, roi, pattern = api.synthetic_flower(128)
    piece, x, y = mk.crop(pattern > 0)
    assert (imaging.pasted(piece, (x, y), pattern.shape) == (pattern > 0)).all()
    red, green = np.zeros((64, 64), bool), np.zeros((64, 64), bool)
    red[5, 5] = green[9, 9] = True
    out = imaging.overlay_strokes(image, red, green)
    assert (out[11, 11] == imaging.RED_STROKE).all() and (out[19, 19] == imaging.GREEN_STROKE).all() and (out[40:] == image[40:]).all()
    assert (imaging.overlay_grid(image, 16)[16, 3] == 190).all() and (imaging.overlay_grid(image, 16)[17, 3] == image[17, 3]).all()
    m = np.zeros((40, 60), bool)
    m[15:25, 5:55] = True
    colour = np.full((40, 60, 3), 200, np.uint8)
    turned, crop = imaging.upright_pair(m, colour, 0.0)
    assert turned.shape[0] > 3 * turned.shape[1] and crop.shape[:2] == turned.shape and (crop[turned] == 200).all()


def test_polygon_takes_its_drawn_edges():
    _, roi, _ = api.synthetic_flower(160)
    corners = [(int(a * 160), int(b * 160)) for a, b in pixels.CORNERS]
    assert all(roi[y, x] for x, y in corners)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        for t in np.linspace(0, 1, 50):  # an edge's pixels lie within half a pixel of it
            x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            assert roi[round(y) - 1 : round(y) + 2, round(x) - 1 : round(x) + 2].any()


def test_polygon_of_columns_equals_arrays(spark):
    for size in (96, 128, 161):
        _, roi, spots = api.synthetic_flower(size)
        got = np.zeros((size, size, 2), bool)
        for r in pixels.synthetic_flower(spark.range(1).withColumnRenamed("id", "image_id"), size).where("in_roi").select("y", "x", "in_pattern").collect():
            got[r["y"], r["x"]] = True, r["in_pattern"]
        assert (got[..., 0] == (roi > 0)).all() and (got[..., 1] == (spots > 0)).all()


def test_preset():
    preset = presets.CampanulaGuidePreset()
    assert preset.assign_roles([[0, 18], [25, -5], [20, 40]]) == {"petal": 0, "guide": 1, "oxidation": 2}
    assert preset.assign_roles([[30, 30], [25, -5], [2, 3], [20, 12]]) == {"petal": 2, "guide": 1, "oxidation": 0}
    with pytest.raises(ValueError):
        preset.assign_roles([[1, 2], [3, 4]])
    image, roi, spots = api.synthetic_flower(160)
    noisy = np.clip(image + np.random.default_rng(0).normal(0, 4, image.shape), 0, 255).astype(np.uint8)[..., ::-1]
    model = api.ColorPatternModel(n_components=3).fit([noisy], [roi])
    assert ((preset.segment(model, noisy, roi) > 0) <= (roi > 0)).all()
    assert presets.campanula_tubular_traits(roi)["corolla_length_mm"] > 0


def test_photos_are_decoded_and_turned(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(24, 16, 1)
    for y in range(16):
        for x in range(24):
            picture.setRGB(x, y, 0xC82014 if x < 8 else 0x1428C8)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/plain.jpg"))
    raw = (tmp_path / "plain.jpg").read_bytes()
    exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    (tmp_path / "turned.jpg").write_bytes(raw[:2] + b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + raw[2:])
    out = {r["stem"]: np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3).astype(int) for r in tables.photos(spark, f"file://{tmp_path}").collect()}
    assert out["plain"].shape == (16, 24, 3) and np.abs(out["plain"][8, 3] - [200, 32, 20]).max() < 40
    assert out["turned"].shape == (24, 16, 3) and np.abs(out["turned"][3, 8] - [200, 32, 20]).max() < 40
    a = np.arange(6).reshape(2, 3, 1)
    assert tables.oriented(a, 3)[..., 0].tolist() == [[5, 4, 3], [2, 1, 0]] and tables.oriented(a, 6)[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]] and tables.oriented(a, 8)[..., 0].tolist() == [[2, 5], [1, 4], [0, 3]]


def test_files_are_written_where_they_belong(spark, tmp_path):
    d = spark.createDataFrame([("a/x.png", bytearray(b"1")), ("b.png", bytearray(b"22"))], "name string, content binary")
    tables.write_files(d, f"file://{tmp_path}/out")
    assert (tmp_path / "out/a/x.png").read_bytes() == b"1" and (tmp_path / "out/b.png").read_bytes() == b"22"


def test_sheets_are_measured_end_to_end(spark):
    raw = np.full((700, 600, 3), 250, np.uint8)
    ann = raw.copy()
    y, x = np.mgrid[:700, :600]
    d = ((x - 300) / 110.0) ** 2 + ((y - 350) / 190.0) ** 2
    raw[d < 1] = ann[d < 1] = [180, 120, 190]
    ann[(d > 0.96) & (d < 1.06)] = [230, 20, 20]
    sheets = spark.createDataFrame([("s1", bytearray(imaging.encode(raw)), bytearray(imaging.encode(ann)))], "sheet string, raw binary, annotated binary")
    r = imaging.measure_sheets(sheets, opened=lambda sheet, number: number == 1).collect()
    assert len(r) == 1 and r[0]["fold_state"] == "opened_full" and r[0]["corolla_length_mm"] == pytest.approx(2 * 190 * 25.4 / 300, rel=0.06)


def test_folds_come_from_a_table(spark):
    rows = [("s1", "1", 10.0, 100.0), ("s1", "2a", 10.0, 100.0), ("s2", "7", 10.0, 100.0), ("s3", "1", 10.0, 100.0)]
    m = spark.createDataFrame([(s, c, "folded_half", w, a, 0.0, 0.0) for s, c, w, a in rows], "sheet string, corolla_id string, fold_state string, corolla_width_obs_mm double, corolla_area_obs_mm2 double, corolla_width_fulleq_mm double, corolla_area_fulleq_mm2 double")
    folds = spark.createDataFrame([("s1", 2), ("s2", None), ("s2", 7), ("s9", 1)], "sheet string, number int")
    got = {(r["sheet"], r["corolla_id"]): (r["fold_state"], r["corolla_width_fulleq_mm"], r["corolla_area_fulleq_mm2"]) for r in imaging.with_folds(m, folds).collect()}
    assert got == {("s1", "1"): ("folded_half", 20.0, 200.0), ("s1", "2a"): ("opened_full", 10.0, 100.0), ("s2", "7"): ("opened_full", 10.0, 100.0), ("s3", "1"): ("folded_half", 20.0, 200.0)}


def test_synthetic_flower(spark):
    d = pixels.synthetic_flower(spark.range(1).withColumnRenamed("id", "image_id"), 128)
    r = pixels.coverage(d, "in_pattern", "in_roi").first()
    assert 0 < r["coverage_pct"] < 20
    m = imaging.mask_column(d, "in_pattern")
    assert imaging.components(m).count() >= 4
    with pytest.raises(ValueError):
        pixels.synthetic_flower(spark.range(1).withColumnRenamed("id", "image_id"), 50)


def test_mixture_recovers_roles(spark):
    rng = np.random.default_rng(5)
    centres = {"petal": (0, 18), "guide": (25, -5), "oxidation": (20, 40)}
    rows = [tuple(map(float, rng.normal(c, 2))) for c in centres.values() for _ in range(300)]
    d = spark.createDataFrame(rows, "a double, b double").repartition(3)
    m = mixture.fit(d, ["a", "b"], starts=4, iterations=40)
    roles = mixture.assign_roles(m.means)
    for role, c in centres.items():
        assert np.linalg.norm(m.means[roles[role]] - c) < 1.5
    assert m.segment(d, roles["guide"]).where("segment").count() == pytest.approx(300, abs=6)
    assert [r["role"] for r in mixture.component_table(spark, m).orderBy("component").collect()] == list(mixture.ROLES)
    with pytest.raises(ValueError):
        m.segment(d, 9)
    with pytest.raises(ValueError):
        mixture.assign_roles(np.zeros((2, 2)))


@pytest.fixture(scope="module")
def scans(spark, tmp_path_factory):
    """Four suppliers of 700 line items each."""
    folder = str(tmp_path_factory.mktemp("scans"))
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, i) for i in range(1, 5)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    items = [(i, *map(int, rng.integers(0, 5000, 2))) for i in range(1, 5) for _ in range(700)]
    spark.createDataFrame(items, "l_suppkey long, l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("query", ["mask_shapes", "mask_axes", "mask_components", "mask_registration"])
def test_mask_queries_take_every_image(spark, scans, query):
    images = {r["image_id"] for r in _pixels(spark, scans).select("image_id").distinct().collect()}
    assert len(images) == 4 and {r["image_id"] for r in catalog.queries()[query](spark, scans).select("image_id").collect()} == images


def made_and_sent(plan: str) -> list[str]:
    """Broadcasts of a plan below which rows are multiplied and not summed up, so that their estimated size says nothing."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:+\-*]*", x)[0]) for x in lines]
    below = lambda i: lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
    return [x for i, x in enumerate(lines) if "BroadcastExchange" in x and any("Generate explode" in y for y in below(i)) and not any("Aggregate" in y for y in below(i))]


@pytest.mark.parametrize("query", ["pixel_centroid", "pixel_channels", "pixel_crop", "pixel_density", "pixel_lobe_incision", "component_sizes", "mask_axes", "mask_components", "mask_registration", "upright_frames"])
def test_pixels_are_never_broadcast(spark, scans, query):
    plan = catalog.queries()[query](spark, scans)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and not made_and_sent(plan)


def test_masks_are_gathered_without_a_join(spark):
    """What audit pictures, photo matches and midline metrics draw: sizes and pixels come from one pass."""
    d = spark.createDataFrame([(1, 0, 0, True)], "image_id long, y long, x long, on boolean")
    assert "Join" not in imaging.mask_column(d, "on")._jdf.queryExecution().executedPlan().toString()


def test_strokes_are_made_by_many_tasks(spark, scans):
    """The file of channel statistics doesn't draw the making of pixels into its one task."""
    got = catalog.queries()["stroke_statistics_file"](spark, scans)
    assert len(got.inputFiles()) > 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.queries()["pixel_channels"](spark, scans).collect()))


def test_midline_pixels_carry_their_pattern(spark):
    m = np.zeros((20, 80), np.uint8)
    m[5:15, 3:75] = 1
    p = np.zeros_like(m)
    p[7, 3:70] = p[0, 0] = 1
    d = spark.createDataFrame([(1, 20, 80, bytearray(m.tobytes()), bytearray(p.tobytes()))], "image_id long, h int, w int, mask binary, pattern binary")
    plain, marked = (imaging.midline_distances(x).orderBy("y", "x").collect() for x in (d.drop("pattern"), d))
    assert [tuple(r) for r in plain] == [tuple(r)[:4] for r in marked] and len(plain) == m.sum()
    assert all(r["pattern"] == bool(p[r["y"], r["x"]]) for r in marked)


def test_masks_wider_than_a_word(spark):
    rng = np.random.default_rng(3)
    images = {i: rng.random((h, w)) < 0.4 for i, (h, w) in enumerate(((3, 130), (5, 64), (1, 1), (4, 65)))}
    rows = [(i, y, x, bool(v)) for i, m in images.items() for (y, x), v in np.ndenumerate(m)]
    got = {r["image_id"]: r for r in imaging.mask_column(spark.createDataFrame(rows, "image_id long, y long, x long, on boolean"), "on").collect()}
    assert all((np.frombuffer(got[i]["mask"], np.uint8).reshape(got[i]["h"], got[i]["w"]) == m).all() for i, m in images.items())


def test_edge_length_counts_each_step_once(spark):
    rng = np.random.default_rng(4)
    m = rng.random((9, 70)) < 0.4
    d = spark.createDataFrame([(1, *map(int, at), bool(v)) for at, v in np.ndenumerate(m)] + [(2, 0, 0, True), (3, 0, 0, False)], "image_id long, y long, x long, on boolean")
    plan = pixels.edge_length(d, "on")
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r["image_id"]: r["length_px"] for r in plan.collect()}
    assert set(got) == {1, 2} and got[2] == 0 and got[1] == pytest.approx(mk.edge_length(m))


def test_tubes_meet_no_join(spark):
    """A gap in a mask has width 0; a mask of few rows has no throat, and is a row all the same."""
    rows = [(1, y, x, y != 5) for y in range(50) for x in range(10 + y)] + [(2, 0, 0, True)]
    d = spark.createDataFrame(rows, "image_id long, y long, x long, on boolean")
    widths = {r["y"]: (r["width"], r["left"]) for r in pixels.width_profile(d, "on").where("image_id = 1").collect()}
    assert widths == {y: (10 + y, 0) if y != 5 else (0, None) for y in range(50)}
    t = pixels.tube_traits(d, "on", 1.0)
    assert "Join" not in t._jdf.queryExecution().executedPlan().toString()
    got = {r["image_id"]: tuple(r)[1:3] for r in t.collect()}
    assert got == {1: (float(np.median([0 if y == 5 else 10 + y for y in range(2, 8)])), float(np.median([10 + y for y in range(36, 44)]))), 2: (None, None)}


def test_marks_of_a_grid(spark):
    """Marks at word ends, repeated, outside, and none at all."""
    marks = [(1, 0, 0), (1, 0, 63), (1, 0, 64), (1, 2, 69), (1, 2, 69), (1, 1, -1), (1, 1, 70), (1, 3, 0), (1, -1, 5), (9, 0, 0)]
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    d = pixels.grid(images, 3, 70, spark.createDataFrame(marks, "image_id long, y long, x long"))
    assert d.count() == 2 * 3 * 70 and d.columns == ["image_id", "y", "x", "hit"] and d.where("hit IS NULL").count() == 0
    assert sorted(tuple(r)[:3] for r in d.where("hit").collect()) == [(1, 0, 0), (1, 0, 63), (1, 0, 64), (1, 2, 69)]


def test_photos_are_matched_one_to_one(spark):
    y, x = np.mgrid[:120, :120]
    hands = {"1": ((x - 60) / 40.0) ** 2 + ((y - 60) / 20.0) ** 2 < 1, "2": (abs(x - 60) < 25) & (abs(y - 60) < 24)}
    rows = [("s", k, *m.shape, bytearray(m.astype(np.uint8).tobytes()), 9.0 if k == "1" else 1.0, 3.0 if k == "1" else 2.0) for k, m in hands.items()]
    h = spark.createDataFrame(rows, "sheet string, corolla_id string, h int, w int, mask binary, hand_length double, hand_width double")
    photos = [("s", f"p{k}", *np.roll(m, 9, (0, 1)).shape, bytearray(np.roll(m, 9, (0, 1)).astype(np.uint8).tobytes())) for k, m in hands.items()]
    out = {r["corolla_id"]: r for r in imaging.match_photos(spark.createDataFrame(photos, "sheet string, photo string, h int, w int, mask binary"), h).collect()}
    assert {k: r["photo"] for k, r in out.items()} == {"1": "p1", "2": "p2"} and all(r["match_iou"] > 0.9 for r in out.values())
    assert out["1"]["corolla_length_mm"] > out["1"]["corolla_width_obs_mm"] and out["2"]["corolla_length_mm"] <= out["2"]["corolla_width_obs_mm"]


def test_frames_stand_upright(spark):
    m = np.zeros((60, 90), np.uint8)
    m[25:35, 5:85] = 1
    p = np.zeros_like(m)
    p[27:30, 10:40] = 1
    d = spark.createDataFrame([(1, 60, 90, bytearray(m.tobytes()), bytearray(p.tobytes()))], "image_id long, h int, w int, mask binary, pattern binary")
    r = imaging.upright_frames(d).first()
    frame = np.frombuffer(r["mask"], np.uint8).reshape(r["h"], r["w"])
    assert min(r["h"], r["w"]) <= 12 and abs(int(frame.sum()) - int(m.sum())) < 60 and abs(sum(r["pattern"]) - int(p.sum())) < 20
