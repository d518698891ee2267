"""Queries over the pixels of scans, one a supplier, and colour mixtures over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corymb.functions import scalars as sc
from corymb.operators import mixture, pixels
from corymb.plans.base import table
from corymb.plans.registry import query
from corymb.sources.scratch import written

#: A scan's rows and columns.
H, W = 96, 80
#: Each supplier is a scan: its nation shapes the flower, its line items are the pattern's pixels.
GRID = f"""g AS (SELECT s_suppkey::BIGINT AS image_id, s_nationkey::BIGINT AS v, (i // {W})::BIGINT AS y, (i % {W})::BIGINT AS x FROM supplier, range({H * W}) t(i)),
li AS (SELECT DISTINCT l_suppkey::BIGINT AS image_id, (l_orderkey % {H})::BIGINT AS y, (l_partkey % {W})::BIGINT AS x, true AS hit FROM lineitem),
px AS (SELECT image_id, v, y, x, (x - 40) * (x - 40) * (3 + v % 4) + (y - 48) * (y - 48) * 2 <= 3600 AS roi, (x - 40) * (x - 40) * (3 + v % 4) + (y - 48) * (y - 48) * 2 <= 3600 AND hit IS NOT NULL AS pat,
  (x - 42) * (x - 42) * 4 + (y - 45) * (y - 45) * 2 <= 3600 AS other, (y = 40 AND x BETWEEN 10 AND 40) OR (x - y = v AND y < 30) AS stroke, (x * 5 + y * 3 + v) % 256 AS r, (x * 11 + y) % 256 AS g, (y * 7 + v * 2) % 256 AS b FROM g LEFT JOIN li USING (image_id, y, x))"""


def _pixels(spark, sf_dir):
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    scans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("image_id"), F.col("s_nationkey").cast("long").alias("v"))
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("image_id"), (F.col("l_orderkey") % H).cast("long").alias("y"), (F.col("l_partkey") % W).cast("long").alias("x"))
    roi = (x - 40) * (x - 40) * (F.lit(3) + v % 4) + (y - 48) * (y - 48) * 2 <= 3600
    return pixels.grid(scans, H, W, hits).select(
        "image_id", "v", "y", "x", roi.alias("roi"), (roi & F.col("hit")).alias("pat"), ((x - 42) * (x - 42) * 4 + (y - 45) * (y - 45) * 2 <= 3600).alias("other"),
        (((y == 40) & x.between(10, 40)) | ((x - y == v) & (y < 30))).alias("stroke"), ((x * 5 + y * 3 + v) % 256).alias("r"), ((x * 11 + y) % 256).alias("g"), ((y * 7 + v * 2) % 256).alias("b"),
    )


_BOX = "bx AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n_px FROM px WHERE roi GROUP BY image_id)"
_PROFILE = f"{GRID}, pr AS (SELECT image_id, y, max(x) - min(x) + 1 AS width FROM px WHERE roi GROUP BY ALL), e AS (SELECT image_id, min(y) AS a, count(*) AS n FROM pr GROUP BY 1)"


@query("pixel_bounding_box", f"WITH {GRID}, {_BOX} SELECT * FROM bx")
def pixel_bounding_box(spark, sf_dir):
    return pixels.bounding_box(_pixels(spark, sf_dir), "roi")


@query("pixel_crop", f"WITH {GRID}, {_BOX} SELECT image_id, count(*) AS n, sum(x - x0) AS sx, sum(y - y0) AS sy FROM px JOIN bx USING (image_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY image_id")
def pixel_crop(spark, sf_dir):
    return pixels.cropped(_pixels(spark, sf_dir), "roi").groupBy("image_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("pixel_coverage", f"WITH {GRID} SELECT image_id, count(*) FILTER (WHERE pat) AS pattern_px, count(*) AS roi_px, round(100.0::DOUBLE * count(*) FILTER (WHERE pat) / count(*), 6) AS coverage_pct, CAST(count(*) FILTER (WHERE pat) >= 300 AS INTEGER) AS has_pattern FROM px WHERE roi GROUP BY image_id")
def pixel_coverage(spark, sf_dir):
    return pixels.coverage(_pixels(spark, sf_dir), "pat", "roi", 300).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("pixel_centroid", f"WITH {GRID} SELECT image_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, max(y) - min(y) + 1 AS height, count(*) AS n_px FROM px WHERE pat GROUP BY image_id")
def pixel_centroid(spark, sf_dir):
    return pixels.centroid(_pixels(spark, sf_dir), "pat").withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query("pixel_width_profile", f"WITH {_PROFILE} SELECT image_id, y, width FROM pr")
def pixel_width_profile(spark, sf_dir):
    return pixels.width_profile(_pixels(spark, sf_dir), "roi").select("image_id", "y", "width")


@query("pixel_tube_traits", f"WITH {_PROFILE}, t AS (SELECT image_id, median(width) FILTER (WHERE y - a >= floor(0.04::DOUBLE * n) AND y - a < floor(0.16::DOUBLE * n)) AS throat, median(width) FILTER (WHERE y - a >= floor(0.72::DOUBLE * n) AND y - a < floor(0.88::DOUBLE * n)) AS mouth FROM pr JOIN e USING (image_id) GROUP BY image_id) SELECT image_id, round(throat * {sc.MM_PER_PX!r}::DOUBLE, 6) AS throat_mm, round(mouth * {sc.MM_PER_PX!r}::DOUBLE, 6) AS mouth_mm, round(mouth / throat, 6) AS flare FROM t")
def pixel_tube_traits(spark, sf_dir):
    return pixels.tube_traits(_pixels(spark, sf_dir), "roi").select("image_id", *(F.round(c, 6).alias(c) for c in ("throat_mm", "mouth_mm", "flare")))


@query("pixel_lobe_incision", f"WITH {GRID}, {_BOX}, l AS (SELECT image_id, x, max(y) AS y FROM px JOIN bx USING (image_id) WHERE roi AND y >= (y0 + y1 + 1) // 2 GROUP BY ALL) SELECT image_id, round(CASE WHEN count(*) >= 8 THEN quantile_cont(y::DOUBLE, 0.98) - quantile_cont(y::DOUBLE, 0.15) ELSE 0 END, 6) AS incision_px FROM l GROUP BY image_id")
def pixel_lobe_incision(spark, sf_dir):
    return pixels.lobe_incision(_pixels(spark, sf_dir), "roi").withColumn("incision_px", F.round("incision_px", 6))


@query(
    "pixel_edge_length",
    f"WITH {GRID}, s AS (SELECT image_id, x, y FROM px WHERE stroke), h AS ({' UNION ALL '.join(f'SELECT a.image_id, {w}::DOUBLE AS w FROM s a JOIN s b ON a.image_id = b.image_id AND b.x = a.x + {dx} AND b.y = a.y + {dy}' for dx, dy, w in ((1, 0, 1), (0, 1, 1), (1, 1, 2**0.5), (-1, 1, 2**0.5)))}) SELECT image_id, round(sum(w), 6) AS length_px FROM h GROUP BY image_id",
)
def pixel_edge_length(spark, sf_dir):
    return pixels.edge_length(_pixels(spark, sf_dir), "stroke").withColumn("length_px", F.round("length_px", 6))


@query(
    "pixel_chord",
    f"""WITH {GRID}, m AS (SELECT image_id, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t FROM px WHERE stroke GROUP BY 1),
p AS (SELECT image_id, x, y, t, (x - mx) * cos(t) + (y - my) * sin(t) AS a FROM px JOIN m USING (image_id) WHERE stroke),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY a, y, x) AS i, row_number() OVER (PARTITION BY image_id ORDER BY a DESC, y DESC, x DESC) AS j FROM p)
SELECT f.image_id, f.x AS x1, f.y AS y1, l.x AS x2, l.y AS y2, round(sqrt((f.x - l.x) ** 2 + (f.y - l.y) ** 2), 6) AS chord_px, round(degrees(f.t), 6) AS angle_deg FROM r f JOIN r l ON f.image_id = l.image_id AND f.i = 1 AND l.j = 1""",
)
def pixel_chord(spark, sf_dir):
    return pixels.chord(_pixels(spark, sf_dir), "stroke").withColumns({c: F.round(c, 6) for c in ("chord_px", "angle_deg")})


@query("pixel_iou", f"WITH {GRID} SELECT image_id, round((count(*) FILTER (WHERE roi AND other))::DOUBLE / count(*) FILTER (WHERE roi OR other), 7) AS iou FROM px GROUP BY image_id")
def pixel_iou(spark, sf_dir):
    return pixels.iou(_pixels(spark, sf_dir), "roi", "other").withColumn("iou", F.round("iou", 7))


@query("pixel_channels", f"WITH {GRID}, l AS (SELECT image_id, 'r' AS channel, r AS v FROM px WHERE pat UNION ALL SELECT image_id, 'g', g FROM px WHERE pat UNION ALL SELECT image_id, 'b', b FROM px WHERE pat), c AS (SELECT image_id, channel, v, count(*) AS c FROM l GROUP BY ALL), m AS (SELECT image_id, channel, v, row_number() OVER (PARTITION BY image_id, channel ORDER BY c DESC, v) AS k FROM c) SELECT l.image_id, l.channel, count(*) AS n, max(m.v) AS mode, round(median(l.v), 4) AS median, round(quantile_cont(l.v::DOUBLE, 0.05), 4) AS p05, round(quantile_cont(l.v::DOUBLE, 0.95), 4) AS p95 FROM l JOIN m ON m.image_id = l.image_id AND m.channel = l.channel AND k = 1 GROUP BY l.image_id, l.channel")
def pixel_channels(spark, sf_dir):
    return pixels.channel_statistics(_pixels(spark, sf_dir), "pat").select("image_id", "channel", "n", "mode", *(F.round(c, 4).alias(c) for c in ("median", "p05", "p95")))


@query("pixel_density", f"WITH {GRID}, {_BOX}, b AS (SELECT v % 3 AS island, ((y - y0) * 16) // (y1 - y0 + 1) AS row_bin, ((x - x0) * 12) // (x1 - x0 + 1) AS col_bin, pat FROM px JOIN bx USING (image_id) WHERE roi), s AS (SELECT island, row_bin, col_bin, count(*) FILTER (WHERE pat) AS hit, count(*) AS n FROM b GROUP BY ALL) SELECT island, row_bin::INTEGER AS row_bin, col_bin::INTEGER AS col_bin, round(CASE WHEN n > 0.05::DOUBLE * max(n) OVER (PARTITION BY island) THEN hit::DOUBLE / n END, 7) AS density FROM s")
def pixel_density(spark, sf_dir):
    d = _pixels(spark, sf_dir).withColumn("island", F.col("v") % 3)
    return pixels.density(d, "roi", "pat", 16, 12, ("island",)).withColumn("density", F.round("density", 7))


@query("pixel_histogram", "WITH b AS (SELECT o_orderstatus, least(floor(o_totalprice / 600000 * 25), 24)::INTEGER AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 600000 GROUP BY ALL) SELECT o_orderstatus, bin, round(n * 25.0::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus), 7) AS density FROM b")
def pixel_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice") / 600000).alias("v"))
    return pixels.histogram(d, ["o_orderstatus"], "v").withColumn("density", F.round("density", 7))


_SPOT = f"{GRID}, d AS (SELECT image_id, pat AS pattern, y / {float(H)}::DOUBLE AS pos, abs(x - 40) / 40.0::DOUBLE AS dist FROM px WHERE roi)"
_RATIO = "SELECT image_id, sum(n * b / (a + 1e-6)) / sum(n) AS {name} FROM (SELECT image_id, floor((pos - {lo}::DOUBLE) / {step}::DOUBLE) AS band, count(*) FILTER (WHERE pattern) AS n, count(*) FILTER (WHERE NOT pattern) AS m, avg(dist) FILTER (WHERE pattern) AS a, avg(dist) FILTER (WHERE NOT pattern) AS b FROM d WHERE pos >= {lo} AND pos < 1 GROUP BY ALL) WHERE n >= 20 AND m >= 20 GROUP BY image_id"


@query("pixel_spatial_metrics", f"WITH {_SPOT}, s AS (SELECT image_id, count(*) FILTER (WHERE pattern) AS n_pattern_px, avg((pos < 0.33)::INTEGER) FILTER (WHERE pattern) AS basal_frac, avg((pos < 0.33)::INTEGER) FILTER (WHERE NOT pattern) AS random_basal_frac, avg(pos) FILTER (WHERE pattern) AS mean_pos FROM d GROUP BY image_id), a AS ({_RATIO.format(name='midline_ratio', lo='0.0', step='0.125')}), b AS ({_RATIO.format(name='midline_ratio_distal', lo='0.5', step='0.125')}) SELECT image_id, n_pattern_px, round(basal_frac, 6) AS basal_frac, round(random_basal_frac, 6) AS random_basal_frac, round(mean_pos, 6) AS mean_pos, round(midline_ratio, 5) AS midline_ratio, round(midline_ratio_distal, 5) AS midline_ratio_distal FROM s LEFT JOIN a USING (image_id) LEFT JOIN b USING (image_id) WHERE n_pattern_px >= 200")
def pixel_spatial_metrics(spark, sf_dir):
    d = _pixels(spark, sf_dir).where("roi").select("image_id", F.col("pat").alias("pattern"), (F.col("y") / float(H)).alias("pos"), (F.abs(F.col("x") - 40) / 40.0).alias("dist"))
    m = pixels.spatial_metrics(d)
    return m.select("image_id", "n_pattern_px", *(F.round(c, 6).alias(c) for c in ("basal_frac", "random_basal_frac", "mean_pos")), *(F.round(c, 5).alias(c) for c in ("midline_ratio", "midline_ratio_distal")))


@query("pooled_samples", f"WITH {_SPOT} SELECT CASE WHEN pattern THEN 'guide' ELSE 'random' END AS kind, 'pos' AS variable, count(*) AS n, round(avg(pos), 6) AS mean FROM d GROUP BY ALL UNION ALL SELECT CASE WHEN pattern THEN 'guide' ELSE 'random' END, 'dist', count(*), round(avg(dist), 6) FROM d GROUP BY ALL")
def pooled_samples(spark, sf_dir):
    """Samples of all flowers, written once, and their means."""
    d = _pixels(spark, sf_dir).where("roi").select("image_id", F.col("pat").alias("pattern"), (F.col("y") / float(H)).alias("pos"), (F.abs(F.col("x") - 40) / 40.0).alias("dist"))
    return written(pixels.pooled_samples(d), "samples").groupBy("kind", "variable").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("pixel_dominance_gain", f"WITH {GRID} SELECT image_id, sum((r - greatest(g, b)) - (g - greatest(r, b))) AS gain FROM px WHERE roi GROUP BY image_id")
def pixel_dominance_gain(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _pixels(spark, sf_dir).where("roi").groupBy("image_id").agg(F.sum(sc.dominance_gain((r, g, b), (g, r, b))).alias("gain"))


def _flower_sql(size: int) -> str:
    """CTE ``fl`` (image_id, y, x, in_roi, in_pattern, r, g, b) of the made-up flower."""
    corners = [(int(a * size), int(b * size)) for a, b in pixels.CORNERS]
    hits = [f"(({y1} > y) <> ({y2} > y) AND x < (y - {y1}) * ({x2 - x1} / {y2 - y1}.0::DOUBLE) + {x1})::INTEGER" for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True) if y1 != y2]
    drawn = []
    for u, v, du, dv, steep, sign in pixels.edge_pixels(corners):
        along, across = ("y", "x") if steep else ("x", "y")
        i = f"(({along} - {u}) * {sign if steep else 1})"
        drawn.append(f"({i} BETWEEN 0 AND {du} AND {across} - {v} = (({i} * {2 * dv} + {du - 1}) // {2 * max(du, 1)}) * {1 if steep else sign})")
    spots = " OR ".join(f"(x - {int(a * size)}) ** 2 + (y - {int(b * size)}) ** 2 <= {max(2, int(r * size)) ** 2}" for a, b, r in pixels.SPOTS)
    pick = lambda a, b, c: f"(CASE WHEN in_pattern THEN {a} WHEN in_roi THEN {b} ELSE {c} END)::SMALLINT"
    return f"""q0 AS (SELECT s_suppkey::BIGINT AS image_id, (i // {size})::BIGINT AS y, (i % {size})::BIGINT AS x FROM supplier, range({size * size}) t(i) WHERE s_nationkey % 3 = {(size - 96) // 16}), q1 AS (SELECT *, ({' + '.join(hits)}) % 2 = 1 OR {' OR '.join(drawn)} AS in_roi FROM q0),
q2 AS (SELECT *, in_roi AND ({spots}) AS in_pattern FROM q1), fl AS (SELECT *, {pick(112, 225, 242)} AS r, {pick(48, 188, 242)} AS g, {pick(145, 220, 242)} AS b FROM q2)"""


_FLOWER = "SELECT image_id, {size} AS size, count(*) FILTER (WHERE in_roi) AS roi_px, count(*) FILTER (WHERE in_pattern) AS pattern_px, sum(CASE WHEN in_roi THEN x * 1000 + y END)::BIGINT AS places, sum(r::BIGINT + 3 * g + 7 * b)::BIGINT AS colours FROM fl GROUP BY image_id"


@query("synthetic_flower", " UNION ALL ".join(f"(WITH {_flower_sql(size)} {_FLOWER.format(size=size)})" for size in (96, 112, 128)))
def synthetic_flower(spark, sf_dir):
    """A made-up flower for each supplier, its size by the nation: pixels, places and colours summed up."""
    out = None
    for k, size in enumerate((96, 112, 128)):
        scans = table(spark, sf_dir, "supplier").where(F.col("s_nationkey") % 3 == k).select(F.col("s_suppkey").cast("long").alias("image_id"))
        d = pixels.synthetic_flower(scans, size).groupBy("image_id").agg(F.lit(size).alias("size"), F.count_if("in_roi").alias("roi_px"), F.count_if("in_pattern").alias("pattern_px"), F.sum(F.when(F.col("in_roi"), F.col("x") * 1000 + F.col("y"))).alias("places"), F.sum(F.col("r").cast("long") + F.col("g") * 3 + F.col("b") * 7).alias("colours"))
        out = d if out is None else out.unionByName(d)
    return out


_LINEAR = "(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92 ELSE (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4::DOUBLE END)"
_F = "(CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END)"
_BYTE = "least(greatest(floor({v} + 0.5::DOUBLE), 0), 255)"


@query(
    "cielab_of_pixels",
    f"""WITH {GRID}, a AS (SELECT roi AS in_roi, pat AS in_pattern, {', '.join(f'{_LINEAR.format(c=c)} AS l{c}' for c in 'rgb')} FROM px),
z AS (SELECT in_roi, in_pattern, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456::DOUBLE AS x, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS y, (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754::DOUBLE AS z FROM a)
SELECT in_roi, in_pattern, count(*) AS n, round(avg({_BYTE.format(v='CASE WHEN y > 0.008856::DOUBLE THEN 116 * cbrt(y) - 16 ELSE 903.3::DOUBLE * y END * 2.55::DOUBLE')} / 2.55::DOUBLE), 6) AS l_star, round(avg({_BYTE.format(v=f"500 * ({_F.format(t='x')} - {_F.format(t='y')}) + 128")} - 128), 6) AS a_star, round(avg({_BYTE.format(v=f"200 * ({_F.format(t='y')} - {_F.format(t='z')}) + 128")} - 128), 6) AS b_star FROM z GROUP BY ALL""",
)
def cielab_of_pixels(spark, sf_dir):
    light, a, b = sc.cielab(F.col("r"), F.col("g"), F.col("b"))
    return _pixels(spark, sf_dir).groupBy(F.col("roi").alias("in_roi"), F.col("pat").alias("in_pattern")).agg(F.count("*").alias("n"), *(F.round(F.avg(v), 6).alias(c) for v, c in ((light, "l_star"), (a, "a_star"), (b, "b_star"))))


_FIXED = mixture.ColourMixture(["a", "b"], [0.5, 0.3, 0.2], [[0.0, 0.0], [0.1, -0.1], [-0.1, 0.1]], [[[0.04, 0.01], [0.01, 0.03]], [[0.02, 0.0], [0.0, 0.05]], [[0.03, -0.01], [-0.01, 0.03]]])


def _log_sql(w, m, c) -> str:
    det = c[0][0] * c[1][1] - c[0][1] * c[1][0]
    q = f"({c[1][1]!r}::DOUBLE * (a - {m[0]!r}::DOUBLE) * (a - {m[0]!r}::DOUBLE) - 2 * {c[0][1]!r}::DOUBLE * (a - {m[0]!r}::DOUBLE) * (b - {m[1]!r}::DOUBLE) + {c[0][0]!r}::DOUBLE * (b - {m[1]!r}::DOUBLE) * (b - {m[1]!r}::DOUBLE)) / {det!r}::DOUBLE"
    return f"({w!r}::DOUBLE * exp(-0.5::DOUBLE * {q}) / sqrt({det!r}::DOUBLE))"


_LOGS = [_log_sql(w, m, c) for w, m, c in zip(_FIXED.weights.tolist(), _FIXED.means.tolist(), _FIXED.covariances.tolist(), strict=True)]


def _colours(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query("mixture_posterior", f"WITH c AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT vec_id, round({_LOGS[1]} / ({' + '.join(_LOGS)}), 5) AS guide FROM c")
def mixture_posterior(spark, sf_dir):
    return _colours(spark, sf_dir).select("vec_id", F.round(_FIXED.posterior()[1], 5).alias("guide"))


@query("mixture_fit")
def mixture_fit(spark, sf_dir):
    """Fit a colour mixture and say which component is which: the weights, centres and hues."""
    d = _colours(spark, sf_dir).select((F.col("a") * 100).alias("a"), (F.col("b") * 100).alias("b"))
    m = mixture.fit(d, ["a", "b"], starts=6, iterations=400)
    rows = [(i, float(w), float(c[0]), float(c[1])) for i, (w, c) in enumerate(zip(m.weights, m.means, strict=True))]
    return spark.createDataFrame(rows, "component int, weight double, mean_a double, mean_b double")
