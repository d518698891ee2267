"""Image measurements as plans over a pixel table (image_id, y, x, ...): no pixel leaves the JVM.

``mask`` and the like are boolean columns.  Every operator groups by ``image_id``, so images are
spread over all tasks and one image's pixels are summed where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corymb.functions.scalars import MM_PER_PX
from corymb.operators.ranks import mann_whitney

ID = "image_id"
#: The synthetic flower's corners (x, y) and its spots (x, y, radius), in shares of the image's size.
CORNERS = ((0.42, 0.14), (0.58, 0.14), (0.70, 0.42), (0.79, 0.70), (0.64, 0.83), (0.50, 0.75), (0.36, 0.83), (0.21, 0.70), (0.30, 0.42))
SPOTS = ((0.43, 0.38, 0.025), (0.55, 0.41, 0.022), (0.39, 0.52, 0.020), (0.51, 0.55, 0.026), (0.61, 0.58, 0.019), (0.47, 0.66, 0.017))


def grid(images: DataFrame, height: int, width: int, marks: DataFrame | None = None) -> DataFrame:
    """``images`` (image_id, ...) with the pixels (y, x) of each, in reading order.

    With ``marks`` (image_id, y, x) a pixel has ``hit`` too, whether it is among them.  An image's marks become one row of
    bits that is joined and dealt by ``image_id`` before pixels are made: no pixel is shuffled or broadcast for them, and
    what groups by image later finds its pixels in one task.
    """
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if marks is None:
        return images.withColumn("y", span(height)).withColumn("x", span(width))
    words = -(-width // 64)
    place = lambda x: F.col(x).bitwiseAND(63).cast("int")
    inside = marks.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(ID, (F.col("y") * words + F.shiftright("x", 6)).alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), place("x")).alias("bit"))
    rows = inside.groupBy(ID, "k").agg(F.bit_or("bit").alias("bits")).groupBy(ID).agg(F.map_from_entries(F.collect_list(F.struct("k", "bits"))).alias("_marks"))
    dealt = images.join(rows, ID, "left").repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), ID)
    row = F.array(*(F.coalesce(F.try_element_at("_marks", F.col("y") * words + i), F.lit(0).cast("long")) for i in range(words)))
    lines = dealt.withColumn("y", span(height)).withColumn("_row", row).drop("_marks").withColumn("x", span(width))
    hit = F.call_function("shiftright", F.get("_row", F.shiftright("x", 6).cast("int")), place("x")).bitwiseAND(1) == 1
    return lines.withColumn("hit", hit).drop("_row")


def _with_image(d: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels with their image's row: a task hashes its images, so pixels are neither sorted nor broadcast, however few they seem to be."""
    return d.join(images.hint("shuffle_hash"), ID)


def polygon_contains(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd test: an odd number of edges lies to the right of the point."""
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            hits = hits + (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1)) + F.lit(x1))).cast("int")
    return hits % 2 == 1


def edge_pixels(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int, bool, int]]:
    """(u, v, |du|, |dv|, steep, sign) of each edge: its left end, along its longer side, and which way the other goes.

    Pixel number i along the longer side lies ``(2 i |dv| + |du| - 1) div (2 |du|)`` along the other.
    """
    out = []
    for a, b in zip(points, points[1:] + points[:1], strict=True):
        (x1, y1), (x2, y2) = min(a, b), max(a, b)
        dx, dy = x2 - x1, y2 - y1
        steep = abs(dy) > dx
        out.append((y1, x1, abs(dy), dx, True, 1 if dy >= 0 else -1) if steep else (x1, y1, dx, abs(dy), False, 1 if dy >= 0 else -1))
    return out


def polygon_covers(x: Column, y: Column, points: list[tuple[int, int]]) -> Column:
    """Inside a polygon of whole-number corners or on a pixel of its drawn edges."""
    inside = polygon_contains(x.cast("double"), y.cast("double"), points)
    for u, v, du, dv, steep, sign in edge_pixels(points):
        along, across = (y, x) if steep else (x, y)
        i = (along - u) * (sign if steep else 1)
        at = F.floor((i * (2 * dv) + (du - 1)) / (2 * max(du, 1))) * (1 if steep else sign)
        inside = inside | (i.between(0, du) & (across - v == at))
    return inside


def synthetic_flower(images: DataFrame, size: int = 256) -> DataFrame:
    """(image_id, y, x, in_roi, in_pattern, r, g, b): a tapered nine-sided flower with six spots in each of ``images`` (image_id)."""
    if size < 96:
        raise ValueError("size must be at least 96")
    d = grid(images.select(ID), size, size)
    roi = polygon_covers(F.col("x"), F.col("y"), [(int(px * size), int(py * size)) for px, py in CORNERS])
    near = F.lit(False)
    for sx, sy, r in SPOTS:
        near = near | ((F.col("x") - int(sx * size)) * (F.col("x") - int(sx * size)) + (F.col("y") - int(sy * size)) * (F.col("y") - int(sy * size)) <= max(2, int(r * size)) ** 2)
    d = d.withColumns({"in_roi": roi, "in_pattern": roi & near})
    pick = lambda a, b, c: F.when(F.col("in_pattern"), a).when(F.col("in_roi"), b).otherwise(c).cast("smallint")
    return d.withColumns({"r": pick(112, 225, 242), "g": pick(48, 188, 242), "b": pick(145, 220, 242)})


def bounding_box(d: DataFrame, mask: str) -> DataFrame:
    return d.where(mask).groupBy(ID).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n_px"))


def cropped(d: DataFrame, mask: str) -> DataFrame:
    """Pixels of each image's mask box, shifted to its corner; the origin is kept as (x0, y0)."""
    b = bounding_box(d, mask).drop("n_px")
    return _with_image(d, b).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x1", "y1")


def coverage(d: DataFrame, pattern: str, roi: str, least: int = 150) -> DataFrame:
    """(image_id, pattern_px, roi_px, coverage_pct, has_pattern)"""
    out = d.where(roi).groupBy(ID).agg(F.count_if(pattern).alias("pattern_px"), F.count("*").alias("roi_px"))
    return out.select("*", (F.col("pattern_px") * 100.0 / F.col("roi_px")).alias("coverage_pct"), (F.col("pattern_px") >= least).cast("int").alias("has_pattern"))


def centroid(d: DataFrame, mask: str, keys: tuple[str, ...] = (ID,)) -> DataFrame:
    return d.where(mask).groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("n_px"))


def width_profile(d: DataFrame, mask: str) -> DataFrame:
    """(image_id, y, width): extent of each row, 0 for empty rows within the mask's box."""
    rows = d.where(mask).groupBy(ID, "y").agg((F.max("x") - F.min("x") + 1).alias("width"), F.min("x").alias("left"), F.max("x").alias("right"))
    # a row stands for the empty ones up to the next, too: windows over an image's rows, no join
    after = F.lead("y").over(Window.partitionBy(ID).orderBy("y"))
    every = rows.withColumn("_to", F.coalesce(after - 1, F.col("y"))).withColumn("_y", F.explode(F.sequence("y", "_to")))
    some = F.col("y") == F.col("_y")
    return every.select(ID, F.col("_y").alias("y"), F.when(some, F.col("width")).otherwise(0).alias("width"), *(F.when(some, F.col(c)).alias(c) for c in ("left", "right")))


def _band(lo: float, hi: float):
    """Whether a row of a profile lies from share ``lo`` to share ``hi`` of its image's height."""
    image = Window.partitionBy(ID)
    i, n = F.col("y") - F.min("y").over(image), F.count("*").over(image)
    return (i >= F.floor(F.lit(lo) * n)) & (i < F.floor(F.lit(hi) * n))


def band_median(profile: DataFrame, lo: float, hi: float, name: str) -> DataFrame:
    """Median width of the rows from share ``lo`` to share ``hi`` of the height."""
    return profile.withColumn("_in", _band(lo, hi)).where("_in").groupBy(ID).agg(F.median("width").alias(name))


def tube_traits(d: DataFrame, mask: str, mm_per_px: float = MM_PER_PX) -> DataFrame:
    """Throat and mouth width in mm and their ratio; null without a row in a band."""
    p = width_profile(d, mask).withColumns({"_throat": _band(0.04, 0.16), "_mouth": _band(0.72, 0.88)})
    t = p.groupBy(ID).agg(*(F.median(F.when(F.col(f"_{c}"), F.col("width"))).alias(c) for c in ("throat", "mouth")))
    return t.select(ID, (F.col("throat") * mm_per_px).alias("throat_mm"), (F.col("mouth") * mm_per_px).alias("mouth_mm"), F.try_divide("mouth", "throat").alias("flare"))


def lobe_incision(d: DataFrame, mask: str) -> DataFrame:
    """Depth of the notches at the lower edge, px: spread of the lowest pixel over columns; 0 under 8 columns."""
    half = bounding_box(d, mask).select(ID, F.floor((F.col("y0") + F.col("y1") + 1) / 2).alias("_mid"))
    low = _with_image(d.where(mask), half).where("y >= _mid").groupBy(ID, "x").agg(F.max("y").alias("y"))
    q = low.groupBy(ID).agg(F.count("*").alias("n"), F.percentile("y", F.lit(0.98)).alias("a"), F.percentile("y", F.lit(0.15)).alias("b"))
    return q.select(ID, F.when(F.col("n") >= 8, F.col("a") - F.col("b")).otherwise(0.0).alias("incision_px"))


def edge_length(d: DataFrame, mask: str) -> DataFrame:
    """Length of a skeleton: each pixel hands the way to its four later neighbours, which count it if they are drawn."""
    own, way = lambda: F.lit(0.0).alias("w"), lambda n: F.lit(n).cast("long").alias("n")
    ways = ((1, 0, 1.0), (0, 1, 1.0), (1, 1, 2.0**0.5), (-1, 1, 2.0**0.5))
    at = F.explode(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"), own(), way(1)), *(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(w).alias("w"), way(0)) for dx, dy, w in ways))).alias("a")
    met = d.where(mask).select(ID, at).select(ID, "a.*").groupBy(ID, "x", "y").agg((F.sum("n") * F.sum("w")).alias("w"))
    return met.groupBy(ID).agg(F.sum("w").alias("length_px"))


def chord(d: DataFrame, mask: str) -> DataFrame:
    """Both ends of a stroke along its main axis, the axis in closed form from the covariance."""
    m = d.where(mask).groupBy(ID).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    t = F.atan2(F.col("sxy") * 2.0, F.col("sxx") - F.col("syy")) / 2.0
    at = (F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t")
    p = d.where(mask).join(m.withColumn("t", t), ID).select(ID, "x", "y", "t", at.alias("at"))
    e = p.groupBy(ID).agg(F.min_by(F.struct("x", "y"), F.struct("at", "y", "x")).alias("a"), F.max_by(F.struct("x", "y"), F.struct("at", "y", "x")).alias("b"), F.degrees(F.max("t")).alias("angle_deg"))
    return e.select(ID, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("chord_px"), "angle_deg")


def iou(d: DataFrame, a: str, b: str) -> DataFrame:
    return d.groupBy(ID).agg(F.coalesce(F.try_divide(F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))), F.lit(0.0)).alias("iou"))


def channel_statistics(d: DataFrame, mask: str, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(image_id, channel, n, mode, median, p05, p95) of the pixels under a mask; the lowest mode wins ties."""
    # not unpivot: rows stay where their image lies
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels))).alias("c")
    long = d.where(mask).select(ID, each).select(ID, "c.channel", "c.v")
    q = long.groupBy(ID, "channel").agg(F.count("*").alias("n"), F.mode("v", True).alias("mode"), F.median("v").alias("median"), F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return q.select(ID, "channel", "n", "mode", "median", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"))


def density(d: DataFrame, roi: str, pattern: str, rows: int = 160, cols: int = 120, keys: tuple[str, ...] = (), least_share: float = 0.05) -> DataFrame:
    """(keys, row_bin, col_bin, density): share of pattern over many flowers scaled to one frame.

    Bins that hold at most ``least_share`` of the fullest bin's region pixels are null.
    """
    box = bounding_box(d, roi).select(ID, "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("_w"), (F.col("y1") - F.col("y0") + 1).alias("_h"))
    bin_ = lambda v, low, size, n: F.floor((F.col(v) - F.col(low)) * n / F.col(size)).cast("int")
    b = _with_image(d.where(roi), box).withColumns({"row_bin": bin_("y", "y0", "_h", rows), "col_bin": bin_("x", "x0", "_w", cols)})
    s = b.groupBy(*keys, "row_bin", "col_bin").agg(F.count_if(pattern).alias("hit"), F.count("*").alias("all"))
    top = s.groupBy(*keys).agg(F.max("all").alias("_top"))
    s = s.join(top, list(keys)) if keys else s.crossJoin(F.broadcast(top))
    return s.select(*keys, "row_bin", "col_bin", F.when(F.col("all") > F.col("_top") * least_share, F.col("hit") / F.col("all")).alias("density"))


def histogram(d: DataFrame, keys: list[str], value: str, bins: int = 25) -> DataFrame:
    """Density histogram over 0 to 1; the last bin is closed."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    n = d.where(F.col(value).between(0, 1)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("_t"))
    n = n.join(total, keys) if keys else n.crossJoin(F.broadcast(total))
    return n.select(*keys, "bin", (F.col("n") * float(bins) / F.col("_t")).alias("density"))


def stratified_ratio(d: DataFrame, side: str, position: str, distance: str, *, lo: float = 0.0, hi: float = 1.0, bands: int = 8, least: int = 20, name: str = "ratio") -> DataFrame:
    """Mean distance of random pixels over that of pattern pixels (``side`` true), averaged over bands of position.

    Bands are half-open and need ``least`` pixels on both sides; their weight is the number of pattern pixels.
    """
    band = F.floor((F.col(position) - F.lit(lo)) / F.lit((hi - lo) / bands))
    s = d.where((F.col(position) >= lo) & (F.col(position) < hi)).groupBy(ID, band.alias("band")).agg(F.count_if(F.col(side)).alias("n"), F.count_if(~F.col(side)).alias("m"), F.avg(F.when(F.col(side), F.col(distance))).alias("a"), F.avg(F.when(~F.col(side), F.col(distance))).alias("b"))
    ok = s.where((F.col("n") >= least) & (F.col("m") >= least)).groupBy(ID).agg((F.sum(F.col("n") * F.col("b") / (F.col("a") + 1e-6)) / F.sum("n")).alias(name))
    return d.select(ID).distinct().join(ok, ID, "left")


def spatial_metrics(d: DataFrame, least_px: int = 200) -> DataFrame:
    """Where the pattern lies in each flower.  ``d``: (image_id, pattern boolean, pos, dist), pattern and random pixels.

    ``distal_midline_p``: are distal pattern pixels nearer the midline than random ones?  Null up to 20 on a side.
    """
    n = d.groupBy(ID).agg(F.count_if("pattern").alias("n_pattern_px"), F.avg(F.when(F.col("pattern"), (F.col("pos") < 0.33).cast("double"))).alias("basal_frac"), F.avg(F.when(~F.col("pattern"), (F.col("pos") < 0.33).cast("double"))).alias("random_basal_frac"), F.avg(F.when(F.col("pattern"), F.col("pos"))).alias("mean_pos")).where(F.col("n_pattern_px") >= least_px)
    far = mann_whitney(d.where(F.col("pos") >= 0.5), [ID], "pattern", "dist", few=True).where("n1 > 20 AND n2 > 20").select(ID, F.col("z").alias("distal_midline_z"), F.col("p").alias("distal_midline_p"))
    out = n.join(stratified_ratio(d, "pattern", "pos", "dist", name="midline_ratio"), ID, "left").join(stratified_ratio(d, "pattern", "pos", "dist", lo=0.5, bands=4, name="midline_ratio_distal"), ID, "left")
    return out.join(far, ID, "left")


def pooled_samples(d: DataFrame) -> DataFrame:
    """(kind, variable, value): positions and midline distances of pattern and random pixels of all flowers, as a long table."""
    kind = F.when(F.col("pattern"), "guide").otherwise("random").alias("kind")
    return d.select(kind, "pos", "dist").unpivot(["kind"], ["pos", "dist"], "variable", "value")
