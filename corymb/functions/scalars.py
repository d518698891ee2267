"""Scalar expressions on traits, keys, flags, angles and colours.  All of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308
MM_PER_PX = 25.4 / 300.0
LEAST_AREA_MM2, MOST_AREA_MM2 = 80.0, 3200.0


def arcsine_share(percent: Column) -> Column:
    """Angular transform of a percentage; values outside 0 to 100 are taken as the nearest bound."""
    return F.asin(F.sqrt(F.least(F.greatest(percent / F.lit(100.0), F.lit(0.0)), F.lit(1.0))))


def floored_log(x: Column) -> Column:
    """Natural logarithm, with the least positive double in place of anything lower."""
    return F.ln(F.greatest(x, F.lit(TINY)))


def body_size(length: Column, width: Column) -> Column:
    return F.sqrt(length * width)


def ratio(a: Column, b: Column) -> Column:
    """Quotient; null if the divisor is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def site_key(*parts: Column) -> Column:
    return F.concat_ws("_", *(p.cast("string") for p in parts))


def flags(text: Column) -> Column:
    """Flags in ``|``-joined text as an array, in order; null and empty text have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: x != "")


def edit_flags(text: Column, remove: list[str], append: Column) -> Column:
    """``|``-joined flags without some, and with one more where ``append`` isn't null."""
    kept = F.filter(flags(text), lambda x: ~x.isin(remove))
    return F.array_join(F.when(append.isNotNull(), F.array_append(kept, append)).otherwise(kept), "|")


def natural_key(text: Column) -> Column:
    """The integers in a text, in order: sorts ``a2`` before ``a10``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def lenient_double(text: Column) -> Column:
    """Number in a text; null for anything else, ``nan`` too."""
    x = text.cast("string").try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def half_even(x: Column, digits: int) -> Column:
    """Rounding to even on the decimal text; for sinks only, see the notes on rounding."""
    return F.bround(x, digits)


def scientific(x: Column, digits: int = 2) -> Column:
    """Text like 1.23e-04, rounded half to even; null stays null."""
    scale = F.pow(F.lit(10.0), F.coalesce(F.floor(F.log10(F.nullif(F.abs(x), F.lit(0.0)))), F.lit(0)).cast("double") - digits)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}e", F.bround(x / scale, 0) * scale))


def wrap_axis(degrees: Column) -> Column:
    """An axis' angle in (-90, 90]; directions that differ by 180 degrees are one axis."""
    turned = F.pmod(degrees + F.lit(90.0), F.lit(180.0)) - F.lit(90.0)
    return F.when(turned <= -90.0, turned + F.lit(180.0)).otherwise(turned)


def half_turn(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(180.0))


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue(a: Column, b: Column) -> Column:
    return F.degrees(F.atan2(b, a))


def angle_of_correlation(r: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))))


def dominance_gain(after: tuple[Column, Column, Column], before: tuple[Column, Column, Column]) -> Column:
    """How much more the first channel leads the other two after than before."""
    lead = lambda c: c[0] - F.greatest(c[1], c[2])
    return lead(after) - lead(before)


def relative_midline_distance(to_midline: Column, to_edge: Column) -> Column:
    return to_midline / (to_midline + to_edge + F.lit(1e-6))


def _linear(c: Column) -> Column:
    x = c.cast("double") / F.lit(255.0)
    return F.when(x <= 0.04045, x / F.lit(12.92)).otherwise(F.pow((x + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def cielab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB (D65) of sRGB bytes, each channel rounded as an 8-bit image would store it: L in 0 to 100, a, b signed."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    x = (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456
    y = lr * 0.212671 + lg * 0.715160 + lb * 0.072169
    z = (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)
    light = F.when(y > 0.008856, F.cbrt(y) * 116.0 - 16.0).otherwise(y * 903.3)
    byte = lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("double")
    return byte(light * 255.0 / 100.0) * 100.0 / 255.0, byte((f(x) - f(y)) * 500.0 + 128.0) - 128.0, byte((f(y) - f(z)) * 200.0 + 128.0) - 128.0


def hash_draw(key: Column, n: Column) -> Column:
    """A number in 0 to n - 1 that depends on the key alone: resampling that any engine can repeat."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("long")
