"""Rank statistics and multiple-testing correction: ordered counts over ranges of values, and windows over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corymb.functions import tails
from corymb.sources.scratch import scratch


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 within the keys; ties share the mean of their ranks."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    tied = Window.partitionBy(*keys, value) if keys else Window.partitionBy(value)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0)


def ordered_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _t, _before): how often each value occurs, and how many rows of its key are below it.

    Values are counted where they lie, dealt to ranges in order, and written once; a range adds the sums of
    the ranges before it.  So a key with all rows is the work of many tasks.  Keys are never null.
    """
    spark = df.sparkSession
    path = scratch(spark, "ordered")
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_t"))
    dealt = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, value).withColumn("_at", F.spark_partition_id())
    dealt.write.parquet(path)
    d = spark.read.schema(dealt.schema).parquet(path)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*keys, "_at").agg(F.sum("_t").alias("_s"))  # a row for each range and key in it
    sums = sums.select(*keys, "_at", F.coalesce(F.sum("_s").over(before(*(keys or [F.lit(0)])).orderBy("_at")), F.lit(0)).alias("_b"))
    within = F.coalesce(F.sum("_t").over(before(*keys, "_at").orderBy(value)), F.lit(0))
    return d.join(sums, [*keys, "_at"]).select(*keys, value, "_t", (F.col("_b") + within).alias("_before"))


def _ranked(df: DataFrame, keys: list[str], value: str, digits: int, few: bool) -> DataFrame:
    """``df`` with ``_v``, its average rank ``_r`` and the number of its ties ``_t``; with ``few`` rows a key by a window.

    Values are rounded first: the last bit of a mean depends on the order of its sum and would break ties.
    """
    d = df.where(F.col(value).isNotNull()).withColumn("_v", F.round(value, digits))
    if few:
        return d.withColumns({"_r": average_rank("_v", *keys), "_t": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_v"))})
    ranks = ordered_counts(d, keys, "_v").select(*keys, "_v", "_t", (F.col("_before") + (F.col("_t") + 1) / F.lit(2.0)).alias("_r"))
    return d.join(ranks, [*keys, "_v"])


def _ties() -> Column:
    """The sum of t^3 - t over groups of t equal values, as a sum over rows."""
    return F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("ties")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, q): interpolated quantiles as an array, from ordered counts; nulls are left out."""
    o = ordered_counts(df.where(F.col(value).isNotNull()), keys, value)
    total = o.groupBy(*keys).agg(F.sum("_t").alias("n"))
    o = o.join(total, keys) if keys else o.crossJoin(F.broadcast(total))  # one row
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    held = lambda i: F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_t")), F.col(value)))
    d = o.groupBy(*keys, "n").agg(*(x for i, h in enumerate(at) for x in (held(F.floor(h)).alias(f"_a{i}"), held(F.ceil(h)).alias(f"_b{i}"))))
    return d.select(*keys, "n", F.array(*(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (h - F.floor(h)) for i, h in enumerate(at))).alias("q"))


def kruskal(df: DataFrame, keys: list[str], group: str, value: str, *, least: int = 2, digits: int = 8, p_value: bool = True) -> DataFrame:
    """(keys, n, k, h[, p]) of groups with ``least`` members, corrected for ties."""
    d = df.where(F.col(value).isNotNull())
    large = d.groupBy(*keys, group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")  # a row a group
    r = _ranked(d.join(large, [*keys, group], "left_semi"), keys, value, digits, False)
    g = r.groupBy(*keys, group).agg(F.sum("_r").alias("s"), F.count("*").alias("m"), _ties())
    s = g.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.count("*").alias("k"), F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("q") - F.lit(3.0) * (n + 1)
    out = s.select(*keys, "n", "k", F.when(F.col("k") >= 2, F.try_divide(raw, F.lit(1.0) - F.col("ties") / (n * n * n - n))).alias("h"))
    return out.withColumn("p", tails.chi2_p(F.col("h"), F.col("k") - 1)) if p_value else out


def pearson(df: DataFrame, keys: list[str], x: str, y: str, *, least: int = 4, p_value: bool = True) -> DataFrame:
    """(keys, n, r[, p]); null with fewer than ``least`` complete pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("_c"))
    out = d.select(*keys, "n", F.when((F.col("n") >= least) & ~F.isnan("_c"), F.col("_c")).alias("r"))
    return out.withColumn("p", tails.pearson_p(F.col("r"), F.col("n"))) if p_value else out


def spearman(df: DataFrame, keys: list[str], x: str, y: str, *, least: int = 3, digits: int = 8, p_value: bool = True, few: bool = False) -> DataFrame:
    """(keys, n, rho[, p]): Pearson's correlation of average ranks; ``few`` rows a key are ranked by windows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": F.round(x, digits), "_y": F.round(y, digits)})
    for name in ("x", "y"):
        d = _ranked(d, keys, f"_{name}", digits, few).drop("_v", "_t").withColumnRenamed("_r", f"_r{name}")
    r = d
    return pearson(r, keys, "_rx", "_ry", least=least, p_value=p_value).withColumnRenamed("r", "rho")


def mann_whitney(df: DataFrame, keys: list[str], side: str, value: str, *, digits: int = 8, p_value: bool = True, few: bool = False) -> DataFrame:
    """(keys, n1, n2, u, z[, p]): is the first side (``side`` true) lower?  Normal approximation with tie and continuity correction."""
    r = _ranked(df, keys, value, digits, few)
    s = r.groupBy(*keys).agg(F.count_if(F.col(side)).alias("n1"), F.count_if(~F.col(side)).alias("n2"), F.sum(F.when(F.col(side), F.col("_r"))).alias("r1"), _ties())
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.try_divide(u - n1 * n2 / 2.0 + 0.5, sd))
    out = s.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))
    return out.withColumn("p", tails.normal_p(-F.col("z"))) if p_value else out


def wilcoxon(df: DataFrame, keys: list[str], value: str, null: float = 0.0, *, digits: int = 8, p_value: bool = True) -> DataFrame:
    """(keys, n, w, z[, p]): is the value above ``null``?  Zeros are dropped; normal approximation with tie correction."""
    d = df.where(F.col(value).isNotNull()).withColumn("_d", F.round(F.col(value) - F.lit(null), digits)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = _ranked(d, keys, "_a", digits, False)
    s = r.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w"), _ties())
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w") - n * (n + 1) / 4.0, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0))
    out = s.select(*keys, "n", "w", z.alias("z"))
    return out.withColumn("p", tails.normal_p(F.col("z"))) if p_value else out


def adjusted(df: DataFrame, p: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p values; a missing p counts as 1.  One row a test: small by nature."""
    keys = keys or []
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    d = df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    d = d.withColumn("_k", F.row_number().over(base.orderBy("_p"))).withColumn("_m", F.count("*").over(base))
    step = F.min(F.col("_p") * F.col("_m") / F.col("_k")).over(base.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, F.least(step, F.lit(1.0))).drop("_p", "_k", "_m")


def centred(value: str, *keys: str) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*keys))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z scores (n - 1 in the variance): a one-row aggregate joined back, no global sort."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    d = df.crossJoin(F.broadcast(stats))  # one row
    return d.select(*(c for c in df.columns if c not in columns), *(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in columns))
