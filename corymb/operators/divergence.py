"""Variance among and within groups: Pst, eta squared, and their resampling.

All statistics are sums over groups: one partial aggregation by (trait, group), then one by trait, so
rows of a hot group are summed where they lie.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corymb.functions.scalars import hash_draw


def group_sums(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, group, n, mean, ss): ss is the sum of squares around the group's mean."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("_v")).withColumn("ss", F.col("_v") * F.col("n")).drop("_v")


def _pst(between: Column, within: Column, n0: Column) -> Column:
    vb = F.greatest((between - within) / n0, F.lit(0.0))
    return F.when(vb + within > 0, F.try_divide(vb, vb + F.lit(2.0) * within)).otherwise(F.lit(0.0))


def pst_from_sums(sums: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, n, k, msb, msw, pst): null where fewer than two groups have ``least`` members, or n <= k."""
    s = sums.where(F.col("n") >= least)
    # between-group sum of squares as sum(n m^2) - (sum n m)^2 / N would cancel; the spread of means is taken around the grand mean
    total = s.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.count("*").alias("k"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand"), F.sum("ss").alias("ssw"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"))
    spread = s.join(total, keys).groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))).alias("ssb")) if keys else s.crossJoin(total).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))).alias("ssb"))
    d = total.join(spread, keys) if keys else total.crossJoin(spread)
    enough = (F.col("k") >= 2) & (F.col("all_n") > F.col("k"))
    msb, msw = F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("all_n") - F.col("k"))
    n0 = F.try_divide(F.col("all_n") - F.col("nn") / F.col("all_n"), F.col("k") - 1)
    return d.select(*keys, F.col("all_n").alias("n"), "k", F.when(enough, msb).alias("msb"), F.when(enough, msw).alias("msw"), F.when(enough, _pst(msb, msw, n0)).alias("pst"))


def pst(df: DataFrame, keys: list[str], group: str, value: str, least: int = 2) -> DataFrame:
    return pst_from_sums(group_sums(df, keys, group, value), keys, least)


def pairwise_pst(df: DataFrame, keys: list[str], group: str, value: str, order: str, least: int = 2) -> DataFrame:
    """Pst of every pair of groups, from the groups' sums: the rows are read once."""
    s = group_sums(df, [*keys, order], group, value)
    a = s.select(*keys, F.col(group).alias("group_a"), F.col(order).alias("_oa"), F.col("n").alias("n_a"), F.col("mean").alias("_ma"), F.col("ss").alias("_sa"))
    b = s.select(*keys, F.col(group).alias("group_b"), F.col(order).alias("_ob"), F.col("n").alias("n_b"), F.col("mean").alias("_mb"), F.col("ss").alias("_sb"))
    d = a.join(b, keys).where("_oa < _ob")
    n = F.col("n_a") + F.col("n_b")
    msb = F.col("n_a") * F.col("n_b") / n * F.pow(F.col("_ma") - F.col("_mb"), F.lit(2.0))
    msw = F.try_divide(F.col("_sa") + F.col("_sb"), n - 2)
    n0 = n - (F.col("n_a") * F.col("n_a") + F.col("n_b") * F.col("n_b")) / n
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least) & (n > 2)
    return d.select(*keys, "group_a", "group_b", "n_a", "n_b", F.when(enough, _pst(msb, msw, n0)).alias("pst"))


def eta_squared(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Share of the sum of squares that lies among groups; 0 where nothing varies."""
    s = group_sums(df, keys, group, value)
    g = s.groupBy(*keys).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand"))
    d = s.join(g, keys) if keys else s.crossJoin(g)
    out = d.groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))).alias("ssb"), F.sum("ss").alias("ssw"))
    return out.select(*keys, F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw"))).otherwise(F.lit(0.0)).alias("eta2"))


def bootstrap_sums(df: DataFrame, keys: list[str], group: str, value: str, unit: str, reps: int, seed: int = 0) -> DataFrame:
    """Group sums of ``reps`` resamples within groups.

    Draw j of a group picks the member that the hash of (seed, repetition, trait, group, j) points to, so the
    result depends on no partitioning and can be repeated in SQL.  Members are numbered by ``unit``.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, group)
    numbered = df.where(F.col(value).isNotNull()).select(*keys, group, F.col(value).alias("_x"), (F.row_number().over(w.orderBy(unit)) - 1).cast("long").alias("_i"))
    sizes = numbered.groupBy(*keys, group).agg(F.count("*").alias("_n"))
    spark = df.sparkSession
    draws = sizes.join(spark.range(reps).withColumnRenamed("id", "rep")).select(*keys, group, "rep", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_j"))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), *(F.col(k).cast("string") for k in (*keys, group)), F.col("_j").cast("string"))
    picked = draws.withColumn("_i", hash_draw(name, F.col("_n"))).join(numbered, [*keys, group, "_i"])
    return picked.groupBy(*keys, "rep", group).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), (F.var_pop("_x") * F.count("*")).alias("ss"))


def bootstrap_interval(df: DataFrame, keys: list[str], group: str, value: str, unit: str, reps: int = 2000, seed: int = 0, least: int = 2) -> DataFrame:
    """(keys, lo, hi, reps): the 2.5 and 97.5 % quantiles of the resampled Pst, interpolated."""
    p = pst_from_sums(bootstrap_sums(df, keys, group, value, unit, reps, seed), [*keys, "rep"], least)
    out = p.groupBy(*keys).agg(F.percentile("pst", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("pst").alias("reps"))
    return out.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "reps")


#: Bounds between the numbers of a Poisson draw of mean 1, in units of 2**-32.
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12))


def weighted_bootstrap(df: DataFrame, traits: list[str], group: str, unit: str, reps: int = 2000, seed: int = 0, least: int = 2) -> DataFrame:
    """(trait, lo, hi, reps): quantiles of the Pst of resampled units, in a plan that never joins draws to rows.

    Each unit weighs as often as a Poisson draw says, from a hash of (seed, unit, repetition); all traits of
    a unit share it.  So a repetition is a sum where the rows lie, without numbering units or joining draws,
    and a hot group costs no more than its rows.  Group sizes vary about their own; :func:`bootstrap_interval`
    draws exactly as many members as a group has.
    """
    centre = df.agg(*(F.avg(t).alias(f"_m_{t}") for t in traits))  # one row; sums of squares keep their digits
    d = df.crossJoin(F.broadcast(centre)).select(F.col(group).alias("_g"), F.col(unit).cast("string").alias("_u"), *((F.col(t) - F.col(f"_m_{t}")).alias(t) for t in traits))
    # narrow rows are dealt evenly before they are multiplied: adaptive execution would merge a small table into one task
    d = d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = d.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // 4))))
    block = block.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "_u", F.col("_b").cast("string")).cast("binary")))
    each = block.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("rep", F.col("_b") * 4 + F.col("_j")).where(F.col("rep") < reps)
    draw = F.substring(F.col("_h"), F.col("_j") * 8 + 1, F.lit(8))  # hexadecimal digits of equal length compare as their numbers do
    each = each.withColumn("_d", draw).withColumn("_w", reduce(lambda a, t: a + (F.col("_d") >= f"{t:08x}").cast("int"), POISSON, F.lit(0)).cast("double")).where("_w > 0")
    sums = each.groupBy("rep", "_g").agg(*(x for t in traits for x in (F.sum(F.when(F.col(t).isNotNull(), F.col("_w"))).alias(f"n_{t}"), F.sum(F.col("_w") * F.col(t)).alias(f"x_{t}"), F.sum(F.col("_w") * F.col(t) * F.col(t)).alias(f"q_{t}"))))
    long = sums.select("rep", "_g", F.explode(F.array(*(F.struct(F.lit(t).alias("trait"), F.col(f"n_{t}").alias("n"), F.col(f"x_{t}").alias("x"), F.col(f"q_{t}").alias("q")) for t in traits))).alias("s")).select("rep", "_g", "s.*")
    groups = long.select("trait", "rep", "n", (F.col("x") / F.col("n")).alias("mean"), (F.col("q") - F.col("x") * F.col("x") / F.col("n")).alias("ss"))
    p = pst_from_sums(groups, ["trait", "rep"], least)
    out = p.groupBy("trait").agg(F.percentile("pst", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("pst").alias("reps"))
    return out.select("trait", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "reps")


def label_permutation(df: DataFrame, keys: list[str], group: str, value: str, unit: str, reps: int, seed: int = 0) -> DataFrame:
    """(keys, eta2, p): the share of label permutations whose eta squared reaches the observed one.

    A repetition orders the units by a hash and gives the i-th of them the i-th label.
    """
    from pyspark.sql import Window

    d = df.where(F.col(value).isNotNull()).select(*keys, group, F.col(value).alias("_x"), F.col(unit).alias("_u"))
    spark = df.sparkSession
    many = d.join(spark.range(reps).withColumnRenamed("id", "rep"))
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("_u").cast("string")).cast("binary"))
    place = Window.partitionBy(*keys, "rep")
    shuffled = many.withColumn("_p", F.row_number().over(place.orderBy(name, "_u")))
    labels = d.select(*keys, F.col(group).alias("_label"), F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_u")).alias("_p"))
    permuted = shuffled.join(labels, [*keys, "_p"])
    simulated = eta_squared(permuted, [*keys, "rep"], "_label", "_x").withColumnRenamed("eta2", "sim")
    seen = eta_squared(d, keys, group, "_x")
    both = simulated.join(seen, keys) if keys else simulated.crossJoin(seen)
    return both.groupBy(*keys).agg(F.max("eta2").alias("eta2"), ((F.count_if(F.col("sim") >= F.col("eta2") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
