"""Statistical models over sites and groups.

Rows are reduced by aggregation to one row a site (or a few moments a group) before any of it reaches
Python.  Each trait is a task of its own; repetitions run in chunks, each with a seed of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corymb.functions.tails import chi2_p, f_p, normal_sf
from corymb.operators import kernels as k
from corymb.operators.divergence import POISSON, label_permutation
from corymb.operators.ranks import adjusted

TEST = "f double, df_num int, df_den int, parametric_p double, permutation_p double, r2_small double, r2_full double, delta_r2 double, partial_r2 double, coefficient double"


#: Ratios of the variances that a likelihood is first profiled on, then parts of the bracket around the best, and how often it is narrowed.
FIRST_RATIOS, PARTS, ROUNDS = (0.0, *(math.exp(-12 + i / 4) for i in range(81))), 20, 8


def site_lrt(df: DataFrame, trait: str, group: str, site: str, value: str) -> DataFrame:
    """(trait, lrt, df, p): does the mean differ among groups, given that sites differ anyway?

    ``y ~ group`` against ``y ~ 1``, both with a random site intercept (maximum likelihood).  Sites enter by their
    size, mean and sum of squares alone, and the likelihood is profiled over the ratio of the two variances: on a grid
    from 0 on, then on ever finer ones between the neighbours of the best.  A likelihood is a sum over sites, so each
    ratio of each trait is a group of its own.  Null with fewer than two groups or eight rows.
    """
    from corymb.sources.scratch import written

    s = df.where(F.col(value).isNotNull()).groupBy(trait, group, site).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("ss"))
    s = written(s.select(F.col(trait).cast("string").alias("_t"), F.col(group).cast("string").alias("_g"), "n", "mean", "ss"), "sites")
    whole = written(s.groupBy("_t").agg(F.sum("n").alias("total"), F.sum("ss").alias("within"), F.count_distinct("_g").alias("k"), F.avg("mean").alias("centre")), "totals")
    enough = whole.where("k >= 2 AND total >= 8")
    model = F.explode(F.array(F.lit("null"), F.lit("group"))).alias("model")

    def best(grid: DataFrame) -> DataFrame:
        """The likeliest of each trait's and model's ratios (_t, model, i, ratio, ...)."""
        d = s.join(grid.select("_t", "model", "i", "ratio"), "_t").join(enough, "_t")
        w, m = F.col("n") / (1 + F.col("ratio") * F.col("n")), F.col("mean") - F.col("centre")
        part = F.when(F.col("model") == "group", F.col("_g")).otherwise("")
        g = d.groupBy("_t", "model", "i", "ratio", "total", "within", part.alias("part")).agg(F.sum(w).alias("w"), F.sum(w * m).alias("wm"), F.sum(w * m * m).alias("wmm"), F.sum(F.log1p(F.col("ratio") * F.col("n"))).alias("logs"))
        e = g.groupBy("_t", "model", "i", "ratio", "total", "within").agg(F.sum(F.col("wmm") - F.col("wm") * F.col("wm") / F.col("w")).alias("among"), F.sum("logs").alias("logs"))
        like = -0.5 * (F.col("total") * F.ln(F.greatest(F.col("within") + F.col("among"), F.lit(1e-300)) / F.col("total")) + F.col("logs"))
        return e.withColumn("like", like).groupBy("_t", "model").agg(F.max(F.struct("like", (-F.col("i")).alias("j"))).alias("b")).select("_t", "model", F.col("b.like").alias("like"), (-F.col("b.j")).alias("i"))

    first = F.array(*map(F.lit, FIRST_RATIOS))
    grid = enough.select("_t", model).select("_t", "model", F.posexplode(first).alias("i", "ratio"))
    found = written(best(grid), "likelihoods")
    found = found.select("_t", "model", "like", first[F.greatest(F.col("i") - 1, F.lit(0))].alias("lo"), first[F.least(F.col("i") + 1, F.lit(len(FIRST_RATIOS) - 1))].alias("hi"))
    at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / PARTS
    for _ in range(ROUNDS):
        grid = found.select("_t", "model", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(PARTS))).alias("i")).withColumn("ratio", at(F.col("i")))
        now = best(grid).withColumnRenamed("like", "new").join(found, ["_t", "model"])
        found = written(now.select("_t", "model", F.greatest("like", "new").alias("like"), at(F.greatest(F.col("i") - 1, F.lit(0))).alias("lo"), at(F.least(F.col("i") + 1, F.lit(PARTS))).alias("hi")), "likelihoods")
    both = found.groupBy("_t").agg(F.max(F.when(F.col("model") == "group", F.col("like"))).alias("a"), F.max(F.when(F.col("model") == "null", F.col("like"))).alias("b"))
    lrt = whole.join(both, "_t", "left").select(F.col("_t").alias(trait), F.greatest(2 * (F.col("a") - F.col("b")), F.lit(0.0)).alias("lrt"), F.when(F.col("a").isNotNull(), F.col("k") - 1).cast("int").alias("df"))
    return lrt.withColumn("lrt", F.when(F.col("df").isNotNull(), F.col("lrt"))).withColumn("p", chi2_p(F.col("lrt"), F.col("df").cast("double")))


def moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return c.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * F.count("*")).alias("sxx"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"), (F.var_pop(y) * F.count("*")).alias("syy"))


def size_residuals(df: DataFrame, keys: list[str], x: str, y: str, name: str = "residual") -> DataFrame:
    """``df`` with residuals from the line of y on x, and its slope; null where either is missing."""
    m = moments(df, keys, x, y).select(*keys, F.try_divide(F.col("sxy"), F.col("sxx")).alias("slope"), "mx", "my")
    d = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    return d.withColumn(name, F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx"))).drop("mx", "my")


def _designs(groups: int) -> dict[str, list[list[int]]]:
    """For each model, the coefficient of (intercept, slope) of each group: indices into the parameters."""
    return {"size": [[0, 1]] * groups, "additive": [[2 + g, 1] if g else [0, 1] for g in range(groups)], "interaction": [[2 * g, 2 * g + 1] for g in range(groups)]}


def hc3_lines(df: DataFrame, trait: str, group: str, x: str, y: str) -> DataFrame:
    """(trait, model, n, r2, aic, slope, se, p): one line, parallel lines, free lines.

    The p value of the (first group's) slope uses the HC3 covariance and the normal tail.  Two passes of
    moments by (trait, group); rows are never gathered.
    """
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    middle = full.groupBy(trait).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))  # a row a trait: centred sums keep their digits
    d = full.join(middle, trait).select(trait, group, (F.col(x) - F.col("_mx")).alias("_x"), (F.col(y) - F.col("_my")).alias("_y"))
    sums = d.groupBy(trait, group).agg(F.count("*").cast("double").alias("n"), *(F.sum(e).alias(c) for c, e in (("x", F.col("_x")), ("y", F.col("_y")), ("xx", F.col("_x") * F.col("_x")), ("xy", F.col("_x") * F.col("_y")), ("yy", F.col("_y") * F.col("_y")))))

    def solve(s: pd.DataFrame) -> dict:
        s = s.sort_values(group).reset_index(drop=True)
        out, n = {}, float(s.n.sum())
        tss = float(s.yy.sum() - s.y.sum() ** 2 / n)
        for model, index in _designs(len(s)).items():
            # parallel lines: group g has its own intercept and the common slope, parameter 1
            p = 1 + max(max(i) for i in index)
            used = sorted({i for pair in index for i in pair})
            xtx, xty = np.zeros((p, p)), np.zeros(p)
            for (a, b), row in zip(index, s.itertuples(), strict=True):
                xtx[np.ix_([a, b], [a, b])] += [[row.n, row.x], [row.x, row.xx]]
                xty[[a, b]] += [row.y, row.xy]
            inverse = np.zeros((p, p))
            inverse[np.ix_(used, used)] = np.linalg.pinv(xtx[np.ix_(used, used)])
            beta = inverse @ xty
            rss = float(s.yy.sum() - beta @ xty)
            out[model] = (index, inverse, beta, n, tss, rss, len(used))
        return out

    def coefficients(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        rows, names = [], sorted(s[group])
        for model, (index, inverse, beta, *_) in solve(s).items():
            for g, (a, b) in zip(names, index, strict=True):
                rows.append((key[0], g, model, beta[a], beta[b], inverse[a, a], 2 * inverse[a, b], inverse[b, b], inverse[1, a], inverse[1, b]))
        return pd.DataFrame(rows, columns=[trait, group, "model", "b0", "b1", "h0", "h1", "h2", "v0", "v1"])

    kind = dict(df.dtypes)
    lines = sums.groupBy(trait).applyInPandas(coefficients, f"{trait} {kind[trait]}, {group} {kind[group]}, model string, b0 double, b1 double, h0 double, h1 double, h2 double, v0 double, v1 double")
    e = (F.col("_y") - F.col("b0") - F.col("b1") * F.col("_x")) / (F.lit(1.0) - F.col("h0") - F.col("h1") * F.col("_x") - F.col("h2") * F.col("_x") * F.col("_x"))
    pull = F.col("v0") + F.col("v1") * F.col("_x")  # the slope's row of (X'X)^-1 X'
    meat = d.join(lines, [trait, group]).groupBy(trait, "model").agg(F.sum(F.pow(pull * e, F.lit(2.0))).alias("var"))

    def describe(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for model, (_, _, beta, n, tss, rss, p) in solve(s).items():
            rows.append((key[0], model, int(n), 1 - rss / tss if tss > 0 else None, n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1) + 2 * p, float(beta[1])))
        return pd.DataFrame(rows, columns=[trait, "model", "n", "r2", "aic", "slope"])

    described = sums.groupBy(trait).applyInPandas(describe, f"{trait} {kind[trait]}, model string, n long, r2 double, aic double, slope double")
    tail = F.pandas_udf(lambda z: z.map(lambda v: None if v is None or v != v else 2 * normal_sf(abs(v))).astype("float64"), "double")
    return described.join(meat, [trait, "model"]).withColumn("se", F.sqrt("var")).withColumn("p", tail(F.try_divide(F.col("slope"), F.col("se")))).drop("var")


def site_tests(sites: DataFrame, trait: str, group: str, site: str, y: str, x: str, *, permutations: int = 999, seed: int = 0, covariates: tuple[str, ...] = (), omit: bool = False) -> DataFrame:
    """(trait, test, omitted, F test): group shifts and group slopes over site means.

    With ``omit`` each group is also left out in turn.  ``coefficient`` is the first covariate's in the full model.
    Without covariates the permutations are dealt (:func:`dealt_site_tests`); with them a trait is one task.
    """
    if not covariates:
        return dealt_site_tests(sites, trait, group, site, y, x, permutations=permutations, seed=seed, omit=omit)
    cols = [trait, group, site, y, x, *covariates]

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna().sort_values([group, site])
        rows = []
        for out in [None, *(sorted(d[group].unique()) if omit else [])]:
            part = d if out is None else d[d[group] != out]
            for test in ("shift", "slope"):
                if out is not None and test == "slope" or part[group].nunique() < 2:
                    continue
                rng = np.random.default_rng([seed, abs(hash_text(f"{key[0]}:{test}:{out}"))])
                r = k.ancova(part[y].to_numpy(float), part[x].to_numpy(float), part[group].to_numpy().astype(str), permutations, rng, slopes=test == "slope", covariates=part[list(covariates)].to_numpy(float) if covariates else None)
                rows.append({trait: key[0], "test": test, "omitted": out, "n_sites": len(part), **r})
        return pd.DataFrame(rows, columns=[trait, "test", "omitted", "n_sites", *(c.split()[0] for c in TEST.split(", "))])

    return sites.select(*cols).groupBy(trait).applyInPandas(run, f"{trait} string, test string, omitted string, n_sites int, {TEST}")


def _fits(d: DataFrame, keys: list[str], y: str) -> DataFrame:
    """(keys, n, k, slopes, tss, r0, r1, r2): squared residuals of a common line, of parallel lines a group, and of a line a group.

    Rows are summed up by group; ``slopes`` counts the groups whose x varies.
    """
    size = F.count("*")
    g = d.groupBy(*keys, "_g").agg(size.alias("n"), F.avg("_x").alias("mx"), F.avg(y).alias("my"), (F.var_pop("_x") * size).alias("sxx"), (F.covar_pop("_x", y) * size).alias("sxy"), (F.var_pop(y) * size).alias("syy"))
    varies = F.col("sxx") > 1e-12
    own = F.col("syy") - F.when(varies, F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(0.0)
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    spread = lambda a, b, within: F.sum(within) + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum(n)
    s = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.count_if(varies).alias("slopes"), spread(mx, mx, "sxx").alias("txx"), spread(mx, my, "sxy").alias("txy"), spread(my, my, "syy").alias("tss"), F.sum("sxx").alias("wxx"), F.sum("sxy").alias("wxy"), F.sum("syy").alias("wyy"), F.sum(own).alias("r2"))
    line = lambda yy, xy, xx: F.col(yy) - F.coalesce(F.try_divide(F.col(xy) * F.col(xy), F.col(xx)), F.lit(0.0))
    return s.select(*keys, "n", "k", "slopes", "tss", line("tss", "txy", "txx").alias("r0"), line("wyy", "wxy", "wxx").alias("r1"), "r2")


def dealt_site_tests(sites: DataFrame, trait: str, group: str, site: str, y: str, x: str, *, permutations: int = 999, seed: int = 0, omit: bool = False) -> DataFrame:
    """:func:`site_tests` without covariates, each repetition of a trait by itself.

    Freedman and Lane: the residuals of the smaller model are shuffled and added to its fit.  The fit lies in both
    models, so the statistic of a repetition is that of the shuffled residuals alone, and a sum by group gives
    it.  A repetition orders the sites by a hash of (seed, test, repetition, group, site) and gives the i-th of them the i-th
    residual: the result depends on no partitioning and can be repeated in SQL.
    """
    from corymb.sources.scratch import written

    d = sites.select(trait, group, site, y, x).dropna().select(F.col(trait).cast("string").alias("_t"), F.col(group).cast("string").alias("_g"), F.col(site).cast("string").alias("_u"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    d = written(d, "sites")
    none = d.withColumn("_o", F.lit(None).cast("string"))
    if omit:
        groups = d.select("_t", F.col("_g").alias("_o")).distinct()
        none = none.unionByName(d.join(groups, "_t").where("_g <> _o").select("_t", "_g", "_u", "_y", "_x", "_o"))
    rows = written(none.select("_t", "_g", "_u", "_y", "_x", F.coalesce(F.concat(F.lit("="), "_o"), F.lit("")).alias("_o")), "rows")
    keys, tests = ["_t", "_o"], ["_t", "_o", "test"]
    seen = written(_fits(rows, keys, "_y").where("k >= 2"), "fits")
    shift, slope = (F.lit(v).alias("test") for v in ("shift", "slope"))
    form = lambda name, small, full, num, den: seen.select(*keys, name, "n", "tss", F.col(small).alias("small"), F.col(full).alias("full"), num.cast("int").alias("df_num"), den.cast("int").alias("df_den"))
    observed = form(shift, "r0", "r1", F.col("k") - 1, F.col("n") - F.col("k") - 1).unionByName(form(slope, "r1", "r2", F.col("slopes") - 1, F.col("n") - F.col("k") - F.col("slopes")).where("_o = ''"))
    statistic = lambda small, full: F.try_divide((F.col(small) - F.col(full)) / F.col("df_num"), F.col(full) / F.col("df_den"))
    observed = observed.withColumn("f", statistic("small", "full"))
    if permutations:
        whole, within = Window.partitionBy(*keys), Window.partitionBy(*keys, "_g")
        ax, ay = F.avg("_x").over(whole), F.avg("_y").over(whole)
        left = rows.withColumns({"cx": F.col("_x") - ax, "cy": F.col("_y") - ay, "gx": F.col("_x") - F.avg("_x").over(within), "gy": F.col("_y") - F.avg("_y").over(within)})
        line = lambda u, v: F.col(v) - F.coalesce(F.try_divide(F.sum(F.col(u) * F.col(v)).over(whole), F.sum(F.col(u) * F.col(u)).over(whole)), F.lit(0.0)) * F.col(u)
        left = left.select(*keys, "_g", "_u", "_x", line("cx", "cy").alias("shift"), line("gx", "gy").alias("slope")).unpivot([*keys, "_g", "_u", "_x"], ["shift", "slope"], "test", "_e").where("test = 'shift' OR _o = ''")
        left = written(left.withColumn("_i", F.row_number().over(Window.partitionBy(*tests).orderBy("_g", "_u"))), "residuals")
        many = left.select(*tests, "_g", "_u", "_x", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("rep"))
        name = F.md5(F.concat_ws(":", F.lit(str(seed)), "test", F.col("rep").cast("string"), "_g", "_u").cast("binary"))
        many = many.withColumn("_i", F.row_number().over(Window.partitionBy(*tests, "rep").orderBy(name, "_g", "_u")))
        shuffled = many.join(left.select(*tests, "_i", "_e"), [*tests, "_i"])
        sim = _fits(shuffled, [*tests, "rep"], "_e").join(observed.select(*tests, "df_num", "df_den", "f"), tests)
        small, full = (F.when(F.col("test") == "shift", F.col(a)).otherwise(F.col(b)) for a, b in (("r0", "r1"), ("r1", "r2")))
        sim = sim.withColumns({"small": small, "full": full}).withColumn("sim", statistic("small", "full"))
        above = sim.groupBy(*tests).agg(F.count_if(F.col("sim") >= F.col("f") - 1e-12).alias("above"))
        observed = observed.join(above, tests)
    else:
        observed = observed.withColumn("above", F.lit(0))
    gain = F.col("small") - F.col("full")
    return observed.select(
        F.col("_t").alias(trait), "test", F.expr("nullif(substring(_o, 2), '')").alias("omitted"), F.col("n").cast("int").alias("n_sites"), "f", "df_num", "df_den", f_p(F.greatest("f", F.lit(0.0)), F.col("df_num").cast("double"), F.col("df_den").cast("double")).alias("parametric_p"),
        ((F.col("above") + 1) / F.lit(permutations + 1)).alias("permutation_p"), (1 - F.col("small") / F.col("tss")).alias("r2_small"), (1 - F.col("full") / F.col("tss")).alias("r2_full"), (gain / F.col("tss")).alias("delta_r2"), F.coalesce(F.try_divide(gain, F.col("small")), F.lit(0.0)).alias("partial_r2"), F.lit(None).cast("double").alias("coefficient"),
    )


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def _site_residuals(df: DataFrame, trait: str, group: str, site: str, x: str, y: str) -> DataFrame:
    """(trait, group, site, n_plants, y, x, residual): site means, the residual from each trait's own line on size."""
    resid = size_residuals(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [trait], x, y)
    return resid.groupBy(trait, group, site).agg(F.count("*").alias("n_plants"), F.avg(y).alias("y"), F.avg(x).alias("x"), F.avg("residual").alias("residual"))


def residual_spread(df: DataFrame, trait: str, group: str, site: str, x: str, y: str) -> DataFrame:
    """(trait, group, n_sites, mean, sd, min, max) of site residuals."""
    r = F.col("residual")
    return _site_residuals(df, trait, group, site, x, y).groupBy(trait, group).agg(F.count("*").alias("n_sites"), F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("sd_residual"), F.min(r).alias("min_residual"), F.max(r).alias("max_residual"))


def within_common_support(df: DataFrame, group: str, size: str) -> DataFrame:
    """Rows whose size every group reaches, with the band (lo, hi)."""
    band = df.where(F.col(size).isNotNull()).groupBy(group).agg(F.min(size).alias("a"), F.max(size).alias("b")).agg(F.max("a").alias("lo"), F.min("b").alias("hi"))
    return df.crossJoin(F.broadcast(band)).where(F.col(size).between(F.col("lo"), F.col("hi")))  # one row


def residual_eta2(df: DataFrame, trait: str, group: str, site: str, x: str, y: str, *, permutations: int = 4999, seed: int = 0) -> DataFrame:
    """(trait, eta2, p, n_plants, n_sites): do site residuals on size differ among groups?  Labels are permuted."""
    s = _site_residuals(df, trait, group, site, x, y)
    n = s.groupBy(trait).agg(F.sum("n_plants").alias("n_plants"), F.count("*").alias("n_sites"))
    return label_permutation(s, [trait], group, "residual", site, permutations, seed).join(n, trait)


def allometry(df: DataFrame, trait: str, group: str, site: str, x: str, y: str, size: str, *, permutations: int = 4999, interaction_permutations: int = 1999, seed: int = 0) -> DataFrame:
    """Everything about size and groups for each trait: lines, residual and site tests, common support, corrected p values.

    Leave-one-group-out runs are :func:`site_tests` with ``omit``; spreads of residuals :func:`residual_spread`.
    """
    lines = hc3_lines(df, trait, group, x, y).groupBy(trait).pivot("model", ["size", "additive", "interaction"]).agg(F.first("r2").alias("r2"), F.first("aic").alias("aic"), F.first("slope").alias("slope"), F.first("p").alias("p"))
    lines = lines.withColumns({"delta_r2": F.col("additive_r2") - F.col("size_r2"), "delta_aic": F.col("interaction_aic") - F.col("additive_aic")})
    sites = _site_residuals(df, trait, group, site, x, y).select(trait, group, site, "y", "x")
    tests = [site_tests(sites, trait, group, site, "y", "x", permutations=n, seed=seed + i).where(F.col("test") == test) for i, (test, n) in enumerate((("shift", permutations), ("slope", interaction_permutations)))]
    named = lambda d, test: d.select(trait, *(F.col(c).alias(f"{test}_{a}") for c, a in (("f", "f"), ("df_num", "df_num"), ("df_den", "df_den"), ("parametric_p", "parametric_p"), ("permutation_p", "p"), ("delta_r2", "delta_r2"), ("partial_r2", "partial_r2"))))
    out = lines.join(named(tests[0], "shift"), trait).join(named(tests[1], "slope"), trait)
    inside = within_common_support(df, group, size)
    parts = (("residual", df, seed + 2), ("common", inside.drop("lo", "hi"), seed + 3))
    for name, rows, s in parts:
        e = residual_eta2(rows, trait, group, site, x, y, permutations=permutations, seed=s)
        out = out.join(e.select(trait, *(F.col(c).alias(f"{name}_{c}") for c in ("eta2", "p", "n_plants", "n_sites"))), trait, "left")
    band = inside.groupBy(trait).agg(F.min("lo").alias("common_lo"), F.max("hi").alias("common_hi"))
    out = out.join(band, trait, "left")
    for name in ("shift", "slope", "residual", "common"):
        out = adjusted(out, f"{name}_p", f"{name}_p_adjusted")
    return out


def _wide(df: DataFrame, group: str, unit: str, columns: list[str]) -> DataFrame:
    """One group of all units with complete columns, in a fixed order; a row a site, small by nature."""
    return df.select(F.col(group).cast("string").alias("_g"), F.col(unit).cast("string").alias("_u"), *(F.col(c).cast("double") for c in columns)).na.drop()


def over_sites(df: DataFrame, group: str, unit: str, columns: list[str], work, schema: str, *, chunks: int = 1) -> DataFrame:
    """``work(z, groups, chunk)`` on the table of sites, once for each chunk of repetitions, as rows of ``schema``."""
    spark = df.sparkSession
    many = _wide(df, group, unit, columns).join(spark.range(chunks).select(F.col("id").cast("int").alias("_c")))

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["_g", "_u"])
        return pd.DataFrame(work(d[columns].to_numpy(float), d["_g"].to_numpy(), int(key[0])), columns=[c.split()[0] for c in schema.split(", ")])

    return many.groupBy("_c").applyInPandas(run, schema)


def covariance_entries(df: DataFrame, group: str, unit: str, columns: list[str], least: int = 2) -> DataFrame:
    """(matrix, row, col, value) of B, B made semidefinite, and W, over z scores."""

    def work(x: np.ndarray, g: np.ndarray, _: int) -> list:
        raw, psd, w, _, _ = k.between_within(k.zscores(x), g, least)
        return [(name, a, b, float(m[i, j])) for name, m in (("B_raw", raw), ("B_psd", psd), ("W", w)) for i, a in enumerate(columns) for j, b in enumerate(columns)]

    return over_sites(df, group, unit, columns, work, "matrix string, row string, col string, value double")


def pst_axes(df: DataFrame, group: str, unit: str, columns: list[str], *, reps: int = 200, chunks: int = 8, seed: int = 0, least: int = 2) -> DataFrame:
    """(axis, lambda, pst, loadings, lo, hi): directions of greatest divergence, the first with a bootstrap interval."""

    def work(x: np.ndarray, g: np.ndarray, _: int) -> list:
        _, b, w, _, _ = k.between_within(k.zscores(x), g, least)
        return [(i + 1, lam, pst, [float(v) for v in vec]) for i, (lam, pst, vec) in enumerate(k.directional_axes(b, w))]

    def boot(x: np.ndarray, g: np.ndarray, chunk: int) -> list:
        rng, out = np.random.default_rng([seed, chunk]), []
        for _ in range(k.dealt(reps, chunks, chunk)):
            i = k.resample_in_groups(g, rng)
            try:
                _, b, w, _, _ = k.between_within(k.zscores(x[i]), g[i], least)
                out.append((k.directional_axes(b, w)[0][1],))
            except (ValueError, np.linalg.LinAlgError):
                continue
        return out

    axes = over_sites(df, group, unit, columns, work, "axis int, lambda double, pst double, loadings array<double>")
    q = over_sites(df, group, unit, columns, boot, "v double", chunks=chunks).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("v").alias("reps"))
    first = F.col("axis") == 1
    return axes.crossJoin(F.broadcast(q)).select("axis", "lambda", "pst", "loadings", F.when(first, F.col("q")[0]).alias("lo"), F.when(first, F.col("q")[1]).alias("hi"), "reps")


def hierarchical_axes(df: DataFrame, group: str, site: str, unit: str, columns: list[str], *, size: str | None = None, reps: int = 500, seed: int = 0, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(lo, hi, reps) of the first axis' Pst when sites are drawn in groups and then units in sites.

    With ``size``, each repetition takes the residuals of its own lines on it.  A site is drawn as often as
    hashes of (seed, repetition, group, draw) point to it; a unit then weighs a Poisson draw for each time
    its site was drawn.  Sums of products by (repetition, group) are made where the rows lie, and only they
    are solved in Python: the size lines, the z scores and both covariances follow from them.
    """
    cols = [*columns, *([size] if size else [])]
    d = df.select(F.col(group).cast("string").alias("_g"), F.col(site).cast("string").alias("_s"), F.col(unit).cast("string").alias("_u"), *(F.col(c).cast("double") for c in cols)).na.drop()
    scale = d.agg(*(x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_d_{c}"))))
    d = d.crossJoin(F.broadcast(scale)).select("_g", "_s", "_u", *((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}") for c in cols)).toDF("_g", "_s", "_u", *cols)  # one row
    sites = d.select("_g", "_s").distinct()
    numbered = sites.select("_g", "_s", (F.row_number().over(Window.partitionBy("_g").orderBy("_s")) - 1).alias("_i"))  # a row a site
    counts = sites.groupBy("_g").agg(F.count("*").alias("_k"))
    draws = counts.select("_g", "_k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("_g", "_k", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_j"))
    draws = draws.select("_g", "rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "_g", "_j"), F.col("_k")).cast("int").alias("_i"))
    drawn = draws.groupBy("_g", "_i", "rep").agg(F.count("*").cast("int").alias("times")).groupBy("_g", "_i").agg(F.collect_list(F.struct("rep", "times")).alias("drawn"))
    drawn = drawn.join(numbered, ["_g", "_i"]).select("_g", "_s", "drawn")
    d = d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # evenly, before rows are multiplied
    few = drawn.limit(broadcast_rows // max(1, reps) + 1).count() <= broadcast_rows // max(1, reps)
    many = d.join(F.broadcast(drawn) if few else drawn, ["_g", "_s"]).select("_g", "_u", *cols, F.inline("drawn"))
    poisson = lambda c: F.aggregate(F.array(*map(F.lit, POISSON)), F.lit(0), lambda n, t: n + (F.pmod(F.xxhash64(F.lit(seed), "_u", "rep", c), F.lit(1 << 32)) >= t).cast("int"))
    weight = F.aggregate(F.sequence(F.lit(1), F.col("times")), F.lit(0), lambda n, c: n + poisson(c))
    many = many.withColumn("_w", weight.cast("double")).where("_w > 0")
    one = [F.lit(1.0), *(F.col(c) for c in cols)]
    p = len(one)
    sums = many.groupBy("rep", "_g").agg(F.array(*(F.sum(F.col("_w") * one[i] * one[j]) for i in range(p) for j in range(i, p))).alias("m"))
    v = sums.groupBy("rep").agg(F.collect_list(F.struct("_g", "m")).alias("parts"))  # a row a group
    first = F.pandas_udf(lambda rows: rows.map(lambda parts: k.first_axis_of_sums([x["m"] for x in sorted(parts, key=lambda x: x["_g"])], len(columns), bool(size))).astype("float64"), "double")
    v = v.select(first("parts").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    return v.agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("v").alias("reps")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "reps")


def _loadings(n: int):
    """Column function: the first component of a flat n x n correlation matrix, its share of variance, its variance."""

    def load(m: pd.Series) -> pd.Series:
        out = []
        for row in m:
            values, vectors = np.linalg.eigh(np.array(row).reshape(n, n))
            v = vectors[:, -1] * (1 if vectors[:, -1].mean() >= 0 else -1)
            out.append([*map(float, v), float(values[-1] / values.sum()), float(values[-1])])
        return pd.Series(out)

    return F.pandas_udf(load, "array<double>")


def _module_parts(df: DataFrame, size: str, modules: dict[str, list[str]], ident: list[str]) -> tuple[DataFrame, DataFrame]:
    """Residuals on size of all traits, and one row with each module's means, spreads and loadings."""
    traits = sorted({t for ts in modules.values() for t in ts})
    # one pass for all lines on size, one for all correlations of residuals: the plan reads df three times, however many traits
    both = {t: F.col(size).isNotNull() & F.col(t).isNotNull() for t in traits}
    lines = df.agg(*(e.alias(f"_{c}_{t}") for t in traits for c, e in (("x", F.avg(F.when(both[t], F.col(size)))), ("y", F.avg(F.when(both[t], F.col(t)))), ("b", F.try_divide(F.covar_pop(size, t), F.var_pop(F.when(both[t], F.col(size))))))))
    left = {t: (F.col(t) - F.col(f"_y_{t}") - F.col(f"_b_{t}") * (F.col(size) - F.col(f"_x_{t}"))).alias(f"_r_{t}") for t in traits}
    out = df.crossJoin(F.broadcast(lines)).select(*ident, *left.values())  # one row
    wanted = []
    for name, ts in modules.items():
        full = F.lit(True)
        for t in ts:
            full = full & F.col(f"_r_{t}").isNotNull()
        x = [F.when(full, F.col(f"_r_{t}")) for t in ts]
        wanted += [F.array(*map(F.avg, x)).alias(f"_m_{name}"), F.array(*map(F.stddev_samp, x)).alias(f"_s_{name}"), F.array(*(F.coalesce(F.corr(a, b), F.lit(0.0)) for a in x for b in x)).alias(f"_c_{name}")]
    stats = out.agg(*wanted).select("*", *(_loadings(len(ts))(F.col(f"_c_{name}")).alias(f"_l_{name}") for name, ts in modules.items()))
    return out, stats


def module_loadings(df: DataFrame, size: str, modules: dict[str, list[str]]) -> DataFrame:
    """(module, trait, loading, variance_share, slope): each trait's part in its module, with its slope on size."""
    slopes = None
    for name, ts in modules.items():
        for t in ts:
            m = moments(df, [], size, t).select(F.lit(name).alias("module"), F.lit(t).alias("trait"), F.try_divide(F.col("sxy"), F.col("sxx")).alias("slope"))
            slopes = m if slopes is None else slopes.unionByName(m)
    _, stats = _module_parts(df, size, modules, [])
    loads = None
    for name, ts in modules.items():
        row = stats.select(F.posexplode(F.array(*map(F.lit, ts))).alias("i", "trait"), F.col(f"_l_{name}").alias("l")).select(F.lit(name).alias("module"), "trait", F.element_at("l", F.col("i") + 1).alias("loading"), F.element_at("l", len(ts) + 1).alias("variance_share"))
        loads = row if loads is None else loads.unionByName(row)
    return loads.join(slopes, ["module", "trait"], "left")


def module_scores(df: DataFrame, size: str, modules: dict[str, list[str]], ident: list[str]) -> DataFrame:
    """``ident`` and a score for each module: the first component of its traits' residuals on size, as z scores.

    Covariances are aggregated; only their matrices (one row a module) are solved in Python.
    """
    out, stats = _module_parts(df, size, modules, ident)
    scores = []
    for name, ts in modules.items():
        terms = [(F.col(f"_r_{t}") - F.col(f"_m_{name}")[i]) / F.col(f"_s_{name}")[i] * F.col(f"_l_{name}")[i] for i, t in enumerate(ts)]
        scores.append((sum(terms[1:], terms[0]) / F.sqrt(F.col(f"_l_{name}")[len(ts) + 1])).alias(name))
    return out.crossJoin(F.broadcast(stats)).select(*ident, *scores)  # one row
