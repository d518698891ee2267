"""Queries of the model layer: regressions, nested tests, axes, modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corymb.operators import models, ranks, syndrome
from corymb.plans.base import LONG, PLANTS, plants, table, traits
from corymb.plans.divergence import _RANK
from corymb.plans.registry import query
from corymb.sources.scratch import written

MODULES = {"wealth": ["balance", "flowers"], "spending": ["price", "top_price"]}
NAMES = list(MODULES)


def _sized(spark, sf_dir):
    """(island, site, plant, trait, x, size, y): traits against the log of the number of orders."""
    d = plants(spark, sf_dir).withColumn("size", F.col("flowers")).withColumn("x", F.ln("flowers"))
    return d.unpivot(["island", "site", "plant", "x", "size"], ["price", "top_price", "balance"], "trait", "y")


SIZED = PLANTS + ",\nd AS (" + " UNION ALL ".join(f"SELECT island, site, plant, ln(flowers) AS x, flowers AS size, '{t}' AS trait, {t} AS y FROM plants" for t in ("price", "top_price", "balance")) + ")"


def _sites(spark, sf_dir):
    d = plants(spark, sf_dir)
    return d.groupBy("island", "site").agg(*(F.avg(c).alias(c) for c in ("price", "top_price", "balance", "flowers")))


def _modules(spark, sf_dir):
    d = plants(spark, sf_dir).withColumn("size", F.ln("flowers"))
    return models.module_scores(d, "size", {"wealth": ["balance"], "spending": ["price", "top_price"], "volume": ["flowers", "price"]}, ["island", "site", "plant", "lat"])


def _scores(spark, sf_dir):
    """Module scores of sites: a row a site, written for the queries that read it again and again."""
    return written(syndrome.site_scores(_modules(spark, sf_dir), "island", "site", MODS), "site_scores")


MODS = ["wealth", "spending", "volume"]
PROFILE = ["price", "balance", "flowers"]


@query("size_residuals", f"WITH {SIZED}, m AS (SELECT trait, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d GROUP BY trait) SELECT trait, island, count(*) AS n, round(avg((y - a - b * x) / 1000), 5) AS mean_residual, round(max(b), 4) AS slope FROM d JOIN m USING (trait) GROUP BY trait, island")
def size_residuals(spark, sf_dir):
    d = models.size_residuals(_sized(spark, sf_dir), ["trait"], "x", "y")
    return d.groupBy("trait", "island").agg(F.count("*").alias("n"), F.round(F.avg(F.col("residual") / 1000), 5).alias("mean_residual"), F.round(F.max("slope"), 4).alias("slope"))


@query(
    "allometric_lines",
    f"""WITH {SIZED}, m AS (SELECT trait, count(*) AS n, regr_r2(y, x) AS r2, regr_slope(y, x) AS b FROM d GROUP BY trait),
c AS (SELECT trait, x - avg(x) OVER (PARTITION BY trait, island) AS x, y - avg(y) OVER (PARTITION BY trait, island) AS y, y AS y0 FROM d),
w AS (SELECT trait, count(*) AS n, 1 - (var_pop(y) - covar_pop(x, y) * covar_pop(x, y) / var_pop(x)) / var_pop(y0) AS r2, covar_pop(x, y) / var_pop(x) AS b FROM c GROUP BY trait)
SELECT trait, 'size' AS model, n, round(r2, 6) AS r2, round(b, 4) AS slope FROM m UNION ALL SELECT trait, 'additive', n, round(r2, 6), round(b, 4) FROM w""",
)
def allometric_lines(spark, sf_dir):
    return models.hc3_lines(_sized(spark, sf_dir), "trait", "island", "x", "y").where("model <> 'interaction'").select("trait", "model", "n", F.round("r2", 6).alias("r2"), F.round("slope", 4).alias("slope"))


@query("allometric_lines_hc3")
def allometric_lines_hc3(spark, sf_dir):
    return models.hc3_lines(_sized(spark, sf_dir), "trait", "island", "x", "y")


def _mixed_sql() -> str:
    """The same search: a grid of ratios, then ever finer ones between the neighbours of the best."""
    first = "[" + ", ".join(f"{r!r}::DOUBLE" for r in models.FIRST_RATIOS) + "]"

    def best(name: str, grid: str) -> str:
        return f"""{name}g AS (SELECT trait, model, i, ratio, CASE model WHEN 'group' THEN island ELSE '' END AS part, sum(n / (1 + ratio * n)) AS w, sum(n / (1 + ratio * n) * (mean - centre)) AS wm, sum(n / (1 + ratio * n) * (mean - centre) ** 2) AS wmm, sum(ln(1 + ratio * n)) AS logs FROM s JOIN {grid} USING (trait) JOIN o USING (trait) GROUP BY ALL),
{name}e AS (SELECT trait, model, i, ratio, -0.5::DOUBLE * (total * ln((within + sum(wmm - wm * wm / w)) / total) + sum(logs)) AS like_ FROM {name}g JOIN o USING (trait) GROUP BY trait, model, i, ratio, total, within),
{name}b AS (SELECT trait, model, max(like_) AS like_, arg_max(i, [like_, -i]) AS i FROM {name}e GROUP BY trait, model)"""

    steps = [f"c0 AS (SELECT trait, model, i, {first}[i + 1] AS ratio FROM o, (VALUES ('null'), ('group')) v(model), range({len(models.FIRST_RATIOS)}) t(i))", best("x0", "c0"), f"f0 AS (SELECT trait, model, like_, {first}[greatest(i - 1, 0) + 1] AS lo, {first}[least(i + 1, {len(models.FIRST_RATIOS) - 1}) + 1] AS hi FROM x0b)"]
    for r in range(1, models.ROUNDS + 1):
        steps += [f"c{r} AS (SELECT trait, model, i, lo + (hi - lo) * i / {models.PARTS} AS ratio FROM f{r - 1}, range({models.PARTS + 1}) t(i))", best(f"x{r}", f"c{r}"), f"f{r} AS (SELECT trait, model, greatest(f.like_, x.like_) AS like_, lo + (hi - lo) * greatest(i - 1, 0) / {models.PARTS} AS lo, lo + (hi - lo) * least(i + 1, {models.PARTS}) / {models.PARTS} AS hi FROM f{r - 1} f JOIN x{r}b x USING (trait, model))"]
    return f"""WITH {LONG}, s AS (SELECT trait, island, site, count(*)::DOUBLE AS n, avg(value) AS mean, var_pop(value) * count(*) AS ss FROM traits WHERE value IS NOT NULL GROUP BY ALL),
o AS (SELECT trait, sum(n) AS total, sum(ss) AS within, count(DISTINCT island) AS k, avg(mean) AS centre FROM s GROUP BY trait), {', '.join(steps)},
l AS (SELECT trait, greatest(2 * (max(like_) FILTER (WHERE model = 'group') - max(like_) FILTER (WHERE model = 'null')), 0) AS lrt FROM f{models.ROUNDS} GROUP BY trait),
p AS (SELECT trait, lrt, (k - 1)::INTEGER AS df, exp(-lrt / 2) * (1 + lrt / 2) AS p FROM l JOIN o USING (trait)), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
SELECT trait, round(lrt, 5) AS lrt, df, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS p_adjusted FROM k"""


@query("site_mixed_model", _mixed_sql())
def site_mixed_model(spark, sf_dir):
    """Region effects beyond sites; the twin's tail is the closed form for five regions."""
    d = ranks.adjusted(models.site_lrt(traits(spark, sf_dir), "trait", "island", "site", "value"), "p", "p_adjusted")
    return d.select("trait", F.round("lrt", 5).alias("lrt"), "df", F.round("p", 6).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"))


@query("allometry")
def allometry(spark, sf_dir):
    return models.allometry(_sized(spark, sf_dir), "trait", "island", "site", "x", "y", "size", permutations=4999, interaction_permutations=1999)


def site_test_sql(permutations: int, omit: bool) -> str:
    """SQL twin of the permutation tests over site means: the same hashes order the sites."""
    groups = " UNION ALL SELECT s.trait, s.island, s.site, s.x, s.y, '=' || o.island FROM s JOIN (SELECT DISTINCT trait, island FROM s) o ON o.trait = s.trait AND o.island <> s.island" if omit else ""
    sums = lambda name, keys, y, source: f"""{name}g AS (SELECT {keys}, island, count(*) AS n, avg(x) AS mx, avg({y}) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, {y}) * count(*) AS sxy, var_pop({y}) * count(*) AS syy FROM {source} GROUP BY ALL),
{name}t AS (SELECT {keys}, count(*) AS n, var_pop({y}) * count(*) AS tss, var_pop({y}) * count(*) - (covar_pop(x, {y}) * count(*)) ** 2 / (var_pop(x) * count(*)) AS r0 FROM {source} GROUP BY ALL),
{name}w AS (SELECT {keys}, count(*) AS k, sum(syy) - sum(sxy) ** 2 / sum(sxx) AS r1, sum(syy - sxy * sxy / sxx) AS r2 FROM {name}g GROUP BY ALL),
{name} AS (SELECT * FROM {name}t JOIN {name}w USING ({keys}))"""  # noqa: E731
    pick = "CASE WHEN test = 'shift' THEN (r0 - r1) / (k - 1) / (r1 / (n - k - 1)) ELSE (r1 - r2) / (k - 1) / (r2 / (n - 2 * k)) END"
    return f"""WITH {SIZED}, s AS (SELECT trait, island, site, avg(x) AS x, avg(y) AS y FROM d GROUP BY ALL), r AS (SELECT trait, island, site, x, y, '' AS o FROM s{groups}),
{sums('m', 'trait, o', 'y', 'r')}, ob AS (SELECT *, {pick} AS f FROM m, (VALUES ('shift'), ('slope')) v(test) WHERE test = 'shift' OR o = ''),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY trait, o) AS cx, y - avg(y) OVER (PARTITION BY trait, o) AS cy, x - avg(x) OVER (PARTITION BY trait, o, island) AS gx, y - avg(y) OVER (PARTITION BY trait, o, island) AS gy FROM r),
l AS (SELECT trait, o, island, site, x, cy - sum(cx * cy) OVER (PARTITION BY trait, o) / sum(cx * cx) OVER (PARTITION BY trait, o) * cx AS a, gy - sum(gx * gy) OVER (PARTITION BY trait, o) / sum(gx * gx) OVER (PARTITION BY trait, o) * gx AS b FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY trait, o, test ORDER BY island, site) AS i FROM (SELECT trait, o, island, site, x, 'shift' AS test, a AS e FROM l UNION ALL SELECT trait, o, island, site, x, 'slope', b FROM l WHERE o = '')),
q AS (SELECT e.* EXCLUDE (e, i), rep, row_number() OVER (PARTITION BY trait, o, test, rep ORDER BY md5('0:' || test || ':' || rep || ':' || island || ':' || site), island, site) AS i FROM e, range({permutations}) t(rep)),
z AS (SELECT q.* EXCLUDE (i), e.e FROM q JOIN e USING (trait, o, test, i)), {sums('p', 'trait, o, test, rep', 'e', 'z')},
n AS (SELECT p.trait, p.o, p.test, count(*) FILTER (WHERE CASE WHEN p.test = 'shift' THEN (p.r0 - p.r1) / (p.k - 1) / (p.r1 / (p.n - p.k - 1)) ELSE (p.r1 - p.r2) / (p.k - 1) / (p.r2 / (p.n - 2 * p.k)) END >= f - 1e-12) AS above FROM p JOIN ob USING (trait, o, test) GROUP BY ALL)
SELECT trait, test, nullif(substr(o, 2), '') AS omitted, n AS n_sites, k - 1 AS df_num, CASE WHEN test = 'shift' THEN n - k - 1 ELSE n - 2 * k END AS df_den, round(f, 5) AS f, round(CASE WHEN test = 'shift' THEN (r0 - r1) / r0 ELSE (r1 - r2) / r1 END, 6) AS partial_r2, round((above + 1) / {permutations + 1}.0::DOUBLE, 7) AS p FROM ob JOIN n USING (trait, o, test)"""


def _site_tests(spark, sf_dir, permutations: int, omit: bool):
    s = _sized(spark, sf_dir).groupBy("trait", "island", "site").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    d = models.site_tests(s, "trait", "island", "site", "y", "x", permutations=permutations, omit=omit)
    return d.select("trait", "test", "omitted", *(F.col(c).cast("long").alias(c) for c in ("n_sites", "df_num", "df_den")), F.round("f", 5).alias("f"), F.round("partial_r2", 6).alias("partial_r2"), F.round("permutation_p", 7).alias("p"))


@query("site_tests_permuted", site_test_sql(4999, False))
def site_tests_permuted(spark, sf_dir):
    """Group shifts and group slopes over site means with their Freedman-Lane p values."""
    return _site_tests(spark, sf_dir, 4999, False)


@query("site_ancova_left_out", site_test_sql(1999, True))
def site_ancova_left_out(spark, sf_dir):
    """The same with each region left out in turn."""
    return _site_tests(spark, sf_dir, 1999, True)


@query("phase_adjusted")
def phase_adjusted(spark, sf_dir):
    """Region shifts of site means beyond size and the share of pending orders."""
    d = plants(spark, sf_dir).withColumn("x", F.ln("flowers")).unpivot(["island", "site", "x", "frac_female"], ["price", "balance"], "trait", "y")
    s = d.groupBy("trait", "island", "site").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.avg("frac_female").alias("phase"))
    return models.site_tests(s, "trait", "island", "site", "y", "x", permutations=1999, covariates=("phase",)).where("test = 'shift'")


@query(
    "covariance_traces",
    f"""WITH {PLANTS}, s AS (SELECT island, site, avg(price) AS a, avg(balance) AS b FROM plants GROUP BY ALL),
z AS (SELECT island, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b FROM s),
c AS (SELECT island, a - avg(a) OVER (PARTITION BY island) AS a, b - avg(b) OVER (PARTITION BY island) AS b, count(*) OVER (PARTITION BY island) AS m FROM z), k AS (SELECT count(*) AS n, count(DISTINCT island) AS k FROM c)
SELECT round(sum(a * a + b * b) / max(n - k), 6) AS trace_w, round(sum(a * b) / max(n - k), 6) AS covariance_w FROM c, k""",
)
def covariance_traces(spark, sf_dir):
    d = models.covariance_entries(_sites(spark, sf_dir), "island", "site", ["price", "balance"]).where("matrix = 'W'")
    return d.agg(F.round(F.sum(F.when(F.col("row") == F.col("col"), F.col("value"))), 6).alias("trace_w"), F.round(F.max(F.when(F.col("row") < F.col("col"), F.col("value"))), 6).alias("covariance_w"))


@query("covariance_matrices")
def covariance_matrices(spark, sf_dir):
    return models.covariance_entries(_sites(spark, sf_dir), "island", "site", ["price", "top_price", "balance"])


@query("pst_axes")
def pst_axes(spark, sf_dir):
    return models.pst_axes(_sites(spark, sf_dir), "island", "site", ["price", "top_price", "balance"], reps=500)


@query("pst_axes_hierarchical")
def pst_axes_hierarchical(spark, sf_dir):
    return models.hierarchical_axes(plants(spark, sf_dir).withColumn("size", F.ln("flowers")), "island", "site", "plant", ["price", "top_price", "balance"], size="size", reps=500)


@query("module_scores")
def module_scores(spark, sf_dir):
    return _modules(spark, sf_dir)


@query("module_trajectories")
def module_trajectories(spark, sf_dir):
    return syndrome.trajectories(_scores(spark, sf_dir), "island", MODS)


@query("mosaic_states")
def mosaic_states(spark, sf_dir):
    return syndrome.mosaic(module_trajectories(spark, sf_dir), "island", MODS)


@query("trajectory_pairs")
def trajectory_pairs(spark, sf_dir):
    return syndrome.pairwise_trajectories(syndrome.group_matrix(_scores(spark, sf_dir), "island", MODS), MODS)


@query("trajectory_bootstrap")
def trajectory_bootstrap(spark, sf_dir):
    return syndrome.trajectory_bootstrap(_sites(spark, sf_dir), "island", "site", ["price", "balance", "flowers"], reps=2000)


@query("profile_tests")
def profile_tests(spark, sf_dir):
    """Site means as z scores; 9999 permutations, as published."""
    d = ranks.standardised(_sites(spark, sf_dir).select("island", "site", *PROFILE), PROFILE)
    return syndrome.profile_tests(d, "island", "site", PROFILE, permutations=9999)


_INTEGRATION = """WITH {p}, s AS (SELECT island, site, avg(price) AS price, avg(balance) AS balance, avg(flowers) AS flowers FROM plants GROUP BY ALL),
c AS (SELECT price - avg(price) OVER (PARTITION BY island) AS price, balance - avg(balance) OVER (PARTITION BY island) AS balance, flowers - avg(flowers) OVER (PARTITION BY island) AS flowers FROM s),
m AS (SELECT avg(price) AS price, avg(balance) AS balance, avg(flowers) AS flowers FROM s GROUP BY island)
{q}"""


@query("module_integration", _INTEGRATION.format(p=PLANTS, q=" UNION ALL ".join(f"SELECT '{a}' AS module_a, '{b}' AS module_b, round((SELECT corr({a}, {b}) FROM c), 5) AS within_r, round((SELECT corr({a}, {b}) FROM m), 5) AS between_r" for a, b in (("price", "balance"), ("price", "flowers"), ("balance", "flowers")))))
def module_integration(spark, sf_dir):
    d = syndrome.integration(_sites(spark, sf_dir), "island", ["price", "balance", "flowers"])
    return d.select("module_a", "module_b", F.round("within_r", 5).alias("within_r"), F.round("between_r", 5).alias("between_r"))


_LEFT_OUT = f"""WITH {PLANTS}, s AS (SELECT island, site, {', '.join(f'avg({c}) AS {c}' for c in PROFILE)} FROM plants GROUP BY ALL), o AS (SELECT DISTINCT island AS omitted FROM s), d AS (SELECT * FROM s, o WHERE island <> omitted),
c AS (SELECT omitted, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY omitted, island) AS {c}' for c in PROFILE)} FROM d), m AS (SELECT omitted, island, {', '.join(f'avg({c}) AS {c}' for c in PROFILE)} FROM d GROUP BY ALL)
""" + " UNION ALL ".join(f"SELECT omitted, '{a}' AS module_a, '{b}' AS module_b, round(w, 5) AS within_r, round(v, 5) AS between_r FROM (SELECT omitted, corr({a}, {b}) AS w FROM c GROUP BY 1) JOIN (SELECT omitted, corr({a}, {b}) AS v FROM m GROUP BY 1) USING (omitted)" for a, b in (("price", "balance"), ("price", "flowers"), ("balance", "flowers")))


@query("module_integration_left_out", _LEFT_OUT)
def module_integration_left_out(spark, sf_dir):
    d = syndrome.integration_left_out(_sites(spark, sf_dir), "island", PROFILE)
    return d.select("omitted", "module_a", "module_b", *(F.round(c, 5).alias(c) for c in ("within_r", "between_r")))


@query("module_integration_bootstrap")
def module_integration_bootstrap(spark, sf_dir):
    return syndrome.integration_bootstrap(_sites(spark, sf_dir), "island", "site", ["price", "balance", "flowers"], reps=1500)


@query("module_max_axis_pst")
def module_max_axis_pst(spark, sf_dir):
    return syndrome.max_axis_pst(_sites(spark, sf_dir), "island", "site", {"money": ["price", "balance"], "all": ["price", "balance", "flowers"]}, reps=800)


@query("covariance_alignment")
def covariance_alignment(spark, sf_dir):
    return syndrome.alignment(_sites(spark, sf_dir), "island", "site", ["price", "top_price", "balance"], reps=2500)


@query("planning_power")
def planning_power(spark, sf_dir):
    return syndrome.planning_power(_sites(spark, sf_dir), "island", "site", ["price", "balance", "flowers"], sims=500)


@query("response_modes")
def response_modes(spark, sf_dir):
    d = allometry(spark, sf_dir).withColumn("module", F.when(F.col("trait") == "balance", "wealth").otherwise("spending"))
    return syndrome.response_summary(d.withColumn("response_mode", syndrome.response_mode(F.col("slope_p_adjusted"), F.col("shift_p_adjusted"))))


@query("evidence_table")
def evidence_table(spark, sf_dir):
    return syndrome.evidence(allometry(spark, sf_dir), {"price": ("signal", "island_level_shift"), "balance": ("mechanical", "simple_scaling_or_unresolved")})


@query("geography")
def geography(spark, sf_dir):
    lat = plants(spark, sf_dir).groupBy("island").agg(F.avg("lat").alias("mean_lat"))
    return syndrome.geography(module_trajectories(spark, sf_dir), lat, "island", ["syndrome_axis_score", *(f"z_{m}" for m in MODS)])


@query(
    "lability_table",
    f"WITH {LONG}, v AS (SELECT trait, stddev_samp(value) / avg(value) AS pst FROM traits GROUP BY trait) SELECT trait, round(pst, 6) AS pst, CAST(rank() OVER (ORDER BY pst DESC) AS INTEGER) AS lability_rank, round(pst / (SELECT pst FROM v WHERE trait = 'price'), 6) AS ratio_to_reference FROM v",
)
def lability_table(spark, sf_dir):
    u = traits(spark, sf_dir).groupBy("trait").agg((F.stddev_samp("value") / F.avg("value")).alias("pst"))
    return syndrome.lability(u, None, None, "price").select("trait", F.round("pst", 6).alias("pst"), "lability_rank", F.round("ratio_to_reference", 6).alias("ratio_to_reference"))


_LEVELS = {
    "raw plants": "SELECT price AS x, balance AS y FROM plants",
    "plants within regions": "SELECT price - avg(price) OVER (PARTITION BY island) AS x, balance - avg(balance) OVER (PARTITION BY island) AS y FROM plants",
    "site means": "SELECT avg(price) AS x, avg(balance) AS y FROM plants GROUP BY site",
    "site means within regions": "SELECT x - avg(x) OVER (PARTITION BY island) AS x, y - avg(y) OVER (PARTITION BY island) AS y FROM (SELECT island, avg(price) AS x, avg(balance) AS y FROM plants GROUP BY island, site)",
    "region means": "SELECT avg(price) AS x, avg(balance) AS y FROM plants GROUP BY island",
    "region means, shape": "SELECT avg(flowers) AS x, avg(balance) AS y FROM plants GROUP BY island",
}
_ROWS = ", ".join(f"l{i} AS (SELECT '{name}' AS comparison, NULL AS omitted, x, y FROM ({q}))" for i, (name, q) in enumerate(_LEVELS.items()))
_RANKED = "rank() OVER (PARTITION BY comparison, omitted ORDER BY round({c}, 8)) + (count(*) OVER (PARTITION BY comparison, omitted, round({c}, 8)) - 1) / 2.0::DOUBLE"


@query(
    "size_signal_levels",
    f"""WITH {PLANTS}, {_ROWS}, g AS (SELECT island, avg(price) AS x, avg(balance) AS y FROM plants GROUP BY island),
u AS ({' UNION ALL '.join(f'SELECT * FROM l{i}' for i in range(len(_LEVELS)))} UNION ALL SELECT 'region means, one left out', o.island, g.x, g.y FROM g JOIN g o ON g.island <> o.island),
v AS (SELECT *, {_RANKED.format(c='x')} AS rx, {_RANKED.format(c='y')} AS ry FROM u)
SELECT comparison, omitted, count(*) AS n, round(corr(x, y), 5) AS r, round(corr(rx, ry), 5) AS rho FROM v GROUP BY comparison, omitted""",
)
def size_signal_levels(spark, sf_dir):
    """One correlation, Pearson's and Spearman's, at six levels of the hierarchy, and over regions with each left out in turn."""
    p = plants(spark, sf_dir).select("island", "site", F.col("price").alias("x"), F.col("balance").alias("y"), "flowers")
    s = p.groupBy("island", "site").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    g = p.groupBy("island").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("flowers").alias("shape"))
    within = lambda d: d.select(ranks.centred("x", "island").alias("x"), ranks.centred("y", "island").alias("y"))
    levels = dict(zip(_LEVELS, (p, within(p), s, within(s), g, g.select(F.col("shape").alias("x"), "y")), strict=True))
    left_out = g.select(F.col("island").alias("omitted")).join(g, F.col("island") != F.col("omitted"))  # a row a region
    rows = left_out.select(F.lit("region means, one left out").alias("comparison"), "omitted", "x", "y")
    for name, d in levels.items():
        rows = rows.unionByName(d.select(F.lit(name).alias("comparison"), F.lit(None).cast("string").alias("omitted"), "x", "y"))
    rows = written(rows.withColumn("omitted", F.coalesce("omitted", F.lit(""))), "levels")
    keys = ["comparison", "omitted"]
    out = ranks.pearson(rows, keys, "x", "y", p_value=False).join(ranks.spearman(rows, keys, "x", "y", p_value=False).drop("n"), keys)
    return out.select("comparison", F.nullif("omitted", F.lit("")).alias("omitted"), "n", F.round("r", 5).alias("r"), F.round("rho", 5).alias("rho"))


def _signed_rank_sql(name: str, value: str, null: float) -> str:
    """CTEs that end in ``{name}`` (l_returnflag, w, z)."""
    return f"""{name}x AS (SELECT l_returnflag AS g, round({value} - {null}, 8) AS d FROM d WHERE {value} IS NOT NULL AND round({value} - {null}, 8) <> 0),
{name}r AS (SELECT *, {_RANK.format(k='g', v='abs(d)')} AS r FROM {name}x), {name}t AS (SELECT g, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT g, abs(d) AS a, count(*) AS c FROM {name}x GROUP BY ALL) GROUP BY g),
{name}s AS (SELECT g, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM {name}r GROUP BY g), {name} AS (SELECT g AS l_returnflag, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM {name}s JOIN {name}t USING (g))"""


_LAYOUT = "d AS (SELECT l_returnflag, l_tax * 10 AS basal_frac, l_discount * 10 AS random_basal_frac, l_tax * 10 - l_discount * 10 AS difference, l_quantity / 50 AS mean_pos, nullif(l_quantity / 25, 0.04) AS midline_ratio, CASE WHEN l_linenumber > 2 THEN l_quantity / 20 END AS midline_ratio_distal FROM lineitem)"


@query(
    "layout_by_flag",
    f"""WITH {_LAYOUT}, {_signed_rank_sql('sa', 'difference', 0.0)}, {_signed_rank_sql('sb', 'midline_ratio', 1.0)}, {_signed_rank_sql('sc', 'midline_ratio_distal', 1.0)},
m AS (SELECT l_returnflag, count(*) AS n, round(avg(basal_frac), 6) AS mean_basal, round(median(difference), 6) AS median_difference, count(midline_ratio_distal) AS n_midline_ratio_distal, round(avg(midline_ratio_distal), 6) AS mean_midline_ratio_distal, round(median(midline_ratio_distal), 6) AS median_midline_ratio_distal, round(avg(CAST(midline_ratio > 1 AS INTEGER)), 6) AS share_midline_ratio_above_1 FROM d GROUP BY 1)
SELECT m.*, sa.w AS w_difference, round(sa.z, 5) AS z_difference, sb.w AS w_midline_ratio, round(sb.z, 5) AS z_midline_ratio, sc.w AS w_midline_ratio_distal, round(sc.z, 5) AS z_midline_ratio_distal FROM m JOIN sa USING (l_returnflag) JOIN sb USING (l_returnflag) JOIN sc USING (l_returnflag)""",
)
def layout_by_flag(spark, sf_dir):
    q = F.col("l_quantity")
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_tax") * 10).alias("basal_frac"), (F.col("l_discount") * 10).alias("random_basal_frac"), (q / 50).alias("mean_pos"), F.nullif(q / 25, F.lit(0.04)).alias("midline_ratio"), F.when(F.col("l_linenumber") > 2, q / 20).alias("midline_ratio_distal"))
    s = syndrome.layout_summary(d, ["l_returnflag"])
    tests = ("difference", "midline_ratio", "midline_ratio_distal")
    return s.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("mean_basal", "median_difference")), "n_midline_ratio_distal", *(F.round(c, 6).alias(c) for c in ("mean_midline_ratio_distal", "median_midline_ratio_distal", "share_midline_ratio_above_1")), *(f"w_{c}" for c in tests), *(F.round(f"z_{c}", 5).alias(f"z_{c}") for c in tests))
