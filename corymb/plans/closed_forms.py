"""Queries whose results have a closed form or a plain relational twin: statistics from sums, tables of tests, sources and sinks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corymb.functions import scalars as sc
from corymb.operators import divergence as dv
from corymb.operators import mixture, models, ranks, syndrome
from corymb.operators import relational as rel
from corymb.plans import registry
from corymb.plans.base import LONG, PLANTS, TRAITS, plants, pst_sql, table, traits
from corymb.plans.divergence import _KW, _RANK
from corymb.plans.models import PROFILE, SIZED, _sized, _sites
from corymb.plans.pixels import _FIXED, GRID, H, W, _colours, _pixels, pixel_channels
from corymb.plans.registry import query
from corymb.sources import tables
from corymb.sources.scratch import scratch


def rounded(d, digits: int, *columns: str):
    return d.withColumns({c: F.round(c, digits) for c in columns})


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


# --- regressions over plants -----------------------------------------------------------------------

_LINES = f"""{SIZED}, g AS (SELECT trait, island, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM d GROUP BY ALL),
t AS (SELECT trait, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM d GROUP BY ALL),
w AS (SELECT trait, count(*) AS k, sum(sxx) AS wxx, sum(sxy) AS wxy, sum(syy) AS wyy, sum(syy - sxy * sxy / sxx) AS free, min_by(sxy / sxx, island) AS first_slope, min(island) AS first FROM g GROUP BY trait),
m AS (SELECT trait, n, syy AS tss, 'size' AS model, syy - sxy * sxy / sxx AS rss, sxy / sxx AS slope, 2 AS p FROM t UNION ALL SELECT trait, n, syy, 'additive', wyy - wxy * wxy / wxx, wxy / wxx, k + 1 FROM t JOIN w USING (trait) UNION ALL SELECT trait, n, syy, 'interaction', free, first_slope, 2 * k FROM t JOIN w USING (trait))"""


@query("allometric_models", f"WITH {_LINES} SELECT trait, model, n::BIGINT AS n, round(1 - rss / tss, 6) AS r2, round(n * (ln(2 * pi() * rss / n) + 1) + 2 * p, 4) AS aic, round(slope, 4) AS slope FROM m")
def allometric_models(spark, sf_dir):
    """All three models: one line, parallel lines, free lines."""
    d = models.hc3_lines(_sized(spark, sf_dir), "trait", "island", "x", "y").select("trait", "model", "n", "r2", "aic", "slope")
    return rounded(rounded(d, 4, "aic", "slope"), 6, "r2")


_PULL = "sqrt(sum(({x} / {s}) * ({x} / {s}) * e * e / ((1 - h) * (1 - h))))"


@query(
    "allometric_hc3_errors",
    f"""WITH {_LINES}, a AS (SELECT d.trait, d.x - t.mx AS x, sxx AS s, (d.y - t.my) - sxy / sxx * (d.x - t.mx) AS e, 1 / n + (d.x - t.mx) * (d.x - t.mx) / sxx AS h FROM d JOIN t USING (trait)),
b AS (SELECT d.trait, d.x - g.mx AS x, wxx AS s, (d.y - g.my) - wxy / wxx * (d.x - g.mx) AS e, 1.0::DOUBLE / g.n + (d.x - g.mx) * (d.x - g.mx) / wxx AS h FROM d JOIN g ON g.trait = d.trait AND g.island = d.island JOIN w ON w.trait = d.trait),
c AS (SELECT d.trait, d.x - g.mx AS x, sxx AS s, (d.y - g.my) - sxy / sxx * (d.x - g.mx) AS e, 1.0::DOUBLE / g.n + (d.x - g.mx) * (d.x - g.mx) / sxx AS h FROM d JOIN g ON g.trait = d.trait AND g.island = d.island JOIN w ON w.trait = d.trait AND w.first = d.island)
SELECT trait, 'size' AS model, round({_PULL.format(x='x', s='s')}, 3) AS se FROM a GROUP BY trait UNION ALL SELECT trait, 'additive', round({_PULL.format(x='x', s='s')}, 3) FROM b GROUP BY trait UNION ALL SELECT trait, 'interaction', round({_PULL.format(x='x', s='s')}, 3) FROM c GROUP BY trait""",
)
def allometric_hc3_errors(spark, sf_dir):
    """HC3 standard errors of the slopes; the interaction model's is that of the first group."""
    return rounded(models.hc3_lines(_sized(spark, sf_dir), "trait", "island", "x", "y").select("trait", "model", "se"), 3, "se")


_SITE_SUMS = f"""{SIZED}, s AS (SELECT trait, island, site, avg(x) AS x, avg(y) AS y FROM d GROUP BY ALL),
g AS (SELECT trait, island, count(*) AS n, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM s GROUP BY ALL),
t AS (SELECT trait, count(*) AS n, var_pop(y) * count(*) - (covar_pop(x, y) * count(*)) ** 2 / (var_pop(x) * count(*)) AS r0 FROM s GROUP BY trait),
w AS (SELECT trait, count(*) AS k, sum(syy) - sum(sxy) ** 2 / sum(sxx) AS r1, sum(syy - sxy * sxy / sxx) AS r2 FROM g GROUP BY trait)"""


@query(
    "site_ancova_f",
    f"""WITH {_SITE_SUMS} SELECT trait, 'shift' AS test, n AS n_sites, k - 1 AS df_num, n - k - 1 AS df_den, round((r0 - r1) / (k - 1) / (r1 / (n - k - 1)), 5) AS f, round((r0 - r1) / r0, 6) AS partial_r2 FROM t JOIN w USING (trait)
UNION ALL SELECT trait, 'slope', n, k - 1, n - 2 * k, round((r1 - r2) / (k - 1) / (r2 / (n - 2 * k)), 5), round((r1 - r2) / r1, 6) FROM t JOIN w USING (trait)""",
)
def site_ancova_f(spark, sf_dir):
    """The observed statistics of both site tests; their permutations are in ``allometry``."""
    s = _sized(spark, sf_dir).groupBy("trait", "island", "site").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    d = models.site_tests(s, "trait", "island", "site", "y", "x", permutations=0)
    return rounded(rounded(d.select("trait", "test", *(F.col(c).cast("long").alias(c) for c in ("n_sites", "df_num", "df_den")), "f", "partial_r2"), 5, "f"), 6, "partial_r2")


@query(
    "site_residual_spread",
    f"""WITH {SIZED}, m AS (SELECT trait, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d GROUP BY trait), s AS (SELECT trait, island, site, avg(y - a - b * x) AS r FROM d JOIN m USING (trait) GROUP BY ALL)
SELECT trait, island, count(*) AS n_sites, round(avg(r) / 1000, 5) AS mean_residual, round(stddev_samp(r) / 1000, 5) AS sd_residual, round(min(r) / 1000, 5) AS min_residual, round(max(r) / 1000, 5) AS max_residual FROM s GROUP BY ALL""",
)
def site_residual_spread(spark, sf_dir):
    d = models.residual_spread(_sized(spark, sf_dir), "trait", "island", "site", "x", "y")
    return d.select("trait", "island", "n_sites", *(F.round(F.col(c) / 1000, 5).alias(c) for c in ("mean_residual", "sd_residual", "min_residual", "max_residual")))


@query(
    "common_support_eta2",
    f"""WITH {SIZED}, o AS (SELECT island, min(size) AS a, max(size) AS b FROM d GROUP BY 1), u AS (SELECT max(a) AS lo, min(b) AS hi FROM o), c AS (SELECT d.* FROM d, u WHERE size BETWEEN lo AND hi),
m AS (SELECT trait, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM c GROUP BY trait), s AS (SELECT trait, island, site, count(*) AS n, avg(y - a - b * x) AS r FROM c JOIN m USING (trait) GROUP BY ALL),
g AS (SELECT trait, avg(r) AS m, sum(n)::BIGINT AS n_plants, count(*) AS n_sites, var_pop(r) * count(*) AS sst FROM s GROUP BY trait), h AS (SELECT trait, island, count(*) AS k, avg(r) AS m FROM s GROUP BY ALL)
SELECT trait, n_plants, n_sites, round(sum(k * (h.m - g.m) * (h.m - g.m)) / max(sst), 6) AS eta2 FROM h JOIN g USING (trait) GROUP BY trait, n_plants, n_sites""",
)
def common_support_eta2(spark, sf_dir):
    """Site residuals among the sizes that every region reaches."""
    d = models.within_common_support(_sized(spark, sf_dir), "island", "size").drop("lo", "hi")
    e = models.residual_eta2(d, "trait", "island", "site", "x", "y", permutations=1)
    return e.select("trait", F.col("n_plants").cast("long").alias("n_plants"), "n_sites", F.round("eta2", 6).alias("eta2"))


# --- modules and profiles --------------------------------------------------------------------------

_PAIR = {"wealth": ["balance"], "spending": ["price", "top_price"]}
_RESID = f"""{PLANTS}, p AS (SELECT *, ln(flowers) AS size FROM plants),
l AS (SELECT {', '.join(f'regr_slope({t}, size) AS b_{t}, regr_intercept({t}, size) AS a_{t}' for t in ('balance', 'price', 'top_price'))} FROM p),
r AS (SELECT island, site, plant, {', '.join(f'{t} - a_{t} - b_{t} * size AS {t}' for t in ('balance', 'price', 'top_price'))} FROM p, l),
q AS (SELECT {', '.join(f'avg({t}) AS m_{t}, stddev_samp({t}) AS s_{t}' for t in ('balance', 'price', 'top_price'))}, corr(price, top_price) AS c FROM r)"""


def _pair_modules(spark, sf_dir):
    return plants(spark, sf_dir).withColumn("size", F.ln("flowers"))


@query("module_scores_of_pairs", f"WITH {_RESID} SELECT plant, round((balance - m_balance) / s_balance, 6) AS wealth, round(((price - m_price) / s_price + (top_price - m_top_price) / s_top_price) / sqrt(2 * (1 + c)), 6) AS spending FROM r, q")
def module_scores_of_pairs(spark, sf_dir):
    """Modules of one and of two traits; two that go together load equally."""
    return rounded(models.module_scores(_pair_modules(spark, sf_dir), "size", _PAIR, ["plant"]), 6, "wealth", "spending")


@query("module_loadings", f"WITH {_RESID} SELECT 'wealth' AS module, 'balance' AS trait, 1.0::DOUBLE AS loading, 1.0::DOUBLE AS variance_share, round(b_balance, 4) AS slope FROM l UNION ALL SELECT 'spending', 'price', round(sqrt(0.5::DOUBLE), 6), round((1 + c) / 2, 6), round(b_price, 4) FROM l, q UNION ALL SELECT 'spending', 'top_price', round(sqrt(0.5::DOUBLE), 6), round((1 + c) / 2, 6), round(b_top_price, 4) FROM l, q")
def module_loadings(spark, sf_dir):
    return rounded(rounded(models.module_loadings(_pair_modules(spark, sf_dir), "size", _PAIR), 6, "loading", "variance_share"), 4, "slope")


_SITE_Z = f"""{PLANTS}, s AS (SELECT island, site, {', '.join(f'avg({c}) AS {c}' for c in PROFILE)} FROM plants GROUP BY ALL),
z AS (SELECT island, site, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in PROFILE)} FROM s)"""


def _site_z(spark, sf_dir):
    return ranks.standardised(_sites(spark, sf_dir).select("island", "site", *PROFILE), PROFILE)


_CENTRED = " UNION ALL ".join(f"SELECT island, site, '{c}' AS c, {c} - (price + balance + flowers) / 3 AS v FROM z" for c in PROFILE)


@query(
    "profile_f",
    f"""WITH {_SITE_Z}, l AS ({_CENTRED}), y AS (SELECT island, site, c, v - avg(v) OVER (PARTITION BY c) AS v FROM l),
g AS (SELECT island, c, sum(v) AS s, count(*) AS n FROM y GROUP BY ALL), k AS (SELECT count(DISTINCT island) AS k, count(DISTINCT site) AS n, sum(v * v) AS total FROM y), h AS (SELECT sum(s * s / n) AS gain FROM g)
SELECT 'module_by_group' AS test, (k - 1) * 2 AS df_num, (n - k) * 2 AS df_den, round((gain / ((k - 1) * 2)) / ((total - gain) / ((n - k) * 2)), 6) AS f FROM k, h
UNION ALL SELECT 'profile', (k - 1) * 2, (n - k) * 2, round((gain / (k - 1)) / ((total - gain) / (n - k)), 6) FROM k, h""",
)
def profile_f(spark, sf_dir):
    """The observed statistics of both profile tests; their permutations are in ``profile_tests``."""
    d = syndrome.profile_tests(_site_z(spark, sf_dir), "island", "site", PROFILE, permutations=0)
    return rounded(d.select("test", F.col("df_num").cast("long").alias("df_num"), F.col("df_den").cast("long").alias("df_den"), "f"), 6, "f")


_GROUP_Z = f"""{PLANTS}, s AS (SELECT island, site, {', '.join(f'avg({c}) AS {c}' for c in PROFILE)} FROM plants GROUP BY ALL), m AS (SELECT island, {', '.join(f'avg({c}) AS {c}' for c in PROFILE)} FROM s GROUP BY 1),
z AS (SELECT island, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in PROFILE)} FROM m)"""


@query("group_profile", f"WITH {_GROUP_Z} SELECT island, {', '.join(f'round(m.{c}, 4) AS mean_{c}, round(z.{c}, 6) AS z_{c}' for c in PROFILE)} FROM m JOIN z USING (island)")
def group_profile(spark, sf_dir):
    d = syndrome.group_matrix(_sites(spark, sf_dir), "island", PROFILE)
    return rounded(rounded(d, 4, *(f"mean_{c}" for c in PROFILE)), 6, *(f"z_{c}" for c in PROFILE))


_PAIRS = [(a, b) for i, a in enumerate(PROFILE) for b in PROFILE[i + 1 :]]
_PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS module_a, '{b}' AS module_b, count(*) AS n, round(corr({a}, {b}), 6) AS r, round(corr(r_{a}, r_{b}), 6) AS rho, round(degrees(acos(corr({a}, {b}))), 4) AS angle FROM k" for a, b in _PAIRS)


@query("trajectory_angles", f"WITH {_GROUP_Z}, k AS (SELECT *, {', '.join(f'rank() OVER (ORDER BY {c}) AS r_{c}' for c in PROFILE)} FROM z) {_PAIR_SQL}")
def trajectory_angles(spark, sf_dir):
    d = syndrome.pairwise_trajectories(syndrome.group_matrix(_sites(spark, sf_dir), "island", PROFILE), PROFILE)
    return rounded(rounded(d.select("module_a", "module_b", "n", "r", "rho", "angle"), 6, "r", "rho"), 4, "angle")


@query("geography_levels", f"WITH {_GROUP_Z}, a AS (SELECT island, avg(lat) AS lat FROM plants GROUP BY 1), k AS (SELECT *, rank() OVER (ORDER BY lat) AS r_lat, {', '.join(f'rank() OVER (ORDER BY {c}) AS r_{c}' for c in PROFILE)} FROM z JOIN a USING (island)) " + " UNION ALL ".join(f"SELECT 'z_{c}' AS variable, count(*) AS n, round(corr({c}, lat), 6) AS r, round(corr(r_{c}, r_lat), 6) AS rho FROM k" for c in PROFILE))
def geography_levels(spark, sf_dir):
    lat = plants(spark, sf_dir).groupBy("island").agg(F.avg("lat").alias("mean_lat"))
    d = syndrome.geography(syndrome.group_matrix(_sites(spark, sf_dir), "island", PROFILE), lat, "island", [f"z_{c}" for c in PROFILE])
    return rounded(d.select("variable", "n", "r", "rho"), 6, "r", "rho")


_COV = {"W": "sum((z.{a} - g.{a}) * (z.{b} - g.{b})) / (count(*) - count(DISTINCT z.island))"}
_N0 = "(SELECT (sum(n) - sum(n * n) / sum(n)::DOUBLE) / (count(*) - 1) FROM g)"


def _entries(a: str, b: str) -> str:
    within = _COV["W"].format(a=a, b=b)
    between = f"(SELECT sum(n * {a} * {b}) / (count(*) - 1) FROM g)"  # the grand mean of z scores is 0
    return f"SELECT 'W' AS matrix, '{a}' AS row, '{b}' AS col, round({within}, 6) AS value FROM z JOIN g USING (island) UNION ALL SELECT 'B_raw', '{a}', '{b}', round(({between} - {within}) / {_N0}, 6) FROM z JOIN g USING (island)"


@query("covariance_entries", f"WITH {_SITE_Z}, g AS (SELECT island, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in PROFILE)} FROM z GROUP BY 1) " + " UNION ALL ".join(_entries(a, b) for a in PROFILE for b in PROFILE))
def covariance_entries(spark, sf_dir):
    """Covariance within and between groups; B made semidefinite is in ``covariance_matrices``."""
    return rounded(models.covariance_entries(_sites(spark, sf_dir), "island", "site", PROFILE).where("matrix <> 'B_psd'"), 6, "value")


# --- tests and tables of tests ---------------------------------------------------------------------

_BH = "least(min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)"


@query("kruskal_wallis_tail", f"WITH {LONG}, {_KW}, p AS (SELECT trait, h, exp(-h / 2) * (1 + h / 2) AS p FROM h WHERE k = 5), o AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT trait, round(p, 6) AS p, round({_BH}, 6) AS p_adjusted FROM o")
def kruskal_wallis_tail(spark, sf_dir):
    """With five regions the chi-square tail has a closed form; corrected over all traits."""
    d = ranks.adjusted(ranks.kruskal(traits(spark, sf_dir), ["trait"], "island", "value"), "p", "p_adjusted").where("k = 5")
    return rounded(d.select("trait", "p", "p_adjusted"), 6, "p", "p_adjusted")


_SHIFTED = f"{LONG}, shifted AS (SELECT island, site, plant, trait, value * (1 + CASE WHEN trait IN ('price', 'flowers') THEN 0.2::DOUBLE * ord ELSE 0 END) AS value FROM traits)"
_KW2 = f"""x AS (SELECT trait, island, round(value, 8) AS v FROM shifted WHERE value IS NOT NULL), r AS (SELECT *, {_RANK.format(k='trait', v='v')} AS r FROM x),
t AS (SELECT trait, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT trait, v, count(*) AS c FROM x GROUP BY ALL) GROUP BY trait),
s AS (SELECT trait, sum(s * s / m) AS q, sum(m)::DOUBLE AS n FROM (SELECT trait, island, sum(r) AS s, count(*) AS m FROM r GROUP BY ALL) GROUP BY trait),
h AS (SELECT trait, (12.0::DOUBLE / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s JOIN t USING (trait))"""


@query("significant_traits", f"WITH {_SHIFTED}, {_KW2}, p AS (SELECT trait, exp(-h / 2) * (1 + h / 2) AS p FROM h), o AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p), a AS (SELECT trait, {_BH} AS p_adjusted FROM o),\n{pst_sql('trait', 'island', 'value', 'shifted')}\nSELECT trait, round(pst, 6) AS pst, round(p_adjusted, 6) AS p_adjusted FROM a JOIN qp USING (trait) WHERE p_adjusted < 0.05")
def significant_traits(spark, sf_dir):
    """Traits, two of them made to differ, whose corrected p is below 0.05, with their divergence."""
    d = traits(spark, sf_dir).withColumn("value", F.col("value") * (F.lit(1.0) + F.when(F.col("trait").isin("price", "flowers"), F.lit(0.2) * F.col("ord")).otherwise(0.0)))
    p = ranks.adjusted(ranks.kruskal(d, ["trait"], "island", "value"), "p", "p_adjusted").select("trait", "p_adjusted")
    return rounded(rel.significant(p).join(dv.pst(d, ["trait"], "island", "value").select("trait", "pst"), "trait").select("trait", "pst", "p_adjusted"), 6, "pst", "p_adjusted")


_TESTS = "t AS (SELECT l_shipdate::DATE AS day, avg(l_tax) AS slope_p, avg(l_discount) AS shift_p, avg(l_quantity) / 50 AS partial, CASE WHEN month(l_shipdate) % 2 = 0 THEN 'even' ELSE 'odd' END AS module FROM lineitem GROUP BY ALL), r AS (SELECT *, CASE WHEN slope_p < 0.05 THEN 'allometric_reconfiguration' WHEN shift_p < 0.05 THEN 'island_level_shift' ELSE 'simple_scaling_or_unresolved' END AS mode FROM t)"


def _tests(spark, sf_dir):
    """A made-up table of tests: ship days stand for traits."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.when(F.month("l_shipdate") % 2 == 0, "even").otherwise("odd").alias("module"))
    return g.agg(F.avg("l_tax").alias("slope_p"), F.avg("l_discount").alias("shift_p"), (F.avg("l_quantity") / 50).alias("partial"))


@query("response_mode_counts", f"WITH {_TESTS} SELECT module, count(*) AS n_traits, " + ", ".join(f"count(*) FILTER (WHERE mode = '{m}') AS n_{m}" for m in ("island_level_shift", "allometric_reconfiguration", "simple_scaling_or_unresolved")) + ", string_agg(DISTINCT mode, ';' ORDER BY mode) AS response_modes_present FROM r GROUP BY module")
def response_mode_counts(spark, sf_dir):
    return syndrome.response_summary(_tests(spark, sf_dir).withColumn("response_mode", syndrome.response_mode(F.col("slope_p"), F.col("shift_p"))))


@query("evidence_by_day", f"WITH {_TESTS} SELECT strftime(day, '%Y-%m-%d') AS trait, CASE module WHEN 'even' THEN 'signal' ELSE 'mechanical' END AS system, mode AS response_mode, round(partial, 6) AS effect, mode = CASE module WHEN 'even' THEN 'island_level_shift' ELSE 'simple_scaling_or_unresolved' END AS as_predicted FROM r WHERE day IN (SELECT day FROM t ORDER BY day LIMIT 40)")
def evidence_by_day(spark, sf_dir):
    """The first forty days as traits of interest, each with what was predicted for it."""
    t = _tests(spark, sf_dir).withColumn("trait", F.date_format("day", "yyyy-MM-dd"))
    first = {r["trait"]: ("signal", "island_level_shift") if r["module"] == "even" else ("mechanical", "simple_scaling_or_unresolved") for r in rel.top_by(t.withColumn("o", -F.unix_date("day")), "o", 40).select("trait", "module").collect()}  # forty rows
    d = syndrome.evidence(t.select("trait", F.col("shift_p").alias("shift_p_adjusted"), F.col("slope_p").alias("slope_p_adjusted"), F.col("partial").alias("shift_partial_r2")), first)
    return d.select("trait", "system", "response_mode", F.round("effect", 6).alias("effect"), "as_predicted")


@query("interpretation_by_p", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.05 THEN 'Module-by-island interaction supports non-parallel module divergence; temporal asynchrony remains untested.' WHEN l_discount < 0.10 THEN 'Module heterogeneity is suggestive but not decisive; a shared syndrome trajectory remains plausible.' ELSE 'Current data do not reject a shared three-module syndrome trajectory, despite heterogeneous trait-level response modes.' END AS interpretation FROM lineitem")
def interpretation_by_p(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", syndrome.interpretation(F.col("l_discount")).alias("interpretation"))


@query("lability_with_tests", f"WITH {LONG}, v AS (SELECT trait, stddev_samp(value) / avg(value) AS pst FROM traits GROUP BY trait), t AS (SELECT trait, count(value) AS n_tests FROM traits WHERE trait <> 'flowers' GROUP BY trait), m AS (SELECT trait, CASE WHEN trait = 'balance' THEN 'shift' ELSE 'scaling' END AS response_mode FROM t WHERE trait <> 'price') SELECT trait, n_tests, response_mode, rank() OVER (ORDER BY pst DESC)::INTEGER AS lability_rank FROM v LEFT JOIN t USING (trait) LEFT JOIN m USING (trait)")
def lability_with_tests(spark, sf_dir):
    """The lability table with both of its optional tables, each of which lacks a trait."""
    d = traits(spark, sf_dir)
    u = d.groupBy("trait").agg((F.stddev_samp("value") / F.avg("value")).alias("pst"))
    t = d.where("trait <> 'flowers'").groupBy("trait").agg(F.count("value").alias("n_tests"))
    m = t.where("trait <> 'price'").select("trait", F.when(F.col("trait") == "balance", "shift").otherwise("scaling").alias("response_mode"))
    return syndrome.lability(u, t, m, "price").select("trait", "n_tests", "response_mode", "lability_rank")


@query("hypotheses", f"WITH {LONG}, p AS (SELECT trait, corr(value, lat) AS r FROM traits GROUP BY trait) SELECT v.h AS hypothesis, v.s AS current_support, v.m AS metric, v.n AS name, CASE v.n WHEN 'within_island_plant_r' THEN (SELECT round(r, 6) FROM p WHERE trait = 'price') WHEN 'between_island_mean_r' THEN (SELECT round(r, 6) FROM p WHERE trait = 'balance') END AS value FROM (VALUES " + ", ".join(f"('{h}', '{s}', {i}, '{m[0]}')" for h, s, ms in syndrome.HYPOTHESES for i, m in enumerate(ms or (("not_applicable",),) * 4, 1)) + ") v(h, s, m, n)")
def hypotheses(spark, sf_dir):
    """Four numbers a hypothesis; only the correlations are there in the driver's tables."""
    c = traits(spark, sf_dir).groupBy(F.col("trait").alias("key")).agg(F.round(F.corr("value", "lat"), 6).alias("r"))
    return syndrome.hypotheses(spark, {"correlations": c}, {"within": "price", "between": "balance"})


# --- joins -----------------------------------------------------------------------------------------

_MASTER = """SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'p' ELSE 'na' END AS status, c_custkey AS collar, n_name AS sheet, (c_custkey % 50)::VARCHAR AS sheet_corolla_id,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS organ_length_mm, s_suppkey::BIGINT AS pollen, CASE WHEN c_nationkey % 3 < 2 AND (s_suppkey IS NULL OR s_suppkey % 4 = 0) THEN 'status_but_no_measurement' WHEN c_nationkey % 3 = 2 AND s_suppkey % 4 <> 0 THEN 'measured_but_status_na' ELSE '' END AS organ_status_check
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 50 ORDER BY s_suppkey DESC) = 1) s ON s_nationkey = c_nationkey AND s_suppkey % 50 = c_custkey % 50"""


def _master(spark, sf_dir):
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    status = F.when(F.col("c_nationkey") % 3 == 0, "s").when(F.col("c_nationkey") % 3 == 1, "p").otherwise("na")
    metadata = c.select(F.col("c_custkey").alias("id"), status.alias("status"), F.col("c_custkey").alias("collar"))
    index = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("global_id"), F.col("n_name").alias("sheet"), (F.col("c_custkey") % 50).cast("string").alias("sheet_corolla_id"))
    found = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("sheet"), (F.col("s_suppkey") % 50).cast("string").alias("corolla_id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("organ_length_mm"), F.col("s_suppkey").cast("long").alias("pollen"))
    # of rows with one key the last one holds, as in a table that is read into a dictionary
    found = found.groupBy("sheet", "corolla_id").agg(F.max(F.struct("pollen", "organ_length_mm")).alias("last")).select("sheet", "corolla_id", "last.organ_length_mm", "last.pollen")
    return rel.integrate_metadata(metadata, index, found.drop("pollen"), found.drop("organ_length_mm"), ["organ_length_mm"], ["pollen"])


@query("metadata_master", _MASTER)
def metadata_master(spark, sf_dir):
    """Customers as field records, suppliers as what was measured."""
    return _master(spark, sf_dir)


@query("master_with_spatial", "SELECT c_custkey AS id, round(s_acctbal / 10000, 6) AS guide_basal_frac, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::DOUBLE END AS guide_midline_ratio FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def master_with_spatial(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("s").alias("sheet"), F.col("c_custkey").cast("string").alias("sheet_corolla_id"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("sheet"), F.col("s_suppkey").cast("string").alias("corolla_id"), F.round(F.col("s_acctbal") / 10000, 6).alias("basal_frac_prox_third"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("double")).alias("midline_ratio_distal"))
    return rel.with_spatial(m, s).select("id", "guide_basal_frac", "guide_midline_ratio")


@query("side_roles", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN greatest(l_extendedprice, l_quantity) ELSE least(l_extendedprice, l_quantity) END AS length, CASE WHEN l_quantity >= 25 THEN least(l_extendedprice, l_quantity) ELSE greatest(l_extendedprice, l_quantity) END AS width FROM lineitem")
def side_roles(spark, sf_dir):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    length, width = rel.side_roles(F.greatest(p, q), F.least(p, q), q, F.lit(25.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", length.alias("length"), width.alias("width"))


@query("report_numbers", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS quarter, format('{:.2e}', l_extendedprice / 7) AS price, concat_ws('_', l_returnflag, l_linenumber) AS site FROM lineitem")
def report_numbers(spark, sf_dir):
    """Numbers as reports show them; eighths make ties, which go to even."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 8).alias("quarter"), (F.col("l_extendedprice") / 7).alias("price"), sc.site_key(F.col("l_returnflag"), F.col("l_linenumber")).alias("site"))
    return tables.formatted(d, {"quarter": 2}, ("price",))


@query("midline_shares", "SELECT l_orderkey, l_linenumber, round(l_quantity / (l_quantity + l_extendedprice / 1000 + 1e-6), 7) AS share FROM lineitem")
def midline_shares(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.relative_midline_distance(F.col("l_quantity"), F.col("l_extendedprice") / 1000), 7).alias("share"))


@query("csv_round_trip", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS island, o_orderkey::INTEGER AS no, o_totalprice AS lat, NULL::DOUBLE AS lon, o_custkey::INTEGER AS id, NULL::INTEGER AS collar, o_orderstatus AS organ, NULL::VARCHAR AS status FROM orders")
def csv_round_trip(spark, sf_dir):
    """Orders as field records, written with a byte-order mark, replaced, and read back; ``nan`` and blanks are null."""
    o = table(spark, sf_dir, "orders")
    d = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("island"), F.col("o_orderkey").alias("no"), F.col("o_totalprice").alias("lat"), F.lit("nan").alias("lon"), F.col("o_custkey").alias("id"), F.lit(None).cast("int").alias("collar"), F.col("o_orderstatus").alias("organ"), F.lit(None).cast("string").alias("status"))
    path = scratch(spark, "csv")
    tables.write_csv(d.limit(3), path, bom=True)
    tables.write_csv(d, path, bom=True)
    return tables.read_csv(spark, path, "field_metadata")


@query("sources_at_hand", "SELECT r_name, 0::BIGINT AS optional_rows FROM region")
def sources_at_hand(spark, sf_dir):
    """The first source that is there, and an optional one that isn't."""
    path = tables.first_existing(spark, f"{sf_dir}/no_such_table.parquet", f"{sf_dir}/region.parquet")
    none = tables.optional_csv(spark, f"{sf_dir}/no_such_table.csv", "guide_traits").agg(F.count("*").alias("optional_rows"))
    return spark.read.parquet(path).select("r_name").crossJoin(none)  # one row


@query("trait_definitions", "WITH d AS (SELECT *, row_number() OVER () AS number FROM (VALUES " + _values(rel.TRAIT_DEFINITIONS) + ") v(trait, definition)), m AS (SELECT l_linenumber AS number, count(*) AS measured, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1) SELECT trait, definition, coalesce(measured, 0) AS measured, mean FROM d LEFT JOIN m USING (number)")
def trait_definitions(spark, sf_dir):
    """Each trait's definition, how often it was measured, and its mean; line numbers stand for traits."""
    number = F.create_map(*(x for i, (name, _) in enumerate(rel.TRAIT_DEFINITIONS, 1) for x in (F.lit(name), F.lit(i))))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("number")).agg(F.count("*").alias("measured"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    d = rel.trait_definitions(spark).withColumn("number", F.element_at(number, F.col("trait"))).join(m, "number", "left")
    return d.select("trait", "definition", F.coalesce("measured", F.lit(0)).alias("measured"), "mean")


@query("evidence_scope", "WITH d AS (SELECT *, row_number() OVER () AS number FROM (VALUES " + _values(syndrome.SCOPE) + ") v(component, current, evidence_status, priority_next)), m AS (SELECT substr(o_orderpriority, 1, 1)::INTEGER AS number, count(*) AS records FROM orders GROUP BY 1) SELECT component, current, evidence_status, priority_next, coalesce(records, 0) AS records FROM d LEFT JOIN m USING (number)")
def evidence_scope(spark, sf_dir):
    """What each component's evidence covers, and how many records bear on it; order priorities stand for components."""
    number = F.create_map(*(x for i, r in enumerate(syndrome.SCOPE, 1) for x in (F.lit(r[0]), F.lit(i))))
    m = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("number")).agg(F.count("*").alias("records"))
    d = syndrome.scope_table(spark).withColumn("number", F.element_at(number, F.col("component"))).join(m, "number", "left")
    return d.select("component", "current", "evidence_status", "priority_next", F.coalesce("records", F.lit(0)).alias("records"))


#: Centres of petal, guide and oxidation, to which each third of the embeddings adds its own mean.
_CENTRES = ((2.0, 18.0), (25.0, -5.0), (20.0, 40.0))
_ROLED_SQL = "WITH v AS (SELECT vec_id % 3 AS k, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), c AS (SELECT count(*) / (SELECT count(*) FROM v)::DOUBLE AS w, m.a + avg(v.a) AS a, m.b + avg(v.b) AS b FROM v JOIN (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(_CENTRES)) + ") m(k, a, b) USING (k) GROUP BY k, m.a, m.b), g AS (SELECT *, row_number() OVER (ORDER BY a - b DESC) = 1 AS guide FROM c), o AS (SELECT *, NOT guide AND row_number() OVER (PARTITION BY guide ORDER BY a + b DESC) = 1 AS oxidation FROM g), r AS (SELECT *, CASE WHEN guide THEN 'guide' WHEN oxidation THEN 'oxidation' ELSE 'petal' END AS role FROM o)"


def _roled(spark, sf_dir) -> mixture.ColourMixture:
    """A mixture of three colours with weights and centres from the embeddings; the driver gets a row a component."""
    s = _colours(spark, sf_dir).groupBy((F.col("vec_id") % 3).cast("int").alias("k")).agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    rows = s.orderBy("k").collect()
    n = sum(r["n"] for r in rows)
    means = [[_CENTRES[r["k"]][0] + r["a"], _CENTRES[r["k"]][1] + r["b"]] for r in rows]
    return mixture.ColourMixture(["a", "b"], [r["n"] / n for r in rows], means, _FIXED.covariances.tolist()[: len(rows)])


@query("mixture_roles", _ROLED_SQL + " SELECT (CASE role WHEN 'petal' THEN 0 WHEN 'guide' THEN 1 ELSE 2 END)::INTEGER AS component, role, round(w, 6) AS weight, round(a, 6) AS mean_a_star, round(b, 6) AS mean_b_star, round(sqrt(a * a + b * b), 6) AS chroma, round(degrees(atan2(b, a)), 6) AS hue_deg, round(a - b, 6) AS magenta_score, round(a + b, 6) AS yellow_red_score FROM r")
def mixture_roles(spark, sf_dir):
    """A mixture's components by role, in their fixed order."""
    return rounded(mixture.component_table(spark, _roled(spark, sf_dir)), 6, "weight", "mean_a_star", "mean_b_star", "chroma", "hue_deg", "magenta_score", "yellow_red_score")


@query("mixture_saved", _ROLED_SQL + " SELECT (row_number() OVER (ORDER BY b) + 5)::INTEGER AS rank, round(w, 6) AS weight, round(a, 6) AS mean_a, round(b, 6) AS mean_b FROM c")
def mixture_saved(spark, sf_dir):
    """A model written and read again."""
    path = scratch(spark, "mixture")
    mixture.save(spark, _roled(spark, sf_dir), path)
    m = mixture.load(spark, path, ["a", "b"])
    rows = [(r + 6, *map(float, (m.weights[i], *m.means[i]))) for r, i in enumerate(m.means[:, 1].argsort())]
    return rounded(spark.createDataFrame(rows, "rank int, weight double, mean_a double, mean_b double"), 6, "weight", "mean_a", "mean_b")


@query(
    "component_sizes",
    f"""WITH RECURSIVE {GRID}, p AS (SELECT image_id, y, x FROM px WHERE pat), e AS (SELECT a.image_id, a.y AS y, a.x AS x, b.y AS v, b.x AS u FROM p a JOIN p b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
c AS (SELECT image_id, y, x, y * 1000 + x AS root FROM p UNION SELECT e.image_id, e.v, e.u, c.root FROM c JOIN e ON c.image_id = e.image_id AND c.y = e.y AND c.x = e.x),
l AS (SELECT image_id, y, x, min(root) AS root FROM c GROUP BY ALL)
SELECT image_id, count(*) AS n_px, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM l GROUP BY image_id, root HAVING count(*) >= 3""",
)
def component_sizes(spark, sf_dir):
    """Connected pieces of a pattern, without those of one or two pixels."""
    from corymb.operators import imaging

    d = imaging.components(imaging.mask_column(_pixels(spark, sf_dir), "pat"), 3)
    return rounded(d.select("image_id", "n_px", "cx", "cy"), 6, "cx", "cy")


# --- figures and files -----------------------------------------------------------------------------

_FOREST = registry.oracle_sql()["bootstrap_pst"].rpartition("\nSELECT trait,")[0]


@query("forest_data", f"{_FOREST},\nqi AS (SELECT trait, quantile_cont(pst, 0.025) AS lo, quantile_cont(pst, 0.975) AS hi FROM qp GROUP BY trait), traits AS ({' UNION ALL '.join(f"SELECT '{t}' AS trait, site, {t} AS value FROM plants" for t in TRAITS)}),\n{pst_sql('trait', 'site', 'value', 'traits', prefix='o')}\nSELECT trait, round(pst, 6) AS pst, round(lo, 6) AS lo, round(hi, 6) AS hi FROM op JOIN qi USING (trait)")
def forest_data(spark, sf_dir):
    """What a forest plot shows: each trait's divergence among sites and its interval."""
    p = dv.pst(traits(spark, sf_dir), ["trait"], "site", "value").select("trait", "pst")
    q = dv.weighted_bootstrap(plants(spark, sf_dir), list(TRAITS), "site", "plant", reps=2000).drop("reps")
    return rounded(p.join(q, "trait"), 6, "pst", "lo", "hi")


@query(
    "heatmap_data",
    f"""WITH {LONG}, s AS (SELECT trait, island, ord, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM traits WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT a.island AS group_a, b.island AS group_b, a.n * b.n / (a.n + b.n)::DOUBLE * (a.m - b.m) * (a.m - b.m) AS msb, (a.ss + b.ss) / (a.n + b.n - 2) AS msw, (a.n + b.n) - (a.n * a.n + b.n * b.n) / (a.n + b.n)::DOUBLE AS n0 FROM s a JOIN s b ON a.trait = b.trait AND a.ord < b.ord WHERE a.n >= 2 AND b.n >= 2),
v AS (SELECT group_a, group_b, greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + 2 * msw) AS pst FROM p), m AS (SELECT group_a, group_b, avg(pst) AS mean FROM v GROUP BY ALL)
SELECT group_a, group_b, round(mean, 6) AS mean FROM m UNION ALL SELECT group_b, group_a, round(mean, 6) FROM m""",
)
def heatmap_data(spark, sf_dir):
    """What a heat map shows: the mean over traits of every pair's divergence, both ways."""
    m = dv.pairwise_pst(traits(spark, sf_dir), ["trait"], "island", "value", "ord").groupBy("group_a", "group_b").agg(F.round(F.avg("pst"), 6).alias("mean"))
    return m.unionByName(m.select(F.col("group_b").alias("group_a"), F.col("group_a").alias("group_b"), "mean"))


@query("stroke_statistics_file", registry.oracle_sql()["pixel_channels"])
def stroke_statistics_file(spark, sf_dir):
    """Colour statistics of strokes, through the CSV files that hold them."""
    d = pixel_channels(spark, sf_dir)
    path = scratch(spark, "strokes")
    tables.write_csv(d, path, files=None)
    return tables.read_csv(spark, path, d.schema)


@query("audit_pictures", f"SELECT s_suppkey::BIGINT AS image_id, 'sheet_' || s_suppkey || '.png' AS name, true AS is_png, {W}::BIGINT AS width, {H}::BIGINT AS height FROM supplier")
def audit_pictures(spark, sf_dir):
    """Each image's pattern laid over it, written as a file and read back by its name."""
    from corymb.operators import imaging

    both = imaging.mask_column(_pixels(spark, sf_dir), "roi").join(imaging.mask_column(_pixels(spark, sf_dir), "pat").select("image_id", F.col("mask").alias("pattern")), "image_id")

    def draw(r: dict) -> list[dict]:
        roi, pattern = (np.frombuffer(r[c], np.uint8).reshape(r["h"], r["w"]) for c in ("mask", "pattern"))
        return [{"name": f"sheet_{r['image_id']}.png", "content": imaging.encode(imaging.overlay_pattern(imaging.overlay_grid(np.full(roi.shape, 230, np.uint8), 16), roi, pattern))}]

    path = scratch(spark, "audit")
    tables.write_files(imaging.per_image(both, draw, "name string, content binary"), path)
    d = tables.images(spark, path)
    return d.select(F.regexp_extract("stem", r"(\d+)$", 1).cast("long").alias("image_id"), F.concat("stem", F.lit(".png")).alias("name"), (F.substring("content", 2, 3).cast("string") == "PNG").alias("is_png"), *(F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long").alias(c) for c, at in (("width", 17), ("height", 21))))


@query("measured_sheets", "SELECT 'sheet_' || s_suppkey AS sheet, 1 AS flowers, true AS length_fits, true AS width_fits, CASE WHEN s_suppkey % 2 = 0 THEN 'opened_full' ELSE 'folded_half' END AS fold_state FROM supplier")
def measured_sheets(spark, sf_dir):
    """A sheet for each supplier with one outlined flower whose size its nation tells, from bytes to measurements."""
    from corymb.operators import imaging

    def make(batches):
        for b in batches:
            for key, v in zip(b["s_suppkey"], b["v"], strict=True):
                raw = np.full((620, 560, 3), 250, np.uint8)
                y, x = np.mgrid[:620, :560]
                d = ((x - 280) / (100.0 + 2 * v)) ** 2 + ((y - 310) / (180.0 + 3 * v)) ** 2
                raw[d < 1] = (180, 120, 190)
                ann = raw.copy()
                ann[(d > 0.96) & (d < 1.06)] = (230, 20, 20)
                yield pd.DataFrame([(f"sheet_{key}", imaging.encode(raw), imaging.encode(ann))], columns=["sheet", "raw", "annotated"])

    scans = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 12).cast("int").alias("v"))
    sheets = scans.repartition(16, "s_suppkey").mapInPandas(make, "sheet string, raw binary, annotated binary")
    folds = scans.where("s_suppkey % 2 = 0").select(F.concat(F.lit("sheet_"), F.col("s_suppkey").cast("string")).alias("sheet"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(1)).alias("number"))
    m = imaging.measure_sheets(sheets, folds=folds).join(scans.select(F.concat(F.lit("sheet_"), F.col("s_suppkey").cast("string")).alias("sheet"), "v"), "sheet")
    fits = lambda value, half: (F.abs(value / (half * 2 * sc.MM_PER_PX) - 1) < 0.06)
    d = m.select("sheet", fits(F.col("corolla_length_mm"), F.col("v") * 3 + 180.0).alias("a"), fits(F.col("corolla_width_obs_mm"), F.col("v") * 2 + 100.0).alias("b"), "fold_state")
    return d.groupBy("sheet", "fold_state").agg(F.count("*").cast("int").alias("flowers"), F.bool_and("a").alias("length_fits"), F.bool_and("b").alias("width_fits")).select("sheet", "flowers", "length_fits", "width_fits", "fold_state")
