"""Divergence queries: Pst, rank tests, resampling, correction, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corymb.operators import divergence as dv
from corymb.operators import ranks, relational
from corymb.plans.base import LONG, PLANTS, TRAITS, flowers, plants, pst_of_sums_sql, pst_sql, table, traits
from corymb.plans.registry import query


@query("pst_by_region", f"WITH {LONG},\n{pst_sql('trait', 'island', 'value', 'traits')}\nSELECT trait, n::BIGINT AS n, k::BIGINT AS k, round(pst, 6) AS pst FROM qp")
def pst_by_region(spark, sf_dir):
    """The flagship: every trait's divergence among regions, from plant means."""
    return dv.pst(traits(spark, sf_dir), ["trait"], "island", "value").select("trait", "n", "k", F.round("pst", 6).alias("pst"))


@query("pst_any_size", f"WITH {PLANTS},\n{pst_sql('', 'segment', 'frac_female', 'plants', 1)}\nSELECT n::BIGINT AS n, k::BIGINT AS k, round(pst, 6) AS pst FROM qp")
def pst_any_size(spark, sf_dir):
    return dv.pst(plants(spark, sf_dir), [], "segment", "frac_female", least=1).select("n", "k", F.round("pst", 6).alias("pst"))


@query("pst_by_return_flag", f"WITH l AS (SELECT l_returnflag, l_linestatus, l_quantity * (CASE l_returnflag WHEN 'R' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS q FROM lineitem),\n{pst_sql('l_linestatus', 'l_returnflag', 'q', 'l')}\nSELECT l_linestatus, n::BIGINT AS n, k::BIGINT AS k, round(pst, 6) AS pst FROM qp")
def pst_by_return_flag(spark, sf_dir):
    """Groups that do differ, so that more than the clamp at 0 is tested."""
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") * F.when(F.col("l_returnflag") == "R", 2.0).otherwise(1.0)).alias("q"))
    return dv.pst(d, ["l_linestatus"], "l_returnflag", "q").select("l_linestatus", "n", "k", F.round("pst", 6).alias("pst"))


@query(
    "pairwise_pst",
    f"""WITH {LONG}, s AS (SELECT trait, island, ord, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM traits WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT a.trait, a.island AS group_a, b.island AS group_b, a.n AS n_a, b.n AS n_b, a.n * b.n / (a.n + b.n)::DOUBLE * (a.m - b.m) * (a.m - b.m) AS msb, (a.ss + b.ss) / (a.n + b.n - 2) AS msw, (a.n + b.n) - (a.n * a.n + b.n * b.n) / (a.n + b.n)::DOUBLE AS n0 FROM s a JOIN s b ON a.trait = b.trait AND a.ord < b.ord)
SELECT trait, group_a, group_b, n_a, n_b, round(CASE WHEN n_a >= 2 AND n_b >= 2 THEN greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + 2 * msw) END, 6) AS pst FROM p""",
)
def pairwise_pst(spark, sf_dir):
    return dv.pairwise_pst(traits(spark, sf_dir), ["trait"], "island", "value", "ord").withColumn("pst", F.round("pst", 6))


@query(
    "eta_squared",
    f"""WITH {LONG}, s AS (SELECT trait, site, count(value) AS n, avg(value) AS m, var_pop(value) * count(value) AS ss FROM traits GROUP BY ALL),
g AS (SELECT trait, sum(n * m) / sum(n) AS grand FROM s GROUP BY trait)
SELECT trait, round(sum(n * (m - grand) * (m - grand)) / (sum(n * (m - grand) * (m - grand)) + sum(ss)), 7) AS eta2 FROM s JOIN g USING (trait) GROUP BY trait""",
)
def eta_squared(spark, sf_dir):
    return dv.eta_squared(traits(spark, sf_dir), ["trait"], "site", "value").withColumn("eta2", F.round("eta2", 7))


_WEIGHT = " + ".join(f"(d >= '{t:08x}')::INTEGER" for t in dv.POISSON)
_REP_SUMS = " UNION ALL ".join(f"SELECT '{t}' AS trait, rep, site AS g, sum(w)::DOUBLE AS n, sum(w * ({t} - c_{t})) AS x, sum(w * ({t} - c_{t}) * ({t} - c_{t})) AS q FROM w, c WHERE {t} IS NOT NULL GROUP BY rep, site" for t in TRAITS)


@query(
    "bootstrap_pst",
    f"""WITH {PLANTS}, c AS (SELECT {', '.join(f'avg({t}) AS c_{t}' for t in TRAITS)} FROM plants),
d AS (SELECT site, {', '.join(TRAITS)}, rep, substr(md5('0:' || plant || ':' || rep // 4), rep % 4 * 8 + 1, 8) AS d FROM plants, range(2000) AS r(rep)),
w AS (SELECT * EXCLUDE (d), {_WEIGHT} AS w FROM d WHERE d >= '{dv.POISSON[0]:08x}'),
u AS ({_REP_SUMS}), qs AS (SELECT trait, rep, g, n, x / n AS m, q - x * x / n AS ss FROM u WHERE n >= 2),
{pst_of_sums_sql('trait, rep')}
SELECT trait, round(quantile_cont(pst, 0.025), 6) AS lo, round(quantile_cont(pst, 0.975), 6) AS hi, count(pst) AS reps FROM qp GROUP BY trait""",
)
def bootstrap_pst(spark, sf_dir):
    """Every trait's divergence among sites with its bootstrap interval, from 2000 weighted repetitions."""
    out = dv.weighted_bootstrap(plants(spark, sf_dir), list(TRAITS), "site", "plant", reps=2000)
    return out.select("trait", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "reps")


@query("bootstrap_pst_whole")
def bootstrap_pst_whole(spark, sf_dir):
    """The same with exactly as many draws as a site has plants, 2000 times; a test compares small groups with a loop."""
    out = dv.bootstrap_interval(traits(spark, sf_dir), ["trait"], "site", "value", "plant", reps=2000)
    return out.select("trait", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "reps")


@query(
    "permutation_eta2",
    f"""WITH {LONG}, s AS (SELECT trait, island, site, avg(value) AS x FROM traits GROUP BY ALL),
m AS (SELECT trait, site, x, rep, row_number() OVER (PARTITION BY trait, rep ORDER BY md5('7:' || rep || ':' || site), site) AS p FROM s, range(4999) AS r(rep)),
l AS (SELECT trait, island AS label, row_number() OVER (PARTITION BY trait ORDER BY site) AS p FROM s),
z AS (SELECT m.trait, rep, label, x FROM m JOIN l USING (trait, p) UNION ALL SELECT trait, -1, island, x FROM s),
q AS (SELECT trait, rep, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM z GROUP BY ALL),
g AS (SELECT trait, rep, sum(n * m) / sum(n) AS grand FROM q GROUP BY ALL),
e AS (SELECT trait, rep, sum(n * (m - grand) * (m - grand)) / (sum(n * (m - grand) * (m - grand)) + sum(ss)) AS e FROM q JOIN g USING (trait, rep) GROUP BY ALL)
SELECT a.trait, round(max(a.e), 7) AS eta2, round((count(*) FILTER (WHERE b.e >= a.e - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 7) AS p FROM e a JOIN e b ON a.trait = b.trait AND a.rep = -1 AND b.rep >= 0 GROUP BY a.trait""",
)
def permutation_eta2(spark, sf_dir):
    s = traits(spark, sf_dir).groupBy("trait", "island", "site").agg(F.avg("value").alias("x"))
    return dv.label_permutation(s, ["trait"], "island", "x", "site", reps=4999, seed=7).select("trait", F.round("eta2", 7).alias("eta2"), F.round("p", 7).alias("p"))


_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0::DOUBLE)"
_KW = f"""x AS (SELECT trait, island, round(value, 8) AS v FROM traits WHERE value IS NOT NULL),
r AS (SELECT *, {_RANK.format(k='trait', v='v')} AS r FROM x),
t AS (SELECT trait, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT trait, v, count(*) AS c FROM x GROUP BY ALL) GROUP BY trait),
s AS (SELECT trait, sum(s * s / m) AS q, sum(m)::DOUBLE AS n, count(*) AS k FROM (SELECT trait, island, sum(r) AS s, count(*) AS m FROM r GROUP BY ALL) GROUP BY trait),
h AS (SELECT trait, n, k, (12.0::DOUBLE / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s JOIN t USING (trait))"""


@query("kruskal_wallis", f"WITH {LONG}, {_KW} SELECT trait, n::BIGINT AS n, k::BIGINT AS k, round(h, 5) AS h FROM h")
def kruskal_wallis(spark, sf_dir):
    return ranks.kruskal(traits(spark, sf_dir), ["trait"], "island", "value", p_value=False).withColumn("h", F.round("h", 5))


@query("kruskal_wallis_p")
def kruskal_wallis_p(spark, sf_dir):
    return ranks.adjusted(ranks.kruskal(traits(spark, sf_dir), ["trait"], "island", "value"), "p", "p_adjusted")


@query(
    "bh_adjusted",
    f"""WITH {LONG}, {_KW}, p AS (SELECT trait, CASE WHEN trait <> 'flowers' THEN exp(-h / 2) END AS p FROM h),
k AS (SELECT trait, coalesce(p, 1) AS q, row_number() OVER (ORDER BY coalesce(p, 1)) AS k, count(*) OVER () AS m FROM p)
SELECT trait, round(least(min(q * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) AS adjusted FROM k""",
)
def bh_adjusted(spark, sf_dir):
    """Correction over all traits, one of them missing; exp(-h/2) stands in for the chi-square tail with two degrees of freedom."""
    d = ranks.kruskal(traits(spark, sf_dir), ["trait"], "island", "value", p_value=False).select("trait", F.when(F.col("trait") != "flowers", F.exp(-F.col("h") / 2)).alias("p"))
    return ranks.adjusted(d, "p", "adjusted").select("trait", F.round("adjusted", 6).alias("adjusted"))


@query(
    "spearman_latitude",
    f"""WITH {LONG}, x AS (SELECT trait, round(value, 8) AS v, lat FROM traits WHERE value IS NOT NULL),
r AS (SELECT trait, {_RANK.format(k='trait', v='v')} AS a, {_RANK.format(k='trait', v='lat')} AS b FROM x)
SELECT trait, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY trait""",
)
def spearman_latitude(spark, sf_dir):
    return ranks.spearman(traits(spark, sf_dir), ["trait"], "value", "lat", p_value=False).withColumn("rho", F.round("rho", 6))


@query("pearson_by_region", f"WITH {PLANTS} SELECT island, count(*) AS n, round(corr(price, balance), 6) AS r FROM plants GROUP BY island")
def pearson_by_region(spark, sf_dir):
    return ranks.pearson(plants(spark, sf_dir), ["island"], "price", "balance", p_value=False).withColumn("r", F.round("r", 6))


@query("correlation_p_values")
def correlation_p_values(spark, sf_dir):
    p = plants(spark, sf_dir)
    a = ranks.pearson(p, ["island"], "price", "balance").select("island", "n", F.col("r").alias("coefficient"), "p", F.lit("pearson").alias("kind"))
    b = ranks.spearman(p, ["island"], "price", "balance").select("island", "n", F.col("rho").alias("coefficient"), "p", F.lit("spearman").alias("kind"))
    return a.unionByName(b)


_MW = f"""x AS (SELECT l_linestatus AS g, l_returnflag = 'A' AS side, round(l_extendedprice, 8) AS v FROM lineitem),
r AS (SELECT *, {_RANK.format(k='g', v='v')} AS r FROM x),
t AS (SELECT g, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT g, v, count(*) AS c FROM x GROUP BY ALL) GROUP BY g),
s AS (SELECT g, (count(*) FILTER (WHERE side))::DOUBLE AS n1, (count(*) FILTER (WHERE NOT side))::DOUBLE AS n2, sum(r) FILTER (WHERE side) - (count(*) FILTER (WHERE side)) * ((count(*) FILTER (WHERE side)) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY g)"""


@query("mann_whitney", f"WITH {_MW} SELECT g AS l_linestatus, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round((u - n1 * n2 / 2 + 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 5) AS z FROM s JOIN t USING (g) WHERE n1 > 0 AND n2 > 0")
def mann_whitney(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "A").alias("side"), "l_extendedprice")
    return ranks.mann_whitney(d, ["l_linestatus"], "side", "l_extendedprice", p_value=False).where("n1 > 0 AND n2 > 0").withColumn("z", F.round("z", 5))


@query(
    "wilcoxon_signed_rank",
    f"""WITH x AS (SELECT l_returnflag AS g, round(l_quantity - 25, 8) AS d FROM lineitem WHERE l_quantity <> 25),
r AS (SELECT *, {_RANK.format(k='g', v='abs(d)')} AS r FROM x),
t AS (SELECT g, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT g, abs(d) AS a, count(*) AS c FROM x GROUP BY ALL) GROUP BY g),
s AS (SELECT g, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r GROUP BY g)
SELECT g AS l_returnflag, n::BIGINT AS n, w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 5) AS z FROM s JOIN t USING (g)""",
)
def wilcoxon_signed_rank(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    return ranks.wilcoxon(d, ["l_returnflag"], "l_quantity", 25.0, p_value=False).withColumn("z", F.round("z", 5))


@query("rank_test_p_values")
def rank_test_p_values(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_returnflag") == "A").alias("side"), "l_extendedprice", "l_quantity")
    a = ranks.mann_whitney(d, ["l_linestatus"], "side", "l_extendedprice").select(F.lit("mann_whitney").alias("test"), F.col("l_linestatus").alias("g"), "z", "p")
    b = ranks.wilcoxon(d, ["l_returnflag"], "l_quantity", 25.0).select(F.lit("wilcoxon").alias("test"), F.col("l_returnflag").alias("g"), "z", "p")
    return a.unionByName(b)


@query(
    "plant_means",
    f"WITH {PLANTS} SELECT island, site, plant, lat, round(price, 4) AS price, flowers::BIGINT AS n_flowers, round(frac_female, 6) AS frac_female, segment FROM plants",
)
def plant_means(spark, sf_dir):
    return plants(spark, sf_dir).select("island", "site", "plant", "lat", F.round("price", 4).alias("price"), F.col("flowers").cast("long").alias("n_flowers"), F.round("frac_female", 6).alias("frac_female"), "segment")


@query("within_region_centred", f"WITH {PLANTS}, c AS (SELECT island, price - avg(price) OVER (PARTITION BY island) AS x, balance - avg(balance) OVER (PARTITION BY island) AS y FROM plants) SELECT island, round(covar_samp(x, y) / 1e6, 5) AS covariance, round(corr(x, y), 6) AS r FROM c GROUP BY island")
def within_region_centred(spark, sf_dir):
    d = plants(spark, sf_dir).select("island", ranks.centred("price", "island").alias("x"), ranks.centred("balance", "island").alias("y"))
    return d.groupBy("island").agg(F.round(F.covar_samp("x", "y") / 1e6, 5).alias("covariance"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("z_scores", f"WITH {PLANTS}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS d FROM plants) SELECT plant, round((price - m) / d, 6) AS z FROM plants, s")
def z_scores(spark, sf_dir):
    return ranks.standardised(plants(spark, sf_dir).select("plant", F.col("price").alias("z")), ["z"]).withColumn("z", F.round("z", 6))


@query(
    "common_support",
    f"WITH {PLANTS}, p AS (SELECT island, min(price) AS lo, max(price) AS hi FROM plants GROUP BY island), b AS (SELECT max(lo) AS lo, min(hi) AS hi FROM p) SELECT island, count(*) AS n_plants, count(DISTINCT site) AS n_sites, count(*) FILTER (WHERE price BETWEEN lo AND hi) AS common_plants, greatest(3 - count(DISTINCT site), 0) AS additional_sites_to_3, greatest(5 - count(DISTINCT site), 0) AS additional_sites_to_5, greatest(8 - count(DISTINCT site), 0) AS additional_sites_to_8, greatest(10 - count(DISTINCT site), 0) AS additional_sites_to_10 FROM plants, b GROUP BY island",
)
def common_support(spark, sf_dir):
    """Sampling gaps: how many plants lie in the band that all regions reach, and how many sites are missing."""
    p = plants(spark, sf_dir)
    band = relational.common_support(p, "island", "price")
    d = p.crossJoin(F.broadcast(band)).groupBy("island").agg(F.count("*").alias("n_plants"), F.count_distinct("site").alias("n_sites"), F.count_if(F.col("price").between(F.col("lo"), F.col("hi"))).alias("common_plants"))
    return d.select("*", *relational.shortfalls(F.col("n_sites"), name="additional_sites_to"))


@query("leave_one_region_out", f"WITH {PLANTS}, g AS (SELECT DISTINCT island AS omitted FROM plants) SELECT omitted, count(*) AS n, round(corr(price, balance), 6) AS r FROM plants, g WHERE island <> omitted GROUP BY omitted")
def leave_one_region_out(spark, sf_dir):
    return relational.leave_one_out(plants(spark, sf_dir), "island").groupBy("omitted").agg(F.count("*").alias("n"), F.round(F.corr("price", "balance"), 6).alias("r"))


@query("divergence_table", f"WITH {LONG},\n{pst_sql('trait', 'island', 'value', 'traits')},\n{_KW} SELECT trait, round(pst, 6) AS pst FROM qp JOIN h USING (trait) WHERE exp(-h / 2) < 0.9 ORDER BY qp.pst DESC, trait LIMIT 3")
def divergence_table(spark, sf_dir):
    """The traits that pass a threshold, the most divergent first; three of them are the report."""
    d = traits(spark, sf_dir)
    p = dv.pst(d, ["trait"], "island", "value").select("trait", "pst")
    h = ranks.kruskal(d, ["trait"], "island", "value", p_value=False).select("trait", "h")
    return relational.top_by(p.join(h, "trait").where(F.exp(-F.col("h") / 2) < 0.9), "pst", 3, "trait").select("trait", F.round("pst", 6).alias("pst"))


@query("site_means_by_pair", "WITH n AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), r AS (SELECT r_name, r_regionkey, c FROM region JOIN n ON r_regionkey = n_regionkey) SELECT a.r_name AS r_name_a, b.r_name AS r_name_b FROM r a JOIN r b ON a.r_regionkey < b.r_regionkey")
def site_means_by_pair(spark, sf_dir):
    return relational.unordered_pairs(table(spark, sf_dir, "region"), "r_name", "r_regionkey")


@query("flower_counts", "SELECT r_name AS island, n_name AS site, o_orderstatus AS phase, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def flower_counts(spark, sf_dir):
    g = flowers(spark, sf_dir).groupBy(F.col("r_name").alias("island"), F.col("n_name").alias("site"), F.col("o_orderstatus").alias("phase"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
