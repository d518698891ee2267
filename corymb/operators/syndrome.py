"""Module-level divergence: trajectories, integration, response modes, evidence tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corymb.functions.scalars import angle_of_correlation
from corymb.functions.tails import f_sf
from corymb.operators import kernels as k
from corymb.operators import ranks
from corymb.operators.models import over_sites
from corymb.operators.relational import argmax_column, leave_one_out
from corymb.sources.scratch import written

#: Fixed text of the evidence table: component, what is measured, its standing, what to measure next.
SCOPE = (
    ("attraction", "nectar-guide coverage", "direct signal-amount proxy", "visible/UV contrast; display; nectar; scent"),
    ("pollination_function", "mouth width; throat width; tube flare", "morphological fit proxies", "visitor body/proboscis size; stigma/anther contact; pollen removal/deposition"),
    ("reproductive_assurance", "organ length and organ/corolla ratio", "NOT direct assurance; reproductive geometry proxy only", "bagged autonomous seed set; hand-self; hand-cross; open + supplemental cross; herkogamy; dichogamy; SC/SI"),
    ("population_history", "no population-matched neutral baseline used here", "must remain separate until sampling is matched", "same-plant/same-site neutral SNPs; coancestry; common garden/families"),
)


def scope_table(spark) -> DataFrame:
    return spark.createDataFrame(SCOPE, "component string, current string, evidence_status string, priority_next string")


def site_scores(plants: DataFrame, group: str, site: str, modules: list[str]) -> DataFrame:
    return plants.groupBy(group, site).agg(F.count("*").alias("n_plants"), *(F.avg(m).alias(m) for m in modules))


def group_matrix(sites: DataFrame, group: str, modules: list[str]) -> DataFrame:
    """Group means of the modules, and the same as z scores over groups."""
    means = sites.groupBy(group).agg(*(F.avg(m).alias(f"mean_{m}") for m in modules))
    z = ranks.standardised(means.select(group, *(F.col(f"mean_{m}").alias(f"z_{m}") for m in modules)), [f"z_{m}" for m in modules])
    return means.join(z, group)


def trajectories(sites: DataFrame, group: str, modules: list[str]) -> DataFrame:
    """Each group's place on the best common axis, and how far it lies off that axis."""
    m = written(group_matrix(sites, group, modules), "group_matrix")  # a row a group, read twice
    cols = [f"z_{c}" for c in modules]
    schema = f"{group} string, rank1_fraction double, syndrome_axis_score double, orthogonal_residual_norm double, " + ", ".join(f"rank1_fitted_{c} double, rank1_residual_{c} double" for c in modules)

    def work(x: np.ndarray, g: np.ndarray, _: int) -> list:
        share, fit, rest, score = k.rank_one(x)
        return [(g[i], share, float(score[i]), float(np.linalg.norm(rest[i])), *(float(v) for j in range(len(modules)) for v in (fit[i, j], rest[i, j]))) for i in range(len(g))]

    return m.withColumn(group, F.col(group).cast("string")).join(over_sites(m, group, group, cols, work, schema), group)


def pairwise_trajectories(matrix: DataFrame, modules: list[str]) -> DataFrame:
    """(module_a, module_b, n, pearson r, its p, spearman rho, its p, angle) across groups."""
    parts = []
    for a, b in combinations(modules, 2):
        d = matrix.select(F.lit(a).alias("module_a"), F.lit(b).alias("module_b"), F.col(f"z_{a}").alias("x"), F.col(f"z_{b}").alias("y"))
        p = ranks.pearson(d, ["module_a", "module_b"], "x", "y", least=2).withColumnRenamed("p", "pearson_p")
        s = ranks.spearman(d, ["module_a", "module_b"], "x", "y", least=2, few=True).drop("n").withColumnRenamed("p", "spearman_p")
        parts.append(p.join(s, ["module_a", "module_b"]).withColumn("angle", angle_of_correlation(F.col("r"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trajectory_bootstrap(sites: DataFrame, group: str, site: str, modules: list[str], *, reps: int = 200, chunks: int = 8, seed: int = 0) -> DataFrame:
    """(statistic, lo, hi, reps) of the rank-one share, the mean correlation and each module's Pst, sites drawn in groups."""

    def work(x: np.ndarray, g: np.ndarray, chunk: int) -> list:
        rng, out, levels = np.random.default_rng([seed, chunk]), [], np.unique(g)
        for _ in range(k.dealt(reps, chunks, chunk)):
            i = k.resample_in_groups(g, rng)
            means = np.stack([x[i][g[i] == v].mean(0) for v in levels])
            z = k.zscores(means)
            out.append(("rank1_fraction", float(k.rank_one(z)[0])))
            out.append(("coherence", float(np.corrcoef(z, rowvar=False)[np.triu_indices(len(modules), 1)].mean())))
            out += [(f"pst_{m}", k.pst_of(x[i][:, j], g[i])) for j, m in enumerate(modules)]
        return out

    d = over_sites(sites, group, site, modules, work, "statistic string, v double", chunks=chunks).where("NOT isnan(v)")
    q = d.groupBy("statistic").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("v").alias("reps"))
    return q.select("statistic", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "reps")


def profile_tests(sites: DataFrame, group: str, site: str, modules: list[str], *, permutations: int = 999, seed: int = 0) -> DataFrame:
    """Two tests of whether groups' profiles are parallel: module by group, and the pseudo-F of profiles."""

    def work(x: np.ndarray, g: np.ndarray, _: int) -> list:
        a = k.profile_interaction(x, g, permutations, np.random.default_rng([seed, 1]))
        b = k.profile_permanova(x, g, permutations, np.random.default_rng([seed, 2]))
        keys = ("f", "df_num", "df_den", "parametric_p", "permutation_p")
        return [("module_by_group", *(a[c] for c in keys), a["partial_r2"]), ("profile", *(b[c] for c in keys), None)]

    return over_sites(sites, group, site, modules, work, "test string, f double, df_num int, df_den int, parametric_p double, permutation_p double, partial_r2 double")


def integration(sites: DataFrame, group: str, modules: list[str]) -> DataFrame:
    """(module_a, module_b, within_r, between_r, delta): correlation in groups against that of group means."""
    centred = sites.select(group, *(ranks.centred(m, group).alias(m) for m in modules))
    means = sites.groupBy(group).agg(*(F.avg(m).alias(m) for m in modules))
    pairs = list(combinations(modules, 2))
    pick = lambda d, name: d.agg(F.array(*(F.struct(F.lit(a).alias("module_a"), F.lit(b).alias("module_b"), F.corr(a, b).alias(name)) for a, b in pairs)).alias("x")).select(F.inline("x"))
    return pick(centred, "within_r").join(pick(means, "between_r"), ["module_a", "module_b"]).withColumn("delta", F.col("between_r") - F.col("within_r"))


def integration_left_out(sites: DataFrame, group: str, modules: list[str]) -> DataFrame:
    """:func:`integration` without each group in turn, in one plan."""
    d = leave_one_out(sites, group)
    centred = d.select("omitted", *(ranks.centred(m, "omitted", group).alias(m) for m in modules))
    means = d.groupBy("omitted", group).agg(*(F.avg(m).alias(m) for m in modules))
    pairs = list(combinations(modules, 2))
    pick = lambda x, name: x.groupBy("omitted").agg(F.array(*(F.struct(F.lit(a).alias("module_a"), F.lit(b).alias("module_b"), F.corr(a, b).alias(name)) for a, b in pairs)).alias("x")).select("omitted", F.inline("x"))
    return pick(centred, "within_r").join(pick(means, "between_r"), ["omitted", "module_a", "module_b"]).withColumn("delta", F.col("between_r") - F.col("within_r"))


def integration_bootstrap(sites: DataFrame, group: str, site: str, modules: list[str], *, reps: int = 200, chunks: int = 8, seed: int = 0) -> DataFrame:
    pairs = list(combinations(modules, 2))

    def work(x: np.ndarray, g: np.ndarray, chunk: int) -> list:
        rng, out = np.random.default_rng([seed, chunk]), []
        for _ in range(k.dealt(reps, chunks, chunk)):
            i = k.resample_in_groups(g, rng)
            out += [(a, b, *map(float, v)) for (a, b), v in zip(pairs, k.integration(x[i], g[i]), strict=True)]
        return out

    d = over_sites(sites, group, site, modules, work, "module_a string, module_b string, within_r double, between_r double, delta double", chunks=chunks)
    ends = F.array(F.lit(0.025), F.lit(0.975))
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return d.groupBy("module_a", "module_b").agg(*(F.percentile(clean(c), ends).alias(f"{c}_interval") for c in ("within_r", "between_r", "delta")), F.avg((F.col("delta") > 0).cast("double")).alias("share_between_above"), F.count("*").alias("reps"))


def max_axis_pst(sites: DataFrame, group: str, site: str, modules: dict[str, list[str]], *, reps: int = 200, chunks: int = 4, seed: int = 0) -> DataFrame:
    """(module, pst, loadings, lo, hi) of the direction of greatest divergence in each module's traits."""
    parts = []
    for name, cols in modules.items():

        def work(x: np.ndarray, g: np.ndarray, chunk: int) -> list:
            rng, out = np.random.default_rng([seed, chunk]), []
            one = lambda i: k.directional_axes(*k.between_within(k.zscores(x[i]), g[i], 1)[1:3])[0]
            if not chunk:
                lam, pst, v = one(np.arange(len(x)))
                out.append((True, pst, [float(a) for a in v]))
            for _ in range(k.dealt(reps, chunks, chunk)):
                try:
                    out.append((False, one(k.resample_in_groups(g, rng))[1], None))
                except (ValueError, np.linalg.LinAlgError):
                    continue
            return out

        d = over_sites(sites, group, site, cols, work, "observed boolean, v double, loadings array<double>", chunks=chunks)
        q = d.agg(F.max(F.when(F.col("observed"), F.col("v"))).alias("pst"), F.max(F.when(F.col("observed"), F.col("loadings"))).alias("loadings"), F.percentile(F.when(~F.col("observed"), F.col("v")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
        parts.append(q.select(F.lit(name).alias("module"), "pst", "loadings", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alignment(sites: DataFrame, group: str, site: str, columns: list[str], *, reps: int = 200, chunks: int = 4, seed: int = 0) -> DataFrame:
    """Angle between the leading axes of divergence and of covariance in groups, with bootstrap intervals."""

    def work(x: np.ndarray, g: np.ndarray, chunk: int) -> list:
        rng, out = np.random.default_rng([seed, chunk]), []
        if not chunk:
            a, b, w, b1, w1 = k.alignment(k.zscores(x), g)
            out.append((True, a, b, w, [*map(float, b1)], [*map(float, w1)]))
        for _ in range(k.dealt(reps, chunks, chunk)):
            i = k.resample_in_groups(g, rng)
            with np.errstate(invalid="ignore"):
                try:
                    a, b, w, _, _ = k.alignment(k.zscores(x[i]), g[i])
                except (ValueError, np.linalg.LinAlgError):
                    continue
            out.append((False, a, b, w, None, None))
        return out

    d = over_sites(sites, group, site, columns, work, "observed boolean, angle double, b1_share double, w1_share double, b1 array<double>, w1 array<double>", chunks=chunks)
    seen, ends = F.col("observed"), F.array(F.lit(0.025), F.lit(0.975))
    return d.agg(*(F.max(F.when(seen, F.col(c))).alias(c) for c in ("angle", "b1_share", "w1_share", "b1", "w1")), *(F.percentile(F.when(~seen, F.col(c)), ends).alias(f"{c}_interval") for c in ("angle", "b1_share", "w1_share")), F.count_if(~seen).alias("reps"))


def planning_power(sites: DataFrame, group: str, site: str, modules: list[str], *, sims: int = 100, designs: tuple[int, ...] = (2, 3, 4, 5, 6, 8, 10, 12), seed: int = 0) -> DataFrame:
    """(sites_per_group, power, median_p): how often the profile test would find the present means with more sites.

    One task a design.
    """

    def work(x: np.ndarray, g: np.ndarray, chunk: int) -> list:
        per, rng, levels = designs[chunk], np.random.default_rng([seed, chunk]), np.unique(g)
        means = np.stack([x[g == v].mean(0) for v in levels])
        rest = x - means[np.searchsorted(levels, g)]
        values, vectors = np.linalg.eigh(np.cov(rest, rowvar=False, ddof=1))
        root = vectors * np.sqrt(np.clip(values, 1e-8, None))
        labels = np.repeat(np.arange(len(levels)), per)
        df1, df2 = (len(levels) - 1) * (x.shape[1] - 1), (len(labels) - len(levels)) * (x.shape[1] - 1)
        ps = [f_sf(max(k.profile_pseudo_f(means[labels] + rng.normal(size=(len(labels), x.shape[1])) @ root.T, labels), 0), df1, df2) for _ in range(sims)]
        return [(per, per * len(levels), float(np.mean(np.array(ps) < 0.05)), float(np.median(ps)), sims)]

    return over_sites(sites, group, site, modules, work, "sites_per_group int, total_sites int, power double, median_p double, sims int", chunks=len(designs))


def mosaic(tracks: DataFrame, group: str, modules: list[str]) -> DataFrame:
    """The modules that deviate most from the common axis in each group, the most deviant groups first."""
    r = [f"rank1_residual_{m}" for m in modules]
    short = lambda c: F.replace(c, F.lit("rank1_residual_"), F.lit(""))
    return tracks.select(group, "syndrome_axis_score", F.col("orthogonal_residual_norm").alias("mosaic_deviation_norm"), short(argmax_column(r)).alias("largest_positive"), short(argmax_column(r, False)).alias("largest_negative"), *(F.col(c).alias(f"deviation_{m}") for c, m in zip(r, modules, strict=True))).orderBy(F.desc("mosaic_deviation_norm"))


def response_mode(slope_p: Column, shift_p: Column) -> Column:
    return F.when(slope_p < 0.05, "allometric_reconfiguration").when(shift_p < 0.05, "island_level_shift").otherwise("simple_scaling_or_unresolved")


def response_summary(modes: DataFrame, module: str = "module", mode: str = "response_mode") -> DataFrame:
    kinds = ("island_level_shift", "allometric_reconfiguration", "simple_scaling_or_unresolved")
    return modes.groupBy(module).agg(F.count("*").alias("n_traits"), *(F.count_if(F.col(mode) == x).alias(f"n_{x}") for x in kinds), F.array_join(F.array_sort(F.collect_set(mode)), ";").alias("response_modes_present"))


def interpretation(p: Column) -> Column:
    """Fixed wording by p value; derived anew, never written into an earlier table."""
    # fixed text
    return (
        F.when(p < 0.05, "Module-by-island interaction supports non-parallel module divergence; temporal asynchrony remains untested.")
        .when(p < 0.10, "Module heterogeneity is suggestive but not decisive; a shared syndrome trajectory remains plausible.")
        .otherwise("Current data do not reject a shared three-module syndrome trajectory, despite heterogeneous trait-level response modes.")
    )


def geography(tracks: DataFrame, latitudes: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(variable, n, r, p, rho, p): group scores against mean latitude."""
    d = tracks.join(latitudes, group).unpivot([group, "mean_lat"], columns, "variable", "v")
    a = ranks.pearson(d, ["variable"], "v", "mean_lat", least=2).withColumnRenamed("p", "pearson_p")
    return a.join(ranks.spearman(d, ["variable"], "v", "mean_lat", least=2, few=True).drop("n").withColumnRenamed("p", "spearman_p"), "variable")


def lability(univariate: DataFrame, tests: DataFrame | None, modes: DataFrame | None, reference: str) -> DataFrame:
    """Traits by divergence, with rank and ratio to a reference trait; the two other tables are optional."""
    from pyspark.sql import Window

    d = univariate.select("trait", "pst")
    if tests is not None:
        d = d.join(tests, "trait", "left")
    if modes is not None:
        d = d.join(modes, "trait", "left")
    base = univariate.where(F.col("trait") == reference).agg(F.max("pst").alias("_ref"))
    ranked = d.withColumn("lability_rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("pst"))))  # a row a trait
    return ranked.crossJoin(F.broadcast(base)).withColumn("ratio_to_reference", F.try_divide(F.col("pst"), F.col("_ref"))).drop("_ref").orderBy(F.desc("pst"))


def layout_summary(flowers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Where guide pixels lie, over all flowers or by group: means, medians, shares above chance, and signed-rank tests.

    ``p_difference``: do guides lie more at the base than random pixels do?  ``p_midline_ratio``, and the same distally: are random
    pixels farther from the midline?  Medians and ranks come from counts over ranges of values.
    """
    one = keys or ["_all"]
    d = flowers if keys else flowers.withColumn("_all", F.lit(0))
    d = d.withColumn("difference", F.col("basal_frac") - F.col("random_basal_frac"))
    cols = [F.count("*").alias("n"), F.avg("basal_frac").alias("mean_basal"), F.avg("random_basal_frac").alias("mean_random_basal"), F.avg("mean_pos").alias("mean_position")]
    for r in ("midline_ratio", "midline_ratio_distal"):
        cols += [F.count(r).alias(f"n_{r}"), F.avg(r).alias(f"mean_{r}"), F.avg((F.col(r) > 1).cast("double")).alias(f"share_{r}_above_1")]
    out = d.groupBy(*one).agg(*cols)
    for c, null in (("difference", 0.0), ("midline_ratio", 1.0), ("midline_ratio_distal", 1.0)):
        middle = ranks.exact_quantiles(d, one, c, [0.5]).select(*one, F.col("q")[0].alias(f"median_{c}"))
        test = ranks.wilcoxon(d, one, c, null).select(*one, *(F.col(x).alias(f"{x}_{c}") for x in ("w", "z", "p")))
        out = out.join(middle, one, "left").join(test, one, "left")
    return out if keys else out.drop("_all")


def verdict(p: Column, supported: str, otherwise: str) -> Column:
    return F.when(p < 0.05, supported).otherwise(otherwise)


def evidence(tests: DataFrame, systems: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each trait of interest: its system, what was predicted, what the tests say.

    ``tests`` has trait, shift_p_adjusted, slope_p_adjusted, shift_partial_r2.
    """
    cases = F.create_map(*(x for t, (s, p) in systems.items() for x in (F.lit(t), F.struct(F.lit(s).alias("system"), F.lit(p).alias("prediction")))))
    d = tests.where(F.col("trait").isin(*systems)).withColumn("_s", F.element_at(cases, F.col("trait")))
    mode = response_mode(F.col("slope_p_adjusted"), F.col("shift_p_adjusted"))
    return d.select("trait", "_s.system", "_s.prediction", mode.alias("response_mode"), F.col("shift_partial_r2").alias("effect"), (mode == F.col("_s.prediction")).alias("as_predicted"))


#: Fixed names: each hypothesis, its standing, and the four numbers that speak to it as (name, table, row, column).
HYPOTHESES = (
    ("nectar_guide_candidate_spatial_layout", "direct_morphological_support", (("mean_guide_fraction_proximal_third", "layout", "", "mean_basal"), ("mean_random_fraction_proximal_third", "layout", "", "mean_random_basal"), ("mean_midline_ratio_distal_random_over_guide", "layout", "", "mean_midline_ratio_distal"), ("fraction_corollas_distal_midline_ratio_gt_1", "layout", "", "share_midline_ratio_distal_above_1"))),
    ("receiver_dependent_visual_signal_amount", "phenotypic_support_only", (("guide_site_ancova_BH_p", "tests", "guide", "shift_p_adjusted"), ("guide_amount_PST", "pst", "guide", "pst"), ("basal_placement_PST", "pst", "basal", "pst"), ("midline_placement_PST", "pst", "midline", "pst"))),
    ("signal_not_generic_individual_allometry", "supported_at_current_sampling_scale", (("within_island_plant_r", "correlations", "within", "r"), ("within_island_plant_p", "correlations", "within", "p"), ("between_island_mean_r", "correlations", "between", "r"), ("between_island_mean_spearman_rho", "correlations", "between", "rho"))),
    ("morphomechanical_rematching", "trait_specific_support", (("mouth_interaction_BH_p", "tests", "mouth", "slope_p_adjusted"), ("mouth_interaction_partial_R2", "tests", "mouth", "slope_partial_r2"), ("throat_island_BH_p", "tests", "throat", "shift_p_adjusted"), ("throat_interaction_BH_p", "tests", "throat", "slope_p_adjusted"))),
    ("pollen_transfer_geometry_reorganisation", "phenotypic_support_only", (("organ_site_ancova_BH_p", "tests", "organ", "shift_p_adjusted"), ("organ_site_ancova_partial_R2", "tests", "organ", "shift_partial_r2"), ("organ_interaction_BH_p", "tests", "organ", "slope_p_adjusted"), ("organ_common_support_p", "tests", "organ", "common_p"))),
    ("genetic_regulation_of_visual_signal", "not_tested", ()),
)


def hypotheses(spark, tables: dict[str, DataFrame], rows: dict[str, str]) -> DataFrame:
    """(hypothesis, current_support, metric, name, value): four numbers a hypothesis, looked up in the tables of results.

    ``tables``: layout (one row), and tests, pst, correlations with a ``key``; ``rows`` gives the key that
    stands for guide, mouth, throat, organ, basal, midline, within and between.  What isn't there is null.
    """
    wanted = [(h, s, i, name, table, rows.get(row, row), column) for h, s, metrics in HYPOTHESES for i, (name, table, row, column) in enumerate(metrics or (("not_applicable", "", "", ""),) * 4, 1)]
    names = spark.createDataFrame(wanted, "hypothesis string, current_support string, metric int, name string, _table string, _key string, _column string")
    long = None
    for table, d in tables.items():
        used = sorted({w[6] for w in wanted if w[4] == table} & set(d.columns))
        key = F.lit("") if table == "layout" else F.col("key")
        part = d.select(F.lit(table).alias("_table"), key.alias("_key"), F.explode(F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("value")) for c in used))).alias("x")).select("_table", "_key", "x.*")
        long = part if long is None else long.unionByName(part)
    return names.join(long, ["_table", "_key", "_column"], "left").select("hypothesis", "current_support", "metric", "name", "value")
