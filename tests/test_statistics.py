import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corymb import catalog
from corymb.functions import tails
from corymb.operators import divergence, kernels, mixture, models, ranks, syndrome


def test_tails_match_known_values():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_sf(2.866081402, 4, 20) == pytest.approx(0.05, abs=1e-7)
    assert tails.t_sf2(2.085963447, 20) == pytest.approx(0.05, abs=1e-8)
    assert tails.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert math.isnan(tails.f_sf(float("nan"), 1, 2)) and tails.f_sf(-1, 2, 3) == 1


def test_pst_of_known_groups(spark):
    rows = [("t", "a", 1.0), ("t", "a", 3.0), ("t", "b", 5.0), ("t", "b", 7.0), ("t", "c", 100.0), ("u", "a", 1.0), ("u", "a", None)]
    d = spark.createDataFrame(rows, "trait string, g string, v double")
    out = {r["trait"]: r for r in divergence.pst(d, ["trait"], "g", "v").collect()}
    # msb = 16, msw = 2, n0 = 2, vb = 7
    assert out["t"]["pst"] == pytest.approx(7 / (7 + 4)) and out["t"]["k"] == 2
    assert "u" not in out or out["u"]["pst"] is None
    loose = {r["trait"]: r for r in divergence.pst(d, ["trait"], "g", "v", least=1).collect()}
    assert loose["t"]["k"] == 3 and loose["u"]["pst"] is None


def test_pst_agrees_with_the_kernel(spark):
    rng = np.random.default_rng(0)
    g = rng.integers(0, 4, 60)
    v = rng.normal(size=60) + g
    d = spark.createDataFrame(pd.DataFrame({"t": "x", "g": g.astype(str), "v": v}))
    assert divergence.pst(d, ["t"], "g", "v").first()["pst"] == pytest.approx(kernels.pst_of(v, g, 2))


def test_ranks_and_correction(spark):
    d = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 2.0), ("k", "b", 4.0)], "trait string, g string, v double")
    assert sorted(r["r"] for r in d.select(ranks.average_rank("v", "trait").alias("r")).collect()) == [1.0, 2.5, 2.5, 4.0]
    h = ranks.kruskal(d, ["trait"], "g", "v").first()
    assert h["h"] == pytest.approx(1.5) and h["p"] == pytest.approx(tails.chi2_sf(1.5, 1))
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    assert sorted(r["a"] for r in ranks.adjusted(p, "p", "a").collect()) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 1.0])


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    d = spark.createDataFrame([("t", g, i, float(i * (g == "a") + i)) for g in "ab" for i in range(6)], "trait string, g string, u int, v double")
    a = divergence.bootstrap_interval(d, ["trait"], "g", "v", "u", reps=30).first()
    b = divergence.bootstrap_interval(d.repartition(5), ["trait"], "g", "v", "u", reps=30).first()
    assert a["reps"] == 30 and a["lo"] == pytest.approx(b["lo"]) and a["lo"] <= a["hi"]


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Four nations in two regions, 19 customers of one to three orders."""
    at = tmp_path_factory.mktemp("small")
    customers = [(i, i % 4, float(i * i % 17), "BUILDING") for i in range(19)]
    orders = [(10 * i + k, i, "OPF"[k], float(100 + i * 7 % 23 + 5 * k + 9 * (i % 4)), "1-URGENT") for i in range(19) for k in range(1 + i % 3)]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"), ("customer", customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
        ("nation", [(i, f"n{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"), ("region", [(0, "r0"), (1, "r1")], "r_regionkey int, r_name string"),
        ("embeddings", [(i, 0, [float(i), 1.0]) for i in range(9)], "vec_id long, label int, embedding array<float>"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at), customers, orders


def test_whole_bootstrap_equals_a_loop(spark, small_tables):
    at, customers, orders = small_tables
    prices = {c: [o[3] for o in orders if o[1] == c] for c, *_ in customers}
    traits = {"price": {c: np.mean(p) for c, p in prices.items()}, "top_price": {c: max(p) for c, p in prices.items()}, "balance": {c[0]: c[2] for c in customers}, "flowers": {c: len(p) for c, p in prices.items()}}
    out = {r["trait"]: r for r in catalog.queries()["bootstrap_pst_whole"](spark, at).collect()}
    assert set(out) == set(traits)
    for trait, of in traits.items():
        groups = {f"n{g}": np.array([of[c[0]] for c in customers if c[1] == g], float) for g in range(4)}
        found = []
        for rep in range(2000):
            x = [v[[int(hashlib.md5(f"0:{rep}:{trait}:{g}:{j}".encode()).hexdigest()[:8], 16) % len(v) for j in range(len(v))]] for g, v in groups.items()]
            n, m = np.array([len(v) for v in x]), np.array([v.mean() for v in x])
            msb = (n * (m - (n * m).sum() / n.sum()) ** 2).sum() / 3
            msw = sum(((v - v.mean()) ** 2).sum() for v in x) / (n.sum() - 4)
            among = max((msb - msw) / ((n.sum() - (n * n).sum() / n.sum()) / 3), 0)
            found.append(among / (among + 2 * msw) if among + msw > 0 else 0.0)
        assert out[trait]["reps"] == 2000
        assert [out[trait]["lo"], out[trait]["hi"]] == pytest.approx(np.quantile(found, [0.025, 0.975]), abs=2e-6)


@pytest.mark.parametrize(("query", "module", "operator", "least"), [
    ("allometry", models, "allometry", {"permutations": 4999, "interaction_permutations": 1999}), ("bootstrap_pst", divergence, "weighted_bootstrap", {"reps": 2000}), ("permutation_eta2", divergence, "label_permutation", {"reps": 4999}), ("site_ancova_left_out", models, "site_tests", {"permutations": 1999}), ("phase_adjusted", models, "site_tests", {"permutations": 1999}), ("profile_tests", syndrome, "profile_tests", {"permutations": 9999}),
    ("pst_axes", models, "pst_axes", {"reps": 500}), ("pst_axes_hierarchical", models, "hierarchical_axes", {"reps": 500}), ("trajectory_bootstrap", syndrome, "trajectory_bootstrap", {"reps": 2000}), ("module_integration_bootstrap", syndrome, "integration_bootstrap", {"reps": 1500}),
    ("module_max_axis_pst", syndrome, "max_axis_pst", {"reps": 800}), ("covariance_alignment", syndrome, "alignment", {"reps": 2500}), ("planning_power", syndrome, "planning_power", {"sims": 500}), ("mixture_fit", mixture, "fit", {"starts": 6, "iterations": 400}),
])
def test_queries_resample_as_often_as_the_reference(spark, small_tables, monkeypatch, query, module, operator, least):
    class Called(Exception):
        pass

    def record(*_, **named):
        raise Called(named)

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as e:
        catalog.queries()[query](spark, small_tables[0])
    assert all(e.value.args[0][k] >= v for k, v in least.items())


def test_nested_f_matches_sums_of_squares():
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=30), np.repeat(["a", "b", "c"], 10)
    y = x + (g == "c") * 2 + rng.normal(size=30) * 0.3
    r = kernels.ancova(y, x, g, 99, np.random.default_rng(0))
    small = np.column_stack([np.ones(30), x])
    full = np.column_stack([small, kernels.dummies(g)])
    rss = [float(((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum()) for d in (small, full)]
    assert r["f"] == pytest.approx(((rss[0] - rss[1]) / 2) / (rss[1] / 26))
    assert (r["df_num"], r["df_den"]) == (2, 26) and r["permutation_p"] == pytest.approx(0.01)


def test_profile_interaction_matches_the_full_design():
    rng = np.random.default_rng(2)
    g = np.repeat(["a", "b", "c"], [4, 3, 5])
    s = rng.normal(size=(12, 3)) + (g == "b")[:, None] * np.array([1, 0, -1])
    r = kernels.profile_interaction(s, g, 9, np.random.default_rng(0))
    site, module = np.repeat(np.arange(12), 3), np.tile(np.arange(3), 12)
    small = np.column_stack([np.ones(36), kernels.dummies(site), kernels.dummies(module)])
    inter = np.column_stack([a * b for a in kernels.dummies(module).T for b in kernels.dummies(np.repeat(g, 3)).T])
    t = kernels.NestedTest(small, np.column_stack([small, inter]))
    assert r["f"] == pytest.approx(float(t.f(s.reshape(-1, 1))[0])) and (r["df_num"], r["df_den"]) == (t.df_num, t.df_den)


def test_mixed_model_without_site_variance_is_least_squares():
    n, mean, ss = np.array([10.0, 10, 10, 10]), np.array([0.0, 0.01, 1.0, 0.99]), np.array([9.0, 9, 9, 9])
    lrt, df = kernels.random_intercept_lrt(n, mean, ss, np.array(["a", "a", "b", "b"]))
    within = 36 + 10 * ((mean - np.array([0.005, 0.005, 0.995, 0.995])) ** 2).sum()
    assert df == 1 and 0 < lrt <= 40 * math.log((36 + 10 * ((mean - 0.5) ** 2).sum()) / within) + 1e-6


def test_hc3_matches_numpy(spark):
    rng = np.random.default_rng(3)
    g, x = np.repeat(["a", "b"], 15), rng.normal(size=30)
    y = 2 * x + (g == "b") + rng.normal(size=30) * (1 + np.abs(x))
    d = spark.createDataFrame(pd.DataFrame({"t": "q", "g": g, "x": x, "y": y}))
    r = {m["model"]: m for m in models.hc3_lines(d, "t", "g", "x", "y").collect()}
    full = np.column_stack([np.ones(30), x, (g == "b").astype(float)])
    inv = np.linalg.inv(full.T @ full)
    beta = inv @ full.T @ y
    e = (y - full @ beta) / (1 - np.einsum("ij,jk,ik->i", full, inv, full))
    var = (inv @ (full.T * e**2) @ full @ inv)[1, 1]
    assert r["additive"]["slope"] == pytest.approx(beta[1])
    assert r["additive"]["p"] == pytest.approx(2 * tails.normal_sf(abs(beta[1] / math.sqrt(var))), rel=1e-6)
    assert r["size"]["r2"] <= r["additive"]["r2"] <= r["interaction"]["r2"]


def test_axes_solve_the_eigenproblem():
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(5), 8)
    z = kernels.zscores(rng.normal(size=(40, 3)) + g[:, None] * np.array([1.0, 0.5, 0]))
    _, b, w, _, _ = kernels.between_within(z, g)
    for lam, _, v in kernels.directional_axes(b, w):
        assert b @ v == pytest.approx(lam * (w @ v), abs=1e-5)


def test_empty_inputs(spark):
    d = spark.createDataFrame([], "trait string, g string, v double")
    assert divergence.pst(d, ["trait"], "g", "v").count() == 0
    assert ranks.kruskal(d, ["trait"], "g", "v").count() == 0
    assert ranks.spearman(d.withColumn("w", F.col("v")), ["trait"], "v", "w").count() == 0


def test_weighted_bootstrap_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", "abc"[i % 3], float(rng.normal(i % 3)), None if i % 5 == 0 else float(rng.normal())) for i in range(40)]
    out = {r["trait"]: r for r in divergence.weighted_bootstrap(spark.createDataFrame(rows, "u string, g string, x double, y double"), ["x", "y"], "g", "u", reps=203).collect()}
    for trait, col in (("x", 2), ("y", 3)):
        found = []
        for rep in range(203):
            groups = {}
            for r in rows:
                d = int(hashlib.md5(f"0:{r[0]}:{rep // 4}".encode()).hexdigest()[rep % 4 * 8 :][:8], 16)
                if r[col] is not None:
                    groups.setdefault(r[1], []).extend([r[col]] * sum(d >= t for t in divergence.POISSON))
            x = [np.array(v) for v in groups.values() if len(v) >= 2]
            n, m = np.array([len(v) for v in x]), np.array([v.mean() for v in x])
            msb, msw = (n * (m - (n * m).sum() / n.sum()) ** 2).sum() / (len(x) - 1), sum(((v - v.mean()) ** 2).sum() for v in x) / (n.sum() - len(x))
            among = max((msb - msw) / ((n.sum() - (n * n).sum() / n.sum()) / (len(x) - 1)), 0)
            found.append(among / (among + 2 * msw))
        assert out[trait]["reps"] == 203 and [out[trait]["lo"], out[trait]["hi"]] == pytest.approx(np.quantile(found, [0.025, 0.975]), abs=1e-9)


def test_first_axis_of_sums_equals_rows():
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(4), [5, 8, 6, 9])
    size = rng.normal(size=28)
    x = rng.normal(size=(28, 3)) + g[:, None] * [0.5, 1.0, 0.0] + size[:, None]
    for adjusted in (False, True):
        y = x
        if adjusted:
            c = size - size.mean()
            y = x - x.mean(0) - c[:, None] * (c @ (x - x.mean(0))) / (c @ c)
        _, b, w, _, _ = kernels.between_within(kernels.zscores(y), g)
        want = kernels.directional_axes(b, w)[0][1]
        one = np.column_stack([np.ones(28), x, *([size] if adjusted else [])])
        i, j = np.triu_indices(one.shape[1])
        parts = [((one[g == v].T @ one[g == v])[i, j]).tolist() for v in range(4)]
        assert kernels.first_axis_of_sums(parts, 3, adjusted) == pytest.approx(want, rel=1e-6)
    assert np.isnan(kernels.first_axis_of_sums(parts[:1], 3, True))


def test_hierarchical_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        for s in range(5):
            shift = rng.normal(scale=0.4)
            for p in range(6):
                z = rng.normal()
                rows.append((f"g{g}", f"g{g}s{s}", f"g{g}s{s}p{p}", float(g + shift + rng.normal() + z), float(rng.normal() + z), float(z)))
    d = spark.createDataFrame(rows, "g string, s string, p string, a double, b double, z double")
    r = models.hierarchical_axes(d, "g", "s", "p", ["a", "b"], size="z", reps=120).first()
    again = models.hierarchical_axes(d.repartition(5), "g", "s", "p", ["a", "b"], size="z", reps=120).first()
    assert r["reps"] == 120 and 0 < r["lo"] < r["hi"] < 1 and [r["lo"], r["hi"]] == pytest.approx([again["lo"], again["hi"]])
    x = np.array([q[3:] for q in rows])
    y = x[:, :2] - np.outer(x[:, 2], [np.polyfit(x[:, 2], x[:, i], 1)[0] for i in (0, 1)])
    _, b, w, _, _ = kernels.between_within(kernels.zscores(y), np.array([q[0] for q in rows]))
    assert r["lo"] < kernels.directional_axes(b, w)[0][1] < r["hi"]


def test_repetitions_are_dealt_out_whole():
    assert [sum(kernels.dealt(n, c, i) for i in range(c)) for n, c in ((1500, 8), (500, 8), (7, 8), (800, 4))] == [1500, 500, 7, 800]


def test_phase_coefficient():
    rng = np.random.default_rng(6)
    g, x, c = np.repeat(["a", "b", "c"], 8), rng.normal(size=24), rng.normal(size=24)
    y = 2 * x + 3 * c + (g == "b") + 1e-9 * rng.normal(size=24)
    assert kernels.ancova(y, x, g, 9, rng, covariates=c[:, None])["coefficient"] == pytest.approx(3, abs=1e-6)
    assert kernels.ancova(y, x, g, 9, rng)["coefficient"] is None


def test_allometry_has_all_tests(spark):
    rng = np.random.default_rng(7)
    rows = [(t, f"g{g}", f"g{g}s{s}", float(z), float(np.exp(z)), float(z * (1 + (t == "b") * g) + (t == "a") * g + 0.1 * rng.normal())) for t in "ab" for g in range(3) for s in range(5) for z in rng.normal(size=6)]
    out = {r["trait"]: r for r in models.allometry(spark.createDataFrame(rows, "trait string, g string, s string, x double, size double, y double"), "trait", "g", "s", "x", "y", "size", permutations=199, interaction_permutations=99).collect()}
    assert out["a"]["shift_p_adjusted"] < 0.05 and out["a"]["residual_p_adjusted"] < 0.05 and out["b"]["slope_p_adjusted"] < 0.05 and out["a"]["common_n_plants"] > 20
    assert out["a"]["delta_r2"] > 0.1 and out["b"]["delta_aic"] < 0 and all(0 < out[t][f"{k}_p"] <= 1 for t in "ab" for k in ("shift", "slope", "residual", "common"))


@pytest.mark.parametrize(
    ("means", "why"),
    [([[-30, -10], [-5, -2], [-40, 30]], "magenta"), ([[20, -10], [5, -20], [-10, -12]], "yellow"), ([[5, -40], [10, 0], [30, 20]], "redder")],
)
def test_roles_need_the_colours_they_are_named_for(means, why):
    from corymb.operators import mixture

    with pytest.raises(ValueError, match=why):
        mixture.assign_roles(np.array(means, float))
    assert mixture.assign_roles(np.array([[5, 2], [20, -15], [12, 25]], float)) == {"petal": 0, "guide": 1, "oxidation": 2}


def test_dealt_site_tests_equal_the_designs(spark):
    rng = np.random.default_rng(11)
    rows = [(t, g, f"{g}{i}", float(rng.normal(i % 3 + (g == "c") * 1.5)), float(rng.normal(2, 1))) for t in ("t1", "t2") for g, n in (("a", 7), ("b", 5), ("c", 6), ("d", 4)) for i in range(n)]
    d = spark.createDataFrame([*rows, ("t1", "a", "none", None, 1.0)], "trait string, g string, site string, y double, x double").repartition(3)
    got = {(r["trait"], r["test"], r["omitted"]): r for r in models.site_tests(d, "trait", "g", "site", "y", "x", permutations=999, omit=True).collect()}
    assert len(got) == 2 * (2 + 4)
    for (t, test, out), r in got.items():
        own = [x for x in rows if x[0] == t and x[1] != out]
        y, x, g = np.array([v[3] for v in own]), np.array([v[4] for v in own]), np.array([v[1] for v in own])
        want = kernels.ancova(y, x, g, 999, np.random.default_rng(1), slopes=test == "slope")
        assert (r["n_sites"], r["df_num"], r["df_den"]) == (len(own), want["df_num"], want["df_den"])
        for c in ("f", "parametric_p", "r2_small", "r2_full", "delta_r2", "partial_r2"):
            assert r[c] == pytest.approx(want[c], abs=1e-8), c
        assert r["permutation_p"] == pytest.approx(want["permutation_p"], abs=0.06)
    again = {(r["trait"], r["test"], r["omitted"]): r["permutation_p"] for r in models.site_tests(d.repartition(7), "trait", "g", "site", "y", "x", permutations=999, omit=True).collect()}
    assert again == {k: r["permutation_p"] for k, r in got.items()}


def test_a_group_of_one_site_has_no_slope(spark):
    rows = [("t", g, f"{g}{i}", float(i * i % 5), float(i)) for g, n in (("a", 6), ("b", 5), ("c", 1)) for i in range(n)]
    got = {r["test"]: r for r in models.site_tests(spark.createDataFrame(rows, "trait string, g string, site string, y double, x double"), "trait", "g", "site", "y", "x", permutations=9).collect()}
    y, x, g = np.array([v[3] for v in rows]), np.array([v[4] for v in rows]), np.array([v[1] for v in rows])
    for test, r in got.items():
        want = kernels.ancova(y, x, g, 9, np.random.default_rng(0), slopes=test == "slope")
        assert r["f"] == pytest.approx(want["f"]) and (r["df_num"], r["df_den"]) == (want["df_num"], want["df_den"])


def test_mixed_model_search_equals_the_kernel(spark):
    rng = np.random.default_rng(6)
    rows = [(t, g, f"{g}{i}", float(rng.normal(j * shift, 1) + site)) for t, shift, sd in (("a", 0.0, 1.0), ("b", 2.0, 0.5), ("c", 0.3, 0.0)) for j, g in enumerate("xyz") for i in range(5) for site in [rng.normal(0, 1) * sd] for _ in range(int(rng.integers(3, 9)))]
    rows += [("one", "x", "x0", 1.0)] * 9
    d = spark.createDataFrame(rows, "trait string, g string, site string, v double").repartition(3)
    got = {r["trait"]: r for r in models.site_lrt(d, "trait", "g", "site", "v").collect()}
    assert got["one"]["lrt"] is None and got["one"]["p"] is None
    for t in "abc":
        own = pd.DataFrame([r for r in rows if r[0] == t], columns=["t", "g", "s", "v"]).groupby(["g", "s"]).v.agg(["size", "mean", lambda v: ((v - v.mean()) ** 2).sum()]).reset_index()
        lrt, df = kernels.random_intercept_lrt(own["size"].to_numpy(float), own["mean"].to_numpy(), own.iloc[:, 4].to_numpy(), own.g.to_numpy().astype(str))
        assert got[t]["lrt"] == pytest.approx(max(lrt, 0), abs=1e-6) and got[t]["df"] == df and got[t]["p"] == pytest.approx(tails.chi2_sf(max(lrt, 0.0), df), abs=1e-7)
