"""Gaussian mixtures of colour: EM whose every step is one aggregation, posteriors as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("petal", "guide", "oxidation")


def log_density(columns: list[Column], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Log density of a normal, written out over the Cholesky factor of its covariance."""
    try:
        root = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        raise ValueError("a covariance must be positive definite") from None
    inverse = np.linalg.inv(root)
    terms = []
    for row in inverse:
        z = sum(((c - F.lit(float(m))) * F.lit(float(v)) for c, m, v in zip(columns, mean, row, strict=True) if v), F.lit(0.0))
        terms.append(z * z)
    return (sum(terms, F.lit(0.0)) + F.lit(2 * float(np.log(np.diag(root)).sum()) + len(mean) * math.log(2 * math.pi))) * F.lit(-0.5)


class ColourMixture:
    """weights (k), means (k, d), covariances (k, d, d) over named feature columns."""

    def __init__(self, features: list[str], weights, means, covariances):
        self.features = features
        self.weights, self.means, self.covariances = (np.asarray(a, float) for a in (weights, means, covariances))

    def log_terms(self) -> list[Column]:
        cols = [F.col(c) for c in self.features]
        return [log_density(cols, m, c) + F.lit(math.log(max(w, 1e-300))) for w, m, c in zip(self.weights, self.means, self.covariances, strict=True)]

    def posterior(self) -> list[Column]:
        """Probability of each component; the greatest log term is taken out first."""
        terms = self.log_terms()
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        exps = [F.exp(t - top) for t in terms]
        total = sum(exps[1:], exps[0])
        return [e / total for e in exps]

    def segment(self, df: DataFrame, component: int, least: float = 0.5, name: str = "segment") -> DataFrame:
        if not 0 <= component < len(self.weights):
            raise ValueError("no such component")
        return df.withColumn(name, self.posterior()[component] >= least)

    def reordered(self, order: list[int]) -> ColourMixture:
        return ColourMixture(self.features, self.weights[order], self.means[order], self.covariances[order])


def _start(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spread-out centres: each next one with odds by its squared distance to those chosen."""
    centres = [sample[rng.integers(len(sample))]]
    while len(centres) < k:
        d = np.min([((sample - c) ** 2).sum(1) for c in centres], 0)
        centres.append(sample[rng.choice(len(sample), p=d / d.sum() if d.sum() > 0 else None)])
    return np.stack(centres)


def _moments(d: DataFrame, models: list[ColourMixture], features: list[str]) -> np.ndarray:
    """(start, component, [weight, sums, sums of products, log likelihood]) over all rows; each batch is summed where it lies."""
    import pyarrow as pa

    k, n = len(models[0].weights), len(features)
    width = 2 + n + n * n
    packed = [(np.log(np.maximum(m.weights, 1e-300)), m.means, [np.linalg.inv(np.linalg.cholesky(c)) for c in m.covariances]) for m in models]

    def step(batches):
        total = np.zeros((len(packed), k, width))
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)], 1)
            for s, (log_w, means, roots) in enumerate(packed):
                terms = np.stack([log_w[c] + np.log(np.diag(roots[c])).sum() - n / 2 * math.log(2 * math.pi) - 0.5 * (((x - means[c]) @ roots[c].T) ** 2).sum(1) for c in range(k)], 1)
                top = terms.max(1, keepdims=True)
                e = np.exp(terms - top)
                r = e / e.sum(1, keepdims=True)
                total[s, :, 0] += r.sum(0)
                total[s, :, 1 : 1 + n] += r.T @ x
                total[s, :, 1 + n : 1 + n + n * n] += np.einsum("rc,ri,rj->cij", r, x, x).reshape(k, -1)
                total[s, 0, -1] += float((top[:, 0] + np.log(e.sum(1))).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(len(packed) * k * width)
    for r in d.select(*features).mapInArrow(step, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a row a moment
        out[r["i"]] = r["v"]
    return out.reshape(len(packed), k, width)


def fit(df: DataFrame, features: list[str], k: int = 3, *, starts: int = 6, iterations: int = 60, ridge: float = 0.35, tolerance: float = 1e-4, seed: int = 20260807, start_rows: int = 2000) -> ColourMixture:
    """EM over a DataFrame.  All starts advance in the same pass, so an iteration is one aggregation for all.

    The driver sees moments only, and ``start_rows`` rows (chosen by hash) to place the first centres.
    """
    d = df.select(*features).na.drop().persist()
    key = F.xxhash64(*features, F.lit(seed))
    sample = np.array([tuple(r) for r in d.orderBy(key, *features).limit(start_rows).collect()], float)
    if len(sample) < k:
        raise ValueError("fewer rows than components")
    rng = np.random.default_rng(seed)
    spread = np.atleast_2d(np.cov(sample, rowvar=False)) + np.eye(len(features)) * ridge
    models = [ColourMixture(features, np.full(k, 1 / k), _start(sample, k, rng), np.stack([spread / k ** (2 / len(features))] * k)) for _ in range(starts)]
    was, n_features = np.full(starts, -np.inf), len(features)
    for _ in range(iterations):
        sums = _moments(d, models, features)
        now = sums[:, 0, 1 + n_features + n_features**2] / max(sums[0, :, 0].sum(), 1.0)
        for s in range(starts):
            w = sums[s, :, 0]
            means = sums[s, :, 1 : 1 + n_features] / np.maximum(w, 1e-12)[:, None]
            covs = sums[s, :, 1 + n_features : 1 + n_features + n_features**2].reshape(k, n_features, n_features) / np.maximum(w, 1e-12)[:, None, None]
            covs = covs - means[:, :, None] * means[:, None] + np.eye(n_features) * ridge
            values, vectors = np.linalg.eigh(covs)
            covs = (vectors * np.maximum(values, ridge * 1e-3)[:, None]) @ vectors.transpose(0, 2, 1)
            models[s] = ColourMixture(features, w / w.sum(), means, covs)
        if np.all(np.abs(now - was) < tolerance):
            break
        was = now
    d.unpersist()
    return models[int(np.argmax(now))]


def assign_roles(means: np.ndarray) -> dict[str, int]:
    """Component of each role: guide is the most magenta (a - b), oxidation the most yellow-red (a + b) of the rest, petal what is left.

    With more than three components petal is the least coloured of the rest.  Fails unless the guide is magenta
    (a - b above 0), the oxidation more yellow (b) than the guide, and the guide redder (a) than the petal.
    """
    means = np.asarray(means, float)
    if means.ndim != 2 or means.shape[1] != 2 or len(means) < 3:
        raise ValueError("three components over a and b are needed")
    guide = int((means[:, 0] - means[:, 1]).argmax())
    rest = [i for i in range(len(means)) if i != guide]
    oxidation = max(rest, key=lambda i: means[i].sum())
    petal = min((i for i in rest if i != oxidation), key=lambda i: float(np.hypot(*means[i])))
    if means[guide, 0] - means[guide, 1] <= 0:
        raise ValueError("no component is magenta")
    if means[oxidation, 1] <= means[guide, 1]:
        raise ValueError("the oxidation isn't more yellow than the guide")
    if means[guide, 0] <= means[petal, 0]:
        raise ValueError("the guide isn't redder than the petal")
    return {"petal": petal, "guide": guide, "oxidation": oxidation}


def component_table(spark, model: ColourMixture) -> DataFrame:
    """A row for each role: weight, centre, chroma, hue and the two scores."""
    roles = assign_roles(model.means)
    rows = []
    for n, role in enumerate(ROLES):
        i = roles[role]
        a, b = map(float, model.means[i])
        rows.append((n, role, float(model.weights[i]), a, b, math.hypot(a, b), math.degrees(math.atan2(b, a)), a - b, a + b))
    return spark.createDataFrame(rows, "component int, role string, weight double, mean_a_star double, mean_b_star double, chroma double, hue_deg double, magenta_score double, yellow_red_score double")


def save(spark, model: ColourMixture, path: str) -> None:
    """Parquet, a row a component."""
    rows = [(i, float(w), [float(x) for x in m], [[float(x) for x in r] for r in c]) for i, (w, m, c) in enumerate(zip(model.weights, model.means, model.covariances, strict=True))]
    spark.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<array<double>>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str, features: list[str]) -> ColourMixture:
    rows = spark.read.parquet(path).orderBy("component").collect()  # a row a component
    return ColourMixture(features, [r["weight"] for r in rows], [r["mean"] for r in rows], [r["covariance"] for r in rows])
