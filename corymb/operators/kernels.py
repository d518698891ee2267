"""Small dense linear algebra on tables with one row a site or group: numpy, never on raw rows."""

from __future__ import annotations

import math

import numpy as np

from corymb.functions.tails import f_sf


def dealt(reps: int, chunks: int, chunk: int) -> int:
    """Repetitions of one of several chunks; together they are ``reps``."""
    return reps // chunks + (chunk < reps % chunks)


def zscores(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(0)) / x.std(0, ddof=1)


def between_within(z: np.ndarray, groups: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Covariance between groups, the same made positive semidefinite, covariance within, rows, groups."""
    parts = [z[groups == g] for g in np.unique(groups)]
    parts = [p for p in parts if len(p) >= least]
    if len(parts) < 2:
        raise ValueError("two groups are needed")
    sizes = np.array([len(p) for p in parts], float)
    means = np.stack([p.mean(0) for p in parts])
    n, k = int(sizes.sum()), len(parts)
    off = means - (sizes[:, None] * means).sum(0) / n
    within = sum((p - m).T @ (p - m) for p, m in zip(parts, means, strict=True)) / (n - k)
    between = ((off * sizes[:, None]).T @ off / (k - 1) - within) / ((n - (sizes**2).sum() / n) / (k - 1))
    between = (between + between.T) / 2
    values, vectors = np.linalg.eigh(between)
    return between, (vectors * np.clip(values, 0, None)) @ vectors.T, within, n, k


def directional_axes(b: np.ndarray, w: np.ndarray) -> list[tuple[float, float, np.ndarray]]:
    """(lambda, lambda / (lambda + 2), direction) of B v = lambda W v, greatest first; W gets a tiny ridge."""
    p = len(w)
    root = np.linalg.cholesky(w + np.eye(p) * max(np.trace(w) / p, 1.0) * 1e-8)
    inverse = np.linalg.inv(root)
    values, vectors = np.linalg.eigh(inverse @ b @ inverse.T)
    out = []
    for j in np.argsort(values)[::-1]:
        v = inverse.T @ vectors[:, j]
        v = v / np.linalg.norm(v) * (1 if v[np.abs(v).argmax()] >= 0 else -1)
        out.append((float(values[j]), float(values[j] / (values[j] + 2)) if values[j] >= 0 else math.nan, v))
    return out


def leading(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit eigenvector of the greatest eigenvalue, and that value's share of their sum."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors[:, -1], float(values[-1] / max(values.sum(), np.finfo(float).tiny))


def alignment(z: np.ndarray, groups: np.ndarray) -> tuple[float, float, float, np.ndarray, np.ndarray]:
    """Angle in degrees between the leading axes of B and W, their variance shares, and the axes."""
    _, b, w, _, _ = between_within(z, groups, 1)
    (b1, bf), (w1, wf) = leading(b), leading(w)
    return math.degrees(math.acos(min(1.0, abs(float(b1 @ w1))))), bf, wf, b1, w1


def first_axis_of_sums(parts: list, columns: int, size: bool) -> float:
    """Pst of the first axis from each group's sums of products of (1, columns, and size if given).

    With a size, columns are residuals of their line on it over all groups.  NaN if it can't be solved.
    """
    p = 1 + columns + size
    m = np.zeros((len(parts), p, p))
    i, j = np.triu_indices(p)
    m[:, i, j] = m[:, j, i] = np.array([list(x) for x in parts], float)
    m = m[m[:, 0, 0] >= 2]
    if len(m) < 2:
        return math.nan
    total = m.sum(0)
    n, mean = total[0, 0], total[0] / total[0, 0]
    spread = total / n - np.outer(mean, mean)
    turn = np.zeros((columns, p))  # rows: what makes a column out of (1, columns, size)
    turn[:, 1 : columns + 1] = np.eye(columns)
    if size:
        slope = spread[1 : columns + 1, -1] / max(spread[-1, -1], 1e-300)
        turn[:, -1] = -slope
    turn[:, 0] = -(turn[:, 1:] @ mean[1:])
    var = np.diag(turn @ total @ turn.T) / (n - 1)
    if not (var > 0).all():
        return math.nan
    turn /= np.sqrt(var)[:, None]
    sizes = m[:, 0, 0]
    sums = m[:, 0] @ turn.T
    within = sum(turn @ x @ turn.T for x in m) - (sums.T / sizes) @ sums
    k = len(m)
    if n <= k:
        return math.nan
    w = within / (n - k)
    off = sums / sizes[:, None]
    b = ((off.T * sizes) @ off / (k - 1) - w) / ((n - (sizes**2).sum() / n) / (k - 1))
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    try:
        return directional_axes((vectors * np.clip(values, 0, None)) @ vectors.T, w)[0][1]
    except np.linalg.LinAlgError:
        return math.nan


def first_component(z: np.ndarray) -> tuple[np.ndarray, float]:
    """Loadings of the first principal component, mean loading positive, and its share of variance."""
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(z, rowvar=False, ddof=1)))
    v = vectors[:, -1]
    return v * (1 if v.mean() >= 0 else -1), float(values[-1] / values.sum())


def rank_one(z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Share of the sum of squares in the best rank-one fit, the fit, what is left, and the row scores.

    The scores' sign follows the row means.
    """
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    total = float((s**2).sum())
    fit = s[0] * np.outer(u[:, 0], vt[0])
    score = u[:, 0] * s[0]
    if np.corrcoef(score, z.mean(1))[0, 1] < 0:
        score = -score
    return s[0] ** 2 / total if total > 0 else math.nan, fit, z - fit, score


def _basis(x: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the columns' span."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > s[0] * max(x.shape) * np.finfo(float).eps]


class NestedTest:
    """F test of a design against a smaller one that it contains; bases are computed once for all permutations."""

    def __init__(self, small: np.ndarray, full: np.ndarray):
        self.small = _basis(small)
        rest = full - self.small @ (self.small.T @ full)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        self.extra = u[:, s > max(1e-9, s[0] * 1e-9)] if len(s) else u[:, :0]
        self.df_num = self.extra.shape[1]
        self.df_den = len(full) - self.small.shape[1] - self.df_num

    def residual(self, y: np.ndarray) -> np.ndarray:
        return y - self.small @ (self.small.T @ y)

    def f(self, y: np.ndarray) -> np.ndarray:
        """F for each column of y."""
        r = self.residual(y)
        gain = ((self.extra.T @ r) ** 2).sum(0)
        return (gain / self.df_num) / (((r**2).sum(0) - gain) / self.df_den)

    def run(self, y: np.ndarray, permutations: int, rng: np.random.Generator) -> dict[str, float]:
        """F, its tail, R2 of both designs, and the Freedman-Lane permutation p: residuals of the small design are shuffled."""
        r = self.residual(y)
        s0, gain = float(r @ r), float(((self.extra.T @ r) ** 2).sum())
        total = float(((y - y.mean()) ** 2).sum())
        seen = float(self.f(y[:, None])[0])
        above = 0
        for lo in range(0, permutations, 512):
            many = np.stack([rng.permutation(r) for _ in range(min(512, permutations - lo))], 1) + (y - r)[:, None]
            above += int((self.f(many) >= seen - 1e-12).sum())
        return {
            "f": seen, "df_num": self.df_num, "df_den": self.df_den, "parametric_p": f_sf(max(seen, 0.0), self.df_num, self.df_den), "permutation_p": (above + 1) / (permutations + 1),
            "r2_small": 1 - s0 / total, "r2_full": 1 - (s0 - gain) / total, "delta_r2": gain / total, "partial_r2": gain / s0 if s0 > 0 else 0.0,
        }


def dummies(labels: np.ndarray) -> np.ndarray:
    """A column of 0 and 1 for each level but the first."""
    return (labels[:, None] == np.unique(labels)[None, 1:]).astype(float)


def ancova(y: np.ndarray, x: np.ndarray, groups: np.ndarray, permutations: int, rng: np.random.Generator, *, slopes: bool = False, covariates: np.ndarray | None = None) -> dict[str, float]:
    """Do groups differ beyond a common line (or, with ``slopes``, do their slopes differ)?"""
    d = dummies(groups)
    small = np.column_stack([np.ones(len(y)), x] + ([covariates] if covariates is not None else []) + ([d] if slopes else []))
    full = np.column_stack([small, d * x[:, None] if slopes else d])
    coefficient = float(np.linalg.lstsq(full, y, rcond=None)[0][2]) if covariates is not None else None
    return {**NestedTest(small, full).run(y, permutations, rng), "coefficient": coefficient}


def random_intercept_lrt(n: np.ndarray, mean: np.ndarray, ss: np.ndarray, groups: np.ndarray) -> tuple[float, int]:
    """Likelihood ratio and degrees of freedom of ``y ~ group`` against ``y ~ 1`` with a random site intercept (ML).

    Sites enter by their size, mean and sum of squares alone, as groups are constant within a site.  The
    likelihood is profiled over the ratio of the two variances, from 0 on.
    """

    def best(x: np.ndarray) -> float:
        def profile(ratio: float) -> float:
            w = n / (1 + ratio * n)
            beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], mean * np.sqrt(w), rcond=None)[0]
            rss = float(ss.sum() + (w * (mean - x @ beta) ** 2).sum())
            return -0.5 * (n.sum() * math.log(max(rss, 1e-300) / n.sum()) + np.log1p(ratio * n).sum())

        grid = np.concatenate([[0.0], np.exp(np.linspace(-12, 8, 81))])
        k = int(np.argmax([profile(r) for r in grid]))
        lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        g = (math.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if profile(a) > profile(b) else (a, hi)
        return max(profile(grid[k]), profile((lo + hi) / 2))

    one = np.ones((len(n), 1))
    full = np.column_stack([one, dummies(groups)])
    return 2 * (best(full) - best(one)), full.shape[1] - 1


def profile_interaction(scores: np.ndarray, groups: np.ndarray, permutations: int, rng: np.random.Generator) -> dict[str, float]:
    """Do the relative scores of a site's modules depend on its group?  Whole sites swap labels.

    Site and module effects come out by double centring, so a permutation costs one small projection.
    """
    n, m = scores.shape
    y = scores - scores.mean(1, keepdims=True)
    y = y - y.mean(0)
    total = float((y**2).sum())
    levels, codes = np.unique(groups, return_inverse=True)

    def gain(codes: np.ndarray) -> float:
        sizes = np.bincount(codes, minlength=len(levels))
        sums = np.stack([np.bincount(codes, y[:, j], len(levels)) for j in range(m)], 1)
        return float((sums**2 / np.maximum(sizes, 1)[:, None]).sum())

    df_num, df_den = (len(levels) - 1) * (m - 1), (n - len(levels)) * (m - 1)
    f = lambda g: (g / df_num) / ((total - g) / df_den)
    seen = f(gain(codes))
    above = sum(f(gain(rng.permutation(codes))) >= seen - 1e-12 for _ in range(permutations))
    return {"f": seen, "df_num": df_num, "df_den": df_den, "parametric_p": f_sf(max(seen, 0), df_num, df_den), "permutation_p": (above + 1) / (permutations + 1), "partial_r2": gain(codes) / total if total > 0 else math.nan}


def profile_pseudo_f(z: np.ndarray, groups: np.ndarray) -> float:
    """F of the groups' profiles: columns are z scores, each row's own level is taken out."""
    x = zscores(z)
    x = x - x.mean(1, keepdims=True)
    levels, codes = np.unique(groups, return_inverse=True)
    sizes = np.bincount(codes)
    means = np.stack([np.bincount(codes, x[:, j]) / sizes for j in range(x.shape[1])], 1)
    between = float((sizes[:, None] * (means - x.mean(0)) ** 2).sum())
    within = float(((x - means[codes]) ** 2).sum())
    return (between / (len(levels) - 1)) / (within / (len(x) - len(levels)))


def profile_permanova(z: np.ndarray, groups: np.ndarray, permutations: int, rng: np.random.Generator) -> dict[str, float]:
    seen = profile_pseudo_f(z, groups)
    above = sum(profile_pseudo_f(z, rng.permutation(groups)) >= seen - 1e-12 for _ in range(permutations))
    k, p = len(np.unique(groups)), z.shape[1]
    a, b = (k - 1) * (p - 1), (len(z) - k) * (p - 1)
    return {"f": seen, "df_num": a, "df_den": b, "parametric_p": f_sf(max(seen, 0), a, b), "permutation_p": (above + 1) / (permutations + 1)}


def resample_in_groups(groups: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Row numbers of a bootstrap sample drawn within each group."""
    return np.concatenate([rng.choice(np.flatnonzero(groups == g), int((groups == g).sum())) for g in np.unique(groups)])


def integration(x: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each pair of columns: correlation within groups, between group means, and their difference."""
    levels, codes = np.unique(groups, return_inverse=True)
    means = np.stack([x[codes == g].mean(0) for g in range(len(levels))])
    with np.errstate(invalid="ignore", divide="ignore"):
        w, b = np.corrcoef(x - means[codes], rowvar=False), np.corrcoef(means, rowvar=False)
    i, j = np.triu_indices(x.shape[1], 1)
    return np.stack([w[i, j], b[i, j], b[i, j] - w[i, j]], 1)


def pst_of(values: np.ndarray, groups: np.ndarray, least: int = 1) -> float:
    try:
        raw, _, w, n, k = between_within(values[:, None], groups, least)
    except ValueError:
        return math.nan
    if n <= k:
        return math.nan
    vb, vw = max(float(raw[0, 0]), 0.0), float(w[0, 0])
    return vb / (vb + 2 * vw) if vb + vw > 0 else 0.0
