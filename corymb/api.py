"""Mask-first functions for one image at a time, in memory: no Spark, no files.

The same kernels run on tables of images in :mod:`corymb.operators.imaging`.
"""

from __future__ import annotations

import math

import numpy as np

from corymb.operators import imaging
from corymb.operators import masks as mk
from corymb.operators.imaging import overlay_morphology, overlay_pattern, overlay_roi
from corymb.operators.mixture import ColourMixture, assign_roles

__all__ = ["ColorPatternModel", "assign_roles", "measure_pattern", "measure_shape", "overlay_morphology", "overlay_pattern", "overlay_roi", "synthetic_flower", "tubular_traits", "width_at", "width_profile"]


def measure_shape(mask: np.ndarray, scale_mm_per_px: float = 1.0) -> dict[str, float]:
    s = mk.shape(mask, scale_mm_per_px)
    return {"area_mm2": s["area"], "major_axis_mm": s["major"], "minor_axis_mm": s["minor"], "aspect_ratio": s["aspect"], "perimeter_mm": s["perimeter"], "solidity": s["solidity"], "circularity": s["circularity"], "orientation_deg": s["angle"]}


def width_profile(mask: np.ndarray, axis: str = "major") -> np.ndarray:
    """Widths in pixels along the longer or the shorter side of the oriented box."""
    if axis not in ("major", "minor"):
        raise ValueError("axis must be 'major' or 'minor'")
    m = mk.checked(mask)
    a, b, u = mk.oriented_box(mk.outline(m))
    angle = math.degrees(math.atan2(u[1], u[0])) + (0 if (a >= b) == (axis == "major") else 90)
    return mk.width_profile(mk.upright(m, angle)).astype(float)


def width_at(mask: np.ndarray, position: float, axis: str = "major", band: float = 0.02) -> float:
    """Median width around a relative position along an axis."""
    if not 0 <= position <= 1:
        raise ValueError("position must be between 0 and 1")
    w = width_profile(mask, axis)
    middle, half = round(position * (len(w) - 1)), max(1, round(band * len(w)))
    return float(np.median(w[max(0, middle - half) : middle + half + 1]))


def measure_pattern(pattern_mask: np.ndarray, roi_mask: np.ndarray) -> dict[str, float]:
    p = mk.pattern(pattern_mask, roi_mask)
    return {"coverage": p["coverage_pct"] / 100, "coverage_pct": p["coverage_pct"], "component_count": float(p["n_components"]), "centroid_x_rel": p["centroid_x"], "centroid_y_rel": p["centroid_y"], "spatial_dispersion": p["dispersion"]}


def synthetic_flower(size: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(RGB image, region mask, pattern mask) of the made-up flower."""
    from corymb.operators.pixels import CORNERS, SPOTS, edge_pixels

    if size < 96:
        raise ValueError("size must be at least 96")
    y, x = np.mgrid[:size, :size]
    inside = np.zeros((size, size), bool)
    corners = [(int(a * size), int(b * size)) for a, b in CORNERS]
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    for u, v, du, dv, steep, sign in edge_pixels(corners):
        i = np.arange(du + 1)
        along, across = u + i * (sign if steep else 1), v + (2 * i * dv + du - 1) // (2 * max(du, 1)) * (1 if steep else sign)
        inside[(along, across) if steep else (across, along)] = True
    spots = np.zeros_like(inside)
    for a, b, r in SPOTS:
        spots |= (x - int(a * size)) ** 2 + (y - int(b * size)) ** 2 <= max(2, int(r * size)) ** 2
    spots &= inside
    image = np.full((size, size, 3), 242, np.uint8)
    image[inside], image[spots] = (225, 188, 220), (112, 48, 145)
    return image, inside.astype(np.uint8), spots.astype(np.uint8)


def tubular_traits(mask: np.ndarray, scale_mm_per_px: float = 1.0, *, width_factor: float = 1.0) -> dict[str, float]:
    """Length, widths, aspect and flare of a flower mounted tube-up; ``width_factor`` 2 for folded ones."""
    if not (scale_mm_per_px > 0 and width_factor > 0):
        raise ValueError("scale and width factor must be positive")
    m = mk.checked(mask)
    a, b, u = mk.oriented_box(mk.outline(m))
    if abs(u[1]) < math.sqrt(0.5):  # the second side is nearer vertical
        a, b, u = b, a, np.array([-u[1], u[0]])
    angle = math.degrees(math.atan2(u[1], u[0])) % 180
    w = mk.width_profile(mk.upright(m, angle)).astype(float)
    n = len(w)
    band = lambda lo, hi: float(np.median(w[max(0, min(n - 1, int(lo * n))) : max(1, min(n, int(hi * n)))])) * scale_mm_per_px * width_factor
    length, width, throat = a * scale_mm_per_px, b * scale_mm_per_px * width_factor, band(0.04, 0.16)
    return {"corolla_length_mm": length, "corolla_width_mm": width, "throat_width_mm": throat, "mouth_width_mm": band(0.72, 0.88), "corolla_aspect_L_W": length / max(width, 1e-12), "tube_flare_W_throat": width / max(throat, 1e-12), "mounted_axis_angle_deg": angle}


def _lab(image: np.ndarray) -> np.ndarray:
    """CIELAB of RGB bytes as an 8-bit image stores it."""
    c = np.asarray(image)[..., :3].astype(float) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    byte = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    return np.stack([byte(light * 2.55) / 2.55, byte(500 * (f[..., 0] - f[..., 1]) + 128) - 128, byte(200 * (f[..., 1] - f[..., 2]) + 128) - 128], -1)


class ColorPatternModel:
    """Colour components of the pixels inside flower masks; what they mean is left to presets."""

    def __init__(self, n_components: int = 3, channels: tuple[str, ...] = ("a", "b"), sample_per_roi: int = 900, random_state: int = 0, reg_covar: float = 0.35):
        if any(c not in ("L", "a", "b") for c in channels):
            raise ValueError("channels must be among 'L', 'a', 'b'")
        self.n_components, self.channels, self.sample_per_roi, self.random_state, self.reg_covar = n_components, channels, sample_per_roi, random_state, reg_covar
        self.model: ColourMixture | None = None

    def _features(self, image: np.ndarray, roi: np.ndarray) -> np.ndarray:
        return _lab(np.asarray(image)[..., ::-1])[roi][:, ["Lab".index(c) for c in self.channels]]

    def fit(self, images: list[np.ndarray], masks: list[np.ndarray]) -> ColorPatternModel:
        """EM from several starts over an equal sample of each image (BGR bytes)."""
        if not images or len(images) != len(masks):
            raise ValueError("as many masks as images are needed, and one at least")
        rng = np.random.default_rng(self.random_state)
        parts = []
        for image, mask in zip(images, masks, strict=True):
            x = self._features(image, mk.checked(mask))
            parts.append(x[rng.permutation(len(x))[: self.sample_per_roi]])
        x = np.concatenate(parts)
        runs = [self._em(x, rng) for _ in range(6)]
        self.model = max(runs, key=lambda r: r[0])[1]
        return self

    def _em(self, x: np.ndarray, rng: np.random.Generator) -> tuple[float, ColourMixture]:
        k, d = self.n_components, x.shape[1]
        means = x[rng.choice(len(x), k, replace=False)]
        covs, weights, was = np.stack([np.atleast_2d(np.cov(x, rowvar=False)) + np.eye(d) * self.reg_covar] * k), np.full(k, 1 / k), -np.inf
        names = list(self.channels)
        for _ in range(400):
            logs = self._logs(x, weights, means, covs)
            top = logs.max(1, keepdims=True)
            e = np.exp(logs - top)
            now = float((top[:, 0] + np.log(e.sum(1))).mean())
            r = e / e.sum(1, keepdims=True)
            w = r.sum(0) + 1e-12
            means, weights = r.T @ x / w[:, None], w / w.sum()
            covs = np.stack([(r[:, c, None] * (x - means[c])).T @ (x - means[c]) / w[c] + np.eye(d) * self.reg_covar for c in range(k)])
            if abs(now - was) < 1e-6:
                break
            was = now
        return now, ColourMixture(names, weights, means, covs)

    @staticmethod
    def _logs(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(weights)))
        for c, (w, m, s) in enumerate(zip(weights, means, covs, strict=True)):
            root = np.linalg.cholesky(s)
            z = np.linalg.solve(root, (x - m).T)
            out[:, c] = math.log(max(w, 1e-300)) - 0.5 * ((z**2).sum(0) + len(m) * math.log(2 * math.pi)) - np.log(np.diag(root)).sum()
        return out

    def _fitted(self) -> ColourMixture:
        if self.model is None:
            raise RuntimeError("the model isn't fitted")
        return self.model

    @property
    def component_centres_(self) -> np.ndarray:
        return self._fitted().means.copy()

    def posterior(self, image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of each inside pixel, boolean region)"""
        m, roi = self._fitted(), mk.checked(mask)
        logs = self._logs(self._features(image, roi), m.weights, m.means, m.covariances)
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), roi

    def segment(self, image: np.ndarray, mask: np.ndarray, component: int, min_posterior: float = 0.5) -> np.ndarray:
        p, roi = self.posterior(image, mask)
        if not 0 <= component < p.shape[1]:
            raise ValueError("no such component")
        out = np.zeros(roi.shape, np.uint8)
        out[roi] = p[:, component] >= min_posterior
        return out


silhouette = imaging.silhouette
