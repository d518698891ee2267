"""What colour components and axes mean for flattened tube flowers mounted tube up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corymb.api import ColorPatternModel, tubular_traits


@dataclass(frozen=True)
class CampanulaGuidePreset:
    """Names the components of a colour model over (a, b), and cuts out the nectar guide."""

    def assign_roles(self, component_centres: np.ndarray) -> dict[str, int]:
        """Guide: the most magenta; oxidation: the most yellow-red of the rest; petal: the palest of what is left."""
        centres = np.asarray(component_centres, float)
        if centres.ndim != 2 or centres.shape[1] != 2 or len(centres) < 3:
            raise ValueError("three or more centres over (a, b) are needed")
        guide = int(np.argmax(centres @ [1, -1]))
        order = sorted(set(range(len(centres))) - {guide}, key=lambda i: (-centres[i].sum(), i))
        petal = min(order[1:], key=lambda i: (float(np.hypot(*centres[i])), i))
        return {"petal": petal, "guide": guide, "oxidation": order[0]}

    def segment(self, model: ColorPatternModel, image: np.ndarray, mask: np.ndarray, min_posterior: float = 0.5) -> np.ndarray:
        """The guide's mask in one flower."""
        return model.segment(image, mask, self.assign_roles(model.component_centres_)["guide"], min_posterior)


campanula_tubular_traits = tubular_traits

__all__ = ["CampanulaGuidePreset", "campanula_tubular_traits"]
