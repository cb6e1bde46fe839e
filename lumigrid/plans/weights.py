"""Weights and extraction lanes, settled before a plan is built: what has no weight never enters it."""

from __future__ import annotations

from lumigrid.functions.registry import FEATURES

MODES = ("optimized", "manual", "equal")
#: Which lane computes a feature; extraction runs only the lanes that a search needs.
VLM = ("category", "description", "entity")


def resolved(mode: str, weights: dict[str, float] | None = None, stored: dict[str, float] | None = None, names: tuple[str, ...] = tuple(FEATURES)) -> dict[str, float]:
    """Weights by feature for a search mode. An empty result means that all sims count 0.

    equal, and optimized without stored weights, give each feature 1 / n; manual takes weights as they are, negative
    ones included, without unknown names and zeros."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "manual" and weights is None:
        raise ValueError("manual mode needs weights")
    given = {"manual": weights, "optimized": stored, "equal": None}[mode]
    if not given:
        return {n: 1.0 / len(names) for n in names}
    return {n: float(given[n]) for n in names if given.get(n)}


def normalized(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else dict(weights)


def limit_of(settings_limit: int | None, form_limit: int = 5) -> int:
    return settings_limit or form_limit


#: The features of the traditional lane whose older names are asked for.
COMPAT = {"hog", "hu_moments", "lbp", "sharpness", "gabor", "ccv", "brightness", "contrast", "saturation", "edge_density", "meta_cell"}


def lanes(mode: str, weights: dict[str, float] | None, compat: bool = False) -> set[str]:
    """The extraction lanes (traditional, vlm, dreamsim, text) for the features with positive weight; all for none.

    compat leaves out the features whose lane the older naming never asked for."""
    needed = {k for k, v in (weights or {}).items() if (v > 0 if mode == "manual" else v != 0)}
    if mode == "equal" or not needed:
        return {"traditional", "vlm", "dreamsim", "text"}
    out = set()
    for name in needed:
        f = FEATURES.get(name)
        if name in VLM:
            out.add("vlm")
        elif name == "dreamsim":
            out.add("dreamsim")
        elif name == "semantic":
            out |= {"text", "vlm"}
        elif f is not None and (not compat or name in COMPAT):
            out.add("traditional")
    return out
