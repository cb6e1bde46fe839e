"""Search over points of the unit cube by tree-structured Parzen estimators, in batches of trials.

Trials so far are split into the best few and the rest. Each side is a density: a mixture of truncated Gaussians around its
points, and of a flat part that keeps every point possible. Of many draws from the good density the one with the greatest
ratio of the good density to the other is tried next. Within a batch, chosen points whose score isn't known yet count as
bad ones, so that a batch spreads out. All draws are seeded.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Random trials before the densities are used; draws for each choice; the share of good trials, and how many at most.
STARTUP, DRAWS, GOOD, MOST_GOOD = 10, 64, 0.15, 25
#: The width of a Gaussian for one point, and the least one.
WIDTH, LEAST_WIDTH = 0.2, 0.01
_erf = np.frompyfunc(math.erf, 1, 1)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(z / math.sqrt(2.0)).astype(float))


@dataclass
class Density:
    """A mixture over [0, 1]^d: each point's truncated Gaussian and the flat part weigh the same."""

    points: np.ndarray
    width: float = field(init=False)

    def __post_init__(self) -> None:
        n, d = self.points.shape
        self.width = max(LEAST_WIDTH, WIDTH * max(1, n) ** (-1.0 / (d + 4)))

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        d = self.points.shape[1]
        out, which = rng.random((n, d)), rng.integers(0, len(self.points) + 1, n)
        near = which < len(self.points)
        middle = self.points[np.minimum(which, len(self.points) - 1)] if len(self.points) else out
        for _ in range(64):  # what falls outside is drawn again; a point on the edge loses half of its draws each time
            if not near.any():
                break
            out[near] = rng.normal(middle[near], self.width)
            near &= ((out < 0) | (out > 1)).any(1)
        return np.clip(out, 0.0, 1.0)

    def log(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the density at x (n x d)."""
        held = _normal_cdf((1 - self.points) / self.width) - _normal_cdf(-self.points / self.width)
        z = (x[:, None, :] - self.points[None, :, :]) / self.width
        each = (-0.5 * z * z - math.log(self.width * math.sqrt(2 * math.pi)) - np.log(np.maximum(held, 1e-300))[None, :, :]).sum(2)
        parts = np.concatenate([each, np.zeros((len(x), 1))], 1)  # the flat part has density 1
        top = parts.max(1)
        return top + np.log(np.exp(parts - top[:, None]).sum(1)) - math.log(parts.shape[1])


def split(points: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The good points and the others; of equal scores the earlier trial is better."""
    order = np.argsort(-scores, kind="stable")
    n = min(MOST_GOOD, max(1, math.ceil(GOOD * len(points))))
    return points[order[:n]], points[order[n:]]


def suggested(points: np.ndarray, scores: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """The next n points (n x d) after trials at points with these scores."""
    good, bad = split(points, scores)
    likely, out = Density(good), np.empty((n, points.shape[1]))
    for i in range(n):
        drawn = likely.draw(rng, DRAWS)
        ratio = likely.log(drawn) - Density(np.concatenate([bad, out[:i]])).log(drawn)
        out[i] = drawn[ratio.argmax()]
    return out


def maximized(evaluate: Callable[[np.ndarray], list[float]], first: np.ndarray, n_trials: int, seed: int, batch: int, startup: int = STARTUP) -> tuple[np.ndarray, np.ndarray]:
    """(points, scores) of n_trials trials: `first` (k x d), random ones up to `startup`, then the densities' choices.
    evaluate() takes the points of a batch together and gives their scores in order."""
    rng, d = np.random.default_rng(seed), first.shape[1]
    points, scores = np.empty((0, d)), np.empty(0)
    while len(points) < n_trials:
        n = min(batch, n_trials - len(points))
        if len(points) < startup:
            n = min(n, max(startup, len(first)) - len(points))
            new = np.concatenate([first[len(points) : len(points) + n], rng.random((max(0, n - max(0, len(first) - len(points))), d))])[:n]
        else:
            new = suggested(points, scores, n, rng)
        points, scores = np.concatenate([points, new]), np.concatenate([scores, np.asarray(evaluate(new), dtype=float)])
    return points, scores
