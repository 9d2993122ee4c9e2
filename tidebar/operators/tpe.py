"""A tree-structured Parzen estimator: parameters that did well, told apart from the others by two densities each.

After some random draws, a parameter's values in the best trials and in the rest give two mixtures of bells cut off at the range's
ends (logarithmic ranges on their logarithms, stepped ones rounded); of some draws from the good one, that with the greatest ratio of
the two is tried. A range's end may depend on parameters drawn before it. All draws are seeded."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

STARTUP = 10
CANDIDATES = 24


@dataclass(frozen=True)
class Range:
    """Numbers from low to high; high may be a function of the parameters before. step: multiples of it above low."""

    low: float
    high: float | Callable[[dict], float]
    step: float | None = None
    log: bool = False
    whole: bool = False

    def ends(self, params: dict) -> tuple[float, float]:
        high = self.high(params) if callable(self.high) else self.high
        return (math.log(self.low), math.log(high)) if self.log else (self.low, high)

    def value(self, x: float, params: dict) -> float | int:
        """The allowed number at a place between the ends."""
        low, high = self.ends(params)
        x = min(max(x, low), high)
        if self.log:
            return math.exp(x)
        step = self.step or (1 if self.whole else None)
        if step:
            x = low + step * min(round((x - low) / step), math.floor((high - low) / step + 1e-9))
        return int(round(x)) if self.whole else round(x, 10)

    def place(self, value: float) -> float:
        return math.log(value) if self.log else float(value)


Space = dict[str, Range]

#: Of the boosted trees.
SPACE: Space = {
    "max_depth": Range(3, 8, whole=True),
    "n_estimators": Range(100, 600, step=50, whole=True),
    "learning_rate": Range(0.01, 0.2, log=True),
    "num_leaves": Range(8, lambda p: min(256, 2 ** p["max_depth"]), whole=True),
    "min_child_samples": Range(10, 200, step=10, whole=True),
    "subsample": Range(0.5, 1.0, step=0.05),
    "colsample_bytree": Range(0.4, 1.0, step=0.05),
    "reg_alpha": Range(1e-8, 10.0, log=True),
    "reg_lambda": Range(1e-8, 10.0, log=True),
}


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class Parzen:
    """A mixture of bells at the places seen and a wide one over the whole range."""

    def __init__(self, places: list[float], low: float, high: float):
        self.low, self.high = low, high
        wide = max(high - low, 1e-12)
        seen = sorted([min(max(p, low), high) for p in places] + [(low + high) / 2])
        middle = seen.index((low + high) / 2)
        least = wide / min(100.0, 1.0 + len(seen))
        self.bells = []
        for k, mu in enumerate(seen):
            left = mu - (seen[k - 1] if k else low)
            right = (seen[k + 1] if k + 1 < len(seen) else high) - mu
            self.bells.append((mu, wide if k == middle else min(max(left, right, least), wide)))

    def draw(self, rng: random.Random) -> float:
        mu, sigma = rng.choice(self.bells)
        while True:
            x = rng.gauss(mu, sigma)
            if self.low <= x <= self.high:
                return x

    def density(self, x: float, width: float) -> float:
        """Mass of [x - width / 2, x + width / 2], or for width 0 the density."""
        total = 0.0
        for mu, sigma in self.bells:
            inside = max(_phi((self.high - mu) / sigma) - _phi((self.low - mu) / sigma), 1e-300)
            if width:
                total += max(_phi((min(x + width / 2, self.high) - mu) / sigma) - _phi((max(x - width / 2, self.low) - mu) / sigma), 0.0) / inside
            else:
                total += math.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi) * inside)
        return max(total / len(self.bells), 1e-300)


def suggest(space: Space, trials: list[tuple[dict, float]], rng: random.Random) -> dict:
    """The next parameters after trials of (parameters, score); the greater score is the better one."""
    params: dict = {}
    ranked = sorted(trials, key=lambda t: -t[1])
    good = ranked[: min(math.ceil(0.1 * len(ranked)), 25)]
    rest = ranked[len(good) :]
    for name, r in space.items():
        low, high = r.ends(params)
        if high <= low:
            params[name] = r.value(low, params)
        elif len(trials) < STARTUP:
            params[name] = r.value(rng.uniform(low, high), params)
        else:
            one, other = (Parzen([r.place(p[name]) for p, _ in part], low, high) for part in (good, rest))
            step = r.step or (1 if r.whole else 0)
            drawn = [r.value(one.draw(rng), params) for _ in range(CANDIDATES)]
            params[name] = max(drawn, key=lambda v: math.log(one.density(r.place(v), step)) - math.log(other.density(r.place(v), step)))
    return params


def search(objective: Callable[[dict], float], space: Space = SPACE, trials: int = 30, seed: int = 0) -> tuple[dict, float, list[tuple[dict, float | None]]]:
    """Best parameters, their score, and all trials in their order; one that repeats an earlier one's parameters is pruned: it counts as
    a trial, has no score and isn't run. A score that isn't a number counts as the worst."""
    rng, done, seen, history = random.Random(seed), [], set(), []
    for _ in range(trials):
        params = suggest(space, done, rng)
        key = tuple(params.values())
        if key in seen:
            history.append((params, None))
            continue
        seen.add(key)
        score = objective(params)
        score = score if score == score else -math.inf
        done.append((params, score))
        history.append((params, score))
    if not done:
        return {}, -math.inf, history
    best = max(done, key=lambda t: t[1])
    return best[0], best[1], history
