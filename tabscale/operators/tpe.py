"""Tree-structured Parzen estimator for parameter search, with batch proposals.

Trials are split by score into good and bad ones. For each parameter both sets
give a density: a uniform prior and one truncated normal per trial, as wide as
the gap to its neighbours, on the parameter's own scale (linear or logarithmic)
mapped to [0, 1]. Candidates are drawn from the good density and the one with
the largest ratio of good to bad density is taken (Bergstra et al. 2011). A
batch is proposed one by one; proposals that have no score yet count as bad, so
the next ones keep away from them. Only trials, never rows, are held here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

STARTUP = 10        # random trials before the densities are used
CANDIDATES = 24     # draws from the good density for each proposal
MOST_GOOD = 25


@dataclass(frozen=True)
class Param:
    """A parameter's range; ``log``: on a logarithmic scale; ``whole``: integers, both ends included."""
    lo: float
    hi: float
    log: bool = False
    whole: bool = False

    def _ends(self):
        lo, hi = (self.lo - 0.5, self.hi + 0.5) if self.whole else (self.lo, self.hi)
        return (math.log(lo), math.log(hi)) if self.log else (lo, hi)

    def value(self, u: float):
        a, b = self._ends()
        v = a + u * (b - a)
        v = math.exp(v) if self.log else v
        v = min(max(round(v) if self.whole else v, self.lo), self.hi)
        return int(v) if self.whole else float(v)

    def unit(self, v) -> float:
        a, b = self._ends()
        return ((math.log(v) if self.log else v) - a) / (b - a)


_PHI = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))


class Density:
    """Uniform prior and a truncated normal around each point of [0, 1], all with equal weight."""

    def __init__(self, points):
        x = np.sort(np.asarray(points, float))
        ends = np.concatenate([[0.0], x, [1.0]])
        wide = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1]) if len(x) else x
        self.x, self.sd = x, np.clip(wide, 1.0 / min(100, len(x) + 2), 1.0)
        self.low = _PHI((0 - x) / self.sd) if len(x) else x
        self.mass = (_PHI((1 - x) / self.sd) - self.low) if len(x) else x

    def log(self, u: np.ndarray) -> np.ndarray:
        z = (u[:, None] - self.x[None, :]) / self.sd[None, :]
        each = np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * self.sd * self.mass)[None, :]
        return np.log((1.0 + each.sum(axis=1)) / (len(self.x) + 1))

    def draw(self, rng: np.random.RandomState, n: int) -> np.ndarray:
        out = rng.rand(n)
        which = rng.randint(0, len(self.x) + 1, n)
        for i in np.flatnonzero(which < len(self.x)):
            c = which[i]
            while True:     # a normal around a point of [0, 1] is inside it at least a third of the time
                u = rng.normal(self.x[c], self.sd[c])
                if 0 <= u <= 1:
                    out[i] = u
                    break
        return out


@dataclass
class Search:
    """Proposals for the parameters of ``space``, told their scores in any order (None: failed, counts as worst)."""
    space: dict[str, Param]
    seed: int = 42
    lower_is_better: bool = True
    startup: int = STARTUP
    candidates: int = CANDIDATES
    trials: list[dict] = field(default_factory=list)
    scores: list = field(default_factory=list)      # "pending" until told

    def __post_init__(self):
        self.rng = np.random.RandomState(self.seed)

    def _split(self):
        told = [(s, t) for s, t in zip(self.scores, self.trials) if s != "pending"]
        waiting = [t for s, t in zip(self.scores, self.trials) if s == "pending"]
        sign = 1 if self.lower_is_better else -1
        ranked = sorted(told, key=lambda x: math.inf if x[0] is None or math.isnan(x[0]) else sign * x[0])
        n = min(math.ceil(0.15 * len(ranked)), MOST_GOOD)
        return [t for _, t in ranked[:n]], [t for _, t in ranked[n:]] + waiting, len(told)

    def ask(self) -> tuple[int, dict]:
        """(number, parameters) of the next trial."""
        good, bad, told = self._split()
        out = {}
        for name, p in self.space.items():
            if told < self.startup:
                u = self.rng.rand()
            else:
                fine, poor = Density([p.unit(t[name]) for t in good]), Density([p.unit(t[name]) for t in bad])
                draws = fine.draw(self.rng, self.candidates)
                u = draws[np.argmax(fine.log(draws) - poor.log(draws))]
            out[name] = p.value(float(u))
        self.trials.append(out)
        self.scores.append("pending")
        return len(self.trials) - 1, out

    def tell(self, number: int, score) -> None:
        self.scores[number] = score

    def best(self):
        """(score, parameters) of the best trial, or (None, {})."""
        told = [(s, i) for i, s in enumerate(self.scores) if s not in ("pending", None) and not math.isnan(s)]
        if not told:
            return None, {}
        s, i = (min if self.lower_is_better else max)(told, key=lambda x: (x[0], x[1] if self.lower_is_better else -x[1]))
        return s, self.trials[i]
