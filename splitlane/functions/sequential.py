"""Early stopping at interim looks: spending boundaries and an always-valid p-value.

Boundaries are a short list, one critical value per planned look, worked out once on the
driver. The always-valid p-value is a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the grid over the continuation region; the integrand is smooth, so Simpson's
#: rule on it is good to about 1e-8.
GRID = 801
#: Above this no look can cross: its tail is below 1e-22.
NEVER = 10.0


def _tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z), to double precision."""
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.ravel(z)]).reshape(np.shape(z))


def _quantile(tail: float) -> float:
    """The z with P(Z > z) = ``tail``, by bisection."""
    low, high = -NEVER, NEVER
    for _ in range(80):
        middle = (low + high) / 2
        if 0.5 * math.erfc(middle / math.sqrt(2)) > tail:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def obrien_fleming_spent(alpha: float) -> Callable[[float], float]:
    """Error spent up to information ``t``, both sides: hardly any early, most at the end."""
    z = _quantile(alpha / 4)
    return lambda t: min(alpha, 2.0 * math.erfc(z / math.sqrt(2 * t))) if t > 0 else 0.0


def pocock_spent(alpha: float) -> Callable[[float], float]:
    """Error spent up to information ``t``: about the same at every look."""
    return lambda t: alpha * math.log(1 + (math.e - 1) * min(1.0, max(0.0, t)))


SPENDING = {"obrien_fleming": obrien_fleming_spent, "pocock": pocock_spent}


def spending_boundaries(
    information: Sequence[float], alpha: float = 0.05, spending: str = "obrien_fleming"
) -> list[float]:
    """Critical value of |z| at every look, so that all looks together err with ``alpha``.

    ``information`` is the share of the planned information at each look, ascending. The
    score process is a Brownian motion; its density over the paths that have not stopped
    is carried from look to look by numerical integration, and each critical value spends
    what the spending function allows by then. A look without new information, or beyond
    the plan, has none left to spend and gets infinity.
    """
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, got {alpha}")
    spent_by = SPENDING[spending](alpha)
    out: list[float] = []
    points = density = weights = None
    before = spent = 0.0
    for t in information:
        if t < before:
            raise ValueError("information must not shrink from look to look")
        t = min(1.0, t)
        step = t - before
        allowed = spent_by(t) - spent
        if step <= 1e-12 or allowed <= 1e-18:
            out.append(math.inf)
            continue
        root = math.sqrt(step)

        def crossing(bound: float, root=root, points=points, mass=None if density is None else density * weights) -> float:
            if points is None:
                return 2 * float(_tail(np.array(bound / root)))
            return float(((_tail((bound - points) / root) + _tail((bound + points) / root)) * mass).sum())

        low, high = 0.0, NEVER * math.sqrt(t)
        for _ in range(60):
            middle = (low + high) / 2
            if crossing(middle) > allowed:
                low = middle
            else:
                high = middle
        bound = (low + high) / 2
        out.append(bound / math.sqrt(t))
        spent += allowed
        grid = np.linspace(-bound, bound, GRID)
        if points is None:
            new = np.exp(-((grid / root) ** 2) / 2) / (root * math.sqrt(2 * math.pi))
        else:
            gaps = (grid[:, None] - points[None, :]) / root
            new = (np.exp(-(gaps**2) / 2) * (density * weights)[None, :]).sum(1) / (root * math.sqrt(2 * math.pi))
        simpson = np.full(GRID, 2.0)
        simpson[1::2] = 4.0
        simpson[[0, -1]] = 1.0
        points, density, weights, before = grid, new, simpson * (2 * bound / (GRID - 1) / 3), t
    return out


def equal_looks(looks: int) -> list[float]:
    return [k / looks for k in range(1, looks + 1)]


def always_valid_p(effect: Column, variance: Column, tau: float) -> Column:
    """p-value of a mixture sequential probability ratio test at one look.

    ``effect`` is normal with ``variance``; under the alternative it is mixed over a normal
    of standard deviation ``tau``. The smallest value over all looks so far is valid
    whenever one stops. Without a positive variance there is no evidence: 1.
    """
    t = F.lit(tau * tau)
    log_ratio = 0.5 * F.log(F.try_divide(variance, variance + t)) + F.try_divide(
        t * effect * effect, 2.0 * variance * (variance + t)
    )
    return F.when(variance > 0, F.least(F.lit(1.0), F.exp(-log_ratio))).otherwise(F.lit(1.0))
