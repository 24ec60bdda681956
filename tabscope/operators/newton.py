"""L2 logistic regression by a trust-region Newton method whose sums are scans of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from tabscope.operators.sums import Rows, Vectors, by_value

# Up to this many coefficients the scan of a point brings its whole Hessian; beyond, each product is a scan of its own.
WHOLE_HESSIAN = 256
# Steps of the inner solver, and the share of the gradient at which it stops.
INNER_STEPS, INNER_TOLERANCE = 200, 0.1


@dataclass(frozen=True)
class Fit:
    """Coefficients with the bias last, the norm of the gradient there and at zero, and the scans it took."""

    weights: np.ndarray
    gradient: float
    gradient_at_zero: float
    scans: int


@dataclass
class Problem:
    """½ |w|² + c Σ weight log(1 + exp(-side (w x + bias))), side -1 or 1; the bias is one more coefficient.

    The columns ``label`` (0 or 1) and ``weight`` of the rows. ``penalty`` is 1 for each penalised coefficient, else 0.
    """

    data: Vectors
    c: float
    penalty: np.ndarray
    scans: int = 0

    @property
    def size(self) -> int:
        return self.data.width + 1

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """Value, gradient and Hessian product at ``w``: one scan, and one more a product if there are many coefficients."""
        n, c, whole = self.size, self.c, self.size <= WHOLE_HESSIAN

        def task(batches: Iterator[Rows]) -> np.ndarray:
            loss, slope = 0.0, np.zeros(n)
            curve = np.zeros((n, n) if whole else (0, 0))
            for rows in batches:
                side, weight = 2.0 * rows.others["label"] - 1.0, rows.others["weight"]
                margin = side * (rows.dot(w[:-1, None])[:, 0] + w[-1])
                loss += float(weight @ np.logaddexp(0.0, -margin))
                missed = 1.0 / (1.0 + np.exp(np.minimum(margin, 500.0)))
                pull = -weight * side * missed
                rows.add_to(slope[None, :-1], pull[:, None])
                slope[-1] += pull.sum()
                if whole:
                    bend = (weight * missed * (1.0 - missed))[:, None]
                    full = np.concatenate([rows.dense, np.ones((len(rows), 1))], 1)
                    curve += full.T @ (full * bend)
            return np.concatenate([[loss], slope, curve.ravel()])

        self.scans += 1
        total = self.data.summed(task, 1 + n + (n * n if whole else 0))
        value = 0.5 * float(self.penalty @ (w * w)) + c * total[0]
        gradient = self.penalty * w + c * total[1 : n + 1]
        if whole:
            hessian = c * total[n + 1 :].reshape(n, n)
            return value, gradient, lambda v: self.penalty * v + hessian @ v
        return value, gradient, lambda v: self._product(w, v)

    def _product(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        n, both = self.size, np.stack([w, v], 1)

        def task(batches: Iterator[Rows]) -> np.ndarray:
            total = np.zeros(n)
            for rows in batches:
                along = rows.dot(both[:-1]) + both[-1]
                missed = 1.0 / (1.0 + np.exp(np.clip(along[:, 0], -500.0, 500.0)))
                pull = rows.others["weight"] * missed * (1.0 - missed) * along[:, 1]
                rows.add_to(total[None, :-1], pull[:, None])
                total[-1] += pull.sum()
            return total

        self.scans += 1
        return self.penalty * v + self.c * self.data.summed(task, n)


def _step(gradient: np.ndarray, product: Callable[[np.ndarray], np.ndarray], radius: float) -> tuple[np.ndarray, float]:
    """A step inside the radius by conjugate gradients, and how much the quadratic model falls by it."""
    step, residual = np.zeros_like(gradient), -gradient
    direction, bent = residual, np.zeros_like(gradient)
    goal = INNER_TOLERANCE * min(1.0, float(np.linalg.norm(gradient)) ** 0.5) * float(np.linalg.norm(gradient))
    for _ in range(INNER_STEPS):
        if np.linalg.norm(residual) <= goal:
            break
        curved = product(direction)
        curvature, square = float(direction @ curved), float(residual @ residual)
        length = square / curvature if curvature > 0 else np.inf
        if not np.isfinite(length) or np.linalg.norm(step + length * direction) >= radius:
            # To the rim: the positive root of |step + t direction| = radius.
            a, b, r = direction @ direction, step @ direction, step @ step - radius * radius
            length = float((-b + np.sqrt(max(b * b - a * r, 0.0))) / a)
            step, bent = step + length * direction, bent + length * curved
            break
        step, bent = step + length * direction, bent + length * curved
        residual = residual - length * curved
        direction = residual + float(residual @ residual) / square * direction
    return step, -float(gradient @ step + 0.5 * step @ bent)


def trust_region(problem: Problem, tolerance: float = 1e-6, max_iter: int = 1000) -> Fit:
    """The minimum to a gradient of at most ``tolerance`` times that at zero; steps are taken only if the value falls.

    The radius grows with steps whose fall the quadratic model foretold, and shrinks with others, so that separable or
    collinear data cannot throw the fit off. It ends early where steps no longer change the value in doubles.
    """
    w = np.zeros(problem.size)
    value, gradient, product = problem.at(w)
    first = radius = float(np.linalg.norm(gradient))
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= tolerance * first:
            break
        step, foretold = _step(gradient, product, radius)
        if foretold <= 1e-15 * abs(value):
            break
        new_value, new_gradient, new_product = problem.at(w + step)
        ratio, length = (value - new_value) / foretold, float(np.linalg.norm(step))
        if ratio < 0.25:
            radius = 0.25 * length
        elif ratio > 0.75 and length > 0.99 * radius:
            radius *= 4.0
        if ratio > 1e-4:
            w, value, gradient, product = w + step, new_value, new_gradient, new_product
    return Fit(w, float(np.linalg.norm(gradient)), first, problem.scans)


by_value(__name__)
