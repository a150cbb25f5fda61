"""The largest eigenvalues of a symmetric matrix by contour integration (the FEAST method).

Inertia counts (signs of the pivots of a symmetric factorisation of V - s I) tell how many eigenvalues lie above any
number s.  They cut the axis into intervals that hold a few eigenvalues each, with cuts in gaps.  For an
interval, the resolvent (z I - V)^-1 is integrated along the circle over it: a quadrature of complex shifted solves
projects a few random vectors onto the interval's eigenvectors.  Rayleigh-Ritz extracts the pairs, the projection is
repeated until the residuals vanish, and the number of pairs must equal the interval's count: none is missed.

The matrix has as many rows as a vector has dimensions, so this runs wherever the matrix fits.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues that one interval may hold, unless they lie too close to be parted.
PER_INTERVAL = 8
#: Points of the quadrature on the upper half of the circle; the lower half is its mirror image.
POINTS = 8
ROUNDS = 60
_EPS = np.finfo(float).eps


def positive_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: signs of its block diagonal factor (full pivoting)."""
    a, found = np.array(matrix, dtype=float), 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        p, q = divmod(int(off.argmax()), len(a))
        if max(diagonal[r], off[p, q]) == 0:
            return found
        if diagonal[r] >= 0.64 * off[p, q]:  # (1 + sqrt 17) / 8 bounds the growth of the entries
            found += a[r, r] > 0
            chosen = [r]
        else:  # a block of two has one positive and one negative eigenvalue
            found += 1
            chosen = [p, q]
        rest = np.delete(np.arange(len(a)), chosen)
        side = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(chosen, chosen)], side.T)
        a = (a + a.T) / 2
    return int(found)


class _Counter:
    """Eigenvalues above a number, each counted once."""

    def __init__(self, v: np.ndarray):
        self.v, self.known = v, {}

    def above(self, s: float) -> int:
        if s not in self.known:
            self.known[s] = positive_pivots(self.v - s * np.eye(len(self.v)))
        return self.known[s]

    def cut(self, low: float, high: float) -> float:
        """A number between that has no eigenvalue close by, if one of a few tries finds it."""
        width = high - low
        for margin in (1e-2, 1e-4, 1e-7):
            for share in (0.5, 0.42, 0.58, 0.35, 0.65, 0.27, 0.73, 0.2, 0.8):
                s = low + share * width
                if self.above(s - margin * width) == self.above(s + margin * width):
                    return s
        return low + width / 2


def intervals(counter: _Counter, low: float, high: float, wanted: int, finest: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in it) from the top down, until they hold ``wanted``."""
    open_, out, have = [(low, high)], [], 0
    while open_ and have < wanted:
        a, b = open_.pop()
        inside = counter.above(a) - counter.above(b)
        if inside == 0:
            continue
        if inside <= PER_INTERVAL or b - a <= finest:
            out.append((a, b, inside))
            have += inside
        else:
            s = counter.cut(a, b)
            open_ += [(a, s), (s, b)]
    return out


def _project(v: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """Quadrature of the resolvent on the circle over (low, high), applied to ``y``."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for j in range(POINTS):
        step = radius * np.exp(1j * np.pi * (j + 0.5) / POINTS)
        solved = np.linalg.solve((centre + step) * np.eye(len(v)) - v, y.astype(complex))
        out += (step * solved).real / POINTS
    return out


def _ritz(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz pairs of the space that ``y`` spans."""
    q, _ = np.linalg.qr(y)
    h = q.T @ v @ q
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values, q @ turn


def eigenpairs_in(v: np.ndarray, low: float, high: float, count: int, scale: float) -> np.ndarray:
    """Eigenvectors of the ``count`` eigenvalues in (low, high], by repeated projection."""
    d = len(v)
    size = min(d, max(count + 4, count * 3 // 2))
    rng = np.random.default_rng(20240607)
    y, enough, best = rng.standard_normal((d, size)), 64 * _EPS * scale, np.inf
    for _ in range(ROUNDS):
        values, x = _ritz(v, _project(v, low, high, y))
        residual = np.linalg.norm(v @ x - x * values, axis=0)
        inside = (values > low) & (values <= high) & (residual <= 1e-6 * scale)
        now = residual[inside].max() if inside.sum() == count else np.inf
        if now <= enough or now < 1e-11 * scale and now > best / 2:  # there, or rounding stops it
            return x[:, inside]
        best = min(best, now)
        if inside.sum() > count or size < d and not np.isfinite(best) and _ % 10 == 9:
            size = min(d, size * 2)
            x = np.hstack([x, rng.standard_normal((d, size - x.shape[1]))])
        y = x
    raise ArithmeticError(f"{count} eigenvalues were counted in ({low}, {high}], but not all were found")


def largest_eigenpairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues, falling, and their unit eigenvectors as columns.

    Fewer come back if the matrix has fewer eigenvalues that differ from zero beyond rounding.
    """
    d = len(v)
    scale = np.abs(v).sum(axis=1).max() if d else 0.0
    if not scale:
        return np.zeros(0), np.zeros((d, 0))
    counter = _Counter(v)
    low, high = 4 * d * _EPS * scale, scale * (1 + 1e-9)
    wanted = min(wanted, counter.above(low))
    found = [eigenpairs_in(v, a, b, n, scale) for a, b, n in intervals(counter, low, high, wanted, 1e-10 * scale)]
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    values, x = _ritz(v, np.hstack(found))  # one more step over all intervals makes them orthogonal to rounding
    order = np.argsort(-values, kind="stable")[:wanted]
    x = x[:, order]
    return values[order], x / np.linalg.norm(x, axis=0)
