"""Singular values and right singular vectors of a small square matrix, by way of a bidiagonal one.

Householder reflections from both sides make the matrix upper bidiagonal. Its squared entries are
a qd array, on which shifted differential qd steps (dqds) find the squared singular values to high
relative accuracy. For each value, a stationary transform from the top and a progressive one from
the bottom meet in a twisted factorisation, whose solution is the vector.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = 1e-280       # stands in for a zero in a qd array, beside entries of about 1
PIVOT = 1e-40       # stands in for a zero pivot
LARGE = 1e100       # entries of a vector beyond it are scaled down
CLOSE = 1e-5        # values nearer than this share of the largest are told apart by orthogonal starts
SWEEPS = 3          # inverse iterations inside such a group
CORRECTIONS = 3     # steps at most, each of which squares what is left of the error
ORTHOGONAL = 1e-13  # error below which no more are taken


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with matrix = U B V' for some orthogonal U; V has the vectors as columns."""
    a = np.array(matrix, float)
    size = len(a)
    right = np.eye(size)
    for k in range(size):
        v = reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k + 2 < size:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, 2 * v)
            right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def reflector(x: np.ndarray) -> np.ndarray:
    """Unit v (or zeros) such that x - 2 v (v'x) has zeros below its first entry."""
    v = x.copy()
    scale = np.abs(v).max(initial=0.0)
    if scale == 0:
        return v
    v /= scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def squared_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B'B for a bidiagonal B with squared diagonal q and superdiagonal e."""
    found: list[float] = []
    parts = [(q.astype(float).tolist(), e.astype(float).tolist(), 0.0)]
    while parts:
        q, e, shifted = parts.pop()
        cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * min(q[k] + shifted, q[k + 1] + shifted) or e[k] <= TINY), None)
        if not e:
            found += [x + shifted for x in q]
        elif cut is not None:
            parts += [(q[:cut + 1], e[:cut], shifted), (q[cut + 1:], e[cut + 1:], shifted)]
        else:
            if q[0] < q[-1]:  # small entries belong at the end, where they deflate
                q, e = flipped(q, e)
            bound = least_bound(q, e)
            for shift in (bound, bound * 0.9, 0.0):
                stepped = qd_step(q, e, shift)
                if stepped is not None:
                    parts.append((*stepped, shifted + shift))
                    break
    return np.sort(np.maximum(found, 0.0))[::-1]


def flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same eigenvalues with its order turned round: B is turned by 180
    degrees, which leaves a lower bidiagonal, that is B' of an upper one."""
    return q[::-1], e[::-1]


def least_bound(q: list[float], e: list[float]) -> float:
    """A bound from below of the least eigenvalue: 1 / trace of the inverse, which the unshifted step gives."""
    d, total = q[0], 0.0
    for k in range(len(q)):
        if d <= TINY:
            return 0.0
        total += 1 / d
        if k < len(e):
            d = q[k + 1] * (d / (d + e[k]))
    return (1 - 16 * EPS) / total


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift was too large."""
    d, new_q, new_e = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        new_q.append(d + e[k])
        ratio = q[k + 1] / new_q[k] if new_q[k] > 0 else 1.0
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


class Twisted:
    """B'B - value as a twisted factorisation, met at the place of the least pivot."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        size = len(diagonal)
        d = np.where(np.abs(diagonal) < 1e-140, 1e-140, diagonal) ** 2
        ratio = above / np.where(np.abs(diagonal[:-1]) < 1e-140, 1e-140, diagonal[:-1])
        self.down, self.up = np.zeros(max(size - 1, 0)), np.zeros(max(size - 1, 0))
        top, low = np.zeros(size), np.zeros(size)       # pivots from the top and from the bottom
        s, p = np.full(size, -value), np.full(size, 0.0)
        for k in range(size):
            top[k] = _pivot(s[k] + d[k])
            if k + 1 < size:
                self.down[k] = d[k] * ratio[k] / top[k]
                s[k + 1] = self.down[k] * ratio[k] * s[k] - value
        p[-1] = d[-1] - value
        low[-1] = _pivot(p[-1])
        for k in range(size - 2, -1, -1):
            low[k + 1] = _pivot(d[k] * ratio[k] ** 2 + p[k + 1])
            share = d[k] / low[k + 1]
            self.up[k] = ratio[k] * share
            p[k] = p[k + 1] * share - value
        meet = s + p + value
        self.at = int(np.argmin(np.abs(meet)))
        self.pivots = np.concatenate((top[:self.at], [_pivot(meet[self.at])], low[self.at + 1:]))

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.pivots))
        z[self.at] = 1.0
        return self._out(z)

    def solve(self, right: np.ndarray) -> np.ndarray:
        z = right.copy()
        for k in range(self.at):
            z[k + 1] -= self.down[k] * z[k]
            if abs(z[k + 1]) > LARGE:
                z /= abs(z[k + 1])
        for k in range(len(z) - 1, self.at, -1):
            z[k - 1] -= self.up[k - 1] * z[k]
            if abs(z[k - 1]) > LARGE:
                z /= abs(z[k - 1])
        z /= self.pivots
        return self._out(z / max(np.abs(z).max(), TINY))

    def _out(self, z: np.ndarray) -> np.ndarray:
        for k in range(self.at - 1, -1, -1):
            z[k] -= self.down[k] * z[k + 1]
            if abs(z[k]) > LARGE:
                z /= abs(z[k])
        for k in range(self.at, len(z) - 1):
            z[k + 1] -= self.up[k] * z[k]
            if abs(z[k + 1]) > LARGE:
                z /= abs(z[k + 1])
        return z / np.linalg.norm(z)


def _pivot(x: float) -> float:
    return x if abs(x) > PIVOT else PIVOT


def right_singular(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling, all of them; the first `count` right singular vectors as columns)."""
    size = len(matrix)
    scale = np.abs(matrix).max(initial=0.0)
    if not size or scale == 0:
        return np.zeros(size), np.eye(size)[:, :count]
    diagonal, above, right = bidiagonalise(matrix / scale)
    whole = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    above[np.abs(above) <= EPS * whole] = 0.0
    blocks = np.split(np.arange(size), np.flatnonzero(above == 0) + 1)
    pairs: list[tuple[float, np.ndarray]] = []
    for block in blocks:  # vectors of different blocks are orthogonal as they stand
        a, b = diagonal[block], above[block[:-1]]
        values = squared_values(np.maximum(a * a, TINY), b * b)
        near: list[np.ndarray] = []
        for k, value in enumerate(values):
            near = near if k and values[k - 1] - value <= CLOSE * whole * whole else []
            factors = Twisted(a, b, value)
            z = factors.vector()
            if near:
                z = np.random.default_rng(k).normal(size=len(a))
                for _ in range(SWEEPS):
                    z = factors.solve(z / np.linalg.norm(z))
                    for _ in range(2):
                        z -= np.sum([y * (y @ z) for y in near], axis=0)
                z /= np.linalg.norm(z)
            near.append(z)
            full = np.zeros(size)
            full[block] = z
            pairs.append((value, full))
    pairs.sort(key=lambda p: -p[0])
    values = np.array([v for v, _ in pairs])
    vectors = right @ np.stack([z for _, z in pairs], axis=1)
    for _ in range(CORRECTIONS):
        vectors = refined(matrix / scale, values, vectors, CLOSE * whole * whole)
        if np.abs(vectors.T @ vectors - np.eye(size)).max() <= ORTHOGONAL:
            break
    return values * scale * scale, vectors[:, :count]


def refined(matrix: np.ndarray, values: np.ndarray, vectors: np.ndarray, close: float) -> np.ndarray:
    """One step of Ogita and Aishima's correction: what a vector holds of those of other values goes, to second order.

    Inside a group of near values, a solution is mostly made of vectors found before; taking these out leaves
    the rounding errors of a much longer vector. Near values are not told apart here, their vectors only made orthonormal.
    """
    image = matrix @ vectors
    inner, product = np.eye(len(values)) - vectors.T @ vectors, image.T @ image
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= close
    return vectors + vectors @ np.where(near, inner / 2, (product + values[None, :] * inner) / np.where(near, 1, gap))
