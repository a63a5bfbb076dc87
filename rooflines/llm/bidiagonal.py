"""Singular values and right singular vectors of one small square matrix by its bidiagonal form.

Householder reflections make the matrix upper bidiagonal; dqds transforms of its squared entries give the squared
singular values, each to a few units in its last places; a twisted factorisation of B'B less such a value is solved for
its vector. Matrices here are as wide as a vector has entries, whatever the number of rows they were reduced from.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v of length 1 (or 0) and the value a with (1 - 2vv')x = a e1."""
    norm = np.linalg.norm(x)
    if norm == 0:
        return np.zeros_like(x), 0.0
    v = x / norm
    a = -np.copysign(norm, v[0])
    v[0] += np.copysign(1.0, v[0])
    return v / np.linalg.norm(v), a


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal, and the reflectors on the right: r = Q B P' with P their product; reflector i begins at entry i + 1."""
    r = np.array(r, dtype=float)
    d = r.shape[0]
    diagonal, above, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, diagonal[k] = _reflector(r[k:, k].copy())
        r[k:, k + 1 :] -= 2 * np.outer(v, v @ r[k:, k + 1 :])
        if k < d - 1:
            w, above[k] = _reflector(r[k, k + 1 :].copy())
            r[k + 1 :, k + 1 :] -= 2 * np.outer(r[k + 1 :, k + 1 :] @ w, w)
            right.append(w)
    return diagonal, above, right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift was larger than the smallest value."""
    out_q, out_e = [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        now = d + e[i]
        if now == 0:  # d and e are both 0: the block ends here
            t = 0.0
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / now
            d = d * t - shift
        out_q.append(now)
        out_e.append(e[i] * t)
    if d < 0:
        return None
    return [*out_q, d], out_e


def _shifts(q: list[float], e: list[float]) -> list[float]:
    """What to try, largest first: an estimate from the last rows, then a bound (Johnson's) that holds, then nothing."""
    a, b = np.sqrt(q), np.sqrt(e)
    near = max(0.0, a[-1] - b[-1] / 2) ** 2
    bound = np.min(a - (np.append(b, 0) + np.insert(b, 0, 0)) / 2)
    safe = max(0.0, float(bound)) ** 2 * (1 - 8 * EPS)
    return [float(near) * (1 - 8 * EPS), float(near) * 0.75, safe, 0.0]


def squared_values(q: list[float], e: list[float]) -> list[float]:
    """The squared singular values of the bidiagonal with squared diagonal q and squared superdiagonal e, in no order."""
    found, todo = [], [(list(q), list(e), 0.0)]
    least = (4 * EPS) ** 2
    while todo:
        q, e, above = todo.pop()
        while True:
            for i in range(len(e)):  # split where the superdiagonal no longer counts
                if e[i] <= least * (above + min(q[i], q[i + 1])):
                    todo.append((q[i + 1 :], e[i + 1 :], above))
                    q, e = q[: i + 1], e[:i]
                    break
            if not e:
                found.append(above + q[0])
                break
            if q[0] < q[-1]:  # small ones at the end come off soonest
                q, e = q[::-1], e[::-1]
            for shift in _shifts(q, e):
                new = _sweep(q, e, shift)
                if new is not None:
                    q, e = new
                    above += shift
                    break
    return found


class Twisted:
    """B'B - value, factored from both ends to the place where the pivot is least."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        q, e, off = a * a, b * b, a[:-1] * b
        tiny = max(EPS * EPS * max(q.max(initial=0), value), np.finfo(float).tiny)
        safe = lambda x: x if abs(x) > tiny else tiny
        self.down, self.up = np.empty(n), np.empty(n)
        self.lower, self.upper = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
        s, p = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            self.down[i] = safe(s[i] + q[i])
            self.lower[i] = off[i] / self.down[i]
            s[i + 1] = e[i] * s[i] / self.down[i] - value
        p[n - 1] = q[n - 1] - value
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = safe(e[i] + p[i + 1])
            self.upper[i] = off[i] / self.up[i + 1]
            p[i] = p[i + 1] * q[i] / self.up[i + 1] - value
        pivots = s + p + value
        self.at = int(np.argmin(np.abs(pivots)))
        self.pivot = safe(pivots[self.at])

    def solve(self, y: np.ndarray) -> np.ndarray:
        y, k, n = y.copy(), self.at, len(y)
        for i in range(k):
            y[i + 1] -= self.lower[i] * y[i]
        for i in range(n - 2, k - 1, -1):
            y[i] -= self.upper[i] * y[i + 1]
        y[:k] /= self.down[:k]
        y[k + 1 :] /= self.up[k + 1 :]
        y[k] /= self.pivot
        for i in range(k - 1, -1, -1):
            y[i] -= self.lower[i] * y[i + 1]
        for i in range(k, n - 1):
            y[i + 1] -= self.upper[i] * y[i]
        return y

    def vector(self) -> np.ndarray:
        """(B'B - value) z = pivot e_k, of length 1."""
        y = np.zeros(len(self.down))
        y[self.at] = self.pivot
        z = self.solve(y)
        return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """z less its part along the others, twice over, of length 1; and how much was left."""
    left = 1.0
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
        norm = float(np.linalg.norm(z))
        left = min(left, norm)
        z = z / norm if norm > 0 else z
    return z, left


def _block_vectors(a: np.ndarray, b: np.ndarray, values: list[float]) -> list[np.ndarray]:
    """A vector for each of the block's values, falling; near ones are kept at right angles by solving again."""
    done: list[np.ndarray] = []
    noise = np.random.default_rng(len(a))
    for value in values:
        twisted = Twisted(a, b, value)
        z, left = _apart(twisted.vector(), done)
        tries = 0
        while left < 0.5 and tries < 8:  # one of a cluster: go on from another start, at right angles to those before
            start, _ = _apart(noise.standard_normal(len(a)) if tries % 4 == 0 else z, done)
            y = twisted.solve(start)
            z, left = _apart(y / np.linalg.norm(y), done)
            tries += 1
        done.append(z)
    return done


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of r, falling (at most so many), and their right vectors as columns."""
    d = r.shape[0]
    scale = float(np.abs(r).max(initial=0))
    if d == 0 or scale == 0:
        return np.zeros(min(d, most)), np.eye(d)[:, :most]
    diagonal, above, right = bidiagonalise(r / scale)
    # signs go into the vectors, so that B is not negative
    sign, left = np.ones(d), 1.0
    for k in range(d):
        left = np.copysign(1.0, diagonal[k]) * sign[k]
        if k < d - 1:
            sign[k + 1] = np.copysign(1.0, above[k]) * left
    a, b = np.abs(diagonal), np.abs(above)
    norm = max(a.max(), b.max(initial=0))
    ends = [*(i + 1 for i in range(d - 1) if b[i] <= EPS * norm * 1e-2), d]
    pairs, start = [], 0
    for end in ends:
        aa, bb = a[start:end], b[start : end - 1]
        values = sorted(squared_values(list(aa * aa), list(bb * bb)), reverse=True)[:most]
        for value, z in zip(values, _block_vectors(aa, bb, values), strict=True):
            pairs.append((value, start, end, z))
        start = end
    pairs.sort(key=lambda x: -x[0])
    out = np.zeros((d, min(most, d)))
    for j, (_, start, end, z) in enumerate(pairs[:most]):
        out[start:end, j] = z
    out *= sign[:, None]
    for i in range(len(right) - 1, -1, -1):
        w = right[i]
        out[i + 1 :] -= 2 * np.outer(w, w @ out[i + 1 :])
    return np.array([p[0] for p in pairs[:most]]) * scale * scale, out
