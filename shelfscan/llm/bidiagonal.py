"""Singular values and right singular vectors of a small upper triangle, by bidiagonal qd.

Householder reflections from both sides leave an upper bidiagonal matrix;
dqds, differential quotients and differences with shifts, finds the squares of
its singular values to high relative accuracy; twisted factorisations of the
shifted tridiagonal give each vector from the place where it is largest.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, alpha): the reflection along unit v takes x to alpha times the first unit vector."""
    size = float(np.linalg.norm(x))
    if size == 0:
        return np.zeros_like(x), 0.0
    alpha = -size if x[0] > 0 else size
    v = x.copy()
    v[0] -= alpha
    length = np.linalg.norm(v)
    return (v / length if length else v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = u B vᵀ, where B has the diagonal a and b above it."""
    m = np.array(r, np.float64)
    n = len(m)
    v = np.eye(n)
    a, b = np.zeros(n), np.zeros(max(n - 1, 0))
    for i in range(n):
        h, a[i] = _reflector(m[i:, i])
        m[i:, i:] -= 2 * np.outer(h, h @ m[i:, i:])
        if i < n - 1:
            h, b[i] = _reflector(m[i, i + 1 :])
            m[i:, i + 1 :] -= 2 * np.outer(m[i:, i + 1 :] @ h, h)
            v[:, i + 1 :] -= 2 * np.outer(v[:, i + 1 :] @ h, h)
    return a, b, v


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int, float]:
    """One differential qd step; the place and value of the first negative d, or (-1, last d)."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return new_q, new_e, i, d
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            new_e[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / new_q[i]
            new_e[i] = e[i] * t
            d = d * t - shift
    new_q[-1] = d
    return new_q, new_e, (n - 1 if d < 0 else -1), d


def _smaller_root(q0: float, e0: float, q1: float) -> float:
    """Smaller eigenvalue of the 2 x 2 matrix with these qd values, without cancellation."""
    s = q0 + e0 + q1
    if s == 0:
        return 0.0
    half = ((q0 - q1 + e0) / 2) ** 2 + q1 * e0
    larger = s / 2 + half**0.5
    return q0 * q1 / larger if larger else 0.0


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of BᵀB, where q and e are the squares of B's diagonals.

    A shift is tried from the trailing 2 x 2; where it is too large, what the
    failed step says about the least eigenvalue gives the next.
    """
    blocks, out = [(list(q), list(e), 0.0)], []
    while blocks:
        q, e, total = blocks.pop()
        for _ in range(100 * (len(q) + 1)):
            n = len(q)
            if n == 1:
                out.append(total + q[0])
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= (EPS * EPS) * (total + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks += [(q[: cut + 1], e[:cut], total), (q[cut + 1 :], e[cut + 1 :], total)]
                break
            shift = 0.0 if min(q) == 0 else _smaller_root(q[-2], e[-1], q[-1])
            for attempt in range(40):
                new_q, new_e, failed, d = _transform(q, e, shift)
                if failed < 0:
                    break
                closer = (shift + d) * (1 - 4 * EPS)
                shift = closer if failed == n - 1 and attempt < 4 and closer > 0 else (shift / 4 if attempt < 12 else 0.0)
            q, e, total = new_q, new_e, total + shift
        else:
            raise ArithmeticError("dqds did not converge")
    return sorted(out, reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of BᵀB for ``value``: both factorisations meet where the residual is least."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    tiny = np.finfo(np.float64).tiny / EPS
    d, l = a * a, b / a[:-1]
    up, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        plus = s[i] + d[i]
        plus = plus if abs(plus) > tiny else -tiny
        up[i] = d[i] * l[i] / plus
        s[i + 1] = up[i] * l[i] * s[i] - value
    down, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        minus = d[i] * l[i] * l[i] + p[i + 1]
        minus = minus if abs(minus) > tiny else -tiny
        t = d[i] / minus
        down[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    at = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _cluster(a: np.ndarray, b: np.ndarray, values: list[float]) -> np.ndarray:
    """Orthonormal rows that span the space of nearly equal ``values``: inverse iteration on all of them at once."""
    n = len(a)
    m = np.diag(a) + np.diag(b, 1)
    shifted = m.T @ m - values[0] * (1 + 16 * EPS) * np.eye(n)
    x = np.random.default_rng(n).standard_normal((n, len(values)))
    for _ in range(6):
        x = np.linalg.qr(np.linalg.solve(shifted, x))[0]
    return x.T


def right_singular(r: np.ndarray, gap: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(squares, vectors): squared singular values of the square matrix r, falling, and the right singular vectors as columns.

    Values closer than ``gap``, relatively, are one cluster, whose vectors are
    found together. Values lost in rounding beside the largest are zero
    and have no vector, so there may be fewer columns than values.
    """
    n = len(r)
    scale = float(np.abs(r).max()) if r.size else 0.0
    if scale == 0:
        return np.zeros(n), np.zeros((n, 0))
    a, b, v = bidiagonalise(r / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    floor = EPS * size
    a = np.where(np.abs(a) < floor, floor, a)
    b = np.where(np.abs(b) < EPS * np.sqrt(np.abs(a[:-1] * a[1:])), 0.0, b)
    found: list[tuple[float, np.ndarray]] = []
    starts = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    for first, last in zip(starts, starts[1:]):
        own_a, own_b = a[first:last], b[first : last - 1]
        values = dqds((own_a**2).tolist(), (own_b**2).tolist())
        breaks = [k for k in range(1, len(values)) if values[k - 1] - values[k] > gap * values[k - 1]]
        for i, j in zip([0, *breaks], [*breaks, len(values)]):
            own = [_twisted(own_a, own_b, values[i])] if j - i == 1 else _cluster(own_a, own_b, values[i:j])
            for value, z in zip(values[i:j], own):
                whole = np.zeros(n)
                whole[first:last] = z
                found.append((value, whole))
    found.sort(key=lambda x: -x[0])
    values = np.array([x for x, _ in found])
    rank = int((values > (10 * n * EPS) ** 2 * values[0]).sum())
    vectors = v @ np.array([z for _, z in found[:rank]]).T
    values[rank:] = 0.0
    return values * scale * scale, vectors
