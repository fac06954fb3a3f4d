"""Leading eigenpairs of a symmetric matrix by contour integration; numpy only, for matrices as wide as a vector."""

from __future__ import annotations

import numpy as np


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix congruent to a by reflections, so of the same inertia at every shift."""
    a = a.copy()
    d = len(a)
    off = np.zeros(max(0, d - 1))
    for k in range(d - 1):
        x = a[k + 1 :, k].copy()
        off[k] = size = np.linalg.norm(x)
        if k == d - 2 or size == 0:
            off[k] = x[0] if k == d - 2 else size
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x)) - 4 * (x @ w) * np.outer(x, x)
    return a.diagonal().copy(), off


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia counts: how many eigenvalues exceed each shift, from the signs of the pivots."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = diagonal[0] - shifts
    count = (q > 0).astype(int)
    for k in range(1, len(diagonal)):
        q = diagonal[k] - shifts - off[k - 1] ** 2 / np.where(np.abs(q) < tiny, tiny, q)
        count += q > 0
    return count


def located(diagonal: np.ndarray, off: np.ndarray, steps: int = 60) -> np.ndarray:
    """Roughly where the eigenvalues lie, falling, by bisection over inertia counts; only the slices depend on it."""
    reach = np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    lo, hi = np.full(len(diagonal), -reach.max()), np.full(len(diagonal), reach.max())
    rank = np.arange(1, len(diagonal) + 1)
    for _ in range(steps):
        mid = (lo + hi) / 2
        at_least = above(diagonal, off, mid) >= rank
        lo, hi = np.where(at_least, mid, lo), np.where(at_least, hi, mid)
    return (lo + hi) / 2


def slices(where: np.ndarray, wanted: int, most: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the `wanted` largest eigenvalues, cut in the middle of the widest gaps.

    An interval holds at most `most` eigenvalues, within a factor of four, unless they lie too close to be parted.
    """
    d, found, start = len(where), [], 0
    least = 1e-9 * max(abs(where[0]), abs(where[-1]))
    gap = np.append(where[:-1] - where[1:], max(where[0] - where[-1], abs(where[-1]), least))
    high = where[0] + gap[-1]
    while start < min(wanted, d):
        end = start + 1
        while end < d and end - start < most and where[end] > where[start] / 4:
            end += 1
        end = start + 1 + int(np.argmax(gap[start:end]))
        while end < d and gap[end - 1] <= least:
            end += 1
        low = where[end - 1] - gap[end - 1] / 2
        found.append((low, high, end - start))
        start, high = end, low
    return found


def filtered(a: np.ndarray, y: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """y projected on the eigenvectors of [low, high]: Gauss quadrature of shifted solves along the half circle around it."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    middle, radius, out = (low + high) / 2, (high - low) / 2, np.zeros_like(y)
    for x, w in zip(at, weight):
        turn = radius * np.exp(1j * np.pi / 2 * (1 - x))
        out += w / 2 * (turn * np.linalg.solve((middle + turn) * np.eye(len(a)) - a, y.astype(complex))).real
    return out


def within(a: np.ndarray, low: float, high: float, count: int, nodes: int = 8, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs in [low, high]: filter, Rayleigh-Ritz, and again until the residuals are of rounding size.

    ValueError if they are not as many as the inertia counts say.
    """
    d = len(a)
    wide = min(d, count + max(8, count // 2))
    y = np.random.default_rng(11).standard_normal((d, wide))
    size, best = np.linalg.norm(a, 2), np.inf
    for _ in range(rounds):
        q, _ = np.linalg.qr(filtered(a, y, low, high, nodes))
        e, s = np.linalg.eigh(q.T @ a @ q)
        y = q @ s
        left = np.linalg.norm(a @ y - y * e, axis=0)
        inside = (e >= low) & (e <= high) & (left <= 1e-10 * size)  # what rounding leaves of other directions has no small residual
        worst = left[inside].max(initial=0.0) if inside.sum() == count else np.inf
        if worst <= 1e-14 * size or worst < np.inf and worst >= best / 2:
            return e[inside], y[:, inside]
        best = min(best, worst)
    raise ValueError(f"{inside.sum()} eigenvalues found between {low} and {high}, where inertia counts {count}")


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the `wanted` largest eigenvalues of a covariance, falling; fewer where its rank is less.

    Values within rounding of zero are no components. Equal values come in any order, the same for one matrix.
    A vector's entry of largest size is positive.
    """
    d = len(a)
    if not d or not a.any():
        return np.zeros(0), np.zeros((d, 0))
    diagonal, off = tridiagonal(a)
    where = located(diagonal, off)
    wanted = min(wanted, int((where > d * np.finfo(float).eps * where[0]).sum()))
    found = slices(where, wanted)
    ends = np.array([[low, high] for low, high, _ in found])
    counts = above(diagonal, off, ends[:, 0]) - above(diagonal, off, ends[:, 1])
    basis = np.concatenate([within(a, low, high, int(n))[1] for (low, high, _), n in zip(found, counts)], axis=1)
    if basis.shape[1] < wanted:
        raise ValueError("the slices hold fewer eigenvalues than asked for")
    q, _ = np.linalg.qr(basis)
    e, s = np.linalg.eigh(q.T @ a @ q)
    e, v = e[::-1][:wanted], (q @ s)[:, ::-1][:, :wanted]
    return e, v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
