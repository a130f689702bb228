"""Leading eigenpairs of a symmetric matrix by slicing its spectrum.

The signs of the pivots of an LDL' factorisation of ``a - s * I`` are those of its eigenvalues, so one
factorisation tells how many eigenvalues lie above ``s``.  Bisection by such counts gives every wanted eigenvalue
an interval of its own; Rayleigh quotient iteration started in it converges cubically, and is taken only if it
stays inside.  Each vector is kept at right angles to those before it, which takes nothing from a vector of another
eigenvalue and finds new ones of an equal one.  In the end counts just above and below each value certify its number.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + 17**0.5) / 8
EPS = float(np.finfo(float).eps)
_STEPS = 16


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` are greater than ``shift``: pivots by Bunch and Kaufman's rule."""
    a = a - shift * np.eye(len(a))
    count = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        largest, own = (column[r - 1] if r else 0.0), abs(a[0, 0])
        if max(largest, own) == 0:  # a zero pivot is neither above nor below
            a = a[1:, 1:]
            continue
        pair = False
        if own < _ALPHA * largest:
            others = np.abs(a[:, r])
            others[r] = 0
            in_row = others.max()
            if own * in_row < _ALPHA * largest**2:
                if abs(a[r, r]) >= _ALPHA * in_row:
                    a = _swapped(a, 0, r)
                else:
                    a, pair = _swapped(a, 1, r), True
        if pair:  # its determinant is negative: one eigenvalue on each side
            count += 1
            rows = a[2:, :2]
            a = a[2:, 2:] - rows @ np.linalg.solve(a[:2, :2], rows.T)
        else:
            count += bool(a[0, 0] > 0)
            row = a[1:, 0]
            a = a[1:, 1:] - np.outer(row / a[0, 0], row)
    return count


def _swapped(a: np.ndarray, i: int, j: int) -> np.ndarray:
    order = np.arange(len(a))
    order[[i, j]] = order[[j, i]]
    return a[np.ix_(order, order)]


def slices(a: np.ndarray, wanted: int, width: float) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, first, last), highest first: eigenvalues ``first`` to ``last``, counted from 1, lie in (low, high].

    Each holds one eigenvalue or is at most ``width`` wide.
    """
    radius = np.abs(a).sum(axis=1).max() * (1 + 1e-9)
    done, todo = [], [(-radius, radius, len(a), 0)]
    while todo:
        low, high, of_low, of_high = todo.pop()
        if of_low == of_high or of_high >= wanted:
            continue
        if of_low - of_high == 1 or high - low <= width:
            done.append((low, high, of_high + 1, of_low))
            continue
        middle = (low + high) / 2
        here = above(a, middle)
        todo += [(low, middle, of_low, here), (middle, high, here, of_high)]
    return done


def _solve(a: np.ndarray, shift: float, b: np.ndarray, size: float) -> np.ndarray:
    eye = np.eye(len(a))
    for nudge in (0.0, EPS, 16 * EPS, 1024 * EPS):
        try:
            x = np.linalg.solve(a - (shift + nudge * size) * eye, b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    raise ArithmeticError("no shift near the eigenvalue can be solved")


def rayleigh(
    a: np.ndarray, low: float, high: float, number: int, others: np.ndarray, size: float
) -> tuple[float, np.ndarray]:
    """Eigenpair ``number`` of ``a``, in (low, high], at right angles to ``others`` (as columns)."""

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):  # once is not enough where little is left
            x = x / np.linalg.norm(x)
            x = x - others @ (others.T @ x)
        return x / np.linalg.norm(x)

    start, slack = apart(np.random.default_rng(number).standard_normal(len(a))), 4 * EPS * size
    while True:
        x, value = start, (low + high) / 2
        for step in range(_STEPS):
            # Two steps at the middle turn the vector towards the one inside, then the shift follows it.
            x = apart(_solve(a, value, x, size))
            ax = a @ x
            quotient = float(x @ ax)
            if step >= 1:
                value = quotient
            if step >= 1 and np.linalg.norm(ax - quotient * x) <= slack:
                break
        if low - slack <= value <= high + slack or high - low <= slack:
            return value, x
        middle = (low + high) / 2
        low, high = (middle, high) if above(a, middle) >= number else (low, middle)


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns with the largest entry positive."""
    a = np.asarray(a, float)
    wanted = min(wanted, len(a))
    size = float(np.abs(a).sum(axis=1).max()) if len(a) else 0.0
    if size == 0:
        return np.zeros(wanted), np.eye(len(a))[:, :wanted]
    values, vectors = [], np.zeros((len(a), 0))
    for low, high, first, last in sorted(slices(a, wanted, 64 * len(a) * EPS * size), key=lambda s: s[2]):
        for number in range(first, min(last, wanted) + 1):
            value, x = rayleigh(a, low, high, number, vectors, size)
            values.append(value)
            vectors = np.column_stack((vectors, x))
    order = np.argsort(-np.array(values), kind="stable")
    values, vectors = np.array(values)[order], vectors[:, order]
    certified(a, values, size)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values, vectors * signs


def certified(a: np.ndarray, values: np.ndarray, size: float) -> None:
    """Raise unless counts put the ``k``-th largest eigenvalue at ``values[k - 1]``."""
    slack = 64 * len(a) * EPS * size
    for k, value in enumerate(values, 1):
        if not above(a, value + slack) < k <= above(a, value - slack):
            raise ArithmeticError(f"eigenvalue {k} is not at {value}")
