"""Seating in Pitman-Yor restaurants: Gibbs draws of the number of tables of each dish.

A restaurant is seen by dish: c customers eat it at t tables. Given the other
dishes' tables, P(t) is proportional to (A)(A + d)...(A + (t - 1) d) * S(c, t) *
p0 ** t, with A = theta + d * (other tables), S the generalised Stirling number
of the seatings of c customers at t tables, and p0 the parent's probability of
the dish. Up to DIRECT customers are drawn at once from that; later ones of a
dish sit down one after the other, in steps of a twelfth of those seated, in
several seatings of which one is drawn by its weight.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Up to SHORT customers the shares are products of doubles; beyond, sums of logarithms.
DIRECT, PARTICLES, SHORT = 48, 8, 12


@lru_cache(64)
def stirling(d: float, most: int = DIRECT) -> np.ndarray:
    """log S(c, t) for c, t up to ``most``; -inf where there is no seating."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = out[c, t] + np.log(np.maximum(c - d * t, 0))
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def _log_rising(a: np.ndarray, d: float, most: int) -> np.ndarray:
    """log of a (a + d) ... of 1 to ``most`` factors, a row for each a."""
    return np.cumsum(np.log(a[:, None] + d * np.arange(most)[None, :]), axis=1)


def draw(c: np.ndarray, p0: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish: c customers, parent's probability p0, ``others`` tables of other dishes in its restaurant."""
    a = theta + d * others
    t = _direct(np.where(c > DIRECT, 0, c), p0, a, d, rng)[:, 0]
    rows = np.flatnonzero(c > DIRECT)
    if len(rows):
        t[rows] = _sequential(c[rows], p0[rows], a[rows], d, rng)
    return t


def _direct(c: np.ndarray, p0: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, times: int = 1) -> np.ndarray:
    """Exact draws for dishes of at most DIRECT customers, a row for each dish."""
    t = np.repeat(np.minimum(c, 1).astype(np.int64)[:, None], times, axis=1)
    table = stirling(d)
    order = np.argsort(c, kind="stable")
    at = np.searchsorted(c[order], np.arange(2, DIRECT + 2))
    for n in (np.flatnonzero(np.diff(at)) + 2).tolist():
        rows = order[at[n - 2] : at[n - 1]]
        for k in range(0, len(rows), 100_000 // times):
            r = rows[k : k + 100_000 // times]
            if n <= SHORT:
                share = np.cumprod((a[r][:, None] + d * np.arange(n)[None, :]) * p0[r][:, None], axis=1) * np.exp(table[n, 1 : n + 1])[None, :]
            else:
                logit = _log_rising(a[r], d, n) + np.log(p0[r])[:, None] * np.arange(1, n + 1)[None, :] + table[n, 1 : n + 1][None, :]
                share = np.exp(logit - logit.max(1, keepdims=True))
            below = np.cumsum(share, axis=1)
            t[r] = 1 + (below[:, None, :-1] <= (rng.random((len(r), times)) * below[:, -1:])[:, :, None]).sum(2)
    return t


def _sequential(c: np.ndarray, p0: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of more customers: after the first DIRECT the others come one after the other.

    Each of PARTICLES seatings is weighted by how likely the dish was at every
    step, and one is drawn by its weight.
    """
    order = np.argsort(-c)
    c, p0, a = c[order], p0[order], a[order]
    t = _direct(np.full(len(c), DIRECT), p0, a, d, rng, PARTICLES)
    weight, n, left = np.zeros(t.shape), DIRECT, len(c)
    while left:  # those with customers to come are the first ones
        step = np.minimum(max(n // 12, 1), c[:left] - n)[:, None]
        new, stay = (a[:left, None] + d * t[:left]) * p0[:left, None], np.maximum(n + (step - 1) / 2 - d * t[:left], 1e-9)
        both = new + stay
        weight[:left] += step * np.log(both)
        t[:left] += rng.binomial(step, new / both)
        n += max(n // 12, 1)
        left = int(np.searchsorted(-c, -n))
    out = np.empty(len(c), np.int64)
    pick = np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    out[order] = t[np.arange(len(pick)), pick]
    return out


def discount(counts: np.ndarray | None = None, once: float = 0, twice: float = 0) -> float:
    """n1 / (n1 + 2 n2), held between 0.05 and 0.95."""
    if counts is not None:
        once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
