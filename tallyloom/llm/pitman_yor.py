"""Seating in Pitman-Yor restaurants: many (restaurant, dish) pairs at once, in arrays.

A dish with c customers in a restaurant with discount d has a *seating*: which of its customers, in order of
arrival, opened a table. Given all else, a seating has the weight a^tables * prod(j - d * k) over the customers who
joined a table, who found j customers at k tables. With the restaurant's strength s and T tables in all, a new table
weighs (s + d * T) * P(dish under the parent). T ties the dishes of a restaurant together; with an auxiliary
x ~ Gamma(s / d + T) the weight is a = d * x * P instead, and given x the dishes are independent: a sweep can seat
them all at once and is still exact.

A sweep removes the customers of each dish and seats them again given the rest: openings are proposed one by one from
near their conditional odds, and the Metropolis ratio accepts or keeps the old seating, so that the exact conditional stays.

All randomness is a hash of ids, sweep and draw, so results depend on no partition, order or retry.
"""

from __future__ import annotations

import numpy as np

from tallyloom.llm.common import mixed_bits

_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_WORD = (1 << 64) - 1
NEAR = 8  # arrivals whose odds are taken one by one; later ones come from a Poisson process
NEAR_DRAW, FAR_DRAW = 1, 16  # draw 0 accepts


def keys(a: np.ndarray, b: np.ndarray, sweep: int) -> np.ndarray:
    """A hash of two arrays of ids and the sweep."""
    h = mixed_bits(np.asarray(b, np.uint64) * np.uint64(_B) + np.uint64((sweep + 1) * _C & _WORD))
    return mixed_bits((np.asarray(a, np.uint64) + np.uint64(1)) * np.uint64(_A) + h)


def uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """In (0, 1)."""
    h = mixed_bits(mixed_bits(key + np.uint64((draw + 1) * _A & _WORD)) * np.uint64(_C))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, for x > 0."""
    x = np.asarray(x, np.float64)
    below = np.ones_like(x)
    for k in range(8):
        below = below * (x + k)
    z = x + 8
    y = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - (1 / 360 - (1 / 1260 - y / 1680) * y) * y) / z - np.log(below)


def gamma(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma(shape, 1) draws for shapes of 1 or more (Marsaglia and Tsang)."""
    m = np.asarray(shape, np.float64) - 1 / 3
    out, todo, draw = np.empty_like(m), np.arange(len(m)), 0
    while len(todo):
        k, mk = key[todo], m[todo]
        z = np.sqrt(-2 * np.log(uniform(k, draw))) * np.cos(2 * np.pi * uniform(k, draw + 1))
        v = (1 + z / np.sqrt(9 * mk)) ** 3
        ok = (v > 0) & (np.log(uniform(k, draw + 2)) < z * z / 2 + mk * (1 - v + np.log(np.where(v > 0, v, 1))))
        out[todo[ok]] = (mk * v)[ok]
        todo, draw = todo[~ok], draw + 3
    return out


def near_odds(c: np.ndarray, a: np.ndarray, d: float, j: np.ndarray) -> np.ndarray:
    """Conditional odds that the arrival after j customers opens a second table that stays the last one."""
    return a * np.exp(log_gamma(c - 2 * d) - log_gamma(c - d) + log_gamma(j - d) - log_gamma(j + 1 - 2 * d))


def far_rate(c: np.ndarray, a: np.ndarray, d: float, j: np.ndarray) -> np.ndarray:
    """The same for later arrivals, as the mass of [j, j + 1) under a power law."""
    return a / d * (((j + 1) / c) ** d - (j / c) ** d)


def proposed(c: np.ndarray, a: np.ndarray, d: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Openings (dish, customers before) besides each dish's first, sorted."""
    dish, before = [], []
    for j in range(1, NEAR):
        at = np.flatnonzero(c > j)
        if not len(at):
            break
        r = near_odds(c[at], a[at], d, np.float64(j))
        at = at[uniform(key[at], NEAR_DRAW + j) * (1 + r) < r]
        dish.append(at)
        before.append(np.full(len(at), j))
    live = np.flatnonzero(c > NEAR)
    time = np.zeros(len(live))
    draw = FAR_DRAW
    while len(live):
        low = (NEAR / c[live]) ** d
        time = time - np.log(uniform(key[live], draw))
        on = time < a[live] / d * (1 - low)
        live, time, low, draw = live[on], time[on], low[on], draw + 1
        dish.append(live)
        before.append(np.clip(np.floor(c[live] * (low + time * d / a[live]) ** (1 / d)), NEAR, c[live] - 1).astype(np.int64))
    if not dish:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    dish, before = np.concatenate(dish), np.concatenate(before)
    order = np.lexsort((before, dish))
    dish, before = dish[order], before[order]
    once = np.append(True, (dish[1:] != dish[:-1]) | (before[1:] != before[:-1]))[: len(dish)]
    return dish[once], before[once]


def log_ratios(c: np.ndarray, a: np.ndarray, d: float, dish: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per dish the log of a seating's weight over its chance to be proposed, up to what all its seatings share."""
    n = len(c)
    extra = np.bincount(dish, minlength=n)
    first = np.cumsum(extra) - extra
    nth = np.arange(len(dish)) - first[dish] + 1  # tables before the opening
    out = np.zeros(n)
    # customers between openings find k tables: from the opening's next customer to the next opening
    begins = np.concatenate((np.zeros(n, np.int64), before))
    owner = np.concatenate((np.arange(n), dish))
    tables = np.concatenate((np.ones(n, np.int64), nth + 1))
    order = np.lexsort((tables, owner))
    begins, owner, tables = begins[order], owner[order], tables[order]
    ends = np.append(begins[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = c[owner[last]] - 1
    lo = begins + 1 - d * tables
    some = ends > begins
    part = np.zeros(len(owner))
    part[some] = log_gamma((lo + ends - begins)[some]) - log_gamma(lo[some])
    out += np.bincount(owner, part, n)
    if len(dish):
        odds = np.empty(len(dish))
        near = before < NEAR
        cd, ad = c[dish], a[dish]
        odds[near] = np.log(near_odds(cd[near], ad[near], d, before[near].astype(np.float64)))
        odds[~near] = np.log(np.expm1(far_rate(cd[~near], ad[~near], d, before[~near])))
        out += np.bincount(dish, np.log(ad) - np.log(before - d * nth) - odds, n)
    return out


def sweep(c: np.ndarray, a: np.ndarray, d: float, dish: np.ndarray, before: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The openings after all dishes (c >= 2 customers each) have been seated again."""
    c = np.asarray(c, np.int64)
    if not len(c):
        return dish, before
    new_dish, new_before = proposed(c, a, d, key)
    ratio = log_ratios(c, a, d, new_dish, new_before) - log_ratios(c, a, d, dish, before)
    taken = np.log(uniform(key, 0)) < ratio
    x, y = np.concatenate((new_dish[taken[new_dish]], dish[~taken[dish]])), np.concatenate((new_before[taken[new_dish]], before[~taken[dish]]))
    order = np.lexsort((y, x))
    return x[order], y[order]


def discount(once: float, twice: float) -> float:
    """From the counts of counts."""
    return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once else 0.5
