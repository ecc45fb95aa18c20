"""Seatings of Pitman-Yor restaurants: how many tables serve each dish, drawn from their conditional distributions.

Of a dish with c customers in a restaurant with discount d and strength s, t tables have a probability in proportion to
S(c, t) * (s | d)_T * p ** t: S is the generalised Stirling number, T counts all tables of the restaurant, and p is the
dish's probability in the parent. Dishes of a restaurant hang together by T alone. A Gamma(s / d + T) variable g of each
restaurant takes them apart: given g, t has a probability in proportion to S(c, t) * (d * g * p) ** t, on its own. So all
dishes of all restaurants are drawn at once, each from its exact conditional.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Most customers of a dish whose tables are drawn from a table of all Stirling numbers; beyond, a proposal is tried against two of them (``draw_tables``).
EXACT = 64
#: Such trials where tables are drawn without those before.
STEPS = 8
#: Points of the integral that gives a Stirling number beyond (``log_stirling_at``).
NODES = 96
#: A quarter of them serves where half of that quarter gives the same within this share; errors fall much faster than points are added.
SAME = 1e-5
#: Values that discounts and strengths are sampled from.
DISCOUNTS = np.round(np.arange(0.1, 0.96, 0.05), 2)
STRENGTHS = np.array([0.05, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0])


@lru_cache(maxsize=64)
def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of S(c, t) for c and t up to EXACT; -inf where it is 0."""
    s = np.full((EXACT + 1, EXACT + 2), -np.inf)
    s[0, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(EXACT):
            t = np.arange(EXACT + 2)
            stay = np.log(np.maximum(c - discount * t, 0)) + s[c]
            s[c + 1] = np.logaddexp(stay, np.append(-np.inf, s[c, :-1]))
    return s[:, : EXACT + 1]


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    low, y = np.zeros_like(x), x
    for _ in range(7):
        small = y < 8
        low = low + np.where(small, np.log(np.where(small, y, 1)), 0)
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_stirling_at(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of S(c, t), 1 <= t <= c, of any size: an integral of its generating function.

    S(c, t) is c! / t! times the coefficient of z ** c in f ** t, with f = (1 - (1 - z) ** d) / d. With z = exp(v), that is an integral over Im v from -pi to pi. Its path
    goes through the saddle point, and bends around the branch point v = 0 but where the integrand is spread over the whole circle.
    """
    c, t = np.asarray(c, float), np.asarray(t, float)
    out = np.where(t == 1, lgamma(c - discount) - lgamma(np.full(1, 1 - discount)), 0.0)
    some = np.flatnonzero((t > 1) & (t < c))  # S(c, c) is 1
    for part in np.split(some, range(4096, len(some), 4096)):
        if len(part):
            out[part] = _log_stirling(c[part], t[part], discount)
    return out


def _log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    lo, hi = np.full(len(c), -700.0), np.zeros(len(c))
    for _ in range(60):  # of log w, w = 1 - z, in t * z * f'(z) / f(z) = c
        mid = (lo + hi) / 2
        above = np.log(t * d) + np.log(-np.expm1(mid)) + (d - 1) * mid - np.log(-np.expm1(d * mid)) > np.log(c)
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    w = np.exp(lo)
    width, start = 1 / np.sqrt(np.maximum(c * (1 + (1 - w) * (1 - d) / w - c / t), 1e-12)), np.log1p(-w)
    start = np.minimum(start, -1 / c)  # nearer to the branch point, points of the integral couldn't be told apart
    far = 9 * np.maximum(width, np.sqrt(-2 * start / c))
    circle = (far > 1) & (start < -16 / NODES)
    bend, far = np.where(circle, 0, -1 / (4 * start)), np.where(circle, np.pi, np.minimum(far, np.pi))
    value, total = np.empty(len(c)), np.empty(len(c))
    todo = np.arange(len(c))
    for nodes in (NODES // 4, NODES):
        value[todo], total[todo], half = _integral(c[todo], t[todo], d, start[todo], bend[todo], far[todo], nodes)
        todo = todo[~(np.abs(half - total[todo]) <= SAME * total[todo])]
        if not len(todo):
            break
    return lgamma(c + 1) - lgamma(t + 1) + value + np.log(total)


def _integral(c: np.ndarray, t: np.ndarray, d: float, start: np.ndarray, bend: np.ndarray, far: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithm of the integrand at the saddle point, the integral over that by so many points, and by half of them."""
    s = far[:, None] * np.linspace(0, 1, nodes + 1)
    v = (start[:, None] + bend[:, None] * s**2) + 1j * s
    log_w = np.log(-np.expm1(v))
    phase = t[:, None] * (np.log(-np.expm1(d * log_w)) - np.log(d)) - c[:, None] * v
    value = (np.exp(phase - phase[:, :1].real) * (1 - 2j * bend[:, None] * s)).real
    value[:, [0, -1]] /= 2
    return phase[:, 0].real, value.sum(1) * far / nodes / np.pi, value[:, ::2].sum(1) * 2 * far / nodes / np.pi


def _limit(c: np.ndarray, x: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes with many customers, but for one: the mean of their number in the limit, which is Poisson.

    The generating function of S(c, t) * x ** t over c is exp(x * (1 - (1 - z) ** d) / d); at its saddle point for c the
    number of tables is Poisson.
    """
    lo, hi = np.full(len(c), 1e-300), np.full(len(c), 1.0)
    for _ in range(60):  # of y = 1 - z in x * (1 - y) * y ** (d - 1) = c, which falls with y
        y = np.sqrt(lo * hi)
        with np.errstate(divide="ignore"):
            above = np.log(x) + np.log1p(-y) + (discount - 1) * np.log(y) > np.log(c)
        lo, hi = np.where(above, y, lo), np.where(above, hi, y)
    return np.maximum(x * (1 - hi**discount) / discount, 1e-300)


def draw_many(rng: np.random.Generator, c: np.ndarray, x: np.ndarray, discount: float) -> np.ndarray:
    """A draw of the limit: one table and a Poisson number more."""
    return np.minimum(c, 1 + rng.poisson(_limit(c, x, discount)))


def draw_tables(rng: np.random.Generator, c: np.ndarray, x: np.ndarray, discount: float, before: np.ndarray | None = None) -> np.ndarray:
    """t with probability in proportion to S(c, t) * x ** t, for each dish; 0 without customers.

    Tables of a dish of more than EXACT customers go on from those it had (at first those that the Poisson limit gives) by Metropolis-Hastings steps, which propose a draw of
    that limit and leave the same distribution as it is.
    """
    t = np.minimum(c, 1)
    several = np.flatnonzero(c > 1)
    if not len(several):
        return t
    order = several[np.argsort(c[several], kind="stable")]
    sizes, first = np.unique(c[order], return_index=True)
    table = log_stirling(discount)
    for size, at in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        if size > EXACT:
            break
        k = np.arange(1, size + 1)
        weight = table[size, 1 : size + 1] + np.log(x[at])[:, None] * k
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
        t[at] = 1 + (weight[:, :-1] < (rng.random(len(at)) * weight[:, -1])[:, None]).sum(1)
    many = order[c[order] > EXACT]
    if len(many):
        t[many] = _step_many(rng, c[many], x[many], discount, None if before is None else before[many])
    return t


def _step_many(rng: np.random.Generator, c: np.ndarray, x: np.ndarray, discount: float, before: np.ndarray | None) -> np.ndarray:
    """Tables of dishes with many customers after one step from those before, or after STEPS steps from a draw of the limit."""
    mean = _limit(c, x, discount)
    # what the distribution has over the limit's; that cuts at c, whose tail is so rare that it isn't counted
    over = lambda t: log_stirling_at(c, t, discount) + t * np.log(x) - (t - 1) * np.log(mean) + lgamma(t)
    propose = lambda: np.minimum(c, 1 + rng.poisson(mean))
    t = propose() if before is None else np.minimum(before, c)
    weight = over(t)
    for _ in range(STEPS if before is None else 1):
        new = propose()
        new_weight = over(new)
        take = np.log(rng.random(len(c))) < new_weight - weight
        t, weight = np.where(take, new, t), np.where(take, new_weight, weight)
    return t


def resample(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, restaurant: np.ndarray, size: int, p: np.ndarray, discount: float, strength: float, live: np.ndarray) -> np.ndarray:
    """One Gibbs sweep: the tables of the live dishes anew, given p, their probabilities in the parent; size: of restaurants."""
    where, tables = restaurant[live], np.bincount(restaurant, t, size)
    drawn = np.zeros(size, bool)
    drawn[where] = True
    g = np.empty(size)
    g[drawn] = rng.standard_gamma(strength / discount + tables[drawn])
    return draw_tables(rng, c[live], np.maximum(discount * g[where] * p, 1e-300), discount, t[live])


def predictive(c: np.ndarray, t: np.ndarray, restaurant: np.ndarray, size: int, p: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Probability of each dish in its restaurant, given the seating."""
    all_c, all_t = np.bincount(restaurant, c, size)[restaurant], np.bincount(restaurant, t, size)[restaurant]
    return (c - discount * t + (strength + discount * all_t) * p) / (strength + all_c)


def distribution(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, restaurant: np.ndarray, size: int, p: np.ndarray, discount: float, strength: float, asked: np.ndarray) -> np.ndarray:
    """A draw of restaurants' distributions from their posterior given the seating, at the dishes asked for (ascending).

    Weights are Gamma variables; all other dishes of a restaurant and its new tables, which serve by p, have one each.
    """
    shape, where = c - discount * t, restaurant[asked]
    rest = np.maximum(np.bincount(restaurant, shape, size) - np.bincount(where, shape[asked], size), 0)
    drawn = np.zeros(size, bool)
    drawn[where] = True
    own, others, new = rng.standard_gamma(np.maximum(shape[asked], 0)), np.zeros(size), np.zeros(size)
    others[drawn] = rng.standard_gamma(rest[drawn])
    new[drawn] = rng.standard_gamma(strength + discount * np.bincount(restaurant, t, size)[drawn])
    return (own + new[where] * p[asked]) / (new + others + np.bincount(where, own, size))[where]


def likelihoods(c: np.ndarray, t: np.ndarray, restaurant: np.ndarray, size: int) -> np.ndarray:
    """Log-likelihood of the seating for each of DISCOUNTS and STRENGTHS, of all restaurants."""
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    use = c > 0
    if not use.any():
        return out
    n, k = np.bincount(restaurant[use], c[use], size).astype(np.int64), np.bincount(restaurant[use], t[use], size).astype(np.int64)
    kinds, often = np.unique((n[n > 0] << 32) | k[n > 0], return_counts=True)
    n, k = (kinds >> 32).astype(float), (kinds & 0xFFFFFFFF).astype(float)
    few, many = use & (c <= EXACT), c > EXACT
    pairs = np.bincount(c[few] * (EXACT + 1) + t[few], minlength=(EXACT + 1) ** 2).reshape(EXACT + 1, EXACT + 1)
    seen = pairs > 0
    large, times = np.unique((c[many].astype(np.int64) << 32) | t[many].astype(np.int64), return_counts=True)
    per_strength = [(often * (lgamma(s + n) - lgamma(s))).sum() for s in STRENGTHS]
    for i, d in enumerate(DISCOUNTS.tolist()):
        dishes = (pairs[seen] * log_stirling(d)[seen]).sum() + (times * log_stirling_at(large >> 32, large & 0xFFFFFFFF, d)).sum()
        for j, s in enumerate(STRENGTHS.tolist()):
            out[i, j] = dishes + (often * (k * np.log(d) + lgamma(s / d + k) - lgamma(s / d))).sum() - per_strength[j]
    return out


def sample_parameters(rng: np.random.Generator, likelihood: np.ndarray) -> tuple[float, float]:
    """(discount, strength) from their posterior on the grid, all pairs being equally likely before."""
    flat = likelihood.reshape(-1)
    p = np.exp(flat - flat.max())
    at = int(rng.choice(len(p), p=p / p.sum()))
    return float(DISCOUNTS[at // len(STRENGTHS)]), float(STRENGTHS[at % len(STRENGTHS)])
