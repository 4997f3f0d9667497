"""Small numerics that Spark lacks: assignment inside a group, and tail probabilities of aggregates."""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost one-to-one assignment; ties go to low rows and columns.

    Shortest augmenting paths with potentials; the smaller side is matched in full.
    """
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in assignment(cost.T))
    nearest = cost.argmin(1)
    if len(set(nearest.tolist())) == n:  # every row can have its cheapest column
        return list(enumerate(nearest.tolist()))
    up, down = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            slack = cost[owner[column] - 1] - up[owner[column]] - down[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], column
            free = np.where(done[1:], np.inf, least[1:])
            step, nearest = free.min(), int(free.argmin()) + 1
            up[owner[done]] += step
            down[done] -= step
            least[~done] -= step
            column = nearest
        while column:
            owner[column] = owner[came[column]]
            column = came[column]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def sparse_assignment(rows: np.ndarray, columns: np.ndarray, costs: np.ndarray, skip: float) -> list[int]:
    """Places of the pairs of a least-cost one-to-one matching, where a row without a pair costs ``skip``.

    Only the given pairs are held.  Each row starts a search by reduced cost from its pairs (Dijkstra's, with potentials)
    that ends at a free column, or at a row of the tree that had better stay alone.
    """
    names, r = np.unique(rows, return_inverse=True)
    _, c = np.unique(columns, return_inverse=True)
    order = np.lexsort((c, r))
    starts = np.searchsorted(r[order], np.arange(len(names) + 1)).tolist()
    places, c, costs = order.tolist(), c[order].tolist(), costs[order].tolist()
    owner: dict[int, int] = {}  # column: row
    by: dict[int, int] = {}  # row: its place among the ordered pairs
    down: dict[int, float] = {}  # potential of a column, never above 0
    up = [0.0] * len(names)
    for root in range(len(names)):
        least: dict[int, float] = {}
        came: dict[int, int] = {}
        done: dict[int, float] = {}
        reached, heap, row, base = {root: 0.0}, [], root, 0.0
        best_end, best_row = skip - up[root], root
        while True:
            for k in range(starts[row], starts[row + 1]):
                column = c[k]
                if column not in done:
                    far = base + costs[k] - up[row] - down.get(column, 0.0)
                    if far < least.get(column, math.inf):
                        least[column], came[column] = far, k
                        heapq.heappush(heap, (far, column))
            while heap and (heap[0][1] in done or heap[0][0] > least[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best_end:
                end, column = best_end, None
                break
            base, column = heapq.heappop(heap)
            if column not in owner:
                end = base
                break
            done[column] = base
            row = owner[column]
            reached[row] = base
            if base + skip - up[row] < best_end:
                best_end, best_row = base + skip - up[row], row
        for x, far in reached.items():
            up[x] += end - far
        for x, far in done.items():
            down[x] = down.get(x, 0.0) - (end - far)
        if column is None:  # the row that stays alone gives its column away
            row = best_row
            column = c[by.pop(row)] if row in by and row != root else None
        while column is not None:
            k = came[column]
            row = bisect.bisect_right(starts, k) - 1
            given = c[by[row]] if row in by else None
            owner[column], by[row] = row, k
            column = given if row != root else None
    return sorted(places[k] for k in by.values())


def closest_first(cost: np.ndarray) -> list[tuple[int, int]]:
    """Greedy pairs: the cheapest first, each row and column once, ties by row and column."""
    rows, columns, out = set(), set(), []
    for k in np.argsort(cost, axis=None, kind="stable"):
        i, j = divmod(int(k), cost.shape[1])
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((i, j))
    return sorted(out)


def closest_pairs(rows: np.ndarray, columns: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Places of the greedy pairs among those given: the cheapest first, each row and column once, ties to low places.

    A pair that comes first both in its row and in its column is chosen whatever the others are, so pairs are chosen many at a
    time; once that rules out less than a tenth of what is left, as among equal costs, the rest is walked in order.
    """
    left = np.argsort(costs, kind="stable")
    used_row, used_column = (np.zeros(int(v.max(initial=-1)) + 1, bool) for v in (rows, columns))
    out = [np.empty(0, left.dtype)]
    while len(left):
        r, c, at = rows[left], columns[left], np.arange(len(left))
        first_row, first_column = np.full(len(used_row), len(left)), np.full(len(used_column), len(left))
        np.minimum.at(first_row, r, at)
        np.minimum.at(first_column, c, at)
        won = (first_row[r] == at) & (first_column[c] == at)
        out.append(left[won])
        used_row[r[won]], used_column[c[won]] = True, True
        before, left = len(left), left[~(used_row[r] | used_column[c])]
        if len(left) > 0.9 * before:
            break
    walked = []
    for a in range(0, len(left), 50_000):
        part = left[a : a + 50_000]
        part = part[~(used_row[rows[part]] | used_column[columns[part]])]
        for k, r, c in zip(part.tolist(), rows[part].tolist(), columns[part].tolist()):
            if not used_row[r] and not used_column[c]:
                used_row[r], used_column[c] = True, True
                walked.append(k)
    return np.concatenate([*out, np.array(walked, left.dtype)])


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for k in range(500):
        i = k // 2
        if k == 0:
            term = 1.0
        elif k % 2:
            term = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))
        else:
            term = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_cdf(middle, a, b) < p else (low, middle)
    return (low + high) / 2


def jeffreys(k: float, n: float, level: float = 0.95) -> tuple[float, float]:
    """Interval of a proportion under Jeffreys' prior; NaN without observations."""
    if n <= 0:
        return math.nan, math.nan
    tail = (1 - level) / 2
    return beta_quantile(tail, k + 0.5, n - k + 0.5), beta_quantile(1 - tail, k + 0.5, n - k + 0.5)


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_p_value(f: float, df1: float, df2: float) -> float:
    """Upper tail."""
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def binomial_p_value(k: int, n: int, p: float = 0.5) -> float:
    """Exact two-sided: all outcomes no likelier than k."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    here = log(k) + 1e-7
    return min(1.0, math.fsum(math.exp(x) for i in range(n + 1) if (x := log(i)) <= here))


def mcnemar_power(n: int, share: float, alpha: float = 0.05) -> float:
    """Chance that an exact test on n discordant pairs is significant if one side wins with ``share``."""
    return math.fsum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1) if binomial_p_value(k, n) <= alpha)


def signed_rank_p_value(w: float, n: int, tie_term: float = 0.0) -> float:
    """Two-sided Wilcoxon signed-rank p of rank sum w: exact up to 50 differences without ties, else normal."""
    if n <= 50 and not tie_term and float(w).is_integer():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        low = int(min(w, n * (n + 1) / 2 - w))
        return float(min(1.0, 2 * ways[: low + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def power_table(differences: list[float], sizes: list[int], spread: float, draws: int = 20_000, alpha: float = 0.05, seed: int = 0) -> list[dict]:
    """Simulated power of an equal-variance t-test by true difference and arm size."""
    rng, out = np.random.default_rng(seed), []
    for d in differences:
        for n in sizes:
            a, b = rng.normal(0, spread, (draws, n)), rng.normal(d, spread, (draws, n))
            t = (b.mean(1) - a.mean(1)) / np.sqrt((a.var(1, ddof=1) + b.var(1, ddof=1)) / n)
            low, high = 0.0, 1000.0  # the critical value by bisection
            for _ in range(60):
                low, high = ((low + high) / 2, high) if t_p_value((low + high) / 2, 2 * n - 2) > alpha else (low, (low + high) / 2)
            out.append({"difference": d, "n": n, "power": float((np.abs(t) > high).mean())})
    return out


def posterior_recall(caught: float, census_wrong: float, drawn: int, drawn_wrong: int, pool: float, draws: int = 20_000, seed: int = 0) -> tuple[float, float]:
    """95 % interval of recall by simulation: censused strata are exact, the sampled one's rate is drawn from its posterior.

    ``stats.grader_table`` has the interval that this comes to with ever more draws.
    """
    rate = np.random.default_rng(seed).beta(drawn_wrong + 0.5, drawn - drawn_wrong + 0.5, draws)
    return tuple(float(x) for x in np.quantile(caught / np.maximum(census_wrong + rate * round(pool), 1e-9), (0.025, 0.975)))


def rule_of_three(n: int) -> float:
    """Upper 95 % bound of a proportion when none of n was seen."""
    return 3.0 / n if n else math.nan
