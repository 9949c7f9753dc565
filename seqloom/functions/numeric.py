"""Small dense algorithms in NumPy for one bounded group: reductions, clusterings, kernels.

They run inside grouped functions, one region's beads at a time; nothing here is global.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np


def clean(x: np.ndarray, fill: float = 0.0) -> np.ndarray:
    return np.where(np.isfinite(x), x, fill)


def column_filled(x: np.ndarray) -> np.ndarray:
    ok = np.isfinite(x)
    n = ok.sum(axis=0)
    mean = np.where(n > 0, np.where(ok, x, 0).sum(axis=0) / np.maximum(n, 1), 0.0)
    return np.where(ok, x, mean[None, :])


def standardised(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1.0)


def distances(x: np.ndarray) -> np.ndarray:
    g = x @ x.T
    d = np.diag(g)
    return np.sqrt(np.maximum(d[:, None] + d[None, :] - 2 * g, 0.0))


def distance_rows(x: np.ndarray, entries: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of some rows to all points) in blocks of bounded size, so that no matrix of all pairs is held."""
    sq, step = (x * x).sum(axis=1), max(1, entries // max(len(x), 1))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        yield at, np.sqrt(np.maximum(sq[part, None] + sq[None, :] - 2 * (x[part] @ x.T), 0.0))


def neighbours(d: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other points of each."""
    far = d + np.diag(np.full(len(d), np.inf))
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that differ, the place of each row among them, and how often each occurs; rows without copies stay in their order."""
    rows, place, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    return (rows, place.ravel(), n) if len(rows) < len(x) else (x, np.arange(len(x)), n)


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other points of each, in blocks of rows; of equal distances the least index comes first. Copies are met once."""
    points, place, n = different(x)
    by_point = np.argsort(place, kind="stable")
    start = np.cumsum(n) - n
    few = np.minimum(n, k + 1)  # of a point's copies no more can be near
    out = np.empty((len(x), k), int)
    for at, d in distance_rows(points):
        rows = np.arange(len(d))
        d[rows, at + rows] = np.inf
        if len(points) == len(x):
            i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
            gap = d[i, j]
        else:
            q = min(k, len(points) - 1)
            i, j = np.nonzero(d <= np.partition(d, q - 1, axis=1)[:, q - 1, None]) if q else (rows[:0], rows[:0])
            # the point itself, then the members of all
            i, j, gap = np.concatenate([rows, i]), np.concatenate([at + rows, j]), np.concatenate([np.zeros(len(d)), d[i, j]])
            i, gap, m = np.repeat(i, few[j]), np.repeat(gap, few[j]), few[j]
            j = by_point[np.repeat(start[j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        order = np.lexsort((j, gap, i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, rows)
        if len(points) == len(x):
            out[at : at + len(d)] = j[first[:, None] + np.arange(k)]
            continue
        for r in rows:
            own, members = j[first[r] : first[r] + k + 1], by_point[start[at + r] : start[at + r] + n[at + r]]
            out[members] = own[:k]  # right for all that are not among them
            for member in members[np.isin(members, own[:k])]:
                out[member] = own[own != member]
    return out


# reductions


def pca(x: np.ndarray, k: int) -> np.ndarray:
    k = max(1, min(k, *x.shape))
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return (u * s * np.where(sign == 0, 1, sign))[:, :k]


def classical_mds(d: np.ndarray, k: int) -> np.ndarray:
    n = len(d)
    j = np.eye(n) - 1.0 / n
    w, v = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = np.argsort(w)[::-1][:k]
    return v[:, order] * np.sqrt(np.maximum(w[order], 0.0))


def metric_mds(d: np.ndarray, k: int, seed: int = 0, steps: int = 200) -> np.ndarray:
    """Stress majorisation from the classical solution."""
    n = len(d)
    y = classical_mds(d, k) + np.random.default_rng(seed).normal(0, 1e-6, (n, k))
    for _ in range(steps):
        e = distances(y)
        ratio = np.where(e > 1e-12, d / np.maximum(e, 1e-12), 0.0)
        b = -ratio
        b[np.arange(n), np.arange(n)] = ratio.sum(axis=1)
        new = b @ y / n
        if np.abs(new - y).max() < 1e-7:
            break
        y = new
    return y


def isomap(x: np.ndarray, k: int, n_neighbors: int = 5) -> np.ndarray:
    d = distances(x)
    n = len(x)
    m = min(n_neighbors, n - 1)
    g = np.full((n, n), np.inf)
    near = neighbours(d, m)
    rows = np.repeat(np.arange(n), m)
    g[rows, near.ravel()] = d[rows, near.ravel()]
    g = np.minimum(g, g.T)
    np.fill_diagonal(g, 0.0)
    for i in range(n):  # all shortest paths, one pivot at a time
        g = np.minimum(g, g[:, i : i + 1] + g[i : i + 1, :])
    if not np.isfinite(g).all():  # join separate parts by their closest points
        g = np.where(np.isfinite(g), g, d)
    return classical_mds(g, k)


def neighbour_weights(x: np.ndarray, m: int, reg: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest other points of each, and the weights, 1 in sum, that rebuild it best from them."""
    near, w = nearest(x, m), np.empty((len(x), m))
    for i in range(len(x)):
        z = x[near[i]] - x[i]
        c = z @ z.T
        trace = np.trace(c)
        c[np.diag_indices(m)] += reg * (trace if trace > 0 else 1.0)
        s = np.linalg.solve(c, np.ones(m))
        w[i] = s / s.sum()
    return near, w


def lle(x: np.ndarray, k: int, n_neighbors: int = 5, reg: float = 1e-3, dense: int = 1000) -> np.ndarray:
    """Locally linear embedding; more than ``dense`` points take sparse elimination in place of a matrix of all pairs."""
    n = len(x)
    near, w = neighbour_weights(x, min(n_neighbors, n - 1), reg)
    if n > dense:
        return least_directions(near, w, x, k)
    a = np.eye(n)
    a[np.arange(n)[:, None], near] -= w
    _, v = np.linalg.eigh(a.T @ a)
    return v[:, 1 : k + 1]


def factored(c: np.ndarray, last: int = 128, panel: int = 64, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray, int]:
    """Orders of rows and columns in which ``c``, overwritten, holds unit lower and upper factors up to a place, and the rest from there.

    The rest is at least the ``last`` ones; columns without a pivot of ``least`` are put there.
    """
    n = len(c)
    rows, columns, at, end = np.arange(n), np.arange(n), 0, n
    while end - at > last:
        stop = good = min(at + panel, end)
        j = at
        while j < good:
            p = j + int(np.abs(c[j:, j]).argmax())
            if abs(c[p, j]) < least:
                good -= 1
                c[:, [j, good]], columns[[j, good]] = c[:, [good, j]], columns[[good, j]]
                continue
            if p != j:
                c[[j, p]], rows[[j, p]] = c[[p, j]], rows[[p, j]]
            c[j + 1 :, j] /= c[j, j]
            c[j + 1 :, j + 1 : stop] -= c[j + 1 :, j, None] * c[j, j + 1 : stop]
            j += 1
        for t in range(at, good):
            c[t + 1 : good, stop:] -= c[t + 1 : good, t, None] * c[t, stop:]
        for a in range(good, n, 512):
            c[a : a + 512, stop:] -= c[a : a + 512, at:good] @ c[at:good, stop:]
        for j in range(good, stop):
            end -= 1
            if end > j:
                c[:, [j, end]], columns[[j, end]] = c[:, [end, j]], columns[[end, j]]
        at = good
    return rows, columns, at


class Eliminated:
    """Sparse rows (dicts by column) of a square matrix, eliminated (at last as one dense block) but for a small core, whose singular values tell its null space.

    A pivot row is one of fewest entries, its column one of fewest among entries that are not small in
    the row, so that entries grow little; rows that all but vanish, as those of closed parts do, stay for the core.
    """

    def __init__(self, rows: list[dict[int, float]], null: float = 1e-11) -> None:
        self.n, self.steps = len(rows), []
        columns: list[set[int]] = [set() for _ in rows]
        for i, row in enumerate(rows):
            for j in row:
                columns[j].add(i)
        heap = [(len(row), i) for i, row in enumerate(rows)]
        heapq.heapify(heap)
        alive_rows, alive_columns = set(range(self.n)), set(range(self.n))
        while heap:
            size, r = heapq.heappop(heap)
            if r not in alive_rows or size != len(rows[r]):
                continue
            row = rows[r]
            top = max(map(abs, row.values()), default=0.0)
            if top < 1e-4:
                continue
            if 25 * size > len(alive_rows) > 100:  # a dense block is quicker from here on
                break
            c = min((j for j, v in row.items() if abs(v) >= 0.1 * top), key=lambda j: (len(columns[j]), j))
            pivot = row.pop(c)
            alive_rows.discard(r)
            alive_columns.discard(c)
            for j in row:
                columns[j].discard(r)
            columns[c].discard(r)
            below = sorted(columns[c])
            factors = []
            for i in below:
                other = rows[i]
                f = other.pop(c) / pivot
                factors.append(f)
                for j, v in row.items():
                    if j in other:
                        other[j] -= f * v
                    else:
                        other[j] = -f * v
                        columns[j].add(i)
                heapq.heappush(heap, (len(other), i))
            columns[c] = set()
            self.steps.append((r, c, pivot, np.fromiter(row, np.int32, len(row)), np.fromiter(row.values(), float, len(row)), np.array(below, np.int32), np.array(factors)))
            rows[r] = {}
        left = sorted(alive_rows)
        place = {c: j for j, c in enumerate(sorted(alive_columns))}
        core = np.zeros((len(left), len(left)))
        for i, r in enumerate(left):
            for c, v in rows[r].items():
                core[i, place[c]] = v
            rows[r] = {}
        by_row, by_column, at = factored(core)
        left, over = np.array(left, int)[by_row], np.array(list(place), int)[by_column]
        self.steps += [(left[t], over[t], core[t, t], over[t + 1 :], core[t, t + 1 :], left[t + 1 :], core[t + 1 :, t]) for t in range(at)]
        self.rows, self.columns = left[at:], over[at:]
        self.u, s, self.vt = np.linalg.svd(core[at:, at:])
        self.inverse = np.where(s > null, 1.0 / np.where(s > null, s, 1.0), 0.0)
        empty = np.zeros((self.n, int((self.inverse == 0).sum())))
        self.null = np.linalg.qr(self._back(empty, self.vt[self.inverse == 0].T))[0]
        self.left_null = np.linalg.qr(self._back_transposed(empty, self.u[:, self.inverse == 0]))[0]

    def _back(self, b: np.ndarray, core: np.ndarray) -> np.ndarray:
        x = np.zeros_like(b)
        x[self.columns] = core
        for r, c, pivot, at, values, _, _ in reversed(self.steps):
            x[c] = (b[r] - values @ x[at]) / pivot
        return x

    def _back_transposed(self, z: np.ndarray, core: np.ndarray) -> np.ndarray:
        u = np.zeros_like(z)
        u[self.rows] = core
        for r, _, _, _, _, below, factors in reversed(self.steps):
            u[r] = z[r] - factors @ u[below]
        return u

    def solve(self, b: np.ndarray) -> np.ndarray:
        """The shortest x with the least error."""
        b = b - self.left_null @ (self.left_null.T @ b)
        for r, _, _, _, _, below, factors in self.steps:
            b[below] -= factors[:, None] * b[r]
        x = self._back(b, self.vt.T @ (self.inverse[:, None] * (self.u.T @ b[self.rows])))
        return x - self.null @ (self.null.T @ x)

    def solve_transposed(self, y: np.ndarray) -> np.ndarray:
        y, z = y - self.null @ (self.null.T @ y), np.zeros_like(y)
        for r, c, pivot, at, values, _, _ in self.steps:
            z[r] = y[c] / pivot
            y[at] -= values[:, None] * z[r]
        u = self._back_transposed(z, self.u @ (self.inverse[:, None] * (self.vt @ y[self.columns])))
        return u - self.left_null @ (self.left_null.T @ u)


def _parts(near: np.ndarray) -> list[np.ndarray]:
    """Points of each connected part of the neighbour graph."""
    n = len(near)
    label, i, j = np.arange(n), np.repeat(np.arange(n), near.shape[1]), near.ravel()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1)


def least_directions(near: np.ndarray, w: np.ndarray, x: np.ndarray, k: int, guard: int = 8, steps: int = 200) -> np.ndarray:
    """Unit vectors v of least |v - Wv| across each other and the constant one, W being ``w`` at columns ``near`` of each row.

    Parts of the graph that no weight leaves are free against each other, so many vectors may have no
    error at all (copies of points make such parts). Of these the ones along which ``x`` varies most
    are taken; then come the least positive errors, found by inverse iteration. Memory grows with
    the entries left by elimination.
    """
    n = len(x)
    centred = x - x.mean(axis=0)
    drawn = np.random.default_rng(0).normal(size=(n, k)) / np.sqrt(n)  # serve if x varies in too few directions
    centred = np.hstack([centred / max(np.linalg.norm(centred), 1e-300), drawn])
    free, nulls, solvers = np.zeros_like(centred), 0, []
    for part in _parts(near):
        place = {p: q for q, p in enumerate(part.tolist())}
        rows = []
        for q, p in enumerate(part.tolist()):
            row = {q: 1.0}
            for j, v in zip(near[p].tolist(), w[p].tolist(), strict=True):
                row[place[j]] = row.get(place[j], 0.0) - v
            rows.append(row)
        solver = Eliminated(rows)
        free[part] = solver.null @ (solver.null.T @ centred[part])
        nulls += solver.null.shape[1]
        if nulls <= k:
            solvers.append((part, solver))
        else:
            solvers.clear()
    found = np.zeros((n, 0))
    for block in (free[:, : x.shape[1]], free[:, x.shape[1] :]):
        block = block - block.mean(axis=0)
        block = block - found @ (found.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        found = np.hstack([found, u[:, s > 1e-9][:, : min(k, nulls - 1) - found.shape[1]]])
    if found.shape[1] < k:
        errors, vectors = [], []
        for part, solver in solvers:
            place = np.full(n, -1)
            place[part] = np.arange(len(part))
            at, weight = place[near[part]], w[part]
            size = min(k - found.shape[1] + guard, len(part) - solver.null.shape[1])
            if size < 1:
                continue
            q = np.linalg.qr(solver.solve(np.random.default_rng(1).normal(size=(len(part), size))))[0]
            s, wanted = np.zeros(size), slice(0, k - found.shape[1])
            for _ in range(steps):
                y = solver.solve(solver.solve_transposed(q))
                if (np.linalg.norm(y * s**2 - q, axis=0) <= 1e-7 + 1e-14 / np.maximum(s, 1e-300))[wanted].all() and s[0] > 0:
                    break
                q = np.linalg.qr(y)[0]
                s, vt = np.linalg.svd(q - np.einsum("im,imc->ic", weight, q[at]), full_matrices=False)[1:]
                s, q = s[::-1], q @ vt[::-1].T
            for c in range(size)[wanted]:
                whole = np.zeros(n)
                whole[part] = q[:, c]
                errors.append(float(s[c]))
                vectors.append(whole)
        best = np.argsort(errors, kind="stable")[: k - found.shape[1]]
        found = np.column_stack([found, *[vectors[b] for b in best]])
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return found * np.where(sign == 0, 1, sign)


def affinity_rbf(x: np.ndarray, gamma: float | None = None) -> np.ndarray:
    return np.exp(-(1.0 / x.shape[1] if gamma is None else gamma) * distances(x) ** 2)


def laplacian(x: np.ndarray, k: int, n_neighbors: int | None = None) -> np.ndarray:
    """Eigenmaps of the neighbour graph (or of RBF affinities)."""
    n = len(x)
    if n_neighbors:
        near = neighbours(distances(x), min(n_neighbors, n - 1))
        a = np.zeros((n, n))
        a[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1.0
        a = 0.5 * (a + a.T)
    else:
        a = affinity_rbf(x)
    np.fill_diagonal(a, 0.0)
    d = np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    _, v = np.linalg.eigh(np.eye(n) - a / d[:, None] / d[None, :])
    return v[:, 1 : k + 1] / d[:, None]


def _affinities(x: np.ndarray, perplexity: float) -> np.ndarray:
    d = distances(x) ** 2
    n = len(x)
    p = np.zeros((n, n))
    for i in range(n):
        row = np.delete(d[i], i)
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            e = np.exp(-(row - row.min()) * beta)
            q = e / e.sum()
            h = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(h - np.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if h > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    return np.maximum((p + p.T) / (2 * n), 1e-12)


def tsne(x: np.ndarray, k: int = 2, perplexity: float = 30.0, seed: int = 0, steps: int = 500) -> np.ndarray:
    n = len(x)
    p = _affinities(x, min(perplexity, max((n - 1) // 3, 1)))
    y = pca(x, k)
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-6, (n, k))
    v = np.zeros_like(y)
    for step in range(steps):
        num = 1.0 / (1.0 + distances(y) ** 2)
        np.fill_diagonal(num, 0.0)
        q = np.maximum(num / num.sum(), 1e-12)
        pq = (p * (12.0 if step < 100 else 1.0) - q) * num
        grad = 4 * (pq.sum(axis=1)[:, None] * y - pq @ y)
        v = (0.5 if step < 100 else 0.8) * v - max(n / 12.0, 10.0) * grad
        y = y + v
        y -= y.mean(axis=0)
    return y


def umap(x: np.ndarray, k: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, seed: int = 0, epochs: int = 200) -> np.ndarray:
    """Fuzzy neighbour graph, spectral start, attraction along edges and sampled repulsion."""
    n, rng = len(x), np.random.default_rng(seed)
    m = max(2, min(n_neighbors, n - 1))
    d = distances(x)
    near = neighbours(d, m)
    near_d = np.take_along_axis(d, near, axis=1)
    rho = near_d[:, 0]
    sigma = np.ones(n)
    for i in range(n):
        lo, hi = 0.0, np.inf
        for _ in range(64):
            s = np.exp(-np.maximum(near_d[i] - rho[i], 0) / max(sigma[i], 1e-12)).sum()
            if abs(s - np.log2(m)) < 1e-5:
                break
            lo, hi = (lo, sigma[i]) if s > np.log2(m) else (sigma[i], hi)
            sigma[i] = sigma[i] * 2 if hi == np.inf else (lo + hi) / 2
    w = np.zeros((n, n))
    w[np.repeat(np.arange(n), m), near.ravel()] = np.exp(-np.maximum(near_d - rho[:, None], 0) / np.maximum(sigma[:, None], 1e-12)).ravel()
    w = w + w.T - w * w.T
    deg = np.sqrt(np.maximum(w.sum(axis=1), 1e-12))
    _, vec = np.linalg.eigh(np.eye(n) - w / deg[:, None] / deg[None, :])
    y = vec[:, 1 : k + 1]
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-4, (n, y.shape[1]))
    # low-dimensional kernel 1 / (1 + a d^(2b)) fitted to the wanted minimum distance
    grid = np.linspace(0, 3, 300)
    want = np.where(grid < min_dist, 1.0, np.exp(-(grid - min_dist)))
    a, b = min(((a, b) for a in np.linspace(0.5, 3, 26) for b in np.linspace(0.5, 1.5, 21)), key=lambda ab: ((1 / (1 + ab[0] * grid ** (2 * ab[1])) - want) ** 2).sum())
    i, j = np.nonzero(w > w.max() / epochs)
    for e in range(epochs):
        rate = 1.0 - e / epochs
        use = rng.random(len(i)) < w[i, j]
        p, q = i[use], j[use]
        diff = y[p] - y[q]
        d2 = np.maximum((diff**2).sum(axis=1), 1e-12)
        pull = (-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * diff
        np.add.at(y, p, rate * np.clip(pull, -4, 4))
        far = rng.integers(0, n, (len(p), 5))
        for c in range(5):
            diff = y[p] - y[far[:, c]]
            d2 = (diff**2).sum(axis=1)
            push = (2 * b / ((0.001 + d2) * (1 + a * np.maximum(d2, 1e-12) ** b)))[:, None] * diff
            np.add.at(y, p, rate * np.clip(push, -4, 4) * (p != far[:, c])[:, None])
    return y


def dtw_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic-time-warping distances by absolute differences of many pairs of rows at once."""
    a, b = clean(a), clean(b)
    prev = np.full((len(a), b.shape[1] + 1), np.inf)
    prev[:, 0] = 0.0
    for i in range(a.shape[1]):
        cost = np.abs(a[:, i : i + 1] - b)
        reach = np.minimum(prev[:, 1:], prev[:, :-1])
        row = np.full_like(prev, np.inf)
        for j in range(b.shape[1]):
            row[:, j + 1] = cost[:, j] + np.minimum(reach[:, j], row[:, j])
        prev = row
    return prev[:, -1]


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    return float(dtw_pairs(np.asarray(a, float)[None, :], np.asarray(b, float)[None, :])[0])


def dtw_distances(x: np.ndarray) -> np.ndarray:
    n = len(x)
    i, j = np.triu_indices(n, 1)
    d = np.zeros((n, n))
    for at in range(0, len(i), 4096):
        p, q = i[at : at + 4096], j[at : at + 4096]
        d[p, q] = d[q, p] = dtw_pairs(x[p], x[q])
    return d


REDUCTIONS = {
    "none": lambda x, k, **o: x,
    "fpca": lambda x, k, **o: pca(x, k),
    "umap": lambda x, k, **o: umap(x, k, **o),
    "tsne": lambda x, k, **o: tsne(x, min(k, 3), **{a: b for a, b in o.items() if a in ("perplexity", "seed")}),
    "isomap": lambda x, k, **o: isomap(x, k, o.get("n_neighbors", 5)),
    "lle": lambda x, k, **o: lle(x, k, o.get("n_neighbors", 5)),
    "laplacian": lambda x, k, **o: laplacian(x, k, o.get("n_neighbors")),
    "dtw_mds": lambda x, k, **o: metric_mds(dtw_distances(x), k, o.get("seed", 0)),
}


def reduce_dimensions(x: np.ndarray, method: str = "none", n_components: int = 10, **options) -> np.ndarray:
    """Finite features in fewer dimensions; fewer than three rows or columns stay as they are."""
    if method not in REDUCTIONS:
        raise ValueError(f"unknown reduction: {method}")
    x = clean(np.asarray(x, float))
    if method == "none" or len(x) < 3:
        return x
    k = max(1, min(n_components, x.shape[0] - 1, x.shape[1])) if method != "dtw_mds" else max(1, min(n_components, x.shape[0] - 1))
    return REDUCTIONS[method](x, k, **options)


# clusterings


def kmeans(x: np.ndarray, k: int, seed: int = 0, n_init: int = 10, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centres and inertia of the best of several starts (spread seeding)."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(n_init):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(steps):
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            labels = d.argmin(axis=1)
            new = np.stack([x[labels == j].mean(axis=0) if (labels == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = float(d.min(axis=1).sum())
        if best is None or inertia < best[2]:
            best = (labels, c, inertia)
    return best


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    ids = np.unique(labels)
    if len(ids) < 2 or len(ids) >= len(labels):
        return float("nan")
    out = np.zeros(len(d))
    for i in range(len(d)):
        own = (labels == labels[i]) & (np.arange(len(d)) != i)
        if own.any():
            a = d[i, own].mean()
            b = min(d[i, labels == c].mean() for c in ids if c != labels[i])
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float(out.mean())


def silhouette_of(x: np.ndarray, labels: np.ndarray) -> float:
    """``silhouette`` by Euclidean distance, from points: sums to every cluster come from blocks of rows, and copies within a cluster count once with their number."""
    ids, code, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    if len(ids) < 2 or len(ids) >= len(labels):
        return float("nan")
    points, _, times = different(np.column_stack([x, code]))
    points, code = points[:, :-1], points[:, -1].astype(int)
    member, total = np.eye(len(ids))[code] * times[:, None], 0.0
    for at, d in distance_rows(points):
        rows = np.arange(len(d))
        own = code[at + rows]
        d[rows, at + rows] = 0.0
        sums = d @ member
        a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[rows, own] = np.inf
        b = means.min(axis=1)
        top = np.maximum(a, b)
        total += float((times[at + rows] * np.where((sizes[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)).sum())
    return total / len(x)


def gmm(x: np.ndarray, k: int, seed: int = 0, steps: int = 200, reg: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, memberships and BIC of a mixture with full covariances, started from k-means."""
    n, p = x.shape
    labels = kmeans(x, k, seed, 3)[0]
    r = np.eye(k)[labels]
    last = -np.inf
    for _ in range(steps):
        w = r.sum(axis=0) + 1e-10
        mu = (r.T @ x) / w[:, None]
        log = np.empty((n, k))
        for j in range(k):
            c = x - mu[j]
            cov = (r[:, j, None] * c).T @ c / w[j] + reg * np.eye(p)
            chol = np.linalg.cholesky(cov)
            z = np.linalg.solve(chol, c.T)
            log[:, j] = np.log(w[j] / n) - 0.5 * (p * np.log(2 * np.pi) + (z**2).sum(axis=0)) - np.log(np.diag(chol)).sum()
        top = log.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        r = np.exp(log - norm[:, None])
        total = norm.sum()
        if abs(total - last) < 1e-3 * n:
            break
        last = total
    free = k * p + k * p * (p + 1) / 2 + k - 1
    return r.argmax(axis=1), r, float(-2 * total + free * np.log(n))


def agglomerative(d: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """Merges by the Lance-Williams recurrence down to k clusters; labels in order of first member."""
    n = len(d)
    a = (d**2 if linkage == "ward" else d).astype(float).copy()
    np.fill_diagonal(a, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - k):
        i, j = divmod(int(np.where(alive[:, None] & alive[None, :], a, np.inf).argmin()), n)
        i, j = min(i, j), max(i, j)
        si, sj = size[i], size[j]
        if linkage == "ward":
            new = ((si + size) * a[i] + (sj + size) * a[j] - size * a[i, j]) / (si + sj + size)
        elif linkage == "complete":
            new = np.maximum(a[i], a[j])
        elif linkage == "single":
            new = np.minimum(a[i], a[j])
        else:
            new = (si * a[i] + sj * a[j]) / (si + sj)
        a[i], a[:, i] = new, new
        a[i, i] = np.inf
        alive[j], size[i] = False, si + sj
        label[label == label[j]] = label[i]
    return _renumbered(label)


def ward_merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a point of one cluster, a point of the other) of all merges by Ward's criterion, lowest first.

    Chains of nearest neighbours find the same tree as the greedy order. Clusters are kept as
    means and sizes, so memory grows with the points and time with their square.
    """
    n = len(x)
    mean, size, point = np.array(x, float), np.ones(n), np.arange(n)
    sq = (mean * mean).sum(axis=1)
    merges, chain, reach, m = [], [], [], n  # reach: of each link of the chain, shrinking
    while m > 1:
        chain = chain or [0]
        while True:
            i = chain[-1]
            gap = np.maximum(sq[:m] + sq[i] - 2 * (mean[:m] @ mean[i]), 0.0)
            gap *= 2 * size[i] * size[:m] / (size[:m] + size[i])
            gap[i] = np.inf
            j = int(gap.argmin())
            # back, also where both directions differ by rounding only, so that no chain runs in a circle
            if reach and (gap[chain[-2]] <= gap[j] or gap[j] >= reach[-1]):
                j = chain[-2]
                break
            chain.append(j)
            reach.append(gap[j])
        del chain[-2:], reach[-2:]
        merges.append((float(gap[j]), int(point[i]), int(point[j])))
        whole = size[i] + size[j]
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / whole
        size[i], sq[i] = whole, mean[i] @ mean[i]
        m -= 1
        mean[j], size[j], sq[j], point[j] = mean[m], size[m], sq[m], point[m]  # the last cluster takes the free place
        chain = [j if c == m else c for c in chain]
    return sorted(merges, key=lambda e: e[0])


def cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of the k clusters that all but the k - 1 highest merges make, in order of first member."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, i, j in merges[: n - k]:
        parent[find(i)] = find(j)
    return _renumbered(np.array([find(i) for i in range(n)]))


def _renumbered(label: np.ndarray) -> np.ndarray:
    order = {v: i for i, v in enumerate(dict.fromkeys(label[label >= 0].tolist()))}
    return np.array([order.get(v, -1) for v in label.tolist()])


def dbscan(d: np.ndarray, min_samples: int = 5, eps: float | None = None) -> np.ndarray:
    """Density clusters; eps defaults to the 90th percentile of the distance to the k-th neighbour."""
    n = len(d)
    if eps is None:
        k = min(min_samples + 1, n) - 1
        eps = float(np.percentile(np.sort(d, axis=1)[:, k], 90)) or 1e-12
    near = d <= eps
    core = near.sum(axis=1) >= min_samples
    label, c = np.full(n, -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = c
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if label[j] < 0:
                    label[j] = c
                    if core[j]:
                        todo.append(j)
        c += 1
    return label


def strips(x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points by the column that parts them best, and the first and last place (exclusive) in it of what may lie in a point's reach."""
    best = None
    for c in range(x.shape[1]):
        order = np.argsort(x[:, c], kind="stable")
        v = x[order, c]
        far = reach[order] * (1 + 1e-9) + 4 * np.spacing(np.abs(v).max())
        low, high = np.searchsorted(v, v - far), np.searchsorted(v, v + far, "right")
        if best is None or (high - low).sum() < (best[2] - best[1]).sum():
            best = order, low, high
    return best


def dbscan_of(x: np.ndarray, min_samples: int = 5, eps: float | None = None, entries: int = 2_000_000) -> np.ndarray:
    """``dbscan`` from points: each meets only those that lie in reach on one column, in blocks of rows.

    Distances are formed one column at a time, so that each is the same in every block.
    """
    n = len(x)

    def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(sum((a[..., c] - b[..., c]) ** 2 for c in range(x.shape[1])))

    def blocks(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Places ``at``, ascending, in blocks of bounded size with the stretch that they meet."""
        start = 0
        while start < len(at):
            stop = min(start + 256, len(at))
            while stop > start + 1 and (stop - start) * (high[at[start:stop]].max() - low[at[start:stop]].min()) > max(entries, 2 * (high - low)[at[start:stop]].sum()):
                stop = start + (stop - start) // 2
            yield at[start:stop], int(low[at[start:stop]].min()), int(high[at[start:stop]].max())
            start = stop

    if eps is None:
        k = min(min_samples + 1, n) - 1
        bound = np.full(n, np.inf)
        for c in range(x.shape[1]):  # the points beside one on a column bound its k-th distance
            order, side = np.argsort(x[:, c], kind="stable"), max(16, 2 * k)
            y, beside = x[order], np.full((n, 2 * side), np.inf)
            for s in range(1, min(side, n - 1) + 1):
                beside[s:, s - 1] = beside[:-s, side + s - 1] = gaps(y[s:], y[:-s])
            bound[order] = np.minimum(bound[order], np.partition(beside, k - 1, axis=1)[:, k - 1] if k else 0.0)
        order, low, high = strips(x, bound)
        y, kth = x[order], np.empty(n)
        for at, a, b in blocks(np.arange(n), low, high):
            kth[order[at]] = np.partition(gaps(y[at, None], y[None, a:b]), k, axis=1)[:, k]
        eps = float(np.percentile(kth, 90)) or 1e-12
    order, low, high = strips(x, np.full(n, eps))
    y = x[order]
    core = np.concatenate([(gaps(y[at, None], y[None, a:b]) <= eps).sum(axis=1) for at, a, b in blocks(np.arange(n), low, high)]) >= min_samples
    label, c = np.full(n, -1), 0
    for i in np.argsort(order)[np.flatnonzero(core[np.argsort(order)])]:  # places of core points, in the points' own order
        if label[i] >= 0:
            continue
        label[i], todo = c, np.array([i])
        while len(todo):
            new = []
            for at, a, b in blocks(todo, low, high):
                met = np.flatnonzero((gaps(y[at, None], y[None, a:b]) <= eps).any(axis=0) & (label[a:b] < 0)) + a
                label[met] = c
                new.append(met[core[met]])
            todo = np.sort(np.concatenate(new))
        c += 1
    out = np.empty(n, int)
    out[order] = label
    return out


def _spanning_tree(w: np.ndarray) -> list[tuple[float, int, int]]:
    n = len(w)
    inside, best, link, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    inside[0] = True
    for _ in range(n - 1):
        closer = ~inside & (w[at] < best)
        best[closer], link[closer] = w[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[at]), int(link[at]), at))
        inside[at] = True
    return sorted(edges)


def hdbscan(d: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> np.ndarray:
    """Mutual-reachability tree, condensed by size; the most stable clusters are kept."""
    n = len(d)
    if n < 2 * min_cluster_size:
        return np.full(n, -1)
    k = min((min_samples or min_cluster_size), n - 1)
    core = np.sort(d, axis=1)[:, k]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    members, parent = {i: [i] for i in range(n)}, list(range(n))
    children, height = {}, {i: 0.0 for i in range(n)}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for w, i, j in _spanning_tree(reach):
        a, b = find(i), find(j)
        node = len(parent)
        parent.append(node)
        parent[a] = parent[b] = node
        members[node], children[node], height[node] = members[a] + members[b], (a, b), w
    root = len(parent) - 1
    lam = lambda w: 1.0 / max(w, 1e-12)
    chosen: list[int] = []

    def walk(node: int, birth: float) -> tuple[float, list[int]]:
        """Stability of the best selection below a cluster that is born at ``birth``."""
        own, at = 0.0, node
        while True:
            if at not in children:
                return own + (lam(height[at]) if at >= n else lam(core[at])) - birth if len(members[at]) >= min_cluster_size else own, [node]
            a, b = children[at]
            death = lam(height[at])
            big = [c for c in (a, b) if len(members[c]) >= min_cluster_size]
            if len(big) == 2:
                own += len(members[at]) * (death - birth)
                below = [walk(c, death) for c in big]
                total = sum(s for s, _ in below)
                return (total, below[0][1] + below[1][1]) if total > own else (own, [node])
            if not big:
                return own + len(members[at]) * (death - birth), [node]
            small = a if big[0] == b else b
            own += len(members[small]) * (death - birth)
            at = big[0]

    import sys

    held = sys.getrecursionlimit()
    sys.setrecursionlimit(max(held, 4 * n + 1000))
    try:
        _, chosen = walk(root, lam(height[root]))
    finally:
        sys.setrecursionlimit(held)
    label = np.full(n, -1)
    if chosen != [root]:
        for c, node in enumerate(chosen):
            label[members[node]] = c
    return label


def optics(d: np.ndarray, min_samples: int = 5, xi: float = 0.05) -> np.ndarray:
    """Reachability order; clusters are stretches between steep falls and rises of at least ``xi``."""
    n = len(d)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        i = int(np.where(done, np.inf, np.where(np.isfinite(reach), reach, 1e300)).argmin())
        done[i] = True
        order.append(i)
        new = np.maximum(core[i], d[i])
        reach = np.where(~done & (new < reach), new, reach)
    plot = np.append(reach[order], np.inf)
    label, c, stack = np.full(n, -1), 0, []
    for p in range(n):
        if p + 1 <= n - 1 and plot[p + 1] <= plot[p] * (1 - xi):
            stack.append((p, plot[p]))
        if plot[p + 1] * (1 - xi) >= plot[p]:
            while stack and stack[-1][1] * (1 - xi) < plot[p]:
                stack.pop()
            if stack:
                start = stack[-1][0]
                inside = [order[q] for q in range(start, p + 1)]
                if len(inside) >= min_samples and (label[inside] < 0).all():
                    label[inside] = c
                    c += 1
    return label


def spectral(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    a = affinity_rbf(x)
    d = np.sqrt(a.sum(axis=1))
    _, v = np.linalg.eigh(np.eye(len(x)) - a / d[:, None] / d[None, :])
    return kmeans(v[:, :k], k, seed)[0]


def best_k(x: np.ndarray, fit, max_k: int) -> np.ndarray:
    """Labels of the number of clusters with the best silhouette; a single choice needs none."""
    most, best = min(max_k, len(x) - 1), None
    if most == 2:
        return fit(2)
    for k in range(2, most + 1):
        labels = fit(k)
        s = silhouette_of(x, labels)
        if best is None or (s == s and s > best[0]):
            best = (s if s == s else -2.0, labels)
    return best[1] if best else np.zeros(len(x), int)


def cluster(x: np.ndarray, method: str = "kmeans", *, n_clusters: int | None = None, max_k: int = 5, seed: int = 0, outlier_z: float | None = None, min_cluster_size: int = 1, min_samples: int = 5, eps: float | None = None, linkage: str = "ward", n_init: int = 10) -> np.ndarray:
    """Impute, standardise, cluster, mark far points and small clusters as -1."""
    x = standardised(column_filled(np.asarray(x, float)))
    n = len(x)
    if n == 0:
        return np.empty(0, int)
    if n < 3:
        return np.zeros(n, int)
    pick = lambda fit: fit(min(n_clusters, n)) if n_clusters else best_k(x, fit, max_k)
    if method == "kmeans":
        labels = pick(lambda k: kmeans(x, k, seed, n_init)[0])
    elif method == "gmm":
        labels = gmm(x, n_clusters, seed)[0] if n_clusters else min((gmm(x, k, seed) for k in range(1, min(max_k, n - 1) + 1)), key=lambda r: r[2])[0]
    elif method in ("hierarchical", "agglomerative"):
        if linkage == "ward":
            merges = ward_merges(x)
            labels = pick(lambda k: cut(merges, n, k))
        else:
            d = distances(x)
            labels = pick(lambda k: agglomerative(d, k, linkage))
    elif method == "dtw":
        labels = pick(lambda k: agglomerative(dtw_distances(x), k, "average"))
    elif method == "dbscan":
        labels = dbscan_of(x, min_samples, eps)
    elif method == "hdbscan":
        labels = hdbscan(distances(x), max(2, min_samples))
    elif method == "optics":
        labels = optics(distances(x), min_samples)
    elif method == "spectral":
        labels = pick(lambda k: spectral(x, k, seed))
    else:
        raise ValueError(f"unknown clustering: {method}")
    labels = np.array(labels)
    if outlier_z is not None:
        dist = np.zeros(n)
        for c in np.unique(labels[labels >= 0]):
            dist[labels == c] = np.linalg.norm(x[labels == c] - x[labels == c].mean(axis=0), axis=1)
        m = np.median(dist)
        mad = 1.4826 * np.median(np.abs(dist - m))
        if mad > 0:
            labels[dist > m + outlier_z * mad] = -1
    values, counts = np.unique(labels, return_counts=True)
    labels[np.isin(labels, values[(counts < min_cluster_size) & (values >= 0)])] = -1
    return labels


# random convolution kernels


def random_kernels(n: int = 10_000, lengths: tuple[int, int] = (7, 9), seed: int | None = None) -> list[tuple[np.ndarray, float]]:
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        size, dilation = int(rng.integers(lengths[0], lengths[1] + 1)), int(rng.integers(1, 3))
        w = rng.normal(size=size)
        w = (w - w.mean()) / (np.linalg.norm(w - w.mean()) or 1.0)
        wide = np.zeros((size - 1) * dilation + 1)
        wide[::dilation] = w
        out.append((wide, float(rng.uniform(-1, 1))))
    return out


def kernel_features(trace: np.ndarray, kernels: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Maximum and share of positive responses of each kernel."""
    t, out = clean(np.asarray(trace, float)), np.empty(2 * len(kernels))
    for i, (w, b) in enumerate(kernels):
        r = np.convolve(t, w[::-1], mode="same") + b if len(t) >= len(w) else np.array([t @ w[: len(t)] + b])
        out[2 * i], out[2 * i + 1] = r.max(), (r > 0).mean()
    return out


def ridge_classifier(x: np.ndarray, y: np.ndarray, alphas=np.logspace(-3, 3, 10)) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and alpha of least leave-one-out error, on targets of -1 and 1."""
    t = np.where(y > 0, 1.0, -1.0)
    mx, mt = x.mean(axis=0), t.mean()
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    c, best = t - mt, None
    for a in alphas:
        shrink = s**2 / (s**2 + a)
        fit = u @ (shrink * (u.T @ c))
        hat = (u**2 * shrink).sum(axis=1) + 1.0 / len(t)
        loo = (((c - fit) / np.maximum(1 - hat, 1e-9)) ** 2).mean()
        if best is None or loo < best[0]:
            best = (loo, vt.T @ (s / (s**2 + a) * (u.T @ c)), a)
    w = best[1]
    return w, float(mt - mx @ w), float(best[2])
