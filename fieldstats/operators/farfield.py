"""A fast product with a covariance matrix, and solves with it.

Samples are halved along their longer side into a tree.  Boxes far from each other for
their size see each other through Chebyshev nodes, boxes nearby directly, so that a product takes about
n log n covariances.  It is in single precision and right to six or seven places: it only steers.  What is returned by
`functionals`, and by conjugate.Covariance.refined, is corrected by residuals with the whole matrix in double
precision until those are small enough.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np

from fieldstats.functions import models
from fieldstats.operators.fit import Variogram

#: Nodes a dimension, by dimensions; in space fewer, so that a product there is right to about 1e-3.
ORDER = {1: 8, 2: 8, 3: 4}
LEAF = 128
#: Numbers of a tile of the whole matrix, and products of the sparse factor, worked at a time.
TILE_NUMBERS = 32_768
ENTRIES = 131_072
NODE_BOXES, LEAVES = 16, 10
#: Boxes are far apart if they are not wider than so many times the gap between them.
ETA = 1.2
#: Scaled distance from which on a covariance does not steer.
FAR = {"exponential": 21.0, "gaussian": 4.6, "spherical": 1.0}


def _correlation(a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """The model scaled to range and sill 1 between places, in their precision."""
    h = np.subtract.outer(a[:, 0], b[:, 0])
    h *= h
    for k in range(1, a.shape[1]):
        step = np.subtract.outer(a[:, k], b[:, k])
        step *= step
        h += step
    if name != "gaussian":
        np.sqrt(h, out=h)
    if name == "spherical":
        np.minimum(h, 1, out=h)
        return 1 - h * (h.dtype.type(1.5) - h.dtype.type(0.5) * h * h)
    np.negative(h, out=h)
    return np.exp(h, out=h)


def _chebyshev(u: np.ndarray, order: int) -> np.ndarray:
    """Shares of the Chebyshev nodes of [-1, 1] at places u, one dimension."""
    nodes = (2 * np.arange(order) + 1) * np.pi / (2 * order)
    at = np.arccos(np.clip(u, -1, 1))
    m = np.arange(1, order)
    return (1 + 2 * np.cos(at[..., None] * m) @ np.cos(np.outer(m, nodes))) / order


def _shares(u: np.ndarray) -> np.ndarray:
    """Shares of all nodes of a box at places u scaled to it; the last axis of u holds the dimensions."""
    one = _chebyshev(u, ORDER[u.shape[-1]])
    out = one[..., 0, :]
    for k in range(1, u.shape[-1]):
        out = (out[..., :, None] * one[..., k, None, :]).reshape(*out.shape[:-1], -1)
    return out


def _nodes(dims: int) -> np.ndarray:
    t = np.cos((2 * np.arange(ORDER[dims]) + 1) * np.pi / (2 * ORDER[dims]))
    return np.stack(np.meshgrid(*[t] * dims, indexing="ij"), -1).reshape(-1, dims)


class Sparse:
    """Rows of a sparse matrix times the columns of an array, by rows of equally many entries, ENTRIES products at a time."""

    def __init__(self, row: np.ndarray, column: np.ndarray, weight: np.ndarray, n: int) -> None:
        order = np.argsort(row, kind="stable")
        column, weight = column[order], weight[order]
        starts = np.searchsorted(row[order], np.arange(n + 1))
        sizes = np.diff(starts)
        self.n, self.groups = n, []
        for k in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == k)
            at = starts[rows][:, None] + np.arange(k)
            self.groups.append((rows, column[at], weight[at][:, None, :]))

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, v.shape[1]), v.dtype)
        for rows, column, weight in self.groups:
            size = max(1, ENTRIES // (column.shape[1] * v.shape[1]))
            for i in range(0, len(rows), size):
                out[rows[i : i + size]] = np.matmul(weight[i : i + size], v[column[i : i + size]])[:, 0]
        return out


class FarField:
    """Fast products and solves for samples; made from arrays, so it can be sent to tasks, where the tree is built on first use.

    `row`, `earlier` and `weight` are the entries of the sparse factor that preconditions (see conjugate).
    """

    def __init__(self, coords: np.ndarray, model: Variogram, row: np.ndarray, earlier: np.ndarray, weight: np.ndarray) -> None:
        self.coords, self.model = coords, model
        self.row, self.earlier, self.weight = row, earlier, weight
        self.name = models.check_model(model.model)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("coords", "model", "row", "earlier", "weight", "name")}

    @cached_property
    def factor(self) -> tuple[Sparse, Sparse]:
        n = len(self.coords)
        return Sparse(self.row, self.earlier, self.weight, n), Sparse(self.earlier, self.row, self.weight, n)

    def precondition(self, r: np.ndarray) -> np.ndarray:
        rows, columns = self.factor
        return columns.times(rows.times(r))

    @cached_property
    def tree(self) -> dict:
        n, dims = self.coords.shape
        depth = max(0, math.ceil(math.log2(n / LEAF)))
        x = (self.coords - self.coords.mean(0)) / self.model.range
        order = np.arange(n)
        cuts = lambda level: np.arange((1 << level) + 1) * n >> level
        for level in range(depth):
            at, halves = cuts(level), cuts(level + 1)
            for i in range(1 << level):
                part = order[at[i] : at[i + 1]]
                places = x[part]
                axis = int(np.argmax(np.ptp(places, axis=0)))
                order[at[i] : at[i + 1]] = part[np.argpartition(places[:, axis], halves[2 * i + 1] - at[i])]
        x = x[order]
        boxes = []
        for level in range(depth + 1):
            at = cuts(level)
            low, high = np.minimum.reduceat(x, at[:-1]), np.maximum.reduceat(x, at[:-1])
            boxes.append(((low + high) / 2, np.maximum((high - low) / 2, 1e-12)))
        a = b = np.zeros(1, int)
        far = []
        for level, (centre, half) in enumerate(boxes):
            between = np.abs(centre[a] - centre[b])
            apart = np.sqrt((np.maximum(between - half[a] - half[b], 0) ** 2).sum(1))
            most = np.sqrt(((between + half[a] + half[b]) ** 2).sum(1))
            wide = 2 * np.sqrt(np.maximum((half[a] ** 2).sum(1), (half[b] ** 2).sum(1)))
            seen = apart < FAR[self.name]
            smooth = (wide <= ETA * apart) & (wide <= 3)
            if self.name == "spherical":
                smooth &= most <= 1
            far.append(self._lists(a[seen & smooth], b[seen & smooth], 1 << level))
            a, b = a[seen & ~smooth], b[seen & ~smooth]
            if level < depth:
                a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
        unit = _nodes(dims)
        nodes = [(c[:, None] + h[:, None] * unit).astype(np.float32) for c, h in boxes]
        moves = []
        for level in range(1, depth + 1):
            (c, h), (above, wide) = boxes[level], boxes[level - 1]
            up = np.arange(1 << level) // 2
            moves.append(_shares((c[:, None] + h[:, None] * unit - above[up][:, None]) / wide[up][:, None]).astype(np.float32))
        at = cuts(depth)
        own = np.repeat(np.arange(1 << depth), np.diff(at))
        centre, half = boxes[-1]
        shares = _shares((x - centre[own]) / half[own]).astype(np.float32)
        return {"order": order, "x": x.astype(np.float32), "at": at, "far": far, "near": self._lists(a, b, 1 << depth), "nodes": nodes, "moves": moves, "shares": shares}

    @staticmethod
    def _lists(a: np.ndarray, b: np.ndarray, n: int) -> list[np.ndarray]:
        order = np.argsort(a, kind="stable")
        return np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))

    def product(self, v: np.ndarray, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one of some parts of the tree, and about C v there, in single precision."""
        t, model = self.tree, self.model
        v = v.astype(np.float32, copy=False)
        w, at, m = v[t["order"]], t["at"], v.shape[1]
        size, depth = t["nodes"][0].shape[1], len(t["far"]) - 1
        leaves = len(at) - 1
        first, last = leaves * part // parts, leaves * (part + 1) // parts
        rows = t["order"][at[first] : at[last]]
        if first == last:
            return rows, np.empty((0, m), np.float32)
        moments = [np.empty((leaves, size, m), np.float32)]
        for i in range(leaves):
            moments[0][i] = t["shares"][at[i] : at[i + 1]].T @ w[at[i] : at[i + 1]]
        for move in reversed(t["moves"]):
            moments.insert(0, np.matmul(move.transpose(0, 2, 1), moments[0]).reshape(-1, 2, size, m).sum(1))
        seen, low = None, 0
        for level, lists in enumerate(t["far"]):
            start, stop = first >> (depth - level), ((last - 1) >> (depth - level)) + 1
            new = np.zeros((stop - start, size, m), np.float32)
            if seen is not None:
                new += np.matmul(t["moves"][level - 1][start:stop], seen[np.arange(start, stop) // 2 - low])
            nodes, held = t["nodes"][level], moments[level]
            for i in range(start, stop):
                for k in range(0, len(lists[i]), NODE_BOXES):
                    some = lists[i][k : k + NODE_BOXES]
                    new[i - start] += _correlation(nodes[i], nodes[some].reshape(-1, nodes.shape[2]), self.name) @ held[some].reshape(-1, m)
            seen, low = new, start
        out = np.empty((len(rows), m), np.float32)
        x = t["x"]
        for i in range(first, last):
            own, put = slice(at[i], at[i + 1]), slice(at[i] - at[first], at[i + 1] - at[first])
            out[put] = t["shares"][own] @ seen[i - low]
            for k in range(0, len(t["near"][i]), LEAVES):
                places = np.concatenate([np.arange(at[j], at[j + 1]) for j in t["near"][i][k : k + LEAVES]])
                out[put] += _correlation(x[own], x[places], self.name) @ w[places]
        out *= np.float32(model.sill - model.nugget)
        out += np.float32(model.nugget) * v[rows]
        return rows, out

    def times(self, v: np.ndarray) -> np.ndarray:
        rows, some = self.product(v)
        out = np.empty_like(some)
        out[rows] = some
        return out

    def steer(self, r: np.ndarray, tolerance: float = 1e-4, times: Callable[[np.ndarray], np.ndarray] | None = None, held: np.ndarray | float = 1.0, most: int = 60) -> np.ndarray:
        """About C^-1 r by conjugate gradients with the fast product (here, or as `times` does it); columns are scaled to length 1 meanwhile.

        With `held`, 1 or 0 for each row and column, each column has the system of its own held rows.
        """
        times = times or self.times
        size = np.linalg.norm(r, axis=0)
        size = np.where(size > 0, size, 1.0)
        r, held = (r / size).astype(np.float32), np.asarray(held, np.float32)
        x = np.zeros_like(r)
        z = self.precondition(r) * held
        p, rz = z.copy(), (r * z).sum(0, dtype=float)
        for _ in range(most):
            left = np.sqrt((r * r).sum(0, dtype=float))
            go = (left > tolerance) & (rz > 0)
            if not go.any() or not np.isfinite(left).all():
                break
            q = times(p) * held
            step = np.divide(rz, (p * q).sum(0, dtype=float), out=np.zeros_like(rz), where=go).astype(np.float32)
            x += step * p
            r -= step * q
            z = self.precondition(r) * held
            new = (r * z).sum(0, dtype=float)
            p = z + np.divide(new, rz, out=np.zeros_like(rz), where=go).astype(np.float32) * p
            rz = new
        return np.where(np.isfinite(x), x, 0) * size

    def residual(self, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        """b - C x with the whole matrix in double precision, a tile at a time."""
        model, out = self.model, b - self.model.nugget * x
        places = self.coords / model.range
        n, rows = len(places), 64
        wide = TILE_NUMBERS // rows
        partial = model.sill - model.nugget
        scaled = partial * x
        for i in range(0, n, rows):
            own, total = places[i : i + rows], 0.0
            # the matrix is symmetric, so a tile right of the diagonal does for its mirror too
            for j in range(i, n, wide):
                tile = _correlation(own, places[j : j + wide], self.name)
                total = total + tile @ scaled[j : j + wide]
                after = max(i + rows, j)
                out[after : j + wide] -= tile[:, after - j :].T @ scaled[i : i + rows]
            out[i : i + rows] -= total
        return out

    def functionals(self, b: np.ndarray, least: float = 0.0, most: int = 30) -> np.ndarray:
        """b' C^-1 b of each column, which is at least `least`, to an error below 1e-7 of it (of a tenth of the sill, if that is more).

        For any x with residual r it is b'x + x'r + r'C^-1 r, and the last term is at most r'r over the nugget (the
        smallest eigenvalue), which decides when to stop; without a nugget the residual itself does.
        """
        nugget, x, r = self.model.nugget, np.zeros_like(b), b
        size, before, value = (b * b).sum(0), np.inf, np.zeros(b.shape[1])
        for _ in range(most):
            square = (r * r).sum(0)
            wanted = 1e-7 * nugget * np.maximum(value, max(least, 0.1 * self.model.sill)) if nugget > 0 else 1e-18 * size
            worst = float(np.sqrt(np.max(square / np.maximum(wanted, 1e-300), initial=0.0)))
            if worst <= 1:
                return value
            if not worst < 0.5 * before:
                break
            before = worst
            x = x + self.steer(r, min(0.1, max(1e-4, 0.3 / worst)))
            r = self.residual(b, x)
            value = (b * x).sum(0) + (x * r).sum(0)
        raise ValueError("the covariance system was not solved; a larger nugget makes it better conditioned")
