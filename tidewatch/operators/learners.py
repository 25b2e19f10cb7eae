"""Learners on arrays: ridge over moving windows, gradient-boosted and bagged histogram trees, and a gated recurrent network.

They are what a Spark task fits for one training window; how windows are dealt to tasks is in `learned`. Each learner is made from an entity's consecutive
rows (x, y) and fits windows of them: fit(start, stop) gives a model, and predict(model, rows) forecasts rows, one step each.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

# ---- ridge -------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Linear:
    mean: np.ndarray
    sd: np.ndarray
    centre: float
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - self.mean) / self.sd) @ self.weights + self.centre


class RollingRidge:
    """Ridge on scaled features, whose window moves by adding and dropping rows of its moments.

    Features are scaled by their window's mean and deviation (over the values that are there), a missing one then counts as 0, and rows without
    target are not fitted. All of that follows from sums over the window of products of values (0 where missing), of presences, and of both; a window
    that moves by k rows costs 2k rows of products instead of its whole length. Values are taken from the entity's mean, so that sums stay small.
    Scales change with the window, so the normal equations are factored anew (Cholesky) where a model is asked for. A move
    of half a window or more, or REFRESH moves in a row, sum the window afresh, which also stops rounding from adding up.
    Where a feature's variance is under STEADY of its squares, here or in a window that the sums came from (an hour that does not change in dense rows), what is
    left of it is rounding: such a window is fitted on its rows themselves.
    """

    REFRESH, STEADY = 256, 1e-6

    def __init__(self, x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> None:
        self.alpha, self.shift = alpha, np.nan_to_num(np.nanmean(x, axis=0)) if len(x) else np.zeros(x.shape[1])
        self.there = (~np.isnan(x)).astype(float)
        self.values = np.where(self.there > 0, x - self.shift, 0.0)
        self.y, self.known = np.nan_to_num(y), (~np.isnan(y)).astype(float)
        self.offset = float(self.y[self.known > 0].mean()) if self.known.any() else 0.0
        self.y = (self.y - self.offset) * self.known
        self.at, self.moves, self.sums, self.top = (0, 0), 0, None, None

    def _part(self, a: int, b: int) -> list[np.ndarray]:
        v, p, y, k = self.values[a:b], self.there[a:b], self.y[a:b], self.known[a:b]
        vk, pk = v * k[:, None], p * k[:, None]
        return [p.sum(0), v.sum(0), (v * v).sum(0), vk.T @ v, pk.T @ v, pk.T @ p, vk.T @ y, pk.T @ y, k.sum(), y.sum()]

    def move(self, start: int, stop: int) -> None:
        a, b = self.at
        self.moves += 1
        if self.sums is None or not a <= start <= b or stop < b or 2 * (start - a + stop - b) >= stop - start or self.moves % self.REFRESH == 0:
            self.sums, self.top = self._part(start, stop), None
        else:
            self.sums = [s + new - old for s, new, old in zip(self.sums, self._part(b, stop), self._part(a, start), strict=True)]
        self.at, self.top = (start, stop), self.sums[2] if self.top is None else np.maximum(self.top, self.sums[2])

    def _direct(self, start: int, stop: int) -> Linear:
        """The window's model from its rows, without the sums."""
        v, p, y, k = self.values[start:stop], self.there[start:stop], self.y[start:stop], self.known[start:stop] > 0
        n = np.maximum(p.sum(0), 1)
        mean = v.sum(0) / n
        away = (v - mean) * p
        sd = np.sqrt((away**2).sum(0) / n)
        # what is left of a constant's variance is rounding
        sd = np.where((sd < 1e-10) | (sd <= 1e-12 * np.sqrt((v * v).sum(0) / n)), 1.0, sd)
        centre = float(y[k].mean()) if k.any() else 0.0
        z = (away / sd)[k]
        w = np.linalg.solve(z.T @ z + self.alpha * np.eye(z.shape[1]), z.T @ (y[k] - centre))
        return Linear(mean + self.shift, sd, centre + self.offset, w)

    def fit(self, start: int, stop: int) -> Linear:
        self.move(start, stop)
        n, s, ss, vv, pv, pp, vy, py, k, ty = self.sums
        mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        var = np.divide(ss, n, out=np.zeros_like(s), where=n > 0) - mean**2
        if (var * n <= self.STEADY * self.top).any():
            return self._direct(start, stop)
        sd = np.sqrt(var)
        centre = ty / k if k else 0.0
        gram = (vv - mean[:, None] * pv - (mean[:, None] * pv).T + np.outer(mean, mean) * pp) / np.outer(sd, sd)
        # a value is 0 where it is missing, so the diagonal of pv has the sums of known rows' values
        right = ((vy - mean * py) - centre * (np.diag(pv) - mean * np.diag(pp))) / sd
        lower = np.linalg.cholesky(gram + self.alpha * np.eye(len(s)))
        w = np.linalg.solve(lower.T, np.linalg.solve(lower, right))
        return Linear(mean + self.shift, sd, centre + self.offset, w)


# ---- trees -------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Nodes in order of growth: rows with x[feature] <= threshold go left; feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = x[rows[inner], f[inner]] <= self.threshold[at[inner]]
            at[inner] = np.where(go, self.left[at[inner]], self.right[at[inner]])


@dataclass(frozen=True)
class Trees:
    base: float
    rate: float
    trees: tuple[Tree, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


class Binned:
    """Features as bins of at most `bins` values each: every distinct value if there are few, else quantiles. A threshold is the middle between two bins' values."""

    def __init__(self, x: np.ndarray, bins: int = 255) -> None:
        self.codes, self.cuts = np.empty(x.shape, np.int32), []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) > bins:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins), method="lower"))
            cuts = (values[:-1] + values[1:]) / 2
            self.codes[:, j] = np.searchsorted(cuts, x[:, j], "left")
            self.cuts.append(cuts)
        self.width = max([1, *[len(c) + 1 for c in self.cuts]])
        self.flat = self.codes + np.arange(x.shape[1]) * self.width
        self.open = np.array([[k < len(c) for k in range(self.width)] for c in self.cuts], bool).reshape(x.shape[1], self.width)


def best_split(b: Binned, rows: np.ndarray, g: np.ndarray, w: np.ndarray, least: float) -> tuple[float, int, int]:
    """Gain (fall of the squared error), feature and last bin on the left of the best split of the rows; gain 0: none. Ties go to the first feature and bin."""
    size = b.open.size
    codes = b.flat[rows].ravel()
    n_rep = b.codes.shape[1]
    sums = np.bincount(codes, np.repeat(g[rows] * w[rows], n_rep), size).reshape(b.open.shape).cumsum(1)
    ns = np.bincount(codes, np.repeat(w[rows], n_rep), size).reshape(b.open.shape).cumsum(1)
    total, n = sums[0, -1], ns[0, -1]
    ok = b.open & (ns >= least) & (n - ns >= least)
    if not ok.any():
        return 0.0, -1, -1
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, sums**2 / ns + (total - sums) ** 2 / (n - ns) - total * total / n, -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // b.width, at % b.width


def grow(b: Binned, g: np.ndarray, w: np.ndarray, depth: int, leaves: int, least: float) -> Tree:
    """A regression tree of g with row weights w, grown leaf by leaf: the split of the largest gain comes next."""
    feature, threshold, left, right, value = [-1], [0.0], [-1], [-1], []
    rows = np.flatnonzero(w > 0)
    mean = lambda r: float(np.average(g[r], weights=w[r])) if len(r) else 0.0
    value.append(mean(rows))
    waiting: list[tuple] = []

    def offer(node: int, rows: np.ndarray, level: int) -> None:
        if level < depth and len(rows) > 1:
            gain, f, cut = best_split(b, rows, g, w, least)
            if gain > 1e-12:
                heapq.heappush(waiting, (-gain, node, f, cut, level, rows))

    offer(0, rows, 0)
    n = 1
    while waiting and n < leaves:
        _, node, f, cut, level, rows = heapq.heappop(waiting)
        go = b.codes[rows, f] <= cut
        feature[node], threshold[node] = f, float(b.cuts[f][cut])
        for side, part in ((left, rows[go]), (right, rows[~go])):
            side[node] = len(feature)
            feature.append(-1)
            threshold.append(0.0)
            left.append(-1)
            right.append(-1)
            value.append(mean(part))
            offer(len(feature) - 1, part, level + 1)
        n += 1
    return Tree(*map(np.array, (feature, threshold, left, right, value)))


class TreeLearner:
    """kind `rf`: bagged trees on bootstrap samples; `gbt`: trees on what the ones before have left, shrunk by `rate`. Missing features count as 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: str = "rf", n_estimators: int = 100, max_depth: int = 10, rate: float = 0.1, leaves: int | None = None, least: int | None = None, seed: int = 42, bins: int = 255, origin: int = 0) -> None:
        self.x, self.y, self.kind, self.n, self.depth, self.rate, self.seed, self.bins, self.origin = np.nan_to_num(x), y, kind, n_estimators, max_depth, rate, seed, bins, origin
        self.leaves, self.least = leaves or (1 << max_depth if kind == "rf" else 31), least or (1 if kind == "rf" else 20)

    def fit(self, start: int, stop: int) -> Trees:
        known = np.arange(start, stop)[~np.isnan(self.y[start:stop])]
        if not len(known):
            return Trees(0.0, 1.0, ())
        x, y = self.x[known], self.y[known]
        b, rng, out = Binned(x, self.bins), np.random.default_rng([self.seed, self.origin + start]), []
        if self.kind == "rf":
            for _ in range(self.n):
                w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
                out.append(grow(b, y, w, self.depth, self.leaves, self.least))
            return Trees(0.0, 1 / self.n, tuple(out))
        base, w = float(y.mean()), np.ones(len(y))
        left = y - base
        for _ in range(self.n):
            t = grow(b, left, w, self.depth, self.leaves, self.least)
            out.append(t)
            left = left - self.rate * t.predict(x)
        return Trees(base, self.rate, tuple(out))


# ---- a recurrent network -----------------------------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Stacked LSTM cells and a head of two layers, for m models side by side: every parameter has a leading axis of models."""

    ROWS = 2048

    def __init__(self, m: int, hidden: int, layers: int, rng: np.random.Generator) -> None:
        self.hidden, self.layers, s = hidden, layers, 1 / np.sqrt(hidden)
        draw = lambda *shape: rng.uniform(-s, s, shape)
        # one draw for all models, so that a model doesn't depend on which others are fitted beside it
        spread = lambda a: np.repeat(a[None], m, axis=0)
        self.p: dict[str, np.ndarray] = {}
        for k in range(layers):
            self.p |= {f"w{k}": spread(draw(1 if k == 0 else hidden, 4 * hidden)), f"u{k}": spread(draw(hidden, 4 * hidden)), f"b{k}": spread(draw(1, 4 * hidden))}
        self.p |= {"a": spread(draw(hidden, hidden // 2)), "c": spread(draw(1, hidden // 2)), "d": spread(draw(hidden // 2, 1)), "e": spread(draw(1, 1))}

    def forward(self, x: np.ndarray, drop: list[np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
        """x (models, rows, steps): outputs (models, rows), and what backward needs. drop: a mask for each layer but the last."""
        h, seq, kept = self.hidden, x[..., None], []
        for k in range(self.layers):
            hs, cs = np.zeros((*x.shape[:2], h)), np.zeros((*x.shape[:2], h))
            outs, gates, cells = [], [], [cs]
            for t in range(x.shape[2]):
                z = seq[:, :, t] @ self.p[f"w{k}"] + hs @ self.p[f"u{k}"] + self.p[f"b{k}"]
                i, f, o = (_sigmoid(z[..., j * h : (j + 1) * h]) for j in (0, 1, 3))
                g = np.tanh(z[..., 2 * h : 3 * h])
                cs = f * cs + i * g
                hs = o * np.tanh(cs)
                gates.append((i, f, g, o))
                cells.append(cs)
                outs.append(hs)
            out = np.stack(outs, axis=2)
            kept.append((seq, gates, cells, out))
            seq = out if drop is None or k == self.layers - 1 else out * drop[k]
        last = seq[:, :, -1]
        mid = last @ self.p["a"] + self.p["c"]
        return (np.maximum(mid, 0) @ self.p["d"] + self.p["e"])[..., 0], (kept, last, mid, drop)

    def infer(self, x: np.ndarray) -> np.ndarray:
        """forward's outputs for the rows (rows, steps) of one model, without what backward needs. ROWS at a time bound its memory; all gates
        come from one exponential, tanh(z) being 2 / (1 + exp(-2z)) - 1."""
        h, out = self.hidden, np.empty(len(x))
        turn = np.full(4 * h, -1.0)
        turn[2 * h : 3 * h] = -2.0  # the candidate is a tanh
        w, u, b = ([self.p[f"{n}{k}"][0] * turn for k in range(self.layers)] for n in "wub")
        with np.errstate(over="ignore"):
            for lo in range(0, len(x), self.ROWS):
                part = x[lo : lo + self.ROWS]
                hs, cs = (np.zeros((self.layers, len(part), h)) for _ in range(2))
                for t in range(part.shape[1]):
                    seq = part[:, t : t + 1]
                    for k in range(self.layers):
                        z = hs[k] @ u[k]
                        z += seq * w[k] if k == 0 else seq @ w[k]
                        z += b[k]
                        np.exp(z, out=z)
                        z += 1.0
                        np.reciprocal(z, out=z)
                        i, f, g, o = (z[:, j * h : (j + 1) * h] for j in range(4))
                        g *= 2.0
                        g -= 1.0
                        cs[k] *= f
                        cs[k] += i * g
                        th = np.exp(-2.0 * cs[k])
                        th += 1.0
                        np.divide(2.0, th, out=th)
                        th -= 1.0
                        np.multiply(o, th, out=hs[k])
                        seq = hs[k]
                mid = hs[-1] @ self.p["a"][0] + self.p["c"][0]
                out[lo : lo + self.ROWS] = (np.maximum(mid, 0) @ self.p["d"][0] + self.p["e"][0])[:, 0]
        return out

    def backward(self, dy: np.ndarray, memory: tuple) -> dict[str, np.ndarray]:
        """Gradients of the parameters for the outputs' gradient dy, back through time."""
        kept, last, mid, drop = memory
        h, turn = self.hidden, lambda a: a.transpose(0, 2, 1)
        dy = dy[..., None]
        grad = {"d": turn(np.maximum(mid, 0)) @ dy, "e": dy.sum(1, keepdims=True)}
        dmid = (dy @ turn(self.p["d"])) * (mid > 0)
        grad |= {"a": turn(last) @ dmid, "c": dmid.sum(1, keepdims=True)}
        above = np.zeros_like(kept[-1][3])
        above[:, :, -1] = dmid @ turn(self.p["a"])
        for k in reversed(range(self.layers)):
            seq, gates, cells, out = kept[k]
            if drop is not None and k < self.layers - 1:
                above = above * drop[k]
            below = np.zeros_like(seq)
            gw, gu, gb = (np.zeros_like(self.p[f"{n}{k}"]) for n in "wub")
            dh, dc = np.zeros_like(cells[0]), np.zeros_like(cells[0])
            for t in reversed(range(seq.shape[2])):
                i, f, g, o = gates[t]
                th = np.tanh(cells[t + 1])
                dh = dh + above[:, :, t]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate((dc * g * i * (1 - i), dc * cells[t] * f * (1 - f), dc * i * (1 - g * g), dh * th * o * (1 - o)), axis=-1)
                gw += turn(seq[:, :, t]) @ dz
                if t:
                    gu += turn(out[:, :, t - 1]) @ dz
                gb += dz.sum(1, keepdims=True)
                below[:, :, t] = dz @ turn(self.p[f"w{k}"])
                dh, dc = dz @ turn(self.p[f"u{k}"]), dc * f
            grad |= {f"w{k}": gw, f"u{k}": gu, f"b{k}": gb}
            above = below
        return grad


@dataclass(frozen=True)
class Recurrent:
    """One fitted network: x holds a row's last `steps` values, oldest first."""

    mean: float
    sd: float
    hidden: int
    layers: int
    p: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        net = Network(1, self.hidden, self.layers, np.random.default_rng(0))
        net.p = self.p
        z = np.nan_to_num((x - self.mean) / self.sd)
        return net.infer(z) * self.sd + self.mean


class RecurrentLearner:
    """An LSTM on scaled values, trained on runs of `steps` values and the next one: Adam on the mean squared error, batches shuffled by a seed.

    x is a row's last values, oldest first; a missing value counts as the mean. Runs without target are left out. Windows of one length train side by side.
    """

    def __init__(
        self, x: np.ndarray, y: np.ndarray, hidden: int = 32, layers: int = 2, dropout: float = 0.1, rate: float = 1e-3, epochs: int = 30, batch: int = 64, seed: int = 42
    ) -> None:
        self.x, self.y, self.hidden, self.layers, self.dropout, self.rate, self.epochs, self.batch, self.seed = x, y, hidden, layers, dropout, rate, epochs, batch, seed

    def fit(self, start: int, stop: int) -> Recurrent:
        return self.fit_all([(start, stop)])[0]

    def fit_all(self, windows: list[tuple[int, int]]) -> list[Recurrent]:
        """A network for each window; all windows have one length."""
        steps, m = self.x.shape[1], len(windows)
        n = windows[0][1] - windows[0][0]
        y = np.stack([self.y[a:b] for a, b in windows])
        with np.errstate(all="ignore"):
            known = ~np.isnan(y)
            mean = np.where(known, y, 0).sum(1) / np.maximum(known.sum(1), 1)
            sd = np.sqrt((np.where(known, y - mean[:, None], 0) ** 2).sum(1) / np.maximum(known.sum(1), 1))
        sd = np.where(sd < 1e-10, 1.0, sd)
        z = np.stack([self.x[a:b] for a, b in windows])
        z = np.nan_to_num((z - mean[:, None, None]) / sd[:, None, None])
        # a run must lie within its window
        known = known & (np.arange(n) >= steps)[None]
        goal = np.where(known, (np.nan_to_num(y) - mean[:, None]) / sd[:, None], 0.0)
        rng = np.random.default_rng(self.seed)
        net = Network(m, self.hidden, self.layers, rng)
        first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
        at, step = np.arange(steps, n), 0
        for _ in range(self.epochs if len(at) else 0):
            order = rng.permutation(at)
            for lo in range(0, len(order), self.batch):
                rows = order[lo : lo + self.batch]
                keep = 1 - self.dropout
                shape = (1, len(rows), steps, self.hidden)
                drop = [(rng.random(shape) < keep) / keep for _ in range(self.layers - 1)] if self.dropout else None
                out, memory = net.forward(z[:, rows], drop)
                ok = known[:, rows]
                grad = net.backward(2 * (out - goal[:, rows]) * ok / np.maximum(ok.sum(1, keepdims=True), 1), memory)
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    net.p[k] = net.p[k] - self.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return [Recurrent(float(mean[j]), float(sd[j]), self.hidden, self.layers, {k: v[j : j + 1].copy() for k, v in net.p.items()}) for j in range(m)]
