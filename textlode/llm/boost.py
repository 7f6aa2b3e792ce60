"""Gradient-boosted trees for a two-class target.

Growing needs only sums of gradients by node, feature and bin, so rows may lie anywhere: ``grow`` asks for the sums of all rows level by level, from arrays
(``fit``) or from a table whose tasks each give the sums of their rows.  Gradients are summed as whole numbers, so the order of rows does not matter.
"""

import numpy as np

#: Whole numbers that a gradient of 1 counts; sums of 2**29 rows are exact.
UNIT = float(1 << 24)
#: A slot that no code passes.
NONE = 255


class Trees:
    """Logistic boosting of depth-limited trees with quantile splits and second-order leaf values."""

    def __init__(self, rounds=40, depth=3, rate=0.3, bins=16, penalty=1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.base, self.cuts, self.weights = 0.0, [], (1.0, 1.0)
        inner = (1 << depth) - 1
        self.feature, self.slot = np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner), dtype=np.int64)
        self.leaf = np.zeros((0, inner + 1))

    def quantiles(self) -> list[float]:
        return np.linspace(0, 1, self.bins + 1)[1:-1].tolist()

    def fit(self, x: np.ndarray, y: np.ndarray):
        codes = self.prepare([np.quantile(x[:, j], self.quantiles()) for j in range(x.shape[1])], float(y.mean())).codes(x)
        return self.grow(lambda trees, level: trees.sums(codes, y, np.ones(len(y), dtype=np.int64), level))

    def prepare(self, cuts, mean: float, weights=(1.0, 1.0)):
        """Splits are looked for at ``cuts``, values by feature; ``mean`` is the share of label 1, ``weights`` those of a row of label 0 and 1."""
        self.cuts = [np.unique(c) for c in cuts]
        mean = np.clip(mean, 1e-3, 1 - 1e-3)
        self.base, self.weights = float(np.log(mean / (1 - mean))), weights
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Of each value, the number of its feature's cuts below it."""
        return np.stack([np.searchsorted(at, x[:, j]) for j, at in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def grow(self, sums):
        """``sums(self, level)``: what ``sums`` below gives, added up over all rows."""
        for _ in range(self.rounds):
            self._add_tree()
            open_nodes = [0]
            for level in range(self.depth):
                total = sums(self, level)
                open_nodes = [child for node in open_nodes for child in self._split(level, node, total[node])]
                if not open_nodes:
                    break
        return self

    def _add_tree(self):
        inner = self.feature.shape[1]
        self.feature = np.vstack([self.feature, np.zeros((1, inner), dtype=np.int64)])
        self.slot = np.vstack([self.slot, np.full((1, inner), NONE)])
        self.leaf = np.vstack([self.leaf, np.zeros((1, inner + 1))])

    def _split(self, level, node, total):
        """Splits node ``node`` of a level of the last tree, or makes it a leaf; its children that may be split in turn."""
        count, w = total[..., 2, :].sum(-1), np.array(self.weights)
        g, h = total[..., 0, :] @ w / UNIT, total[..., 1, :] @ w / UNIT
        all_g, all_h = g[0].sum(), h[0].sum()
        left_g, left_h, left_n = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h, count))
        gain = (left_g ** 2 / (left_h + self.penalty) + (all_g - left_g) ** 2 / (all_h - left_h + self.penalty) - all_g ** 2 / (all_h + self.penalty))
        at = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else None
        if count[0].sum() < 4 or at is None or gain[at] <= 1e-6:
            self._value(level, node, all_g, all_h)
            return []
        place = (1 << level) - 1 + node
        self.feature[-1, place], self.slot[-1, place] = at
        if level + 1 == self.depth:
            self._value(level + 1, 2 * node, left_g[at], left_h[at])
            self._value(level + 1, 2 * node + 1, all_g - left_g[at], all_h - left_h[at])
            return []
        return [2 * node, 2 * node + 1]

    def _value(self, level, node, g, h):
        self.leaf[-1, node << (self.depth - level)] = self.rate * g / (h + self.penalty)  # ended ways go left

    def _nodes(self, codes, levels, trees):
        """The node of a level that each row (of ``codes``) comes to in each of some trees."""
        rows = np.arange(len(codes))[:, None]
        feature, slot = self.feature[trees], self.slot[trees]
        own, node = np.arange(len(feature)), np.zeros((len(codes), len(feature)), dtype=np.int64)
        for level in range(levels):
            place = node + (1 << level) - 1
            node = 2 * node + (codes[rows, feature[own, place]] > slot[own, place])
        return node

    def score_codes(self, codes: np.ndarray, trees=slice(None), most=1 << 14) -> np.ndarray:
        out = [np.zeros(0)]
        leaf = self.leaf[trees]
        for lo in range(0, len(codes), most):
            node = self._nodes(codes[lo:lo + most], self.depth, trees)
            out.append(self.base + leaf[np.arange(len(leaf)), node].sum(axis=1))
        return 1 / (1 + np.exp(-np.concatenate(out)))

    def sums(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray, level: int) -> np.ndarray:
        """(node, feature, bin, 3, label): gradients and second derivatives in ``UNIT``, and rows, at a level of the last tree; ``n`` rows each."""
        p = self.score_codes(codes, slice(0, -1))
        node = self._nodes(codes, level, slice(-1, None))[:, 0]
        width, size = max(map(len, self.cuts)) + 1, 1 << level
        values = np.rint((y - p) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n, n.astype(float)
        out = np.zeros((size, len(self.cuts), width, 3, 2))
        for j in range(len(self.cuts)):
            cell = (node * width + codes[:, j]) * 2 + y
            for k, v in enumerate(values):
                out[:, j, :, k] = np.bincount(cell, v, size * width * 2).reshape(size, width, 2)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.score_codes(self.codes(x))
