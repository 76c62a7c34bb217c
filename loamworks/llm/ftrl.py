"""FTRL-proximal logistic regression over hashed features: rates by coordinate, L1 for sparse weights."""

import numpy as np

ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.5, 1.0
#: Rows of a step, passes over the rows.
STEP, PASSES = 32, 3


class Ftrl:
    """The state of each coordinate; the last one is the bias, which L1 spares."""

    def __init__(self, bits: int, l1: float = L1) -> None:
        self.bias, self.l1 = 1 << bits, l1
        self.z, self.n = np.zeros(self.bias + 1), np.zeros(self.bias + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def fit(self, at: np.ndarray, offsets: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> None:
        """One step of rows, given as the features of all and where those of each start."""
        own = np.repeat(np.arange(len(targets)), np.diff(offsets))
        at, own = np.concatenate([at, np.full(len(targets), self.bias)]), np.concatenate([own, np.arange(len(targets))])
        distinct, place = np.unique(at, return_inverse=True)
        w = self.weights(distinct)
        margin = np.bincount(own, w[place], len(targets))
        g = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - targets) * weights)[own]
        total, square = np.bincount(place, g), np.bincount(place, g * g)
        rate = (np.sqrt(self.n[distinct] + square) - np.sqrt(self.n[distinct])) / ALPHA
        self.z[distinct] += total - rate * w
        self.n[distinct] += square


def fitted(at: np.ndarray, offsets: np.ndarray, targets: np.ndarray, weights: np.ndarray, bits: int, passes: int = PASSES, l1: float = L1) -> tuple[np.ndarray, float]:
    """Weights and bias from rows with targets; those of weight 0 and without a feature are left out."""
    model, rng = Ftrl(bits, l1), np.random.default_rng(7)
    use = np.flatnonzero((weights > 0) & (np.diff(offsets) > 0))
    for _ in range(passes):
        order = rng.permutation(use)
        for k in range(0, len(order), STEP):
            rows = order[k : k + STEP]
            n = offsets[rows + 1] - offsets[rows]
            ends = np.cumsum(n)
            flat = np.repeat(offsets[rows] - (ends - n), n) + np.arange(n.sum())
            model.fit(at[flat], np.concatenate([[0], ends]), targets[rows], weights[rows])
    w = model.weights(np.arange(model.bias + 1))
    return w[:-1].astype(np.float32), float(w[-1])
