"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding in batches.

Both directions run in one loop over time, as one batch of two.
"""

from __future__ import annotations

import numpy as np

PAD = 0


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    def __init__(self, symbols: int, labels: int, hidden: int = 16, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.h, self.n_labels = hidden, labels
        bias = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)  # forget gates start open
        self.p = {
            "w": r.normal(0, 0.3, (2, symbols, 4 * hidden)) + bias,
            "u": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
            "out": r.normal(0, 0.3, (2 * hidden, labels)),
            "bias": np.zeros(labels),
            "trans": np.zeros((labels, labels)),
            "first": np.zeros(labels),
        }

    def _lstm(self, x: np.ndarray, keep: bool):
        """Hidden states (time, batch, 2 * hidden) over symbols (batch, time), and what training needs."""
        n, t = x.shape
        h, u = self.h, self.p["u"]
        both = np.stack([x.T, x.T[::-1]], axis=1)  # (time, direction, batch); the second one runs backwards
        state, cell = np.zeros((2, n, h), u.dtype), np.zeros((2, n, h), u.dtype)
        hs, tape = np.empty((t, 2, n, h), u.dtype), []
        for k in range(t):
            z = np.stack([self.p["w"][0][both[k, 0]], self.p["w"][1][both[k, 1]]]) + state @ u
            gates, g = _sigmoid(z[:, :, : 3 * h]), np.tanh(z[:, :, 3 * h :])
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            before, old = state, cell
            cell = f * cell + i * g
            tanh = np.tanh(cell)
            state = o * tanh
            hs[k] = state
            if keep:
                tape.append((i, f, o, g, tanh, old, before))
        return np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2), both, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        hidden, both, tape = self._lstm(x, keep)
        return hidden @ self.p["out"] + self.p["bias"], (hidden, both, tape)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the label sequences, and its gradients."""
        n, t = x.shape
        e, (hidden, both, tape) = self.emissions(x, keep=True)
        trans, first = self.p["trans"], self.p["first"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = first + e[0]
        for k in range(1, t):
            alpha[k] = _logsumexp(alpha[k - 1][:, :, None] + trans, 1) + e[k]
        for k in range(t - 2, -1, -1):
            beta[k] = _logsumexp(trans + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        log_z = _logsumexp(alpha[-1], 1)
        rows, times, grad = np.arange(n), np.arange(t), {k: np.zeros_like(v) for k, v in self.p.items()}
        gold = first[y[:, 0]] + e[times[:, None], rows, y.T].sum(0) + trans[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - log_z[None, :, None])
        grad["first"] = de[0].sum(0) - np.bincount(y[:, 0], minlength=self.n_labels).astype(de.dtype)
        pairs = alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None]
        grad["trans"] = np.exp(pairs).sum((0, 1))
        np.add.at(grad["trans"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
        de[times[:, None], rows, y.T] -= 1.0
        grad["out"] = np.tensordot(hidden, de, axes=([0, 1], [0, 1]))
        grad["bias"] = de.sum((0, 1))
        self._back(both, tape, de @ self.p["out"].T, grad)
        return float((log_z - gold).mean()), {k: v / n for k, v in grad.items()}

    def _back(self, both, tape, dhidden, grad) -> None:
        h, u, t, n = self.h, self.p["u"], len(tape), both.shape[2]
        dh = np.stack([dhidden[:, :, :h], dhidden[::-1, :, h:]], axis=1)
        dstate, dcell, dz = np.zeros((2, n, h), u.dtype), np.zeros((2, n, h), u.dtype), np.empty((t, 2, n, 4 * h), u.dtype)
        back = u.transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            i, f, o, g, tanh, old, _ = tape[k]
            dstate = dstate + dh[k]
            dcell = dcell + dstate * o * (1 - tanh * tanh)
            dz[k] = np.concatenate([dcell * g * i * (1 - i), dcell * old * f * (1 - f), dstate * tanh * o * (1 - o), dcell * i * (1 - g * g)], axis=2)
            dstate, dcell = dz[k] @ back, dcell * f
        before = np.stack([step[6] for step in tape])
        symbols = np.arange(self.p["w"].shape[1])
        for d in (0, 1):
            flat = dz[:, d].reshape(t * n, 4 * h)
            grad["u"][d] = before[:, d].reshape(t * n, h).T @ flat
            grad["w"][d] = (symbols[:, None] == both[:, d].reshape(1, t * n)).astype(flat.dtype) @ flat

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches, in single precision; the losses of the epochs."""
        self.slim()
        r, losses, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for epoch in range(epochs):
            order, total = r.permutation(len(x)), 0.0
            lr = rate * (1 - epoch / epochs) + 0.001
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                value, grad = self.loss(x[rows], y[rows])
                total += value * len(rows)
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / len(x))
        return losses

    def slim(self) -> BiLstmCrf:
        """In single precision."""
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best labels (batch, time) for emissions (time, batch, labels)."""
        t, n, _ = e.shape
        back, best = np.zeros((t, n, self.n_labels), np.int8), self.p["first"] + e[0]
        for k in range(1, t):
            options = best[:, :, None] + self.p["trans"]
            back[k] = options.argmax(1)
            best = options.max(1) + e[k]
        labels = np.zeros((n, t), np.int8)
        labels[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for k in range(t - 1, 0, -1):
            labels[:, k - 1] = back[k][rows, labels[:, k]]
        return labels
