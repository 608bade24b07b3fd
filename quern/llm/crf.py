"""A linear-chain conditional random field in numpy.

Feature ids are given per token as rows of an integer matrix (-1 pads); the score of a label is
the sum of its weights over the token's features, plus a weight for each pair of neighbouring
labels. Training maximises the conditional log-likelihood by Adam on minibatches; decoding is
Viterbi over whole batches of sequences.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Crf:
    def __init__(self, n_features: int, n_labels: int):
        self.emit = np.zeros((n_features + 1, n_labels), dtype=np.float32)  # the last row, always 0, is the padding
        self.trans = np.zeros((n_labels, n_labels), dtype=np.float32)
        self.start = np.zeros(n_labels, dtype=np.float32)

    def gradient(self, feats: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood and its gradients for padded sequences: feats (B, T, F), labels (B, T).

        Forward and backward sums are kept as probabilities that are scaled at every step, so a
        step is one product with the exponentiated transitions.
        """
        b, t, _ = feats.shape
        k = self.trans.shape[0]
        scores = self.emit[feats].sum(axis=2).astype(np.float64)
        mask = np.arange(t)[None, :] < lengths[:, None]
        top = scores.max(axis=2, keepdims=True)
        e = np.where(mask[:, :, None], np.exp(scores - top), 1.0)
        step = np.exp(self.trans.astype(np.float64))
        alpha, beta, scale = np.empty((t, b, k)), np.ones((t, b, k)), np.ones((t, b))
        now = np.exp(self.start.astype(np.float64)) * e[:, 0]
        for i in range(t):
            if i:
                on = mask[:, i, None]
                now = np.where(on, (alpha[i - 1] @ step) * e[:, i], alpha[i - 1])
            scale[i] = now.sum(axis=1)
            alpha[i] = now / scale[i][:, None]
        for i in range(t - 2, -1, -1):
            back = (e[:, i + 1] * beta[i + 1]) @ step.T / scale[i + 1][:, None]
            beta[i] = np.where(mask[:, i + 1, None], back, beta[i + 1])
        prob = (alpha * beta).transpose(1, 0, 2)
        rows, cols = np.nonzero(mask)
        gold = labels[rows, cols]
        delta = -prob[rows, cols]
        delta[np.arange(len(gold)), gold] += 1
        flat = feats[rows, cols]
        real = flat != self.emit.shape[0] - 1
        ids, at = flat[real], np.nonzero(real)[0]
        g_emit = np.stack([np.bincount(ids, weights=delta[at, j], minlength=self.emit.shape[0]) for j in range(k)], axis=1)
        inner = mask[:, 1:]
        x, y = alpha[:-1].transpose(1, 0, 2)[inner], (e[:, 1:] * beta[1:].transpose(1, 0, 2) / scale[1:].T[:, :, None])[inner]
        pairs = np.bincount(labels[:, :-1][inner] * k + labels[:, 1:][inner], minlength=k * k).reshape(k, k)
        g_trans = pairs - step * (x.T @ y)
        g_start = np.bincount(labels[:, 0], minlength=k) - prob[:, 0].sum(axis=0)
        value = float(self.start[labels[:, 0]].sum() + scores[rows, cols, gold].sum() + (pairs * self.trans).sum() - np.log(scale).sum() - top[:, :, 0][mask].sum())
        return value, g_emit, g_trans, g_start

    def fit(self, sequences: Sequence[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.08, l2: float = 1e-4, batch: int = 64, seed: int = 0) -> Crf:
        rng = np.random.default_rng(seed)
        params = [self.emit, self.trans, self.start]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, steps = 0, epochs * -(-len(sequences) // batch)
        by_length = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
        blocks = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
        for _ in range(epochs):
            for at in rng.permutation(len(blocks)):
                feats, labels, lengths = padded([sequences[i] for i in blocks[at]], self.emit.shape[0] - 1)
                _, *grads = self.gradient(feats, labels, lengths)
                step += 1
                lr = rate * (1 - step / (steps + 1))
                for p, g, a, c in zip(params, grads, m, v):
                    g = g / len(lengths) - l2 * p
                    a *= 0.9
                    a += 0.1 * g
                    c *= 0.99
                    c += 0.01 * g * g
                    p += lr * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-6)
                self.emit[-1] = 0
        return self

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels (B, T) for label scores (B, T, K)."""
        b, t, k = scores.shape
        best = self.start + scores[:, 0]
        back = np.zeros((t, b, k), dtype=np.int8)
        for i in range(1, t):
            cand = best[:, :, None] + self.trans[None]
            back[i] = cand.argmax(axis=1)
            step = np.take_along_axis(cand, back[i][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[:, i]
            best = np.where((i < lengths)[:, None], step, best)
        out = np.zeros((b, t), dtype=np.int8)
        now = best.argmax(axis=1)
        rows = np.arange(b)
        for i in range(t - 1, -1, -1):
            on = i < lengths
            out[:, i] = np.where(on, now, 0)
            if i:
                now = np.where(on, back[i][rows, now], now)
        return out


def padded(sequences: Sequence[tuple[np.ndarray, np.ndarray]], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(y) for _, y in sequences])
    width = sequences[0][0].shape[1]
    feats = np.full((len(sequences), lengths.max(), width), pad, dtype=np.int64)
    labels = np.zeros((len(sequences), lengths.max()), dtype=np.int64)
    for i, (x, y) in enumerate(sequences):
        feats[i, : len(y)] = x
        labels[i, : len(y)] = y
    return feats, labels, lengths
