"""Forward and backward passes over many sequences at once."""

from __future__ import annotations

import numpy as np


class Chains:
    """Sequences of at least one item, laid out step by step: first the first items
    of all, longest sequence first, then the second items, and so on."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        steps = int(lengths.max()) if len(lengths) else 0
        self.active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=steps + 1))[:steps]
        self.offsets = np.r_[0, np.cumsum(self.active)]
        self.starts = np.cumsum(lengths) - lengths
        step = np.arange(lengths.sum()) - np.repeat(self.starts, lengths)
        # Where each item, in the order of its sequence, lies.
        self.place = self.offsets[step] + np.repeat(rank, lengths)

    def laid(self, items: np.ndarray) -> np.ndarray:
        out = np.empty_like(items)
        out[self.place] = items
        return out

    def sums(self, laid: np.ndarray) -> np.ndarray:
        """The sum over each sequence's items."""
        return np.add.reduceat(laid[self.place], self.starts) if len(self.starts) else laid

    def forward(self, emission: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state probabilities given all items so far, and the scales, whose
        product over a sequence is its likelihood."""
        alpha = np.empty_like(emission)
        scale = np.empty(len(emission))
        before = None
        for t, n in enumerate(self.active):
            a, b = self.offsets[t], self.offsets[t] + n
            now = emission[a:b] * (first if before is None else before[:n] @ moves)
            total = now.sum(1)
            now /= total[:, None]
            alpha[a:b], scale[a:b] = now, total
            before = now
        return alpha, scale

    def backward(self, emission: np.ndarray, moves: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """What follows an item weighs each of its states; times alpha, its marginals."""
        beta = np.ones_like(emission)
        back = moves.T
        for t in range(len(self.active) - 1, 0, -1):
            a, n = self.offsets[t], self.active[t]
            p = self.offsets[t - 1]
            beta[p : p + n] = ((emission[a : a + n] * beta[a : a + n]) / scale[a : a + n, None]) @ back
        return beta

    def forward_by_state(self, emission: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``forward`` of states by items, in place of ``emission``: long rows suit many sequences."""
        alpha, scale = emission, np.empty(emission.shape[1], emission.dtype)
        back, before = np.ascontiguousarray(moves.T), None
        for n, a in zip(self.active.tolist(), self.offsets.tolist(), strict=False):
            now = alpha[:, a : a + n]
            now *= first[:, None] if before is None else back @ before[:, :n]
            total = scale[a : a + n]
            now.sum(0, out=total)
            now /= total
            before = now
        return alpha, scale

    def marginals_by_state(
        self, alpha: np.ndarray, emission: np.ndarray, moves: np.ndarray, scale: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Each item's states given all items, in place of ``alpha``, and ``moved``; ``emission`` is used up."""
        met, after = np.zeros(moves.shape), None
        emission /= scale
        offsets = self.offsets.tolist()
        for t in range(len(self.active) - 1, -1, -1):
            now = alpha[:, offsets[t] : offsets[t + 1]]
            if after is not None:
                n = after.shape[1]
                met += now[:, :n] @ after.T
                beta = moves @ after
                now[:, :n] *= beta
            if t:
                after_now = emission[:, offsets[t] : offsets[t + 1]]
                if after is not None:
                    after_now[:, :n] *= beta
                after = after_now
        return alpha, moves * met

    def moved(self, alpha: np.ndarray, beta: np.ndarray, emission: np.ndarray, moves: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Expected numbers of moves between states."""
        if len(self.active) < 2:
            return np.zeros_like(moves)
        # Every item but the first ones lies active[t - 1] places behind the one before it.
        later = np.arange(self.offsets[1], len(alpha))
        earlier = later - np.repeat(self.active[:-1], self.active[1:])
        return moves * (alpha[earlier].T @ (emission[later] * beta[later] / scale[later, None]))
