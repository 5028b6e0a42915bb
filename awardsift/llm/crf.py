"""A linear-chain conditional random field with two labels over sets of named features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Feature weights (score of label 1 over label 0), transitions by (label, next label), and scores of the first and last label."""

    weights: dict[str, float]
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The best sequence of labels (Viterbi)."""
        if not blocks:
            return []
        get = self.weights.get
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = self.first.tolist()
        b += sum(get(f, 0.0) for f in blocks[0])
        back = []
        for block in blocks[1:]:
            own = sum(get(f, 0.0) for f in block)
            x, y = a + m00, b + m10
            u, v = a + m01, b + m11
            back.append((x < y, u < v))
            a, b = max(x, y), max(u, v) + own
        label = int(a + self.last[0] < b + self.last[1])
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Chain:
    """Maximise the penalised likelihood of labelled sequences by gradients from forward and backward sums."""
    pages = [p for p in pages if p[0]]
    ids: dict[str, int] = {}
    lengths = np.array([len(blocks) for blocks, _ in pages])
    flat = [[ids.setdefault(f, len(ids)) for f in block] for blocks, _ in pages for block in blocks]
    owner = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    feature = np.array([k for x in flat for k in x])
    gold = np.array([y for _, labels in pages for y in labels])
    page = np.repeat(np.arange(len(pages)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size, longest = len(pages), int(lengths.max())
    inside = np.arange(longest)[None, :] < lengths[:, None]
    label = np.zeros((size, longest), np.int64)
    label[page, place] = gold
    both = inside[:, 1:]
    ends = (np.arange(size), lengths - 1)
    observed = [np.array([[(both & (label[:, :-1] == i) & (label[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)]),
                np.array([(label[:, 0] == i).sum() for i in (0, 1)]), np.array([(label[ends] == i).sum() for i in (0, 1)])]
    w, moves, first, last = np.zeros(len(ids)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)
    squares = [np.full(x.shape, 1e-6) for x in (w, moves, first, last)]
    for _ in range(rounds):
        score = np.zeros((size, longest, 2))
        score[page, place, 1] = np.bincount(owner, w[feature], len(flat))
        ahead = np.zeros((size, longest, 2))
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            new = _sum_exp(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
            ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
        total = _sum_exp(ahead[:, -1] + last, 1)
        behind = np.tile(last, (size, longest, 1))
        pair = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            onward = score[:, t + 1] + behind[:, t + 1]
            new = _sum_exp(moves + onward[:, None, :], 2)
            go = inside[:, t + 1]
            behind[:, t] = np.where(go[:, None], new, behind[:, t])
            chance = np.exp(ahead[:, t, :, None] + moves + onward[:, None, :] - total[:, None, None])
            pair += chance[go].sum(axis=0)
        chance = np.exp(ahead + behind - total[:, None, None])
        one = chance[page, place, 1]
        slopes = [np.bincount(feature, (one - gold)[owner], len(ids)) / size + decay * w, (pair - observed[0]) / size + decay * moves,
                  (chance[:, 0].sum(axis=0) - observed[1]) / size, (chance[ends].sum(axis=0) - observed[2]) / size]
        for value, slope, square in zip((w, moves, first, last), slopes, squares):
            square += slope * slope
            value -= rate * slope / np.sqrt(square)
    return Chain({name: float(w[k]) for name, k in ids.items()}, moves, first, last)
