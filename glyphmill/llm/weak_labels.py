"""Generative label models and linear scorers for weak supervision (driver side, numpy).

Both work on bounded inputs: a matrix of votes (1 yes, 0 no, -1 abstains), each row with
the number of texts that voted so, and sparse feature lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Share of a voter's entropy that another one must explain beyond the class for the two to be linked.
LINK = 0.3


def _index(votes: np.ndarray) -> np.ndarray:
    return np.where(votes < 0, 2, votes).astype(np.int64)


@dataclass
class LabelModel:
    """Class prior and P(vote | vote of the parent, class) per voter; ``parent`` is -1 for independent voters."""

    prior: float
    table: np.ndarray  # voters x 3 votes (0, 1, abstain) x 3 votes of the parent x 2 classes
    parent: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        index = _index(votes)
        m = index.shape[1]
        ratio = np.log(self.table[..., 1]) - np.log(self.table[..., 0])
        ratio[:, 2] = 0  # an abstention is no evidence
        of_parent = np.where(self.parent >= 0, index[:, np.maximum(self.parent, 0)], 0)
        z = np.log(self.prior / (1 - self.prior)) + ratio[np.arange(m), index, of_parent].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def accuracy_beliefs(votes: np.ndarray, prior: float, accuracy: np.ndarray | float) -> np.ndarray:
    """P(vote | class) tables (voters x 3 x 2) of voters that are right with ``accuracy`` when they speak.

    A voter that never says no speaks more often in its class.
    """
    m = votes.shape[1]
    index = np.where(votes < 0, 2, votes)
    talk = np.eye(3)[index].mean(axis=0) if len(votes) else np.full((m, 3), 1 / 3)
    accuracy = np.broadcast_to(np.asarray(accuracy, dtype=float), (m,))
    said = 1 - talk[:, 2]
    out = np.zeros((m, 3, 2))
    out[:, 1, 1], out[:, 0, 1] = accuracy * said, (1 - accuracy) * said
    out[:, 0, 0], out[:, 1, 0] = accuracy * said, (1 - accuracy) * said
    out[:, 2, :] = talk[:, 2, None]
    one_sided = (talk[:, 0] == 0) & (talk[:, 1] > 0)
    up = np.clip(talk[:, 1] * accuracy / max(prior, 1e-3), 0, 0.95)[one_sided]
    down = np.clip(talk[:, 1] * (1 - accuracy) / max(1 - prior, 1e-3), 0, 0.95)[one_sided]
    out[one_sided, 1, 1], out[one_sided, 2, 1] = up, 1 - up
    out[one_sided, 1, 0], out[one_sided, 2, 0] = down, 1 - down
    return np.clip(out, 1e-4, 1)


def labelled_beliefs(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """P(vote | class) tables as counted over labelled rows."""
    onehot = np.eye(3)[np.where(votes < 0, 2, votes)]
    out = np.stack([onehot[labels == y].sum(axis=0) + 0.3 * onehot.mean(axis=0) + 0.01 for y in (0, 1)], axis=2)
    return np.clip(out / out.sum(axis=1, keepdims=True), 1e-4, 1)


def dependence_tree(index: np.ndarray, believed: np.ndarray, prior: float, number: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Parent of each voter in the forest of strongest dependences; -1 for roots and voters not ``free``.

    Two voters depend on one another as far as their joint votes diverge from what the
    believed tables imply for voters that are independent given the class. No estimate
    of the class enters, for near-copies of one voter would have decided it already.
    """
    n, m = index.shape
    total = float(number.sum())
    shared = np.zeros((m, m))
    chosen = [(index == v).astype(np.float32) for v in range(3)]
    for a in range(3):
        weighted = (chosen[a] * number[:, None].astype(np.float32)).T
        for b in range(3):
            both = (weighted @ chosen[b]).astype(float) / total
            apart = prior * np.outer(believed[:, a, 1], believed[:, b, 1]) + (1 - prior) * np.outer(believed[:, a, 0], believed[:, b, 0])
            shared += np.where(both > 0, both * np.log(np.where(both > 0, both, 1) / apart), 0.0)
    often = np.stack([number @ c for c in chosen], axis=1) / total
    entropy = -(often * np.log(np.maximum(often, 1e-12))).sum(axis=1)
    shared -= 4 / (2 * total)  # what chance gives two voters of three votes
    shared = np.maximum(shared, 0) / np.maximum(np.minimum.outer(entropy, entropy), 1e-9)
    shared[~free] = shared[:, ~free] = 0
    np.fill_diagonal(shared, 0)
    parent = np.full(m, -1)
    done = np.zeros(m, dtype=bool)
    for root in np.argsort(-shared.sum(axis=1), kind="stable"):
        if done[root] or not free[root]:
            continue
        done[root] = True
        best, via = np.where(done, -1.0, shared[root]), np.full(m, root)
        while best.max() > LINK:
            new = int(best.argmax())
            parent[new], done[new] = via[new], True
            closer = (shared[new] > best) & ~done
            best, via = np.where(closer, shared[new], best), np.where(closer, new, via)
            best[done] = -1.0
    return parent


def fit_label_model(votes: np.ndarray, prior: float, believed: np.ndarray, rounds: int = 30, strength: float = 10.0, prior_weight: float = 0.0, apart: tuple[int, ...] = (), number: np.ndarray | None = None) -> LabelModel:
    """Expectation-maximisation for the accuracies and correlations of voters.

    ``believed`` (P(vote | class), as ``strength`` pseudo votes) decides which class is
    which; ``number`` says how many texts voted as a row does. Each voter's votes are
    modelled given those of its parent in the forest of strongest dependences, whose
    tables are estimated as well: a near-copy of another voter adds next to nothing.
    Voters ``apart`` (such as the silence of all others, which depends on them by
    definition) stay independent.
    """
    n, m = votes.shape
    number = np.ones(n) if number is None else number.astype(float)
    index = _index(votes)
    free = (votes >= 0).any(axis=0)
    free[list(apart)] = False
    believed = np.clip(believed, 1e-4, 1)
    independent = np.repeat(believed[:, :, None, :], 3, axis=2)
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    parent = dependence_tree(index, believed, prior, number, free)
    of_parent = np.where(parent >= 0, index[:, np.maximum(parent, 0)], 0)
    cell = ((np.arange(m) * 3 + index) * 3 + of_parent).ravel()
    #: At the start a vote beside one of its parent's says nothing; where the parent abstains, what is believed.
    together = np.bincount(cell, np.repeat(number, m), minlength=9 * m).reshape(m, 3, 3) + 0.01
    given = np.repeat((together / together.sum(axis=1, keepdims=True))[..., None], 2, axis=3)
    given[:, :, 2, :] = believed
    model = LabelModel(prior, np.where((parent >= 0)[:, None, None, None], np.clip(given, 1e-4, 1), independent), parent)
    for _ in range(rounds):
        p = model.posterior(votes)
        table = np.empty((m, 3, 3, 2))
        for y, q in ((1, p), (0, 1 - p)):
            counts = np.bincount(cell, np.repeat(q * number, m), minlength=9 * m).reshape(m, 3, 3)
            #: Beliefs are spread over the parent's votes as often as it votes so.
            often = counts.sum(axis=1, keepdims=True) / np.maximum(counts.sum(axis=(1, 2), keepdims=True), 1e-9)
            alone = counts.sum(axis=2, keepdims=True) + strength * believed[:, :, None, y]
            counts = counts + (strength * often + 1.0) * alone / alone.sum(axis=1, keepdims=True)
            table[..., y] = counts / counts.sum(axis=1, keepdims=True)
        model.table = np.clip(table, 1e-4, 1)
        model.prior = float(np.clip(((p * number).sum() + prior_weight * prior) / max(1e-9, number.sum() + prior_weight), 1e-3, 1 - 1e-3))
    return model


def fit_linear(rows: list[np.ndarray], values: list[np.ndarray] | None, target: np.ndarray, size: int, weight: np.ndarray, epochs: int = 60, rate: float = 0.3, decay: float = 1e-4, seed: int = 4, bias: float = 0.0) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows (indices, optional values) and soft targets, by AdaGrad over mini-batches."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    b2 = 1e-8
    counts = np.array([len(r) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            if not len(pick):
                continue
            index = np.concatenate([rows[i] for i in pick]) if counts[pick].sum() else np.zeros(0, dtype=np.int64)
            value = np.concatenate([values[i] for i in pick]) if values is not None and counts[pick].sum() else np.ones(len(index))
            row = np.repeat(np.arange(len(pick)), counts[pick])
            z = bias + np.bincount(row, w[index] * value, minlength=len(pick))
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[pick]) * weight[pick]
            grad = np.bincount(index, miss[row] * value, minlength=size)
            touched = np.unique(index)
            grad = grad[touched] / len(pick) + decay * w[touched]
            g2[touched] += grad * grad
            w[touched] -= rate * grad / np.sqrt(g2[touched])
            gb = miss.mean()
            b2 += gb * gb
            bias -= rate * gb / np.sqrt(b2)
    return w, float(bias)
