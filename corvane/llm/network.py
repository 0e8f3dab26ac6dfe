"""A bidirectional window network in numpy: a word from the words on both sides, by a tree of three choices.

h = tanh(sum of the embeddings of the neighbours, by place); then a class of words, a group of that class and a
word of that group, each by a softmax over the same number of branches. The vocabulary has branches ** 3 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 2
HIDDEN = 16
BATCH = 16384
RATE = 0.1
#: Inputs of a softmax stay within these bounds, so exp() of float32 neither overflows nor vanishes.
LIMIT = 40.0


class Network:
    """The weights lie in one flat vector of float32; attributes are views into it."""

    def __init__(self, branches: int, flat: np.ndarray | None = None):
        self.branches, self.size = branches, branches**3
        b, wide = branches, HIDDEN + 1  # the last input of each choice is 1
        shapes = {"context": (2 * WINDOW, self.size + 1, HIDDEN), "bias": (HIDDEN,), "first": (1, wide, b), "second": (b, wide, b), "third": (b * b, wide, b)}
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else flat
        for (name, shape), end, n in zip(shapes.items(), np.cumsum(sizes), sizes, strict=True):
            setattr(self, name, self.flat[end - n : end].reshape(shape))
        self.tree = (self.first, self.second, self.third)

    @classmethod
    def initial(cls, branches: int) -> Network:
        out, rng = cls(branches), np.random.default_rng(8)
        out.context[:] = rng.normal(0, 0.1, out.context.shape)
        for level in out.tree:
            level[:, :HIDDEN] = rng.normal(0, 0.1, level[:, :HIDDEN].shape)
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """h with the constant behind it, for rows of neighbours."""
        h = np.ones((len(context), HIDDEN + 1), np.float32)
        places = np.ascontiguousarray(context.T).astype(np.intp)
        total = self.context[0].take(places[0], 0)
        for j in range(1, 2 * WINDOW):
            total += self.context[j].take(places[j], 0)
        np.tanh(total + self.bias, out=h[:, :HIDDEN])
        return h

    def choices(self, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: its weights, the nodes present, where each one's rows begin and the branch taken by each row.

        target is sorted, so that rows of one node lie together.
        """
        b, t = self.branches, target.astype(np.int64)
        for level, below in zip(self.tree, (b * b, b, 1), strict=True):
            node = t // (below * b)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(t)]])
            yield level, node[cuts[:-1]], cuts, t // below % b

    def log_probabilities(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its neighbours."""
        out = np.empty(len(target), np.float64)
        for a in range(0, len(target), BATCH):
            order = np.argsort(target[a : a + BATCH], kind="stable")
            t, h = target[a : a + BATCH][order], self.hidden(context[a : a + BATCH][order])
            total, rows, ones = np.zeros(len(t), np.float32), np.arange(len(t)), np.ones(self.branches, np.float32)
            for level, nodes, cuts, branch in self.choices(t):
                z = np.empty((len(t), self.branches), np.float32)
                for k, i, j in zip(nodes.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                    np.matmul(h[i:j], level[k], out=z[i:j])
                np.clip(z, -LIMIT, LIMIT, out=z)
                total += z[rows, branch] - np.log(np.exp(z) @ ones)
            out[a + order] = total
        return out

    def _backward(self, target: np.ndarray, context: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Gradients of the summed negative log-probabilities: of the tree's levels, of the bias, and (words, rows) of each place."""
        order = np.argsort(target, kind="stable")
        t, x = target[order], context[order]
        h, rows = self.hidden(x), np.arange(len(t))
        back, ones = np.zeros((len(t), HIDDEN), np.float32), np.ones(self.branches, np.float32)
        part = np.empty_like(back)
        tree = [np.zeros_like(level) for level in self.tree]
        for (level, nodes, cuts, branch), g in zip(self.choices(t), tree, strict=True):
            z = np.empty((len(t), self.branches), np.float32)
            spans = list(zip(nodes.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False))
            for k, i, j in spans:
                np.matmul(h[i:j], level[k], out=z[i:j])
            np.clip(z, -LIMIT, LIMIT, out=z)
            np.exp(z, out=z)
            z /= (z @ ones)[:, None]
            z[rows, branch] -= 1
            turned = np.ascontiguousarray(level[:, :HIDDEN].transpose(0, 2, 1))
            for k, i, j in spans:
                np.matmul(h[i:j].T, z[i:j], out=g[k])
                np.matmul(z[i:j], turned[k], out=part[i:j])
            back += part
        back *= 1 - h[:, :HIDDEN] ** 2
        places = []
        for j in range(2 * WINDOW):
            by = np.argsort(x[:, j], kind="stable")
            ids = x[by, j]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
            places.append((ids[cuts].astype(np.intp), np.add.reduceat(back.take(by, 0), cuts, axis=0)))
        return tree, back.sum(0), places

    def gradient(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Gradient of the summed negative log-probabilities by all weights, flat."""
        grad = Network(self.branches)
        tree, grad.bias[:], places = self._backward(target, context)
        for mine, g in zip(grad.tree, tree, strict=True):
            mine[:] = g
        for j, (ids, g) in enumerate(places):
            grad.context[j][ids] = g
        return grad.flat

    def train(self, squares: np.ndarray, target: np.ndarray, context: np.ndarray) -> None:
        """Adagrad steps over the targets, in place; squares: the sums of squared gradients so far. Of the embeddings only those of words that occur move."""
        sums = Network(self.branches, squares)

        def step(grad, size):
            grad /= np.float32(np.sqrt(size))
            return grad

        for a in range(0, len(target), BATCH):
            n = len(target[a : a + BATCH])
            tree, bias, places = self._backward(target[a : a + BATCH], context[a : a + BATCH])
            for w, total, g in zip((*self.tree, self.bias), (*sums.tree, sums.bias), (*tree, bias), strict=True):
                g = step(g, n)
                total += g * g
                w -= np.float32(RATE) * g / np.sqrt(total + np.float32(1e-6))
            for j, (ids, g) in enumerate(places):
                g = step(g, n)
                total = sums.context[j].take(ids, 0) + g * g
                sums.context[j][ids] = total
                self.context[j][ids] -= np.float32(RATE) * g / np.sqrt(total + np.float32(1e-6))


def windows(ids: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(target, context) of all words of some documents; a place outside of the document holds the pad."""
    gap = np.full(WINDOW, pad, np.uint32 if pad > 65_535 else np.uint16)
    padded = np.concatenate([gap, *(x for i in ids for x in (i, gap))])
    at = np.flatnonzero(padded != pad)
    return padded[at], np.stack([padded[at + d] for d in range(-WINDOW, WINDOW + 1) if d], 1)
