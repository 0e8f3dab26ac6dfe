"""A convolutional network over bytes, in numpy: forward, gradient and Adam steps.

A text is its UTF-8 bytes, cut into chunks of CHUNK bytes of which neighbours share OVERLAP; the last one is padded.
Bytes have learned vectors; FILTERS of WIDTH bytes slide over a chunk by STRIDE; each keeps its largest answer, and
a hidden layer reads those of a chunk, with how full the chunk is. Over all chunks of a text the hidden values'
largest and their mean give one probability.
"""

from __future__ import annotations

import numpy as np

CHUNK, OVERLAP = 256, 16
WIDTH, STRIDE = 8, 2
FILTERS, HIDDEN, DIM = 32, 24, 8
PAD = 256
#: Chunks that are computed at a time.
BLOCK = 1024

SHAPES = {
    "bytes": (PAD + 1, DIM),
    "filters": (WIDTH * DIM, FILTERS),
    "filter_bias": (FILTERS,),
    "hidden": (FILTERS + 1, HIDDEN),
    "hidden_bias": (HIDDEN,),
    "out": (2 * HIDDEN,),
    "out_bias": (1,),
}


def chunk_places(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, valid bytes, text) of the chunks of texts at starts with sizes bytes; an empty text has an empty one."""
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    of = np.repeat(np.arange(len(sizes)), counts)
    within = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return starts[of] + within, np.minimum(CHUNK, sizes[of] - within), of


def chunk_bytes(raw: np.ndarray, place: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Rows of CHUNK bytes, PAD where a chunk has none."""
    at = place[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < valid[:, None]
    x = np.full(at.shape, PAD, np.int16)
    x[inside] = raw[at[inside]]
    return x


class ByteNet:
    """The weights, as one flat vector with a view for each layer."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 0):
        size = sum(int(np.prod(s)) for s in SHAPES.values())
        self.flat = np.zeros(size, np.float32) if flat is None else np.ascontiguousarray(flat, np.float32)
        at = 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        if flat is None:
            rng = np.random.default_rng(seed)
            self.bytes[:] = rng.normal(0, 0.5, self.bytes.shape)
            self.bytes[PAD] = 0
            for w, fan in ((self.filters, WIDTH * DIM), (self.hidden, FILTERS), (self.out, 2 * HIDDEN)):
                w[:] = rng.normal(0, fan**-0.5, w.shape)

    def answers(self, x: np.ndarray) -> np.ndarray:
        """Filters' answers for rows of bytes: chunks by places by filters, without bias."""
        n, steps = len(x), CHUNK // STRIDE
        parts = WIDTH // STRIDE
        blocks = self.bytes[x].reshape(n * steps, STRIDE * DIM)
        # the filters' parts side by side: each block of STRIDE bytes meets every part in one product
        w = self.filters.reshape(parts, STRIDE * DIM, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DIM, parts * FILTERS)
        product = (blocks @ w).reshape(n, steps, parts, FILTERS)
        places = steps - parts + 1
        total = product[:, :places, 0].copy()
        for j in range(1, parts):
            total += product[:, j : j + places, j]
        return total

    def chunks(self, x: np.ndarray, valid: np.ndarray):
        """(hidden values, their inputs, places of the filters' largest answers) of chunks."""
        answers = self.answers(x)
        where = answers.argmax(1)
        best = np.take_along_axis(answers, where[:, None], 1)[:, 0]
        inputs = np.empty((len(x), FILTERS + 1), np.float32)
        inputs[:, :-1] = np.maximum(best + self.filter_bias, 0)
        inputs[:, -1] = valid / CHUNK
        return np.tanh(inputs @ self.hidden + self.hidden_bias), inputs, where

    def hidden_values(self, raw: np.ndarray, place: np.ndarray, valid: np.ndarray) -> np.ndarray:
        out = np.empty((len(place), HIDDEN), np.float32)
        for a in range(0, len(place), BLOCK):
            s = slice(a, a + BLOCK)
            x = chunk_bytes(raw, place[s], valid[s])
            out[s] = np.tanh(self._inputs(x, valid[s]) @ self.hidden + self.hidden_bias)
        return out

    def _inputs(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        best = self.answers(x).max(1)
        return np.hstack([np.maximum(best + self.filter_bias, 0), (valid / CHUNK).astype(np.float32)[:, None]])

    def probabilities(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts that stand in raw at starts with sizes bytes each."""
        if not len(sizes):
            return np.zeros(0)
        place, valid, of = chunk_places(starts, sizes)
        h = self.hidden_values(raw, place, valid)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        mean = np.add.reduceat(h, first, axis=0) / np.diff(np.append(first, len(of)))[:, None]
        z = np.hstack([np.maximum.reduceat(h, first, axis=0), mean]).astype(float) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
        """(gradient of the mean cross entropy, that mean) over the texts."""
        grad = ByteNet(np.zeros_like(self.flat))
        place, valid, of = chunk_places(starts, sizes)
        x = chunk_bytes(raw, place, valid)
        h, inputs, where = self.chunks(x, valid)
        n, first = len(sizes), np.flatnonzero(np.diff(of, prepend=-1))
        counts = np.diff(np.append(first, len(of)))
        top = np.maximum.reduceat(h, first, axis=0)
        read = np.hstack([top, np.add.reduceat(h, first, axis=0) / counts[:, None]])
        z = read @ self.out + self.out_bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-12))
        dz = ((p - labels) / n).astype(np.float32)
        grad.out[:] = read.T @ dz
        grad.out_bias[:] = dz.sum()
        is_top = (h == top[of]).astype(np.float32)  # ties share
        is_top /= np.add.reduceat(is_top, first, axis=0)[of]
        dh = is_top * (dz[of, None] * self.out[:HIDDEN]) + (dz / counts)[of, None] * self.out[HIDDEN:]
        dh *= 1 - h * h
        grad.hidden[:] = inputs.T @ dh
        grad.hidden_bias[:] = dh.sum(0)
        dbest = (dh @ self.hidden.T)[:, :-1] * (inputs[:, :-1] > 0)
        grad.filter_bias[:] = dbest.sum(0)
        # only the windows with the largest answers have a gradient
        at = where[:, :, None] * STRIDE + np.arange(WIDTH)
        window = x[np.arange(len(x))[:, None, None], at]  # chunks, filters, bytes
        seen = self.bytes[window].reshape(len(x), FILTERS, WIDTH * DIM)
        grad.filters[:] = np.einsum("cf,cfk->kf", dbest, seen, optimize=True)
        back = dbest[:, :, None] * self.filters.T[None]
        flat, back = window.ravel(), back.reshape(-1, DIM)
        for d in range(DIM):
            grad.bytes[:, d] = np.bincount(flat, back[:, d], PAD + 1)
        return grad.flat, float(loss)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> ByteNet:
    """A network of texts with labels 0 or 1, by Adam with a rate that falls to zero; the order follows seed only."""
    net, rng = ByteNet(seed=seed), np.random.default_rng(seed)
    m, v = np.zeros_like(net.flat), np.zeros_like(net.flat)
    steps = epochs * -(-len(texts) // batch)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(texts), batch):
            some = order[a : a + batch]
            sizes = np.array([len(texts[i]) for i in some], np.int64)
            raw = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            g, _ = net.gradient(raw, np.cumsum(sizes) - sizes, sizes, labels[some])
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            step = rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            net.flat -= step + rate * decay * net.flat
    return net
