"""A one-layer convolution over bytes in numpy: windows, forward pass, gradients and training."""

from __future__ import annotations

import numpy as np


def windows(data: bytes, length: int, stride: int, most: int | None = None) -> np.ndarray:
    """Fixed-length windows over all bytes, the last one padded with zeros; at least one. most: evenly spaced ones only (for training)."""
    n = 1 + max(0, -(-(len(data) - length) // stride))
    padded = np.zeros((n - 1) * stride + length, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(padded, length)[::stride]
    if most is not None and n > most:
        out = out[np.linspace(0, n - 1, most).round().astype(int)]
    return out


#: Windows that are looked at together.
TOGETHER = 4096


def grouped(texts: list[bytes], length: int, stride: int):
    """The windows of many texts in groups of about TOGETHER: (numbers of the texts, windows, where each text's windows start). A text of more windows comes alone, in several groups, so what is added up for a text does not depend on its neighbours."""
    numbers, parts, held = [], [], 0

    def group():
        return numbers, np.concatenate(parts), np.cumsum([0, *(len(p) for p in parts[:-1])])

    for i, data in enumerate(texts):
        n = 1 + max(0, -(-(len(data) - length) // stride))
        if n > TOGETHER:
            for at in range(0, n, TOGETHER):
                few = min(TOGETHER, n - at)
                yield [i], windows(data[at * stride : (at + few - 1) * stride + length], length, stride)[:few], np.array([0])
            continue
        if held + n > TOGETHER and numbers:
            yield group()
            numbers, parts, held = [], [], 0
        numbers, parts, held = [*numbers, i], [*parts, windows(data, length, stride)], held + n
    if numbers:
        yield group()


def outputs(features: np.ndarray, dense: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """features @ dense + bias; of equal rows the same to the last bit, wherever they stand."""
    wide = features.astype(np.float64)
    return np.stack([(wide * dense[:, k].astype(np.float64)).sum(1) for k in range(dense.shape[1])], 1) + bias


class ByteCnn:
    """Filters of several widths, each a table of one weight a byte value and place; max-pooled over a window."""

    #: Windows that are convolved at once: their activations stay in the cache.
    BATCH = 64

    def __init__(self, widths: dict[int, int], outputs: int, features: int, seed: int, sees_padding: bool = False):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 1 / np.sqrt(w), (w, 256, f)).astype(np.float32) for w, f in widths.items()]
        self.sees_padding = sees_padding  # else filters answer 0 to it
        for t in self.tables:
            t[:, 0] *= sees_padding
        self.bias = np.full(sum(widths.values()), -0.5, np.float32)
        self.dense = rng.normal(0, 0.1, (features, outputs)).astype(np.float32)
        self.dense_bias = np.zeros(outputs, np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.dense_bias]

    def pooled(self, x: np.ndarray, places: bool = False):
        """The rectified maximum of each filter over each window, and where it is."""
        out, at = np.empty((len(x), len(self.bias)), np.float32), np.empty((len(x), len(self.bias)), np.int32) if places else None
        for i in range(0, len(x), self.BATCH):
            part, k = x[i : i + self.BATCH], 0
            for t in self.tables:
                m, f = part.shape[1] - len(t) + 1, t.shape[2]
                a = np.take(t[0], part[:, :m], axis=0)
                for j in range(1, len(t)):
                    a += np.take(t[j], part[:, j : j + m], axis=0)
                out[i : i + len(part), k : k + f] = a.max(1)
                if places:
                    at[i : i + len(part), k : k + f] = a.argmax(1)
                k += f
        out += self.bias
        np.maximum(out, 0, out=out)
        return (out, at) if places else out

    def table_grads(self, x: np.ndarray, at: np.ndarray, grad: np.ndarray) -> list[np.ndarray]:
        out, k, rows = [], 0, np.arange(len(x))[:, None]
        for t in self.tables:
            f, g = t.shape[2], np.zeros_like(t)
            for j in range(len(t)):
                cell = x[rows, at[:, k : k + f] + j].astype(np.int64) * f + np.arange(f)
                g[j] = np.bincount(cell.ravel(), grad[:, k : k + f].ravel(), 256 * f).reshape(256, f)
            g[:, 0] *= self.sees_padding
            out.append(g)
            k += f
        return out


def trained(net: ByteCnn, samples: list[np.ndarray], labels: np.ndarray, spread, epochs: int, batch: int, seed: int, rate: float = 0.01) -> ByteCnn:
    """Adam on the cross-entropy of a softmax. spread(pooled, owner) -> features, and a function that takes their gradient back to the windows."""
    rng, steps = np.random.default_rng(seed), 0
    first = [np.zeros_like(p) for p in net.params()]
    second = [np.zeros_like(p) for p in net.params()]
    total = epochs * -(-len(samples) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x = np.concatenate([samples[j] for j in pick])
            owner = np.repeat(np.arange(len(pick)), [len(samples[j]) for j in pick])
            pooled, at = net.pooled(x, places=True)
            features, back = spread(pooled, owner)
            p = softmax(features @ net.dense + net.dense_bias)
            p[np.arange(len(p)), labels[pick] if len(p) == len(pick) else labels[pick][owner]] -= 1
            p /= len(p)
            to_pool = back(p @ net.dense.T) * (pooled > 0)
            grads = [*net.table_grads(x, at, to_pool), to_pool.sum(0), features.T @ p + 1e-4 * net.dense, p.sum(0)]
            steps += 1
            step = rate * min(1.0, 2.0 * (1 - steps / (total + 1)))
            for w, g, m, v in zip(net.params(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (step * m / (1 - 0.9**steps) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    return net


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
