"""Text quality by a convolutional network over bytes, in numpy.

Bytes are embedded, filters of eight bytes slide over them in steps of four, and each filter's largest
response is taken in every chunk of 1,024 bytes (chunks overlap by half and cover the whole text).  The mean
and the maximum over the chunks go into one logistic unit.  Everything is learned by gradient descent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

DIM, WIDTH, STRIDE, FILTERS = 4, 8, 4, 16
#: Steps of a half chunk; a chunk is two halves.
HALF = 128
#: Half chunks that are computed at once.
BLOCK = 1024
#: Bounds of the sample that is learned from, for each label value; passes over it.
TEXTS, TEXT_BYTES, EPOCHS, RATE, GROUP = 600, 20_000, 12, 0.01, 16


class ByteNetwork:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "base": np.zeros(1, np.float32),
        }

    @staticmethod
    def padded(text: str | None) -> np.ndarray:
        """The text's bytes with spaces up to whole half chunks, and at least one."""
        data = (text or "").encode("utf-8", "surrogatepass")
        step = HALF * STRIDE
        size = max(1, -(-len(data) // step)) * step
        return np.frombuffer(data.ljust(size + WIDTH - STRIDE, b" "), dtype=np.uint8)

    def _windows(self, data: np.ndarray) -> np.ndarray:
        x = self.p["embed"][data]
        n = (len(data) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * DIM), (STRIDE * DIM * 4, 4))

    def _halves(self, data: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each half chunk, block by block."""
        step, out = HALF * STRIDE, []
        for at in range(0, len(data) - (WIDTH - STRIDE), step * BLOCK):
            part = data[at : at + step * BLOCK + WIDTH - STRIDE]
            h = self._windows(np.ascontiguousarray(part)) @ self.p["filters"]
            out.append(h.reshape(-1, HALF, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(out) + self.p["bias"], 0)

    @staticmethod
    def _pooled(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]), chunks

    def score(self, text: str | None) -> float:
        f, _ = self._pooled(self._halves(self.padded(text)))
        return float(1 / (1 + np.exp(-np.clip(f @ self.p["out"] + self.p["base"][0], -30, 30))))

    def scores(self, texts) -> list[float]:
        """Scores of many texts; their half chunks are computed together, some megabytes at a time."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(self.padded(text))
            size += len(group[-1])
            if size > 1 << 19:
                out += self._group(group)
                group, size = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, group: list[np.ndarray]) -> list[float]:
        tail = WIDTH - STRIDE
        step = HALF * STRIDE
        if len(group) == 1:
            halves, counts = self._halves(group[0]), [(len(group[0]) - tail) // step]
        else:  # a spare half chunk of spaces between two texts keeps windows from reaching over
            space = np.full(step - tail, 32, np.uint8)
            joined = np.concatenate([x for d in group for x in (d, space)] + [np.full(tail, 32, np.uint8)])
            halves, counts = self._halves(joined), [(len(d) - tail) // step for d in group]
        result, at = [], 0
        for n in counts:
            f, _ = self._pooled(halves[at : at + n])
            result.append(float(1 / (1 + np.exp(-np.clip(f @ self.p["out"] + self.p["base"][0], -30, 30)))))
            at += n + 1
        return result

    def gradient(self, text: str, y: float, weight: float, grads: dict[str, np.ndarray]) -> None:
        """Adds one text's gradient of the log loss."""
        data = self.padded(text)
        x = self._windows(data)
        h = (x @ self.p["filters"] + self.p["bias"]).reshape(-1, HALF, FILTERS)
        arg = h.argmax(axis=1)
        n, k = len(h), np.arange(FILTERS)
        halves = np.maximum(h[np.arange(n)[:, None], arg, k], 0)
        f, chunks = self._pooled(halves)
        d = weight * (1 / (1 + np.exp(-np.clip(f @ self.p["out"] + self.p["base"][0], -30, 30))) - y)
        grads["base"] += d
        grads["out"] += d * f
        back = np.broadcast_to(d * self.p["out"][:FILTERS] / len(chunks), chunks.shape).copy()
        back[chunks.argmax(axis=0), k] += d * self.p["out"][FILTERS:]
        to = np.zeros_like(halves)
        if n > 1:
            left = halves[:-1] >= halves[1:]
            to[:-1] += back * left
            to[1:] += back * ~left
        else:
            to += back
        to *= halves > 0
        grads["bias"] += to.sum(axis=0)
        where = (np.arange(n)[:, None] * HALF + arg).ravel()  # the window that each response came from
        flat = to.ravel()
        picked = x[where]
        wide = np.zeros((len(where), FILTERS), np.float32)
        wide[np.arange(len(where)), np.tile(k, n)] = flat
        grads["filters"] += picked.T @ wide
        down = (wide @ self.p["filters"].T).reshape(-1, DIM)
        at = data[(where[:, None] * STRIDE + np.arange(WIDTH)).ravel()]
        for j in range(DIM):
            grads["embed"][:, j] += np.bincount(at, down[:, j], 256)

    def fit(self, sample: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> "ByteNetwork":
        """Adam over small groups; label values weigh alike.  Without both values the network stays at one half."""
        ones = sum(y for _, y in sample)
        if not 0 < ones < len(sample):
            return self
        share = {1: 0.5 * len(sample) / ones, 0: 0.5 * len(sample) / (len(sample) - ones)}
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.p["out"] = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(sample))
            for at in range(0, len(order), GROUP):
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                chosen = order[at : at + GROUP]
                for i in chosen:
                    self.gradient(sample[i][0], sample[i][1], share[sample[i][1]] / len(chosen), grads)
                t += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    step = rate * (1 - epoch / (epochs + 1))
                    self.p[k] = (self.p[k] - step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> ByteNetwork:
    """Learns from about TEXTS labelled texts for each value, of at most TEXT_BYTES bytes each, whole; unlabelled rows don't count."""
    sample, _ = labelled_sample(docs, labels.select("doc_id", label_col), label_col, TEXTS, TEXT_BYTES)
    return ByteNetwork().fit(sample)


def quality_score(model: ByteNetwork, text: Column) -> Column:
    """Probability from 0 to 1 that a text is of good quality; every byte of it is seen.

    Null counts as empty, and an empty text is a chunk of spaces.  If nothing was learned every text gets one
    half.  Equal texts get scores equal up to rounding.
    """

    @F.pandas_udf("double")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts), dtype="float64")

    return good(text)
