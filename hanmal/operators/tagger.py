"""The convolutional tagger over all characters of many sentences at once, in numpy."""

from __future__ import annotations

import functools

import numpy as np

from .resources import KERNELS, Model

#: Characters whose windows are held at once.
BLOCK = 4096


@functools.lru_cache(8)
def positions(length: int, width: int, kind: str) -> np.ndarray:
    """1 - p/L - (i/D)(1 - 2p/L) for places p and dimensions i from 1; kind sinusoid: the alternative encoding."""
    p, i = np.arange(1, length + 1)[:, None], np.arange(1, width + 1)[None, :]
    if kind == "sinusoid":
        angle = p / 10000 ** (2 * ((i - 1) // 2) / width)
        return np.where(i % 2 == 1, np.sin(angle), np.cos(angle))
    return 1 - p / length - i / width * (1 - 2 * p / length)


class Layout:
    """Characters of sentences side by side, `window` padded places between sentences and around them."""

    def __init__(self, sentences: list[list[str]], window: int):
        words = [(s, len(w)) for s, ws in enumerate(sentences) for w in ws]
        self.text = "".join(w for ws in sentences for w in ws)
        size = np.array([n for _, n in words], np.int64)
        sent = np.repeat(np.array([s for s, _ in words], np.int64), size)
        self.begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.inner = np.arange(len(sent)) - np.repeat(self.begin, size)
        self.length = np.repeat(size, size)
        self.place = np.arange(len(sent)) + window * (sent + 1)
        self.cells = len(sent) + window * (len(sentences) + 1)
        self._ids: tuple[Model, np.ndarray] | None = None

    def ids(self, model: Model) -> np.ndarray:
        """The ids of all places, looked up once for all blocks."""
        if self._ids is None or self._ids[0] is not model:
            ids = np.zeros(self.cells, np.int64)
            codes, values = model.codes()
            text = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(codes) and len(text):
                at = np.minimum(np.searchsorted(codes, text), len(codes) - 1)
                ids[self.place] = np.where(codes[at] == text, values[at], 1)
            else:
                ids[self.place] = 1
            self._ids = model, ids
        return self._ids[1]


def windows(model: Model, layout: Layout, which: np.ndarray) -> np.ndarray:
    """The input of each of the characters `which`: (characters, 2 window + 1, embed)."""
    w, dtype = model.window, model.embed.dtype
    ids = layout.ids(model)
    x = model.embed[ids[layout.place[which][:, None] + np.arange(-w, w + 1)]]
    left = w - layout.inner[which]
    at = np.flatnonzero(left >= 0)
    x[at, left[at]] += model.embed[2]
    right = w + layout.length[which] - layout.inner[which] - 1
    at = np.flatnonzero(right <= 2 * w)
    x[at, right[at]] += model.embed[3]
    return x + positions(2 * w + 1, model.embed.shape[1], "linear").astype(dtype)


def pooled(model: Model, x: np.ndarray) -> np.ndarray:
    """The convolutions' outputs over all places of each window, the largest of each, rectified."""
    n, length, width = x.shape
    out = []
    for k in KERNELS:
        weight, bias = model.filters[k]
        rows = length - k + 1
        flat = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), k * width, axis=1)[:, ::width]
        y = (np.ascontiguousarray(flat).reshape(n * rows, k * width) @ weight).reshape(n, rows, -1).max(1) + bias
        out.append(np.maximum(y, 0))
    return np.concatenate(out, 1)


def hidden(model: Model, features: np.ndarray) -> np.ndarray:
    return np.maximum(features @ model.hidden[0] + model.hidden[1], 0)


def logits(model: Model, x: np.ndarray) -> np.ndarray:
    return hidden(model, pooled(model, x)) @ model.out[0] + model.out[1]


def predict(model: Model, sentences: list[list[str]], tags: list[list[list[int]]]) -> list[list[list[int]]]:
    """tags (of each character of each word of each sentence) with a tag in place of each 0: the class of the largest output, from 1."""
    flat = np.array([t for s in tags for w in s for t in w], np.int64)
    todo = np.flatnonzero(flat <= 0)
    if len(todo):
        layout = Layout(sentences, model.window)
        for lo in range(0, len(todo), BLOCK):
            which = todo[lo : lo + BLOCK]
            flat[which] = logits(model, windows(model, layout, which)).argmax(1) + 1
    values, at, out = flat.tolist(), 0, []
    for s in sentences:
        own = []
        for w in s:
            own.append(values[at : at + len(w)])
            at += len(w)
        out.append(own)
    return out
