"""What the analyzer looks up: dictionaries held in each worker, and the network's weights."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..functions.tags import N_TAGS

#: Entries of a dictionary up to which it is sent to the workers; a larger one is refused, and can be joined instead (dictionary.py).
MOST_ENTRIES = 2_000_000
Restored = list[tuple[str, int, int]]


def entries(dic: DataFrame, most: int = MOST_ENTRIES) -> list:
    rows = dic.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} entries can't be sent to every worker")
    return rows


@dataclass(frozen=True)
class Dictionaries:
    """exact, prefix: tags by word; patches: right sides by packed left sides; restored: characters by (character, tag); firsts: simple tags by composite ones."""

    exact: dict[str, list[int]] = field(default_factory=dict)
    prefix: dict[str, list[int]] = field(default_factory=dict)
    patches: dict[tuple[int, ...], list[int]] = field(default_factory=dict)
    restored: dict[tuple[str, int], Restored] = field(default_factory=dict)
    firsts: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def of(preanal: DataFrame | None = None, errpatch: DataFrame | None = None, restore: DataFrame | None = None, firsts: DataFrame | None = None) -> Dictionaries:
        """From tables: preanal (key, is_pfx, tag_nums), errpatch (left, right), restore (chr, tag_out, vals), firsts (tag_out, first_tag)."""
        words = [(r["key"], r["is_pfx"], list(r["tag_nums"])) for r in (entries(preanal) if preanal is not None else ())]
        return Dictionaries(
            {k: t for k, p, t in words if not p}, {k: t for k, p, t in words if p},
            {tuple(r["left"]): list(r["right"]) for r in (entries(errpatch) if errpatch is not None else ())},
            {(r["chr"], r["tag_out"]): [tuple(v) for v in r["vals"]] for r in (entries(restore) if restore is not None else ())},
            {r["tag_out"]: r["first_tag"] for r in (entries(firsts) if firsts is not None else ())},
        )

    def longest(self) -> int:
        return max(map(len, (*self.exact, *self.prefix)), default=0)

    def save(self, folder: str) -> None:
        flat = {
            "exact": self.exact, "prefix": self.prefix, "patches": [[list(k), v] for k, v in self.patches.items()],
            "restored": [[c, t, [list(v) for v in vals]] for (c, t), vals in self.restored.items()], "firsts": list(self.firsts.items()),
        }
        with open(os.path.join(folder, "dictionaries.json"), "w", encoding="utf-8") as f:
            json.dump(flat, f, ensure_ascii=False)

    @staticmethod
    def load(folder: str) -> Dictionaries:
        with open(os.path.join(folder, "dictionaries.json"), encoding="utf-8") as f:
            d = json.load(f)
        return Dictionaries(d["exact"], d["prefix"], {tuple(k): v for k, v in d["patches"]}, {(c, t): [tuple(v) for v in vals] for c, t, vals in d["restored"]}, {a: b for a, b in d["firsts"]})


KERNELS = (2, 3, 4, 5)


@dataclass(frozen=True)
class Model:
    """A character tagger: embeddings, four convolutions with max-pooling, a hidden layer, an output layer.

    Ids 0 to 3 are padding (a zero vector), unknown, word begin and word end. filters[k]: (k * embed, out); matrices are (in, out).
    """

    window: int
    chars: dict[str, int]
    embed: np.ndarray
    filters: dict[int, tuple[np.ndarray, np.ndarray]]
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]

    @property
    def classes(self) -> int:
        return self.out[0].shape[1]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the known characters in order, and their ids."""
        known = sorted((ord(c), i) for c, i in self.chars.items() if len(c) == 1)
        return np.array([c for c, _ in known], np.uint32), np.array([i for _, i in known], np.int64)

    @staticmethod
    def made(window: int, embed_dim: int, hidden_dim: int, classes: int, chars: str, value: Callable[[np.ndarray], np.ndarray], dtype=np.float32) -> Model:
        """A model whose parameters are value(number of the parameter), counted over all of them in order."""
        at = 0

        def take(*shape: int) -> np.ndarray:
            nonlocal at
            n = int(np.prod(shape))
            got = np.asarray(value(np.arange(at, at + n)), np.float64).reshape(shape).astype(dtype)
            at += n
            return got

        embed = take(len(chars) + 4, embed_dim)
        embed[0] = 0
        filters = {k: (take(k * embed_dim, embed_dim), take(embed_dim)) for k in KERNELS}
        hidden = take(len(KERNELS) * embed_dim, hidden_dim), take(hidden_dim)
        return Model(window, {c: i + 4 for i, c in enumerate(chars)}, embed, filters, hidden, (take(hidden_dim, classes), take(classes)))

    @staticmethod
    def seeded(window: int, embed_dim: int, hidden_dim: int, classes: int, chars: str, seed: int = 1) -> Model:
        r = np.random.default_rng(seed)
        return Model.made(window, embed_dim, hidden_dim, classes, chars, lambda i: r.normal(0, 0.2, len(i)))

    def check(self) -> None:
        """Raises where shapes do not fit."""
        d, n = self.embed.shape[1], self.hidden[0].shape[1]
        want = [(self.embed.shape[0], len(self.chars) + 4), (self.hidden[0].shape, (len(KERNELS) * d, n)), (self.hidden[1].shape, (n,)), (self.out[0].shape[0], n), (self.out[1].shape, (self.classes,))]
        want += [(self.filters[k][0].shape, (k * d, d)) for k in KERNELS] + [(self.filters[k][1].shape, (d,)) for k in KERNELS]
        if bad := [f"{a} is not {b}" for a, b in want if a != b]:
            raise ValueError("model shapes: " + "; ".join(bad))

    def save(self, folder: str) -> None:
        arrays = {"embed": self.embed, "hidden_w": self.hidden[0], "hidden_b": self.hidden[1], "out_w": self.out[0], "out_b": self.out[1]}
        arrays |= {f"conv{k}_{n}": self.filters[k][i] for k in KERNELS for i, n in enumerate("wb")}
        np.savez(os.path.join(folder, "model.npz"), window=self.window, chars=np.array(list(self.chars)), **arrays)

    @staticmethod
    def load(folder: str) -> Model:
        with np.load(os.path.join(folder, "model.npz"), allow_pickle=False) as z:
            chars = {c: i + 4 for i, c in enumerate(z["chars"].tolist())}
            m = Model(int(z["window"]), chars, z["embed"], {k: (z[f"conv{k}_w"], z[f"conv{k}_b"]) for k in KERNELS}, (z["hidden_w"], z["hidden_b"]), (z["out_w"], z["out_b"]))
        m.check()
        return m

    @staticmethod
    def from_state(state: dict[str, np.ndarray], chars: str, window: int) -> Model:
        """From a trainer's parameters: embedding.weight; convs.K.weight (out, in, K) and bias; hidden and tag layers (out, in)."""
        conv = lambda k: (np.ascontiguousarray(state[f"convs.{k}.weight"].transpose(2, 1, 0)).reshape(-1, state[f"convs.{k}.weight"].shape[0]), state[f"convs.{k}.bias"])
        linear = lambda n: (np.ascontiguousarray(state[f"{n}.weight"].T), state[f"{n}.bias"])
        m = Model(window, {c: i + 4 for i, c in enumerate(chars)}, state["embedding.weight"], {k: conv(k) for k in KERNELS}, linear("hidden"), linear("tag"))
        m.check()
        return m

    def __post_init__(self) -> None:
        if self.classes < 2 * N_TAGS:
            raise ValueError(f"{self.classes} classes are fewer than the {2 * N_TAGS} simple tags")
