"""Error patches from a tagged corpus: candidates from differences between predicted and gold analyses, and the evidence for and against them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import rows_of_parts, with_columns

Span = tuple[int, int]
Triple = tuple[str, str, str]
#: Items up to which two stretches are compared item by item.
FEW = 128


def sentences(words: DataFrame, key: list[str]) -> DataFrame:
    """key and words, an array of structs of word_idx, raw, morph_list and pred in order."""
    return words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word_idx", "raw", "morph_list", "pred"))).alias("words"))


def spans_of(raw: str, morphs: list[str], start: int) -> list[Span]:
    """Characters of a word that each of its morphemes covers; those that share a syllable overlap."""
    out, at = [], 0
    for lex in morphs:
        end = min(len(raw), at + max(1, len(lex)))
        out.append((start + min(at, max(0, len(raw) - 1)), start + end))
        at = min(at + len(lex), len(raw))
    return out


def _popular_apart(b: list[str]) -> dict[str, list[int]]:
    """Places of each item of b; of 200 items and more, those of over one in a hundred are left out."""
    at: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    if len(b) >= 200:
        most = len(b) // 100 + 1
        at = {x: js for x, js in at.items() if len(js) <= most}
    return at


def _by_rows(a: list[str], at: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """Begin in a, begin in b and size of the longest run in common; of equal ones the first in a, then in b."""
    best, size_at = (alo, blo, 0), {}
    for i in range(alo, ahi):
        now: dict[int, int] = {}
        for j in at.get(a[i], ()):
            if j >= bhi:
                break
            if j >= blo:
                k = now[j] = size_at.get(j - 1, 0) + 1
                if k > best[2]:
                    best = i - k + 1, j - k + 1, k
        size_at = now
    return best


class Runs:
    """Runs of 1, 2, 4 and so on items of a and b as numbers, so that runs of any length are compared as two numbers; items that `at` lacks equal none."""

    def __init__(self, a: list[str], b: list[str], at: dict[str, list[int]]):
        number = {x: i for i, x in enumerate(at)}
        codes = [number.get(x, -1) for x in a] + [-1] + [number.get(x, -1) for x in b] + [-1]
        own = np.array(codes, np.int64)
        alone = np.flatnonzero(own < 0)
        own[alone] = len(number) + np.arange(len(alone))
        self.levels, self.shift = [own], len(a) + 1

    def keys(self, k: int, lo: int, hi: int) -> np.ndarray:
        """A number for the run of k items from each place in [lo, hi - k]."""
        p = k.bit_length() - 1
        while len(self.levels) <= p:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            pair = last[:-step] * len(self.levels[0]) * 2 + last[step:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].reshape(-1).astype(np.int64))
        level, rest = self.levels[p], k - (1 << p)
        return (level[lo : hi - k + 1] << 32) | level[lo + rest : hi - k + 1 + rest]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int]:
        """What _by_rows finds, by bisection of the length, which is `most` at most and often just that."""

        def shared(k: int) -> tuple[int, int] | None:
            x, y = self.keys(k, alo, ahi), self.keys(k, self.shift + blo, self.shift + bhi)
            hit = np.isin(x, y)
            if not hit.any():
                return None
            i = int(hit.argmax())
            return alo + i, blo + int((y == x[i]).argmax())

        best, low, high = (alo, blo, 0), 0, min(ahi - alo, bhi - blo, most)
        k = high
        while low < high:
            if (found := shared(k)) is not None:
                best, low = (*found, k), k
            else:
                high = k - 1
            k = min((low + high + 1) // 2, 2 * low + 1)
        return best


def _longest(a: list[str], b: list[str], at: dict[str, list[int]], runs: list[Runs], alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int]:
    """The same by way of the items that b has once: what holds one lies on its diagonal, and the rest is no longer than a stretch without."""
    best, gap, widest, i = (alo, blo, 0), 0, 0, alo
    while i < ahi:
        js = at.get(a[i], ())
        if len(js) > 1:
            gap += 1
            widest = max(widest, gap)
            i += 1
            continue
        gap = 0
        if not js or not blo <= js[0] < bhi:
            i += 1
            continue
        j = js[0]
        x, y = i, j
        while x > alo and y > blo and a[x - 1] == b[y - 1] and b[y - 1] in at:
            x, y = x - 1, y - 1
        i, j = i + 1, j + 1
        while i < ahi and j < bhi and a[i] == b[j] and b[j] in at:
            i, j = i + 1, j + 1
        if i - x > best[2] or (i - x == best[2] and x < best[0]):
            best = x, y, i - x
        # the run may end in items that another stretch goes on with
        k = i - 1
        while k >= alo and len(at.get(a[k], ())) > 1:
            gap, k = gap + 1, k - 1
        widest = max(widest, gap)
    if best[2] <= widest:
        if ahi - alo < FEW:
            best = _by_rows(a, at, alo, ahi, blo, bhi)
        else:
            if not runs:
                runs.append(Runs(a, b, at))
            best = runs[0].longest(alo, ahi, blo, bhi, most)
    x, y, n = best
    while x > alo and y > blo and a[x - 1] == b[y - 1]:
        x, y, n = x - 1, y - 1, n + 1
    while x + n < ahi and y + n < bhi and a[x + n] == b[y + n]:
        n += 1
    return x, y, n


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """The blocks of difflib.SequenceMatcher(None, a, b).get_matching_blocks()."""
    at, todo, found = _popular_apart(b), [(0, len(a), 0, len(b), len(a))], []
    runs: list[Runs] = []
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        i, j, n = _longest(a, b, at, runs, alo, ahi, blo, bhi, most)
        if n:
            found.append((i, j, n))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, n))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi, n))
    found.sort()
    out: list[tuple[int, int, int]] = []
    for i, j, n in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return [*out, (len(a), len(b), 0)]


class Difference:
    """Two morpheme sequences of one sentence with delimiters, and the characters of the predicted ones."""

    def __init__(self, pred: list[str], gold: list[str], spans: list[Span], raw: str):
        self.pred, self.gold, self.spans, self.raw = pred, gold, spans, raw

    def origin(self, a: int, b: int) -> str:
        return self.raw[self.spans[max(a, 0)][0] : self.spans[min(b, len(self.spans)) - 1][1]]

    def left_edge(self, a: int) -> int:
        """a, moved left while the morpheme before shares a syllable."""
        while a > 0 and self.spans[a - 1][1] > self.spans[a][0]:
            a -= 1
        return a

    def right_edge(self, b: int) -> int:
        while 0 < b < len(self.pred) and self.spans[b - 1][1] > self.spans[b][0]:
            b += 1
        return b

    def triple(self, a: int, b: int, c: int, d: int) -> Triple:
        return self.origin(a, b), " + ".join(self.pred[max(a, 0) : b]), " + ".join(self.gold[max(c, 0) : d])

    def with_spaces(self, a: int, b: int, c: int, d: int) -> Iterator[Triple]:
        """One more morpheme beyond a word delimiter at either end."""
        wide_a = self.left_edge(a - 1) if self.pred[max(a, 0)] == "_" else a
        wide_b = self.right_edge(b + 1) if self.pred[min(b, len(self.pred)) - 1] == "_" else b
        if (wide_a, wide_b) != (a, b):
            yield self.triple(wide_a, wide_b, c - (a - wide_a), d + (wide_b - b))

    def triples(self) -> Iterator[Triple]:
        """Each difference alone, with a neighbour on the left, on the right, and on both sides."""
        lex = lambda m: m.rsplit("/", 1)[0]
        a0 = c0 = 0
        for b0, d0, size in matching_blocks(self.pred, self.gold):
            a, b = (self.left_edge(a0), self.right_edge(b0)) if b0 > a0 else (a0, b0)
            c, d = c0 - (a0 - a), d0 + (b - b0)
            a0, c0 = b0 + size, d0 + size
            left, right = self.pred[a:b], self.gold[max(c, 0) : d]
            if not left and not right:
                continue
            if left and right and len(left) + len(right) > 2:
                yield self.triple(a, b, c, d)
            la = self.left_edge(a - 1)
            lc = c - (a - la)
            rb = self.right_edge(b + 1)
            rd = d + (rb - b)
            for x, y, z, w, agree in ((la, b, lc, d, 0), (a, rb, c, rd, -1)):
                p, g = self.pred[max(x, 0) : y], self.gold[max(z, 0) : w]
                if len(p) >= 2 and len(g) >= 2 and lex(p[agree]) == lex(g[agree]):
                    yield self.triple(x, y, z, w)
                    yield from self.with_spaces(x, y, z, w)
            yield self.triple(la, rb, lc, rd)
            yield from self.with_spaces(la, rb, lc, rd)


Word = tuple[str, list[str], list[str]]


def difference(words: list[dict]) -> Difference | None:
    """None where prediction and gold agree."""
    text = lambda ms: [f"{m['lex']}/{m['tag']}" for m in ms]
    return text_difference([(w["raw"], text(w["morph_list"]), text(w["pred"])) for w in words])


def text_difference(words: list[Word]) -> Difference | None:
    """From words as raw, gold and predicted morphemes (lex/TAG)."""
    if all(g == p for _, g, p in words):
        return None
    pred, gold, spans, raws, at = ["|"], ["|"], [(0, 0)], [], 0
    for k, (raw, own, guess) in enumerate(words):
        if k:
            pred.append("_"), gold.append("_")
            spans.append((at, at + 1))
            at += 1
        pred += guess
        gold += own
        spans += spans_of(raw, [m.rsplit("/", 1)[0] for m in guess], at)
        raws.append(raw)
        at += len(raw)
    pred.append("|"), gold.append("|"), spans.append((at, at))
    return Difference(pred, gold, spans, " ".join(raws)) if pred != gold else None


def sentence_triples(words: list[Word]) -> Iterator[Triple]:
    """origin, left (predicted) and right (gold) of each candidate in a sentence."""
    found = text_difference(words)
    return found.triples() if found else iter(())


def error_triples(sents: DataFrame) -> DataFrame:
    """origin, left (predicted) and right (gold) of each candidate in each sentence."""

    def fn(cols: list[list]) -> list[list]:
        got = [difference(ws) for ws in cols[0]]
        return [[[dict(zip(("origin", "left", "right"), t, strict=True)) for t in d.triples()] if d else [] for d in got]]

    return with_columns(sents, ["words"], fn, "found array<struct<origin:string,left:string,right:string>>").select(F.explode("found").alias("t")).select("t.*")


Index = dict[int, dict[int, set[tuple[int, ...]]]]


def indexed(needles: dict[int, list[tuple[int, ...]]]) -> Index:
    """Needles by first item and length, so that a place is compared once for each length, not with each needle."""
    out: Index = {}
    for x, own in needles.items():
        for needle in own:
            out.setdefault(x, {}).setdefault(len(needle), set()).add(needle)
    return out


def found_in(haystack: list[int], index: Index) -> Iterator[tuple[tuple[int, ...], int]]:
    """Each needle's occurrences from the left, without overlaps of its own, with their places."""
    free: dict[tuple[int, ...], int] = {}
    for i, x in enumerate(haystack):
        if x in index:
            for n, known in index[x].items():
                here = tuple(haystack[i : i + n])
                if here in known and i >= free.get(here, 0):
                    free[here] = i + n
                    yield here, i


def occurrences(haystack: list[int], needles: dict[int, list[tuple[int, ...]]]) -> Iterator[tuple[tuple[int, ...], int]]:
    """found_in for needles by first item."""
    return found_in(haystack, indexed(needles))


def patch_evidence(sents: DataFrame, patches: dict[tuple[int, ...], list[int]], inputs: tuple[str, ...] = ("mix", "gold"), read: Callable[..., tuple[list[int], list[int]]] = lambda *x: x) -> DataFrame:
    """left, n_right and n_wrong: where a patch's left side occurs in mix, whether its right side is what gold has there.

    mix (packed, before patches) and gold (tags) have one length; read makes them of the columns `inputs` of sents. Every sentence is read once for all patches; only the counts of each part of a batch leave the workers.
    """
    needles: dict[int, list[tuple[int, ...]]] = {}
    for left in patches:
        needles.setdefault(left[0], []).append(left)

    def fn(cols: list[list]) -> list[tuple]:
        right: Counter = Counter()
        every: Counter = Counter()
        for given in zip(*cols, strict=True):
            if None in given:
                continue
            mix, gold = read(*given)
            for needle, i in found_in(mix, index):
                every[needle] += 1
                right[needle] += gold[i : i + len(needle)] == wanted[needle]
        return [(list(n), right[n], k - right[n]) for n, k in every.items()]

    index, wanted = indexed(needles), {left: list(own) for left, own in patches.items()}
    found = rows_of_parts(sents, list(inputs), fn, "left array<bigint>, n_right bigint, n_wrong bigint")
    return found.groupBy("left").agg(F.sum("n_right").alias("n_right"), F.sum("n_wrong").alias("n_wrong"))


def valid_patches(evidence: DataFrame) -> DataFrame:
    """Patches that were right at least once and never wrong."""
    return evidence.where("n_right > 0 and n_wrong = 0")
