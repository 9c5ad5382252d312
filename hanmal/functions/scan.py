"""Words and characters of many texts at once: code points in one array, everything else by prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE_CODES = (0x20, 0x09, 0x0B, 0x0D, 0x0A, 0x3000)


class Scan:
    """Texts side by side, each followed by a newline, which no word contains. A text ends at its first NUL."""

    def __init__(self, texts: list[str]):
        texts = [t.partition("\0")[0] for t in texts]
        joined = "\n".join(texts) + "\n"
        self.utf8 = np.frombuffer(joined.encode(), np.uint8)
        self.cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        self.width = 1 + (self.cp >= 0x80).astype(np.int64) + (self.cp >= 0x800) + (self.cp >= 0x10000)
        self.byte = np.concatenate(([0], np.cumsum(self.width)))

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="left")

    def strings(self, kept: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Strings of these sizes in bytes, cut from the kept characters in order."""
        data = self.utf8[np.repeat(kept, self.width)]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))

    def words(self) -> dict[str, np.ndarray | pa.Array]:
        inside = ~np.isin(self.cp, SPACE_CODES)
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = self.owner(begin)
        first = np.searchsorted(owner, owner, side="left")
        sizes = self.byte[end] - self.byte[begin]
        return {
            "owner": owner, "word_idx": np.arange(len(begin)) - first, "lex": self.strings(inside, sizes), "c_begin": begin - self.start[owner], "c_len": end - begin,
            "b_begin": self.byte[begin] - self.byte[self.start[owner]], "b_len": sizes,
        }

    def chars(self, most: int) -> Iterator[dict[str, np.ndarray | pa.Array]]:
        """All characters, `most` at a time."""
        for lo in range(0, len(self.cp), most):
            at = np.arange(lo, min(lo + most, len(self.cp)))
            owner = self.owner(at)
            at, owner = at[at != self.end[owner]], owner[at != self.end[owner]]
            if not len(at):
                continue
            begin, width = self.byte[at] - self.byte[self.start[owner]], self.width[at]
            # whole characters from the first to the last; the newlines between texts are dropped
            inside = np.zeros(at[-1] + 1 - at[0], bool)
            inside[at - at[0]] = True
            data = self.utf8[self.byte[at[0]] : self.byte[at[-1] + 1]][np.repeat(inside, self.width[at[0] : at[-1] + 1])]
            offsets = np.concatenate(([0], np.cumsum(width)))
            chr_ = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
            yield {"owner": owner, "char_idx": at - self.start[owner], "chr": chr_, "b_begin": begin, "b_end": begin + width}


def as_lists(values: np.ndarray, sizes: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """values cut into lists of these sizes; null where absent."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    mask = None if absent is None else pa.array(absent)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=mask)


def chars_at_bytes(texts: list[str | None], places: list[list[int] | None]) -> pa.Array:
    """For each text the numbers of the characters that begin at these byte offsets; null where either is."""
    absent = np.fromiter((t is None or p is None for t, p in zip(texts, places, strict=True)), bool, len(texts))
    scan = Scan(["" if gone else t for t, gone in zip(texts, absent, strict=True)])
    sizes = np.fromiter((0 if gone else len(p) for p, gone in zip(places, absent, strict=True)), np.int64, len(texts))
    flat = np.fromiter((x for p, gone in zip(places, absent, strict=True) if not gone for x in p), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    start, end = scan.start[owner], scan.end[owner]
    found = np.searchsorted(scan.byte, flat + scan.byte[start])
    return as_lists(np.clip(found, start, end + 2) - start, sizes, absent)
