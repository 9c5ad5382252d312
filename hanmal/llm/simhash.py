"""Near-duplicate documents by SimHash with bit-variant lookups of signature parts (operator 4).

A document's signature has BITS = 512 bits: the signs of a random projection of its distinct words, each weighted by the
square root of its count (words are lower-cased runs of letters and digits, so changes of case and punctuation do not
count). Word hashes first fall into 4,096 signed buckets, which keeps the projection one matrix product.

All pairs of up to max_distance bits are found, with certainty. Distinct signatures are dealt into blocks by a hash, and a task joins two
blocks (or one with itself), so it needs no rows but theirs and no value of any bits can be too hot for it. Of max_distance = 64 differing
bits, some of the SEGMENTS = 16 segments of 32 bits has at most 3 (one segment: 4), and of these some half has at most 1 (one half: 2).
So one block is sorted by each half in turn, the other looks up its own halves with up to so many bits flipped, and what it
meets is verified first on the segment, then on the whole signature. For other distances the same shares are computed.

Pairs within one component need no link. Neighbours in sorted order are joined first, and documents of a large component skip their own component's
rows, so groups of thousands cost little. Only the edges of a spanning forest leave a task; the components are those of all pairs.
The work grows with the square of the distinct signatures, by a small share of the pairs; what is sent grows in proportion up to BLOCKS * BLOCK_ROWS signatures.

Equal signatures are grouped first; the smallest doc_id of a connected component is the one that stays.

Defined results: null, empty and wordless texts are near-duplicates of nothing, and stay; rows with a null doc_id stay;
rows that share a doc_id are one document, of which the row with the smallest hash of its text stays; classes() has a row for every
document, and for each row with a null doc_id one with a null group and the size 1; an empty table gives an empty table; other columns are passed through, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .common import fingerprint, map_rows, materialize, require, spark_to_arrow, unused
from .components import connected_components

BITS, SEGMENTS, BUCKETS = 512, 16, 4096
MAX_DISTANCE = 64
#: Rows that a task reads on before it splits off whole groups.
CHUNK_ROWS = 1 << 20
#: Blocks of signatures, each of SMALL_ROWS at least; of more than BLOCK_ROWS, more blocks are made.
BLOCKS, SMALL_ROWS, BLOCK_ROWS = 16, 2048, 1 << 19
#: Candidates that are compared at once, and the size from which a component's documents skip its own rows.
CANDIDATES, LARGE = 1 << 18, 64


@functools.lru_cache(1)
def projection() -> np.ndarray:
    at = np.arange(BUCKETS * BITS // 64, dtype=np.uint64) + np.uint64(1 << 40)
    bits = np.unpackbits(tv.mix(tv.mix(at)).view(np.uint8)).reshape(BUCKETS, BITS)
    return bits.astype(np.float32) * 2 - 1


def signatures(texts: list[str | None]) -> list[bytes | None]:
    """The signature of each text, None without words."""
    t = tv.Texts([x.lower() if x else x for x in texts])
    begin, end = t.words()
    doc, word, count = tv.group_counts(t.text_of(begin), t.hashes(begin, end))
    h = tv.mix(word ^ np.uint64(0xA5A5))
    weight = np.sqrt(count) * (1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64))
    cell = doc * BUCKETS + ((h >> np.uint64(8)) % np.uint64(BUCKETS)).astype(np.int64)
    out: list[bytes | None] = []
    for lo in range(0, t.n, 512):  # a block of documents is 8 MB of buckets
        hi = min(t.n, lo + 512)
        i, j = np.searchsorted(doc, [lo, hi])
        x = np.bincount(cell[i:j] - lo * BUCKETS, weight[i:j], (hi - lo) * BUCKETS).astype(np.float32).reshape(hi - lo, BUCKETS)
        sig = np.packbits(x @ projection() > 0, axis=1)
        has = np.bincount(doc[i:j] - lo, minlength=hi - lo) > 0
        out += [sig[k].tobytes() if has[k] else None for k in range(hi - lo)]
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, fp, sig of the documents that have words."""
    require(docs, "doc_id", "text")
    fn = lambda cols: {"doc_id": cols[0], "fp": cols[1], "sig": signatures(cols[2])}
    src = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_rows(src, [F.col("doc_id").cast("long"), fingerprint(), "text"], fn, "doc_id long, fp long, sig binary").where("sig is not null")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Forest:
    """Union-find that tells which edges joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def labels(self) -> np.ndarray:
        """The root of each."""
        up = np.array(self.up, np.int64)
        while not np.array_equal(over := up[up], up):
            up = over
        return up


def radii(most: int) -> list[tuple[int, int]]:
    """For each half, the bits that may differ in its segment and in it: a pair of up to `most` bits keeps within both somewhere."""
    out = []
    for k in range(SEGMENTS):
        share = (most + 1 + SEGMENTS - 1 - k) // SEGMENTS  # the shares add up to most + 1
        out += [(share - 1, (share + 1) // 2 - 1), (share - 1, share // 2 - 1)]
    return out


@functools.lru_cache(16)
def flips(radius: int) -> np.ndarray:
    """The 16-bit masks of up to radius bits."""
    masks = np.arange(1 << 16, dtype=np.uint16)
    return masks[np.bitwise_count(masks) <= radius]


def close_edges(sigs: np.ndarray, cut: int, most: int) -> list[tuple[int, int]]:
    """Edges among sigs' rows whose components are those of all close pairs.

    With a cut, these are pairs of a row before and one from it on; components within either side are taken to be known elsewhere.
    """
    n = len(sigs)
    forest = Forest(n)
    for word in range(sigs.shape[1]):  # neighbours in order: large groups hang together before pairs are listed
        order, label = np.argsort(sigs[:, word]), forest.labels()
        a, b = order[:-1], order[1:]
        apart = label[a] != label[b]
        _join(forest, a[apart], b[apart], sigs, most)
    segments, halves = sigs.view(np.uint32), sigs.view(np.uint16)
    ask, told = np.arange(cut or n), np.arange(cut, n)
    label, seen = forest.labels(), 0
    for k, (in_segment, in_half) in enumerate(radii(most)):
        if in_half < 0:
            continue
        if seen:
            label, seen = forest.labels(), 0
        sorted_by = label
        key = (halves[told, k].astype(np.int64) << 40) | label[told]
        order = np.argsort(key)
        key, rows = key[order], told[order]
        at = np.searchsorted(key, np.arange((1 << 16) + 1, dtype=np.int64) << 40)
        segment, own_segment, half = segments[rows, k // 2], segments[ask, k // 2], halves[ask, k]
        large = np.bincount(label, minlength=n)[label[ask]] > LARGE
        for mask in flips(in_half):
            value = half ^ mask
            lo, hi = at[value], at[value.astype(np.int64) + 1]
            who = np.flatnonzero(hi > lo)
            lo, hi = lo[who], hi[who]
            skip = large[who] & (hi - lo > LARGE)
            if skip.any():
                own = who[skip]
                own_key = (value[own].astype(np.int64) << 40) | sorted_by[ask[own]]
                a, b = np.searchsorted(key, own_key), np.searchsorted(key, own_key, "right")
                who, lo, hi = np.concatenate((who[~skip], own, own)), np.concatenate((lo[~skip], lo[skip], b)), np.concatenate((hi[~skip], a, hi[skip]))
            for i, j in _met(own_segment[who], lo, hi, segment, in_segment):
                i, j = ask[who[i]], rows[j]
                apart = label[i] != label[j]
                seen += _join(forest, i[apart], j[apart], sigs, most)
                if seen > max(1024, n // 16):
                    label, seen = forest.labels(), 0
    return [(i, j) for i, j in forest.edges if not cut or (i < cut) != (j < cut)]


def _met(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, segment: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with j in lo[i]:hi[i] and at most so many bits between own[i] and segment[j], some at a time."""
    ends = np.cumsum(hi - lo)
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
        count = hi[begin:end] - lo[begin:end]
        j = np.repeat(hi[begin:end] - ends[begin:end] + done, count)
        j += np.arange(len(j))
        met = np.flatnonzero(np.bitwise_count(np.repeat(own[begin:end], count) ^ segment[j]) <= most)
        if len(met):
            yield np.searchsorted(ends[begin:end] - done, met, "right") + begin, j[met]
        begin = end


def _join(forest: Forest, a: np.ndarray, b: np.ndarray, sigs: np.ndarray, most: int) -> int:
    """Joins the close ones of pairs and counts these."""
    close = distances(sigs[a], sigs[b]) <= most
    for i, j in zip(a[close].tolist(), b[close].tolist(), strict=True):
        forest.join(i, j)
    return int(close.sum())


def whole_halves(batches: Iterator[pa.RecordBatch], most: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Tables of about `most` rows that hold all rows of their halves; the batches come sorted by half."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(0)[-1].as_py()
        if sum(b.num_rows for b in held) < most or held[0].column(0)[0].as_py() == last:
            continue
        cuts = [int(np.searchsorted(b.column(0).to_numpy(), last)) for b in held]
        yield pa.Table.from_batches([b.slice(0, k) for b, k in zip(held, cuts, strict=True)])
        held = [b.slice(k) for b, k in zip(held, cuts, strict=True) if k < b.num_rows]
    if held:
        yield pa.Table.from_batches(held)


def near_pairs(unique: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between unique signatures (id, sig) whose components are those of all pairs of up to max_distance bits."""
    if blocks is None:
        n = unique.count()
        blocks = max(1, min(BLOCKS, n // SMALL_ROWS), -(-n // BLOCK_ROWS))
    edges = spark_to_arrow(unique.sparkSession, "a long, b long")

    def match(batches):
        for t in whole_halves(batches, 1):
            tile = t.column("tile").to_numpy()
            starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)], strict=True):
                second = t.column("second").slice(at, end - at).to_numpy()
                order = np.argsort(second, kind="stable")
                ids = t.column("id").slice(at, end - at).to_numpy()[order]
                sigs = np.frombuffer(b"".join(t.column("sig").slice(at, end - at).to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]
                cut = len(ids) - int(second.sum())
                across = tile[at] // blocks != tile[at] % blocks
                if across and cut in (0, len(ids)):
                    continue
                found = np.array(close_edges(sigs, cut if across else 0, max_distance), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], schema=edges)

    own, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = unique.select("id", "sig", own.alias("own"), other.alias("other"))
    tile = F.least("own", "other") * blocks + F.greatest("own", "other")
    rows = rows.select(tile.alias("tile"), (F.col("own") > F.col("other")).cast("int").alias("second"), "id", "sig")
    rows = rows.repartition(blocks * (blocks + 1) // 2, "tile").sortWithinPartitions("tile")
    return rows.mapInArrow(match, "a long, b long").distinct()


def classes(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, kept_doc_id and group_size for each document; kept_doc_id names its group, which may be itself alone."""
    member = _members(materialize(signed(docs), "signatures"), max_distance)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    alone = [F.coalesce("kept_doc_id", "doc_id").alias("kept_doc_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")]
    out = ids.where("doc_id is not null").distinct().join(member, "doc_id", "left").select("doc_id", *alone)
    return out.unionByName(ids.where("doc_id is null").select("doc_id", F.col("doc_id").alias("kept_doc_id"), F.lit(1).cast("long").alias("group_size")))


def duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, kept_doc_id and group_size for each document that goes."""
    return _duplicates(materialize(signed(docs), "signatures"), max_distance)


def _duplicates(sigs: DataFrame, max_distance: int) -> DataFrame:
    return _members(sigs, max_distance).where("doc_id != kept_doc_id")


def _members(sigs: DataFrame, max_distance: int) -> DataFrame:
    """doc_id, kept_doc_id and group_size of the documents in groups of two and more."""
    sigs = sigs.groupBy("doc_id").agg(F.min(F.struct("fp", "sig")).alias("x")).select("doc_id", "x.sig")
    unique = materialize(sigs.groupBy("sig").agg(F.min("doc_id").alias("id")), "unique")
    groups = connected_components(near_pairs(unique, max_distance), 60)
    member = sigs.join(unique, "sig").join(groups, "id", "left").select("doc_id", F.coalesce("component", "id").alias("kept_doc_id"))
    member = materialize(member, "members")
    sizes = member.groupBy("kept_doc_id").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return member.join(sizes, "kept_doc_id").select("doc_id", "kept_doc_id", "group_size")


def apply(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each group."""
    sigs = materialize(signed(docs), "signatures")
    key, n = unused(docs, "id", "n")
    same = F.col("doc_id").cast("long") == F.col(key)
    out = docs.join(_duplicates(sigs, max_distance).select(F.col("doc_id").alias(key)), same, "left_anti")
    repeated = sigs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    if repeated.isEmpty():
        return out
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(fingerprint()))
    once = out.join(repeated, same, "left_semi").withColumn(n, first).where(F.col(n) == 1).drop(n)
    return out.join(repeated, same, "left_anti").unionByName(once)
