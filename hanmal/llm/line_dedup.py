"""Near-duplicate lines by a deletion-neighbourhood join (operator 3).

Two lines are duplicates when their normalised forms (lower case, white space squeezed) differ by at most one inserted,
deleted or replaced character. A line goes if an earlier line, by (doc_id, line number), is its duplicate, whether or not
that one goes too. Of lines of fewer than min_chars normalised characters only exact copies of normalised lines are duplicates,
as one edit makes another line of a very short one; blank lines stay. With short_copies off, the default of apply(), short
lines stay and are compared with nothing.

Emitting a deletion variant for every character of every line would multiply the corpus by its line length. Of two
lines within one edit, though, either the first or the second half is equal. So each distinct line first sends the
64-bit hashes of its halves (three keys, as the shorter of a pair sets the cut), and only lines that share a half go on.
Within each shared half, all their deletion variants are emitted as hashed keys; equal variants join a line to the line that
is that variant (an insertion), or to a line with the same variant at the same place (a replacement); the edit distance
of every joined pair is then verified on the texts. A half that many lines share (more than hot_lines) is not one task's work: its
lines send their variants as rows of their own, which are joined on (half, variant) by the cluster, and the pairs are verified after
joining the texts; at most one line for each character there is shares a variant at one place, so no variant is hot. Both ways find the same pairs. Exact copies of a line need no variant: a digest of 128 bits
groups them. No candidate is dropped, and none of this depends on how often a line occurs.

Text is shuffled for two things only: to fetch the candidate lines (of documents that a broadcast sketch of fixed size lets
through), and to join what goes with its document.

Defined results: rows with a null doc_id or text pass unchanged, as they have no rank; an empty text stays; rows that
share a doc_id and a text are one document in several copies, which lose the same lines, and rows that share a doc_id
alone are ranked by a hash of their texts; a document whose remaining text is blank is dropped; n_chars, where it
exists, follows the text; other columns are passed through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import CHUNK_CHARS, fingerprint, map_rows, materialize, maybe_among, own_columns, require, spark_to_arrow, unused

ID = ["h1", "h2"]
#: Distinct lines that share a half, up to which one task joins their variants in memory.
HOT_LINES = 100_000
RANK = ["doc_id", "line_no", "fp"]


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def half_keys(s: str) -> list[int]:
    """Hashes of the halves that a line within one edit of s may share with it."""
    n = len(s)
    out = set()
    for m in (n, n - 1):
        h = m // 2
        out.add(xxhash.xxh3_64_intdigest(s[:h], seed=1) - (1 << 63))
        out.add(xxhash.xxh3_64_intdigest(s[n - (m - h) :], seed=2) - (1 << 63))
    return sorted(out)


def lines_of(docs: DataFrame, min_chars: int, short_copies: bool = False) -> DataFrame:
    """One row for each line that is long enough: doc_id, fp, line_no, digest, half keys. short_copies: shorter ones too, without keys."""

    def fn(cols: list[list]) -> dict:
        ids, fps, nos, h1, h2, keys = [], [], [], [], [], []
        for doc_id, fp, text in zip(*cols, strict=True):
            for no, line in enumerate(text.split("\n")):
                s = normalise(line)
                if len(s) >= min_chars or (s and short_copies):
                    a, b = digest(s.encode())
                    ids.append(doc_id), fps.append(fp), nos.append(no), h1.append(a), h2.append(b), keys.append(half_keys(s) if len(s) >= min_chars else [])
        return {"doc_id": ids, "fp": fps, "line_no": nos, "h1": h1, "h2": h2, "keys": keys}

    src = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_rows(src, [F.col("doc_id").cast("long"), fingerprint(), "text"], fn, "doc_id long, fp long, line_no int, h1 long, h2 long, keys array<long>")


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def later_neighbours(group: np.ndarray, rank: np.ndarray, texts: list[str]) -> np.ndarray:
    """Which of these distinct lines have an earlier one of their group within one edit.

    group: ascending numbers; rank: the order of the lines. All deletion variants are hashed at once.
    """
    t = tv.Texts(texts)
    p, inv = tv.powers(len(t.cp) + 2)
    total = np.zeros(len(t.cp) + 1, np.uint64)
    np.cumsum(tv.mix(t.cp + np.uint64(0x51ED27)) * p[: len(t.cp)], out=total[1:])
    salt = tv.mix(group.astype(np.uint64) + np.uint64(77))
    full = tv.mix((total[t.end] - total[t.start]) * inv[t.start] ^ salt)
    line = np.repeat(np.arange(t.n), t.end - t.start)
    at = np.arange(len(line)) + line  # a newline follows each line
    s, e = t.start[line], t.end[line]
    cut = tv.mix(((total[at] - total[s]) + (total[e] - total[at + 1]) * inv[1]) * inv[s] ^ salt[line])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(full)  # a line that is another's variant: one insertion apart
    place = np.minimum(np.searchsorted(full[order], cut), t.n - 1)
    hit = np.flatnonzero(full[order][place] == cut)
    pairs.append((line[hit], order[place[hit]]))
    key = tv.mix(cut ^ (at - s).astype(np.uint64))  # the same variant at the same place: one replacement apart
    order = np.argsort(key)
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    if same.any():
        run = np.cumsum(~same) - 1
        member = np.flatnonzero(same | np.concatenate((same[1:], [False])))
        run, who = run[member], line[order[member]]
        by = np.lexsort((rank[who], run))
        run, who = run[by], who[by]
        first = np.concatenate(([True], run[1:] != run[:-1]))
        lead = who[np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))]
        pairs.append((who[~first], lead[~first]))
    out = np.zeros(t.n, bool)
    for a, b in pairs:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = (i, j) if rank[i] > rank[j] else (j, i)
            if i != j and not out[i] and within_one(texts[i], texts[j]):
                out[i] = True
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[pa.Table]:
    """Tables of about CHUNK_CHARS of text that never cut a group of equal keys; the batches come sorted by key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if size < CHUNK_CHARS:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:  # else the last group began before this batch
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
            size = pc.sum(pc.binary_length(held[0].column(text))).as_py() or 0
        elif held[0].column(key)[0].as_py() != keys[-1]:  # groups before that one are whole
            whole, rest = [], []
            for b in held:
                at = int(np.searchsorted(b.column(key).to_numpy(), keys[-1]))
                whole.append(b.slice(0, at)), rest.append(b.slice(at))
            yield pa.Table.from_batches(whole)
            held = [b for b in rest if b.num_rows]
            size = sum(pc.sum(pc.binary_length(b.column(text))).as_py() or 0 for b in held)
    if held:
        yield pa.Table.from_batches(held)


def variant_rows(lines: DataFrame) -> DataFrame:
    """For each (key, line) its place-bound variants, its variants, and itself: v1, v2 (a digest with the key), kind, h1, h2, RANK.

    kind 0: a variant and the place of the deleted character; 1: a variant; 2: the line itself.
    """
    kinds = "v1 long, v2 long, kind int, h1 long, h2 long, doc_id long, line_no int, fp long"
    schema = spark_to_arrow(lines.sparkSession, kinds)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, h1, h2, doc_id, line_no, fp, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, salt = (h1, h2, doc_id, line_no, fp), key.to_bytes(8, "little", signed=True)
                rows.append((*digest(salt + s.encode()), 2, *own))
                for i in range(len(s)):
                    cut = salt + (s[:i] + s[i + 1 :]).encode()
                    rows.append((*digest(cut), 1, *own))
                    rows.append((*digest(cut + i.to_bytes(8, "little")), 0, *own))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return lines.select("key", *ID, *RANK, "line").mapInArrow(run, kinds)


def joined_variants(lines: DataFrame) -> DataFrame:
    """Digests of the lines (key, ID, RANK, line) that have an earlier one within one edit in their key: by joins on variants alone."""
    v = ["v1", "v2"]
    rows = materialize(variant_rows(lines), "variants")
    who = F.struct(*RANK, *ID)
    first = rows.where("kind = 0").groupBy(*v).agg(F.min(who).alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = rows.where("kind = 0").select(*v, who.alias("one")).join(first, v)
    whole = rows.where("kind = 2").select(*v, who.alias("other"))
    pairs = pairs.union(rows.where("kind = 1").select(*v, who.alias("one")).join(whole, v).select(pairs.columns))
    later, earlier = F.greatest("one", "other"), F.least("one", "other")
    pairs = pairs.where("one != other").select(later.alias("one"), earlier.alias("other")).select("one.h1", "one.h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).distinct()
    text = lines.select(*ID, "line").dropDuplicates(ID)
    near = pairs.join(text, ID).join(text.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other")), ["o1", "o2"])
    return near.where(F.levenshtein("line", "other", 1) >= 0).select(*ID)


def near_copies(docs: DataFrame, distinct: DataFrame, hot_lines: int = HOT_LINES) -> DataFrame:
    """Digests of the distinct lines that have an earlier one within one edit."""
    each = materialize(distinct.select(*ID, "first.*", F.explode("keys").alias("key")), "keys")
    counts = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "halves")
    likely = maybe_among(each, F.col("key"), counts.select(F.col("key").alias("k")))
    shared = materialize(
        likely.join(counts, "key").groupBy("doc_id", "fp")
        .agg(F.collect_list(F.struct("line_no", *ID, "key", (F.col("n") > hot_lines).alias("hot"))).alias("wanted")),
        "shared",
    )
    wanted = shared.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), "wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint().alias("fp"), "text").where("doc_id is not null and text is not null")
    own = maybe_among(own, F.col("fp"), shared.select(F.col("fp").alias("k")))
    found = own.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.col("fp") == F.col("__fp"))).select("doc_id", "fp", "wanted", "text")

    def fetch(cols: list[list]) -> dict:
        out: dict[str, list] = {k: [] for k in ("key", "hot", *ID, *RANK, "line")}
        for doc_id, fp, want, text in zip(*cols, strict=True):
            lines = text.split("\n")
            for x in want:
                row = (x["key"], x["hot"], x["h1"], x["h2"], doc_id, x["line_no"], fp, normalise(lines[x["line_no"]]))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    schema = "key long, hot boolean, h1 long, h2 long, doc_id long, line_no int, fp long, line string"
    lines = map_rows(found, ["doc_id", "fp", "wanted", "text"], fetch, schema).dropDuplicates(["key", *ID])
    names = spark_to_arrow(docs.sparkSession, "h1 long, h2 long")

    def run(batches):
        for t in whole_groups(batches, "key", "line"):
            keys = t.column("key").to_numpy()
            group = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).astype(np.int64))))
            rank = np.empty(len(keys), np.int64)
            rank[np.lexsort([t.column(c).to_numpy() for c in reversed(RANK)])] = np.arange(len(keys))
            gone = pa.array(later_neighbours(group, rank, t.column("line").to_pylist()))
            for b in t.select(ID).filter(gone).cast(names).combine_chunks().to_batches():
                yield b

    any_hot = not counts.where(F.col("n") > hot_lines).isEmpty()
    if any_hot:
        lines = materialize(lines, "candidates")
    near = lines.where("not hot").repartition("key").sortWithinPartitions("key").mapInArrow(run, "h1 long, h2 long")
    return (near.union(joined_variants(lines.where("hot"))) if any_hot else near).distinct()


def removals(docs: DataFrame, min_chars: int = 20, short_copies: bool = False, hot_lines: int = HOT_LINES) -> DataFrame:
    """doc_id, fp and the array of line numbers that go."""
    require(docs, "doc_id", "text")
    lines = materialize(lines_of(docs, min_chars, short_copies), "lines")
    distinct = lines.groupBy(*ID).agg(F.min(F.struct(*RANK)).alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"))
    near = near_copies(docs, distinct, hot_lines).withColumn("near", F.lit(True))
    rules = lines.groupBy(*ID).agg(F.min(F.struct(*RANK)).alias("first"), F.count(F.lit(1)).alias("n")).join(near, ID, "left").where("n > 1 or near")
    gone = lines.select(*ID, *RANK).join(rules, ID).where(F.col("near").isNotNull() | (F.struct(*RANK) != F.col("first")))
    return gone.groupBy("doc_id", "fp").agg(F.collect_set("line_no").alias("lines"))


def apply(docs: DataFrame, min_chars: int = 20, short_copies: bool = False, hot_lines: int = HOT_LINES) -> DataFrame:
    """docs without the lines that repeat an earlier one."""
    key, print_, lines = unused(docs, "id", "fp", "gone")
    gone = removals(docs, min_chars, short_copies, hot_lines).select(F.col("doc_id").alias(key), F.col("fp").alias(print_), F.col("lines").alias(lines))
    on = (F.col("doc_id").cast("long") == F.col(key)) & (fingerprint() == F.col(print_))
    left = F.array_join(F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains(lines, i), x)), lambda x: x.isNotNull()), "\n")
    changed = F.col(lines).isNotNull()
    kinds = dict(docs.dtypes)
    columns = {"text": F.when(changed, left).otherwise(F.col("text"))}
    out = docs.join(gone.hint("shuffle_hash"), on, "left").withColumns(columns).where(~changed | ~F.col("text").rlike(r"^\s*$"))
    if "n_chars" in kinds:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kinds["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*own_columns(docs))
