"""Repeated passages by hashing lines and the sentences in them (operator 10).

A unit is a line, cut further after sentence-final punctuation, and before a capitalised word once the unit has min_words
words (a passage pasted into the middle of another sentence thus starts a unit of its own). Neighbouring sentences of a
line that are shorter than that are taken together until they have min_words words. Units are normalised (lower
case, white space squeezed) and hashed to 128 bits; digests are grouped globally and the occurrence in the smallest doc_id, and
there the first, is kept. Repeats form runs of neighbouring units. What is left of short sentences (a gap) is not a unit,
as it repeats by chance; a run goes on over a gap only if the gap with the units on both sides of it (a bridge, hashed and grouped as units are)
occurred before. A passage that starts or ends within a sentence shares only a part of the
units at its edges, so a run is extended word by word as long as the words beside its units are those beside their kept
occurrences, and goes if it then has at least min_run words. Offsets are characters of the original text. A passage without a
whole unit in it has nothing to start from and is not found.

A unit that occurred before in its own document needs no other: only first occurrences within a document are grouped, by a
hash aggregation of fixed-width columns with map-side combining, so that no digest is hot, however often it occurs. The join
that follows gets only units that a broadcast sketch of fixed size lets through. Hashes of the words beside a unit are fetched a
few at a time, and more only where all of them agree, up to the ends of the texts.

Defined results: rows with a null doc_id or text take no part (clean() passes them on); empty texts have no units; rows that share a doc_id are one
document: their units are not repeats of each other, and repeated rows lose the same; an empty table gives an empty
table; other columns are passed on by clean(), whatever their names, but for a column kept_spans, which is replaced.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fingerprint, map_rows, materialize, maybe_among, quoted, require, unused

MIN_WORDS, MIN_RUN = 4, 30
#: Words beside a unit that are compared at first; each further round compares eight times as many.
FIRST_REACH = 4
UNIT_COLUMNS = {"doc_id": "long", "fp": "long", "no": "int", "bridge": "boolean", "begin": "int", "end": "int", "words": "int", "h1": "long", "h2": "long", "gap_words": "int", "again": "boolean", "kept_begin": "int", "kept_end": "int"}
#: Begin, end, words, digest; words of the gap before it, and the digest of the bridge over that gap from the unit before, if there are both.
Unit = tuple[int, int, int, bytes, int, bytes | None]


def _ranges(*categories: str) -> str:
    """A regex class of the code points of these categories."""
    own = [cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) in categories]
    out, start = [], own[0]
    for a, b in zip(own, [*own[1:], -1], strict=True):
        if b != a + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}" if a > start else re.escape(chr(a)))
            start = b
    return "[" + "".join(out) + "]"


@functools.lru_cache(1)
def cuts() -> re.Pattern:
    """White space between units; group 1: only once the unit is long enough."""
    return re.compile(rf"\s*\n\s*|(?<=[.!?…。])\s+|(\s+)(?={_ranges('Lu', 'Lt')}{_ranges('Ll')})")


def units(text: str, min_words: int = MIN_WORDS) -> list[Unit]:
    """The units of at least min_words words, in order."""
    out: list[Unit] = []
    begin, held = 0, []  # held: neighbouring short sentences of one line
    gap: list[str] = []  # words since the last unit that are in no unit

    before: list[str] = []  # words of the last unit

    def add(b: int, e: int, words: list[str]) -> None:
        nonlocal before
        out.append((b, e, len(words), _digest(words), len(gap), _digest(["", *before, *gap, *words]) if gap and before else None))
        before = words
        gap.clear()

    for m in [*cuts().finditer(text), None]:
        end = m.start() if m else len(text)
        if m and m.group(1) is not None and text.count(" ", begin, end) < min_words - 1:
            continue
        words = text[begin:end].lower().split()
        if len(words) >= min_words:
            gap += [w for x in held for w in x[2]]
            add(begin, end, words)
            held = []
        elif words:
            held.append((begin, end, words))
            together = [w for x in held for w in x[2]]
            if len(together) >= min_words:
                add(held[0][0], end, together)
                held = []
        if m and "\n" in m.group():
            gap += [w for x in held for w in x[2]]
            held = []
        begin = m.end() if m else end
    return out


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode())


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """UNIT_COLUMNS of each unit, and of each bridge to the unit `no`: again says whether the document had it before, and kept_ where it first did."""
    require(docs, "doc_id", "text")

    def fn(cols: list[list]) -> dict:
        rows = []
        for doc_id, fp, text in zip(*cols, strict=True):
            seen: dict[bytes, tuple[int, int]] = {}

            def add(no: int, bridge: bool, b: int, e: int, n: int, d: bytes, gap: int) -> None:
                again = d in seen  # noqa: B023
                first = seen.setdefault(d, (b, e))  # noqa: B023
                rows.append((doc_id, fp, no, bridge, b, e, n, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), gap, again, *first))  # noqa: B023

            for no, (b, e, n, d, gap, over) in enumerate(units(text, min_words)):
                add(no, False, b, e, n, d, gap)
                if over is not None:
                    add(no, True, b, e, n, over, gap)
        return dict(zip(UNIT_COLUMNS, zip(*rows, strict=True), strict=True)) if rows else {k: [] for k in UNIT_COLUMNS}

    src = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_rows(src, [F.col("doc_id").cast("long"), fingerprint(), "text"], fn, ", ".join(f"{k} {v}" for k, v in UNIT_COLUMNS.items()))


_WORD = re.compile(r"\S+")


def words_after(text: str, at: int, most: int) -> list[tuple[int, int]]:
    """Begin and end of the first `most` words from at on."""
    return [m.span() for m in itertools.islice(_WORD.finditer(text, at), most)]


def words_before(text: str, at: int, most: int) -> list[tuple[int, int]]:
    """Begin and end of the last `most` words before at, the last first. Reads no more of text than it needs, to a factor of two."""
    back = 8 * most
    while True:
        low = max(0, at - back)
        found = [m.span() for m in _WORD.finditer(text, low, at)]
        if low and found and found[0][0] == low and not text[low - 1].isspace():
            found.pop(0)  # cut in two by low
        if len(found) >= most or not low:
            return found[::-1][:most]
        back *= 2


def beside(docs: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """Hashes and outer offsets of up to reach words before (side -1) or after (side 1) the places of wanted: doc_id, fp, side, at."""
    wanted = materialize(wanted.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("side", "at")).alias("wanted")), "wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint().alias("fp"), "text").where("doc_id is not null and text is not null")
    own = maybe_among(own, F.col("fp"), wanted.select(F.col("fp").alias("k")))
    wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), "wanted")  # own has no other columns
    found = own.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.col("fp") == F.col("__fp"))).select("doc_id", "fp", "wanted", "text")

    def fetch(cols: list[list]) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "fp", "side", "at", "hashes", "outer")}
        for doc_id, fp, want, text in zip(*cols, strict=True):
            for x in want:
                near = words_after(text, x["at"], reach) if x["side"] > 0 else words_before(text, x["at"], reach)
                hashes = [xxhash.xxh3_64_intdigest(text[b:e].lower().encode()) - (1 << 63) for b, e in near]
                row = (doc_id, fp, x["side"], x["at"], hashes, [e if x["side"] > 0 else b for b, e in near])
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    schema = "doc_id long, fp long, side int, at int, hashes array<long>, outer array<int>"
    return map_rows(found, ["doc_id", "fp", "wanted", "text"], fetch, schema).dropDuplicates(["doc_id", "fp", "side", "at"])


def extended(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each run's outermost offset of the words that agree beyond its edge, and how many these are: doc_id, fp, run, side, reached, more.

    edges: doc_id, fp, run, side, edge (of the run), at (of the unit), kept_doc_id, kept_fp, kept_at.
    """
    reach, rounds = FIRST_REACH, []
    edges = edges.withColumn("more", F.lit(0))
    while True:
        places = edges.select("doc_id", "fp", "side", "at").union(edges.select("kept_doc_id", "kept_fp", "side", "kept_at"))
        near = materialize(beside(docs, places, reach), "beside")
        kept = near.select(F.col("doc_id").alias("kept_doc_id"), F.col("fp").alias("kept_fp"), "side", F.col("at").alias("kept_at"), F.col("hashes").alias("kept_hashes"), F.col("outer").alias("kept_outer"))
        both = edges.join(near.hint("shuffle_hash"), ["doc_id", "fp", "side", "at"]).join(kept.hint("shuffle_hash"), ["kept_doc_id", "kept_fp", "side", "kept_at"])
        differs = F.array_position(F.zip_with("hashes", "kept_hashes", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        same = F.when(differs > 0, differs - 1).otherwise(F.size("hashes")).cast("int")
        both = both.withColumn("same", same).withColumn("agreed", F.slice("outer", 1, F.col("same")))
        both = both.withColumn("more", F.col("more") + F.size(F.filter("agreed", lambda x: (x - F.col("edge")) * F.col("side") > 0)))
        last = lambda c, or_else: F.when(F.col("same") > 0, F.element_at(c, F.greatest(F.col("same"), F.lit(1)))).otherwise(F.col(or_else))
        both = both.withColumn("at", last("outer", "at")).withColumn("kept_at", last("kept_outer", "kept_at"))
        done = materialize(both.select(*edges.columns, (F.col("same") == reach).alias("open")), "edges")
        rounds.append(done.where("not open"))
        edges = done.where("open").drop("open")
        if edges.isEmpty():
            break
        reach *= 8
    reached = functools.reduce(DataFrame.union, [r.select("doc_id", "fp", "run", "side", "at", "more") for r in rounds])
    return reached.groupBy("doc_id", "fp", "run", "side").agg(F.max(F.col("at") * F.col("side")).alias("reached"), F.max("more").alias("more")).withColumn("reached", F.col("reached") * F.col("side"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """One row for each run that goes: doc_id, fp, begin, end, words, units, and kept_doc_id, which holds its first unit."""
    all_units = materialize(unit_table(docs, min_words), "units")
    spread = all_units.where("not again").groupBy("h1", "h2").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last")).where("kept_doc_id < last")
    spread = materialize(spread.drop("last"), "spread")
    likely = maybe_among(all_units.where("not again"), F.col("h1"), spread.select(F.col("h1").alias("k"))).drop("kept_begin", "kept_end")
    shared = materialize(likely.join(spread, ["h1", "h2"]), "shared")
    source = shared.where("kept_doc_id = doc_id and not bridge").groupBy("h1", "h2").agg(F.min(F.struct("fp", "begin", "end")).alias("source"))
    source = source.select("h1", "h2", *[F.col(f"source.{c}").alias(f"kept_{c}") for c in ("fp", "begin", "end")])
    columns = ["doc_id", "fp", "no", "begin", "end", "words", "gap_words", "kept_doc_id", "kept_fp", "kept_begin", "kept_end"]
    gone = shared.where("kept_doc_id < doc_id and not bridge").join(source, ["h1", "h2"]).select(*columns)
    own = all_units.where("again and not bridge").withColumn("kept_doc_id", F.col("doc_id")).withColumn("kept_fp", F.col("fp"))
    gone = gone.unionByName(own.select(*columns)).distinct()
    place = ["doc_id", "fp", "no"]
    bridges = shared.where("kept_doc_id < doc_id and bridge").select(*place).union(all_units.where("again and bridge").select(*place)).distinct()
    gone = gone.join(bridges.withColumn("bridged", F.lit(True)), place, "left")
    order = Window.partitionBy("doc_id", "fp").orderBy("no")
    goes_on = F.coalesce((F.lag("no").over(order) + 1 == F.col("no")) & ((F.col("gap_words") == 0) | F.col("bridged")), F.lit(False))
    gone = gone.withColumn("opens", (~goes_on).cast("int")).withColumn("run", F.sum("opens").over(order))
    run = Window.partitionBy("doc_id", "fp", "run")
    inner = F.col("words") + F.when(F.col("opens") == 0, F.col("gap_words")).otherwise(0)
    whole = {"run_begin": F.min("begin"), "run_end": F.max("end"), "run_words": F.sum(inner), "run_units": F.count(F.lit(1)), "run_kept": F.min(F.struct("no", "kept_doc_id"))}
    gone = materialize(gone.withColumns({k: v.over(run) for k, v in whole.items()}).withColumn("run_kept", F.col("run_kept.kept_doc_id")), "runs")
    # a short run may hold units whose kept occurrences are elsewhere by chance, so each of its units is tried
    edge = lambda side, own: gone.where((F.col("run_words") < min_run) | (F.col(own) == F.col(f"run_{own}"))).select("doc_id", "fp", "run", F.lit(side).alias("side"), F.col(f"run_{own}").alias("edge"), F.col(own).alias("at"), "kept_doc_id", "kept_fp", F.col(f"kept_{own}").alias("kept_at"))
    by_side = materialize(extended(docs, edge(-1, "begin").union(edge(1, "end"))), "extended")
    runs = gone.select("doc_id", "fp", "run", *whole).distinct()
    for side, name in ((-1, "left"), (1, "right")):
        runs = runs.join(by_side.where(F.col("side") == side).select("doc_id", "fp", "run", F.col("reached").alias(name), F.col("more").alias(f"{name}_more")), ["doc_id", "fp", "run"])
    runs = runs.select("doc_id", "fp", F.least("run_begin", "left").alias("begin"), F.greatest("run_end", "right").alias("end"), (F.col("run_words") + F.col("left_more") + F.col("right_more")).alias("words"), "run_units", "run_kept", "run_begin")
    # runs of one passage that other cuts have parted are extended to the same
    return (
        runs.where(F.col("words") >= min_run).groupBy("doc_id", "fp", "begin", "end")
        .agg(F.max("words").alias("words"), F.sum("run_units").alias("units"), F.min_by("run_kept", "run_begin").alias("kept_doc_id"))
    )


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """What is left of text, its pieces joined by newlines, and the offsets of the pieces in text."""
    kept, at = [], 0
    for b, e in [*sorted(spans), (len(text), len(text))]:
        if text[at:b].strip():
            kept.append((at, b))
        at = max(at, e)
    return "\n".join(text[b:e].strip() for b, e in kept), kept


def clean(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """docs with the repeats cut out of text, and kept_spans: begin and end of what is left, null where all is."""
    key, print_, gone, done = unused(docs, "id", "fp", "spans", "cut")
    spans = repeats(docs, min_words, min_run).groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(gone))
    spans = spans.select(F.col("doc_id").alias(key), F.col("fp").alias(print_), gone)
    joined = docs.join(spans.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(key)) & (fingerprint() == F.col(print_)), "left")

    @F.pandas_udf("struct<text string, kept array<struct<begin int, end int>>>")
    def cut(text, gone):
        import pandas as pd

        got = [without(t, [(x["begin"], x["end"]) for x in g]) if g is not None else (t, None) for t, g in zip(text, gone, strict=True)]
        return pd.DataFrame({"text": [a for a, _ in got], "kept": [None if b is None else [{"begin": x, "end": y} for x, y in b] for _, b in got]})

    out = joined.withColumn(done, F.when(F.col(gone).isNotNull(), cut("text", gone)))
    text = F.when(F.col(gone).isNotNull(), F.col(f"{done}.text")).otherwise(F.col("text"))
    own = [text.alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns if c.lower() != "kept_spans"]
    return out.select(*own, F.col(f"{done}.kept").alias("kept_spans"))
