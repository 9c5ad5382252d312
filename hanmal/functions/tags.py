"""Part-of-speech tags, output tags, and the integers they are packed into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "EC EF EP ETM ETN IC JC JKB JKC JKG JKO JKQ JKS JKV JX MAG MAJ MM NNB NNG NNP NP NR SE SF SH SL SN SO SP SS SW SWK VA VCN VCP VV VX XPN XR XSA XSN XSV ZN ZV ZZ".split()
N_TAGS = len(TAGS)
NUMBER = {t: i for i, t in enumerate(TAGS, 1)}
#: B-X is X's number, I-X is that plus 46; composites follow.
SIMPLE = [f"B-{t}" for t in TAGS] + [f"I-{t}" for t in TAGS]
WORD_DELIM, SENT_DELIM = -1, -2
CHAR_TAG = 4096


def tagset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TAGS, 1)), "num int, tag string")


def needs_restore(tag_out: Column) -> Column:
    """Whether an output tag is a composite."""
    return tag_out > 2 * N_TAGS


def simple_tag(tag_out: Column) -> Column:
    """1 to 46, for B- and I- tags alike."""
    return F.pmod(tag_out - 1, F.lit(N_TAGS)) + 1


def is_inside(tag_out: Column) -> Column:
    """0 for B-, 1 for I-."""
    return (tag_out > N_TAGS).cast("int")


def tag_name(num: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TAGS)), num)


def out_name(tag_out: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SIMPLE)), tag_out)


def pack(chr_: Column, tag: Column) -> Column:
    """Character and tag as one integer; delimiters (negative tags) stay themselves."""
    return F.when(tag < 0, tag.cast("long")).otherwise(F.ascii(chr_).cast("long") * CHAR_TAG + tag)


def mix_char_tag(chars: Column, tags: Column) -> Column:
    """Packed integers of a character array and its tags; a space is a word delimiter. Tags at the ends may be sentence
    delimiters, which have no character."""
    n, m = F.size(chars), F.size(tags)
    lead = F.when((F.get(tags, F.lit(0)) == SENT_DELIM) & (m > n), 1).otherwise(0)
    body = F.zip_with(chars, F.slice(tags, lead + 1, n), lambda c, t: F.when(c == " ", F.lit(WORD_DELIM).cast("long")).otherwise(pack(c, t)))
    head = F.when(lead == 1, F.array(F.lit(SENT_DELIM).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(m - lead > n, F.array(F.lit(SENT_DELIM).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(head, body, tail)


def unpack_value(packed: Column) -> dict[str, Column]:
    """A restored character packed as chr * 256 + 128 if inside + tag."""
    return {"code": F.floor(packed / 256).cast("int"), "bi": F.floor(packed % 256 / 128).cast("int"), "tag": (packed % 128).cast("int")}


def to_numbers(name: str) -> int:
    """The number of a simple output tag; 0 for others."""
    return SIMPLE.index(name) + 1 if name in SIMPLE else 0


def by_word(flat: Column, words: Column) -> Column:
    """A sentence's flat list of tags as one array for each word; null where their numbers differ."""
    sizes = F.transform(words, F.char_length)
    upto = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    parts = F.transform(words, lambda w, i: F.slice(flat, upto(i) + 1, F.char_length(w)))
    return F.when(F.size(flat) == F.aggregate(sizes, F.lit(0), lambda a, n: a + n), parts)


def spans(lengths: Column) -> Column:
    """Begin and end of each of the parts of these lengths that stand side by side."""
    upto = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    return F.transform(lengths, lambda n, i: F.struct(upto(i).alias("begin"), (upto(i) + n).alias("end")))
