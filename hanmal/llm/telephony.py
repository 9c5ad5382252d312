"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled PCM (operator 9).

The companded codecs expand by a table lookup on whole columns. ADPCM is sequential within a block only, so the decoder walks
over the places of a block and handles all blocks of a chunk at each place with numpy. The samples are resampled
by a polyphase windowed-sinc filter, which computes only the samples that stay, and stored as 16-bit little-endian PCM. Memory is in
proportion to a clip's input and output, whatever the rates.

Rows are media structs: codec, rate, block (bytes of an ADPCM block) and data. Every byte is decoded; nothing is cut or capped.

Defined results: null data gives null PCM and no samples; empty data gives empty PCM; an unknown or null codec, or a rate or block that cannot
be, gives null PCM and the reason in `error`; a last ADPCM block that is cut short gives the samples it holds, one of fewer than
four bytes none; a key column named like one of OUTPUT is returned as key_NAME; repeated rows are decoded alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, quoted, require, table

TARGET_RATE = 16_000
BLOCK = 256
#: Products of a sample and a tap that resampling holds at once.
BLOCK_CELLS = 1 << 18
OUTPUT = ("codec", "rate", "n_samples", "seconds", "pcm", "error")
CODECS = ("mulaw", "alaw", "ima_adpcm")
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_STEP = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


@functools.lru_cache(2)
def expansion(codec: str) -> np.ndarray:
    """The sample of each byte."""
    b = np.arange(256)
    if codec == "mulaw":
        u = ~b & 0xFF
        mag = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
        return np.where(u & 0x80, -mag, mag).astype(np.int16)
    a = b ^ 0x55
    exp, man = (a >> 4) & 7, (a & 0x0F) << 4
    mag = np.where(exp == 0, man + 8, (man + 0x108) << np.maximum(exp - 1, 0))
    return np.where(a & 0x80, mag, -mag).astype(np.int16)


@functools.lru_cache(1)
def _deltas() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next step index for each step index and nibble."""
    step, n = _STEP[:, None], np.arange(16)
    diff = (step >> 3) + np.where(n & 1, step >> 2, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 4, step, 0)
    return np.where(n & 8, -diff, diff).astype(np.int32).ravel(), np.clip(np.arange(89)[:, None] + _INDEX[n], 0, 88).astype(np.int32).ravel()


def decode_adpcm(clips: list[bytes], block: int = BLOCK) -> list[np.ndarray]:
    """Samples of each mono IMA ADPCM clip; all blocks of all clips are decoded together."""
    blocks = [-(-len(c) // block) for c in clips]
    raw = np.zeros((sum(blocks), block), np.uint8)
    at = 0
    for c, n in zip(clips, blocks, strict=True):
        raw[at : at + n].reshape(-1)[: len(c)] = np.frombuffer(c, np.uint8)
        at += n
    out = np.empty((len(raw), 2 * (block - 4) + 1), np.int16)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    nibbles = np.stack([raw[:, 4:] & 15, raw[:, 4:] >> 4], 2).reshape(len(raw), 2 * (block - 4)).T.astype(np.int32)
    diff, after = _deltas()
    for k in range(len(nibbles)):
        cell = index * 16 + nibbles[k]
        value = np.clip(value + diff[cell], -32768, 32767)
        index = after[cell]
        out[:, k + 1] = value
    got, at = [], 0
    for c, n in zip(clips, blocks, strict=True):
        rest = len(c) - (n - 1) * block if n else 0
        short = out.shape[1] - (2 * (rest - 4) + 1 if rest >= 4 else 0) if n else 0
        flat = out[at : at + n].reshape(-1)
        got.append(flat[: len(flat) - short])
        at += n
    return got


@functools.lru_cache(8)
def _filter(up: int, down: int, zeros: int = 12) -> np.ndarray:
    """Low-pass taps for the faster of both rates, a Kaiser-windowed sinc over `zeros` crossings a side."""
    m = max(up, down)
    t = np.arange(-zeros * m, zeros * m + 1)
    return (np.sinc(t / m) * np.kaiser(len(t), 8.0) * up / m).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """x at another rate: ceil(len(x) * target / rate) samples, rounded and clipped to 16 bits."""
    if rate == target or not len(x):
        return x.astype(np.int16)
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    h = _filter(up, down)
    middle = len(h) // 2
    x = x.astype(np.float32)
    n = -(-len(x) * up // down)
    if down == 1:  # every phase is wanted whole
        y = np.empty((len(x) + -(-len(h) // up), up), np.float32)
        for p in range(up):
            z = np.convolve(x, h[p::up])
            y[: len(z), p] = z
            y[len(z) :, p] = 0
        y = y.reshape(-1)[middle : middle + n]
    else:  # only the samples that stay, a block at a time: each is its phase's taps over the inputs around it
        taps = np.zeros((-(-len(h) // up), up), np.float32)
        taps.reshape(-1)[: len(h)] = h
        back = np.arange(len(taps))
        y = np.empty(n, np.float32)
        block = max(1, BLOCK_CELLS // len(taps))
        for lo in range(0, n, block):
            at = middle + np.arange(lo, min(n, lo + block), dtype=np.int64) * down
            source = at[:, None] // up - back
            inside = (source >= 0) & (source < len(x))
            y[lo : lo + block] = np.einsum("ij,ij->i", np.where(inside, x[np.clip(source, 0, len(x) - 1)], 0), taps[:, at % up].T)
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def decode(media: list[dict | None], target: int = TARGET_RATE) -> list[tuple[bytes | None, int, str | None]]:
    """PCM, samples and error of each clip."""
    out: list = [(None, 0, None)] * len(media)
    adpcm: dict[int, list[int]] = {}
    for i, m in enumerate(media):
        if m is None or m["data"] is None:
            continue
        rate, block = m["rate"], m["block"]
        if m["codec"] not in CODECS:
            out[i] = (None, 0, f"unknown codec {m['codec']}")
        elif not rate or rate < 0:
            out[i] = (None, 0, f"impossible rate {rate}")
        elif m["codec"] == "ima_adpcm":
            if not block or block <= 4:
                out[i] = (None, 0, f"impossible block {block}")
            else:
                adpcm.setdefault(block, []).append(i)
        else:
            y = resample(expansion(m["codec"])[np.frombuffer(m["data"], np.uint8)], rate, target)
            out[i] = (y.astype("<i2").tobytes(), len(y), None)
    for block, at in adpcm.items():
        for i, x in zip(at, decode_adpcm([media[i]["data"] for i in at], block), strict=True):
            y = resample(x, media[i]["rate"], target)
            out[i] = (y.astype("<i2").tobytes(), len(y), None)
    return out


def to_pcm(clips: DataFrame, key: str, target: int = TARGET_RATE) -> DataFrame:
    """clips: key, codec, rate, block, data. Key, codec, rate, n_samples, seconds, pcm and error of each row."""
    require(clips, key, "codec", "rate", "block", "data")
    kind = dict(clips.dtypes)[key]
    named = f"key_{key}" if key.lower() in OUTPUT else key

    def fn(cols: list[list]) -> dict:
        media = [dict(zip(("codec", "rate", "block", "data"), r, strict=True)) for r in zip(*cols[1:], strict=True)]
        got = decode(media, target)
        return {named: cols[0], "codec": cols[1], "rate": [target] * len(got), "n_samples": [n for _, n, _ in got], "seconds": [n / target for _, n, _ in got], "pcm": [p for p, _, _ in got], "error": [e for _, _, e in got]}

    schema = f"{quoted(named)} {kind}, codec string, rate int, n_samples long, seconds double, pcm binary, error string"
    return map_rows(clips, [F.col(quoted(key)).alias("__key"), "codec", "rate", "block", "data"], fn, schema)


def clips_of(docs: DataFrame) -> DataFrame:
    """A stand-in for recordings, as no table holds audio: each text's bytes are taken for 8 kHz telephony in the codec that
    its doc_id picks."""
    codec: Column = F.element_at(F.array(*map(F.lit, CODECS)), (F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(3)) + 1).cast("int"))
    return docs.select("doc_id", codec.alias("codec"), F.lit(8000).alias("rate"), F.lit(BLOCK).alias("block"), F.col("text").cast("binary").alias("data"))


def apply(spark, sf_dir: str) -> DataFrame:
    return to_pcm(clips_of(table(spark, sf_dir, "documents")), "doc_id")
