"""Which of very many strings a text holds: windows of the text's bytes against a bitmap of the strings' hashes, then by equality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a needle that are looked for at first; what is longer is confirmed in the text.
WIDE = 64
#: Bytes of text that are gone through at once.
CHUNK = 1 << 19
#: Bits of the bitmap for each needle, at most _MOST bits in all, and bits that one needle sets.
_PER, _MOST, _PROBES = 40, 1 << 28, 5
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def _sums(raw: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums of bytes weighted by powers, modulo 2**64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def _spread(h: np.ndarray, width: int) -> np.ndarray:
    """A window's hash, mixed with its width, so that high bits depend on all of it."""
    h = (h ^ np.uint64(width * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def _bits(h: np.ndarray, k: int, log: int) -> np.ndarray:
    return (h * _STEP + np.uint64(k) * (h | np.uint64(1))) >> np.uint64(64 - log)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins and ends."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _windows(raw: np.ndarray, widths: list[int], log: int, bitmap: np.ndarray):
    """(width, places) of windows that the bitmap may know, by chunks."""
    most = max(widths)
    up, down = _powers(_BASE, min(len(raw), CHUNK + most)), _powers(pow(_BASE, -1, 1 << 64), min(len(raw), CHUNK))
    for start in range(0, len(raw), CHUNK):
        part = raw[start : start + CHUNK + most - 1]
        sums = _sums(part, up)
        for w in widths:
            n = min(CHUNK, len(part) - w + 1)
            if n <= 0:
                continue
            h = _spread((sums[w : w + n] - sums[:n]) * down[:n], w)
            at = None
            for k in range(_PROBES):
                b = _bits(h, k, log)
                known = np.flatnonzero(bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
                h, at = h[known], known if at is None else at[known]
                if not len(at):
                    break
            if len(at):
                yield w, start + at


def _words(log: int):
    """(word, bits): the 64-bit words of the bitmap that needles(head) touch."""

    def run(batches):
        for batch in batches:
            raw, at = _raw(batch.column(0))
            size, up = np.diff(at), _powers(_BASE, WIDE)
            found = []
            for w in np.unique(size):
                if w:
                    mine = raw[at[:-1][size == w][:, None] + np.arange(w)]
                    h = _spread(((mine.astype(np.uint64) + np.uint64(1)) * up[:w]).sum(1, dtype=np.uint64), int(w))
                    found += [_bits(h, k, log) for k in range(_PROBES)]
            if found:
                b = np.unique(np.concatenate(found))
                word, first = np.unique(b >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (b & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def holders(texts: DataFrame, needles: DataFrame, key: str, text: str) -> DataFrame:
    """(key): rows of texts(key, text) that hold a string of needles(needle), which are distinct and not empty.

    The bitmap of the needles' first WIDE bytes, of at most 32 MB, goes to all
    tasks. A task hashes every window of its texts that is as long as a
    needle and sends on those that the bitmap may know, once a text, so that
    neither texts nor their pieces are shuffled. These are joined by equality.
    """
    spark = texts.sparkSession
    head = F.substring(F.encode("needle", "UTF-8"), 1, WIDE)
    short = needles.select("needle", head.alias("head"))
    lengths = short.groupBy(F.octet_length("head").alias("w")).agg(F.count("*").alias("n")).collect()  # at most WIDE rows
    if not lengths:
        return texts.select(key).where("false")
    widths, total = sorted(r.w for r in lengths), sum(r.n for r in lengths)
    log = min(_MOST, max(1 << 16, total * _PER)).bit_length() - 1
    words = short.select("head").mapInArrow(_words(log), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = np.zeros(1 << (log - 6), np.uint64)
    full[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    told = spark.sparkContext.broadcast(full.tobytes())
    kind = texts.schema[key].dataType

    def run(batches):
        bitmap = np.frombuffer(told.value, np.uint8)
        for batch in batches:
            raw, at = _raw(batch.column(1))
            for w, places in _windows(raw, widths, log, bitmap):
                row = np.searchsorted(at, places, "right") - 1
                inside = places + w <= at[row + 1]
                row, places = row[inside], places[inside]
                found = {(int(r), raw[p : p + w].tobytes()) for r, p in zip(row, places)}
                if found:
                    rows, heads = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(heads, pa.binary())], names=[key, "head"])

    met = texts.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, head binary").distinct()
    sure = met.join(short.where(F.octet_length("head") < WIDE).select("head"), "head", "left_semi").select(key)
    if widths[-1] < WIDE:
        return sure.distinct()
    long = met.where(F.octet_length("head") == WIDE).join(short.where(F.octet_length("head") == WIDE), "head").select(key, "needle")
    return sure.union(texts.join(long, key).where(F.contains(text, F.col("needle"))).select(key)).distinct()
