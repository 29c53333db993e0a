"""Benchmark decontamination by spaced-seed hashing.

A mask marks the token positions of a window that count; the others may differ.
Hashes of all masked windows of the benchmark are joined with those of the
documents, and each hit is verified along its diagonal: the longest stretch in
which enough tokens agree, substitutions allowed, has to be long enough.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K

#: One of these fits 283 of the 286 ways in which 3 of 13 tokens differ.
MASKS = ("11101011", "1100100111", "111111", "1011000111", "1110001011")
#: Items of fewer tokens have masks of their length, of which one fits wherever few enough tokens differ.
SHORT = 13
MAX_BITS = 1 << 28
PROBES = 6


@cache
def short_masks(n: int, share: float) -> tuple[str, ...]:
    """Masks of n positions or fewer, one of which fits however many of n tokens may differ at this share; greedily chosen."""
    k = n - ceil(share * n - 1e-9)
    weight = min(6, n - k, max(4, n - 2 * k))
    ways = np.array([[i in c for i in range(n)] for c in combinations(range(n), k)])
    fits = {}
    for span in range(weight, n + 1):
        for inner in combinations(range(1, span - 1), max(0, weight - 2)):
            on = np.array(sorted({0, *inner, span - 1}))
            fits["".join("1" if i in on else "0" for i in range(span))] = np.any([~ways[:, on + at].any(1) for at in range(n - span + 1)], axis=0)
    names, fits, out = list(fits), np.array(list(fits.values())), []
    left = np.ones(len(ways), bool)
    while left.any():
        best = int(np.argmax((fits & left).sum(1)))
        out.append(names[best])
        left &= ~fits[best]
    return tuple(out)


def _masks(lengths, share: float) -> list[tuple[str, int]]:
    """The masks with 0, and those for items of each of the lengths, with the length."""
    return [*((m, 0) for m in MASKS), *((m, n) for n in lengths for m in short_masks(n, share))]


def masked_hashes(t: K.Tokens, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """First token of each window of the mask inside one text, and the hash of its marked tokens."""
    m, span = len(t.hash), len(mask)
    if m < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(m - span + 1, int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += t.hash[j : m - span + 1 + j]
    at = np.flatnonzero(t.row[span - 1 :] == t.row[: m - span + 1])
    return at, K.fmix(h[at])


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch of which at least this share is equal, the first of several."""
    s = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - share, -share))))
    low = np.minimum.accumulate(s)
    # the first start whose sum is not above that of the end
    start = np.searchsorted(-low, -(s + 1e-9), "left")
    b = int(np.argmax(np.arange(len(s)) - start))
    return int(start[b]), b


def _items(masks):
    """Rows of the benchmark: item, tokens, and its masked hashes with positions."""

    @X.trimmed
    def run(batches):
        for batch in batches:
            col, ids = K.strings(batch.column(1)), batch.column(0).to_pylist()
            t = K.tokenise(col)
            first = t.first()
            size = np.diff(first)
            rows, hashes, at = [], [], []
            for m, length in masks:
                where, h = masked_hashes(t, m)
                if length:
                    on = size[t.row[where]] == length
                    where, h = where[on], h[on]
                rows.append(t.row[where]), hashes.append(h), at.append(where - first[t.row[where]])
            rows, hashes, at = map(np.concatenate, (rows, hashes, at))
            for i in range(len(col)):
                on = rows == i
                yield pa.RecordBatch.from_pydict({"item": [ids[i]], "size": [int(size[i])], "tokens": [t.hash[first[i] : first[i + 1]].tobytes()], "hashes": [hashes[on].view(np.int64)], "at": [at[on].astype(np.int32)]}, schema=_ITEM(batch.schema.field(0).type))

    return run


def _ITEM(id_type):
    return pa.schema([("item", id_type), ("size", pa.int32()), ("tokens", pa.binary()), ("hashes", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def _places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """Bit of a filter of 2^k bits that a probe of a hash looks at."""
    with np.errstate(over="ignore"):
        return (h * np.uint64(0x9E3779B97F4A7C15 + 2 * probe)) >> np.uint64(65 - bits.bit_length())


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter over the column's hashes: 64 bits and 6 probes each, 32 MB at most.

    It only spares rows: what passes is joined on the hashes themselves, so a
    full filter costs time and changes no result.
    """
    n = hashes.count()
    bits = 1 << 10
    while bits < min(64 * n, MAX_BITS):
        bits *= 2

    def fill(tables):
        b = np.zeros(bits // 8, np.uint8)
        for t in tables:
            h = t.column(0).to_numpy().view(np.uint64)
            for probe in range(PROBES):
                at = _places(h, bits, probe)
                np.bitwise_or.at(b, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([b.tobytes()], pa.binary())})

    def join(tables):
        b = np.zeros(bits // 8, np.uint8)
        for t in tables:
            for x in t.column(0):
                b |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_pydict({"bits": pa.array([b.tobytes()], pa.binary())})

    tasks = max(1, min(8, n // 5_000_000))
    filled = hashes.select(column).coalesce(tasks).mapInArrow(fill, "bits binary")
    if tasks > 1:
        filled = filled.repartition(1).mapInArrow(join, "bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for x in filled.toLocalIterator():
        out |= np.frombuffer(x[0], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    left = np.arange(len(h))
    for probe in range(PROBES):
        at = _places(h[left], len(bits) * 8, probe)
        left = left[(np.take(bits, (at >> np.uint64(3)).astype(np.int64)) >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(h), bool)
    out[left] = True
    return out


def _segments(masks, bits, reach):
    """Stretches of documents around windows that the bitmap lets pass, `reach` tokens to either side."""

    @X.trimmed
    def run(batches):
        held = bits.value
        for batch in batches:
            col, ids, keys = K.strings(batch.column(2)), batch.column(0), batch.column(1)
            schema = pa.schema([("__id", ids.type), ("__key", pa.int64()), ("start", pa.int64()), ("tokens", pa.binary()), ("hashes", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
            for lo, hi in K.slices(col):
                t = K.tokenise(col.slice(lo, hi - lo))
                at, h = [], []
                for m in masks:
                    where, x = masked_hashes(t, m)
                    on = in_bitmap(held, x)
                    at.append(where[on]), h.append(x[on])
                at, h = np.concatenate(at), np.concatenate(h)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                row, first = t.row[at], t.first()
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (np.diff(at) > reach))))
                out = {n: [] for n in schema.names}
                for a, b in zip(new, np.append(new[1:], len(at))):
                    r = int(row[a])
                    s, e = max(int(at[a]) - reach, int(first[r])), min(int(at[b - 1]) + reach, int(first[r + 1]))
                    for n, v in zip(schema.names, (ids[lo + r].as_py(), keys[lo + r].as_py(), s - int(first[r]), t.hash[s:e].tobytes(), h[a:b].view(np.int64), (at[a:b] - s).astype(np.int32))):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _verify(least, share):
    @X.trimmed
    def run(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep, starts, sizes, matches = [], [], [], []
            for i, (seg, item, shift) in enumerate(zip(c["tokens"], c["item_tokens"], c["shift"].to_pylist())):
                d, q = np.frombuffer(seg.as_buffer(), np.uint64), np.frombuffer(item.as_buffer(), np.uint64)
                lo, hi = max(0, shift), min(len(d), shift + len(q))
                equal = d[lo:hi] == q[lo - shift : hi - shift]
                a, b = longest_stretch(equal, share)
                n = int(equal[a:b].sum())
                if b - a >= min(least, len(q)):
                    keep.append(i), starts.append(c["start"][i].as_py() + lo + a), sizes.append(b - a), matches.append(n)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2)], names=batch.schema.names[:3]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(matches, pa.int32())], names=["__id", "__key", "__item", "first_token", "n_tokens", "n_equal"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.75, whole: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: (__id, __key, __item, first_token, n_tokens, n_equal), the longest of each document and item.

    least: tokens an overlap needs, or the item's length where that is less.
    share: part of its tokens that must agree, so items of 1 to 3 tokens match
    exactly. Items of under `whole` tokens match nothing; by default there are
    none. Ties of equal overlaps are broken by position. Items and documents
    without any word match nothing.
    """
    items_in = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    kind = items_in.schema["item"].dataType.simpleString()
    items = X.written(items_in.mapInArrow(_items(_masks(range(whole, SHORT), share)), f"item {kind}, size int, tokens binary, hashes array<long>, at array<int>"), "items")
    hashes = X.written(items.select("item", F.explode(F.arrays_zip("hashes", "at")).alias("x")).select("item", F.col("x.hashes").alias("h"), F.col("x.at").alias("p")), "hashes")
    stat = items.agg(F.max("size"), F.array_sort(F.collect_set(F.when(F.col("size").between(whole, SHORT - 1), F.col("size"))))).first()
    reach = int(stat[0] or 0) + SHORT
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(hashes, "h"))
    keyed = X.with_row_key(docs, id_col, text_col).where("__text is not null").select("__id", "__key", "__text")
    idk = keyed.schema["__id"].dataType.simpleString()
    seg = X.written(keyed.mapInArrow(_segments(list(dict.fromkeys(m for m, _ in _masks(stat[1] or [], share))), bits, reach), f"__id {idk}, __key long, start long, tokens binary, hashes array<long>, at array<int>"), "segments")
    hit = seg.select("__key", "start", F.explode(F.arrays_zip("hashes", "at")).alias("x")).select("__key", "start", F.col("x.hashes").alias("h"), F.col("x.at").alias("d"))
    hit = hit.join(X.small_side(hashes), "h").select("__key", "start", "item", (F.col("d") - F.col("p")).alias("shift")).distinct()
    both = hit.join(seg.select("__id", "__key", "start", "tokens"), ["__key", "start"]).join(items.select("item", F.col("tokens").alias("item_tokens")), "item")
    found = both.select("__id", "__key", "item", "start", "tokens", "item_tokens", "shift").mapInArrow(_verify(least, share), f"__id {idk}, __key long, __item {kind}, first_token long, n_tokens int, n_equal int")
    w = Window.partitionBy("__key", "__item").orderBy(F.desc("n_equal"), "first_token", "n_tokens")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id, first_token, n_tokens, n_equal): the longest verified overlap of each document and item.

    Rows equal in id and text are one document; rows of one id with other texts
    are looked at each. Null texts and items match nothing, null ids are
    reported as null; other columns are not read. Items of one text are each
    reported. Empty tables give no rows.
    """
    return overlaps(docs, benchmark, id_col=id_col, item_col=item_col, **options).select(F.col("__id").alias(id_col), F.col("__item").alias(item_col), "first_token", "n_tokens", "n_equal")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those in which leaks() finds an overlap; columns as given, other rows untouched."""
    bad = X.written(overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("__key").distinct(), "bad")
    return docs.select(F.struct("*").alias("__row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("__key")).join(X.small_side(bad), "__key", "left_anti").select("__row.*")
