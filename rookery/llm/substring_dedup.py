"""Substring deduplication by MinHash banding of content-defined paragraphs.

Repeated passages seldom begin where a line does, so paragraphs are cut by
content: a cut is a word whose pair with the next word has the least hash of
all pairs up to `reach` words to either side, which depends on nearby words
alone. A paragraph runs from a cut to the first cut `least` words on or later;
paragraphs overlap, and a passage of 50 words holds whole ones wherever it
stands. Their word 3-gram sets are MinHashed, bands that collide are verified
by exact Jaccard similarity, and connected components are the clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K
from .components import components
from .decontaminate import MAX_BITS, bitmap, in_bitmap
from .ngram_join import _batch, _in_blocks, _split

FLUSH = 1_500_000
#: First words of paragraphs, in bits of a place.
PLACE = (1 << 24) - 1
#: Contents of a bucket that one task compares; larger buckets are compared in blocks of so many.
BUCKET = 1000


def tune_bands(threshold: float, recall: float, rows: int = 4) -> int:
    """Bands of `rows` hashes so that a pair at the threshold collides with at least this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _cuts(t: K.Tokens, reach: int) -> np.ndarray:
    """Tokens at which paragraphs may begin or end; the first of each text is one."""
    n = len(t.hash)
    first = t.first()[:-1][np.diff(t.first()) > 0]
    if n < 2:
        return first
    with np.errstate(over="ignore"):
        g = K.fmix(t.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + t.hash[1:])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    g[t.row[1:] != t.row[:-1]] = top
    low = np.ones(len(g), bool)
    for j in range(1, reach + 1):
        low[j:] &= g[j:] < g[:-j]
        low[:-j] &= g[:-j] <= g[j:]
    return K.distinct(np.concatenate([np.flatnonzero(low & (g != top)), first]))


def paragraphs(t: K.Tokens, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and one past the last of each paragraph, all of `least` words or more."""
    cut = _cuts(t, reach)
    bound = t.first()[1:][t.row[cut]] if len(cut) else cut
    stops = K.distinct(np.concatenate([cut, t.first()[1:]]))
    at = np.searchsorted(stops, cut + least)
    end = stops[np.minimum(at, len(stops) - 1)] if len(stops) else cut
    ok = (at < len(stops)) & (end <= bound)
    return cut[ok], end[ok]


def _content(t: K.Tokens, start, end) -> np.ndarray:
    """63-bit hash of a paragraph's words, as an even number."""
    n = len(t.hash)
    power, inverse = K._powers(n + 1)
    with np.errstate(over="ignore"):
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(t.hash * power[:n], dtype=np.uint64)))
        h = K.fmix((s[end] - s[start]) * inverse[start])
    return h & ~np.uint64(1)


def _grams(t: K.Tokens) -> np.ndarray:
    """Hash of the word 3-gram at each token; the last two of the batch are missing."""
    n = len(t.hash)
    with np.errstate(over="ignore"):
        m = np.uint64(0x9E3779B97F4A7C15)
        return K.fmix((t.hash[: n - 2] * m + t.hash[1 : n - 1]) * m + t.hash[2:]) if n > 2 else np.zeros(0, np.uint64)


def signatures(grams, start, end, count: int) -> np.ndarray:
    """MinHashes of each paragraph's 3-grams, one row a hash function."""
    rng = np.random.default_rng(11)
    at = np.empty(2 * len(start), np.int64)
    at[0::2], at[1::2] = start, end - 2
    out = np.empty((count, len(start)), np.uint64)
    padded = np.append(grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(count):
        a, b = rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1 << 63, dtype=np.uint64)
        with np.errstate(over="ignore"):
            out[k] = np.minimum.reduceat((padded ^ b) * a, at)[0::2] if len(start) else 0
    return out


def _bands(reach, least, bands, rows, parts):
    """Packed (band hash, paragraph's content, place) entries; of the first band the content's lowest bit is set.

    A place is 40 bits of the document's key and its first word, up to 2^24 - 1.
    """

    def run(batches):
        keys, contents, places, held = [], [], [], 0

        def flush():
            if keys:
                h, c, d = np.concatenate(keys), np.concatenate(contents), np.concatenate(places)
                keys.clear(), contents.clear(), places.clear()
                o = np.argsort(h)
                h, c, d = h[o], c[o], d[o]
                part = ((h >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
                for p, a, b in _split(part, parts):
                    yield _batch([p], [X.pack(h=X.deltas(h[a:b]), c=c[a:b], d=d[a:b])])

        for batch in batches:
            col, doc = K.strings(batch.column(1)), batch.column(0).to_numpy().view(np.uint64)
            for lo, hi in K.slices(col, max_bytes=1 << 20):
                t = K.tokenise(col.slice(lo, hi - lo))
                start, end = paragraphs(t, reach, least)
                if not len(start):
                    continue
                content = _content(t, start, end)
                row = t.row[start]
                mine = (doc[lo + row] & ~np.uint64(PLACE)) | np.minimum(start - t.first()[row], PLACE).astype(np.uint64)
                sig = signatures(_grams(t), start, end, bands * rows)
                for b in range(bands):
                    h = np.full(len(start), b + 1, np.uint64)
                    with np.errstate(over="ignore"):
                        for r in range(rows):
                            h = K.fmix(h * np.uint64(0x9E3779B97F4A7C15) + sig[b * rows + r])
                    keys.append(h >> np.uint64(16))
                    contents.append(content | np.uint64(b == 0))
                    places.append(mine)
                    held += len(start)
                if held > FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _collide(least: int):
    """Of one range of band hashes: sets of several contents in one bucket; contents found twice or more alone.

    A bucket counts if two of its paragraphs are in different documents or at
    least `least` words apart: those nearer overlap, and resemble each other.
    """

    def run(table: pa.Table) -> pa.Table:
        got = [X.unpack(x.as_py()) for x in table["payload"]]
        h, c, d = np.concatenate([X.undeltas(g["h"]) for g in got]), np.concatenate([g["c"] for g in got]), np.concatenate([g["d"] for g in got])
        del got
        o = np.lexsort((c, h))
        h, c, d = h[o], c[o], d[o]
        first_band = (c & np.uint64(1)) == 1
        c = c & ~np.uint64(1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        twice = K.distinct(c[same & first_band])
        start, length = X.runs(h)
        far = np.maximum.reduceat(d, start) - np.minimum.reduceat(d, start) >= least if len(start) else np.zeros(0, bool)
        several = np.maximum.reduceat(c, start) != np.minimum.reduceat(c, start) if len(start) else far
        on = np.repeat(far & several, length) & ~same
        h, c = h[on], c[on]
        start, length = X.runs(h)
        many = [c[a : a + n] for a, n in zip(start.tolist(), length.tolist())]
        with np.errstate(over="ignore"):
            sig = [int(K.fmix(np.array([np.bitwise_xor.reduce(K.fmix(x))]))[0].view(np.int64)) for x in many]
        offs = np.concatenate(([0], np.cumsum([1] * len(twice) + [len(x) for x in many]))).astype(np.int32)
        flat = np.concatenate([twice, *many]) if len(offs) > 1 else np.zeros(0, np.uint64)
        return pa.table([pa.array(np.concatenate([twice.view(np.int64), np.array(sig, np.int64)])), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))], schema=pa.schema([("sig", pa.int64()), ("contents", pa.list_(pa.int64()))]))

    return run


def _occurrences(reach, least, wanted, fuzzy):
    """Paragraphs, with filters those whose content may be in `wanted`; with the 3-grams of those that may be in `fuzzy`, once a slice."""

    def run(batches):
        w, f = (wanted.value, fuzzy.value) if wanted is not None else (None, None)
        for batch in batches:
            ids, keys, col = batch.column(0), batch.column(1), K.strings(batch.column(2))
            schema = pa.schema([("__id", ids.type), ("__key", pa.int64()), ("content", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("grams", pa.binary())])
            for lo, hi in K.slices(col, max_bytes=1 << 20):
                t = K.tokenise(col.slice(lo, hi - lo))
                start, end = paragraphs(t, reach, least)
                content = _content(t, start, end)
                grams = [None] * len(content)
                if w is not None:
                    on = in_bitmap(w, K.fmix(content))
                    start, end, content = start[on], end[on], content[on]
                    g, grams = _grams(t), [None] * len(content)
                    new = np.zeros(len(content), bool)
                    new[np.unique(content, return_index=True)[1]] = True
                    for i in np.flatnonzero(new & in_bitmap(f, K.fmix(content))).tolist():
                        grams[i] = K.distinct(g[start[i] : end[i] - 2]).tobytes()
                row = t.row[start]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), keys.take(pa.array(row + lo)), pa.array(content.view(np.int64)), pa.array(start - t.first()[row]), pa.array((end - start).astype(np.int32)), pa.array(grams, pa.binary())], schema=schema)

    return run


def _samples(batches):
    """3-gram sets of the paragraphs that rows (text, [(content, first word, words)]) name."""
    for batch in batches:
        col = K.strings(batch.column(0))
        lists = batch.column(1).to_pylist()
        for lo, hi in K.slices(col, max_bytes=1 << 20):
            t = K.tokenise(col.slice(lo, hi - lo))
            g, first = _grams(t), t.first()
            c, out = [], []
            for r in range(lo, hi):
                for x in lists[r]:
                    a = int(first[r - lo]) + x["first_word"]
                    c.append(x["content"])
                    out.append(K.distinct(g[a : a + x["n_words"] - 2]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(out, pa.binary())], names=["content", "grams"])


def _verify(threshold):
    """Edges of the verified similarity graph of each run of rows with one (bucket, i, j), enough to connect what it connects.

    Each set reached is compared with all that are not yet reached, so no pair
    is skipped that could join two parts.
    """

    def one(rows):
        todo = [(c, np.frombuffer(g, np.uint64)) for c, g in rows]
        while todo:
            front = [todo.pop()]
            while front and todo:
                c, g = front.pop()
                flat = np.concatenate([x for _, x in todo])
                where = np.minimum(np.searchsorted(g, flat), len(g) - 1)
                size = np.array([len(x) for _, x in todo])
                both = np.add.reduceat(g[where] == flat, np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64)
                on = both >= threshold * (len(g) + size - both) - 1e-9
                for k in np.flatnonzero(on):
                    yield c, todo[k][0]
                    front.append(todo[k])
                todo = [x for x, y in zip(todo, on) if not y]

    def batch_of(e):
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in e], pa.int64()), "b": pa.array([y for _, y in e], pa.int64())})

    def run(batches):
        rows, now, out = [], None, []
        for batch in batches:
            for *unit, c, g in zip(*(batch.column(x).to_pylist() for x in ("sig", "i", "j", "content", "grams"))):
                if unit != now:
                    out += one(rows)
                    rows, now = [], unit
                rows.append((c, g))
            if out:
                yield batch_of(out)
                out = []
        if out := list(one(rows)):
            yield batch_of(out)

    return run


def clusters(docs: DataFrame, threshold: float = 0.7, recall: float = 0.8, reach: int = 5, least: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, content, cluster, first_word, n_words, removed, kept_id): paragraphs of clusters of two or more.

    The first paragraph of a cluster by (id, row key, position) stays, null ids
    last; the others are marked removed, but for those that overlap it.
    """
    spark = docs.sparkSession
    rows = 4
    bands = tune_bands(threshold, recall, rows)
    keyed = X.with_row_key(docs, id_col, text_col).where("__text is not null")
    kind = keyed.schema["__id"].dataType.simpleString()
    parts = X.parts_for(keyed.select("__text"), 12 << 20)
    packed = keyed.select("__key", "__text").mapInArrow(_bands(reach, least, bands, rows, parts), "part int, payload binary")
    sets = X.written(packed.groupBy("part").applyInArrow(_collide(least), "sig long, contents array<long>"), "buckets")
    many = sets.where("size(contents) > 1").dropDuplicates(["sig"])
    wanted = X.written(sets.select(F.explode("contents").alias("content")).distinct(), "wanted")
    few = wanted.count() * 16 <= MAX_BITS  # one false positive in a thousand
    bucket = X.written(many.select("sig", F.size("contents").alias("size"), F.explode("contents").alias("content")), "bucket")
    near = bucket.select("content").distinct()
    filters = [spark.sparkContext.broadcast(bitmap(x.mapInArrow(_mix, "content long"), "content")) if few else None for x in (wanted, near)]
    seen = keyed.select("__id", "__key", "__text").mapInArrow(_occurrences(reach, least, *filters), f"__id {kind}, __key long, content long, first_word long, n_words int, grams binary")
    # a filter is only right for so many contents; beyond, the paragraphs themselves are joined with them
    seen = X.written(seen if few else seen.join(wanted, "content", "left_semi"), "seen")
    place = seen.join(near, "content", "left_semi").groupBy("content").agg(F.count("*").alias("n"), F.min(F.struct("__key", "first_word", "n_words")).alias("at"))
    place = X.written(place, "places")
    if few:
        grams = seen.where("grams is not null").select("content", "grams")
    else:
        named = place.groupBy(F.col("at.__key").alias("__key")).agg(F.collect_list(F.struct("content", F.col("at.first_word").alias("first_word"), F.col("at.n_words").alias("n_words"))).alias("at"))
        grams = keyed.select("__key", "__text").join(named, "__key").select("__text", "at").mapInArrow(_samples, "content long, grams binary")
    grams = grams.groupBy("content").agg(F.first("grams").alias("grams"))
    seen = seen.drop("grams")
    split = _in_blocks(bucket.join(grams, "content"), "sig", F.ceil(F.col("size") / F.lit(BUCKET)), "content")
    edges = split.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").select("sig", "i", "j", "content", "grams").mapInArrow(_verify(threshold), "a long, b long")
    # two paragraphs that occur once each, overlapping, are no repeat
    a, b = place.select(F.col("content").alias("a"), F.col("n").alias("na"), F.col("at").alias("ta")), place.select(F.col("content").alias("b"), F.col("n").alias("nb"), F.col("at").alias("tb"))
    overlap = (F.col("ta.__key") == F.col("tb.__key")) & (F.col("ta.first_word") < F.col("tb.first_word") + F.col("tb.n_words")) & (F.col("tb.first_word") < F.col("ta.first_word") + F.col("ta.n_words"))
    edges = edges.distinct().join(a, "a").join(b, "b").where(~((F.col("na") == 1) & (F.col("nb") == 1) & overlap)).select("a", "b")
    comp = components(edges)
    one = X.written(seen.join(comp.withColumnRenamed("node", "content"), "content", "left").withColumn("cluster", F.coalesce("component", "content")).drop("component"), "placed")
    first = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("first_word").alias("word"), F.col("n_words").alias("words"))
    kept = X.written(one.groupBy("cluster").agg(F.count("*").alias("__n"), F.min(first).alias("__kept")).where("__n > 1").drop("__n"), "kept")
    k = F.col("__kept")
    mine = (F.col("__key") == k["key"]) & F.col("__id").eqNullSafe(k["id"])
    beside = mine & (F.col("first_word") < k["word"] + k["words"]) & (k["word"] < F.col("first_word") + F.col("n_words"))
    # rows equal in id and text share their key: what occurs in each of them is a repeat
    again = X.written(one.groupBy("__key", "__id", "content", "first_word").agg(F.count("*").alias("__rows")).where("__rows > 1"), "again")
    out = one.join(X.small_side(kept), "cluster").join(X.small_side(again.select(F.col("__key").alias("ka"), F.col("content").alias("ca"), F.col("first_word").alias("wa"), "__rows")), (F.col("__key") == F.col("ka")) & (F.col("content") == F.col("ca")) & (F.col("first_word") == F.col("wa")), "left")
    return out.select("__id", "__key", "content", "cluster", "first_word", "n_words", (~beside | F.col("__rows").isNotNull()).alias("removed"), k["id"].alias("kept_id"))


def _mix(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(K.fmix(b.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["content"])


def repeats(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, first_word, n_words, kept_ids): the passages that other places repeat.

    Overlapping removed paragraphs of a document are one passage; kept_ids are
    the documents where the copies that stay are found. Words are counted from
    0. Repeats inside one document count too. Rows equal in id and text are
    repeats of each other and share their passages, which name their id among
    the kept. Null, empty and short texts have no paragraphs; null ids are
    reported as null and kept last. Of a cluster the first place by (id, text
    hash, position) is the kept one, so ties can't differ from run to run.
    Documents are told apart by 64 bits of id and text, and candidates inside
    one bucket by 40 of them. Other columns are not read.
    """
    gone = clusters(docs, id_col=id_col, **options).where("removed").select("__key", "__id", "first_word", "n_words", "kept_id").distinct()
    w = Window.partitionBy("__key", "__id").orderBy("first_word", "n_words")
    before = F.max(F.col("first_word") + F.col("n_words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = gone.withColumn("__new", F.when(before >= F.col("first_word"), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("__key", "__id", "__run").agg(F.min("first_word").alias("first_word"), (F.max(F.col("first_word") + F.col("n_words")) - F.min("first_word")).cast("int").alias("n_words"), F.array_sort(F.collect_set("kept_id")).alias("kept_ids"))
    return out.select(F.col("__id").alias(id_col), "first_word", "n_words", "kept_ids")
