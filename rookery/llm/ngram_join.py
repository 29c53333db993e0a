"""N-gram Jaccard self-join by T-occurrence search.

Plan. (1) Every document becomes its set of word n-grams (48-bit hashes), sent
packed to hash ranges. Grams that a sample finds in many documents skip this
exchange and count as shared: they would make one range as large as the table.
(2) In a range, grams of a single document are dropped: no pair shares them.
(3) What is left goes back to its document; a document whose shared grams are
fewer than threshold * |set| can't have a partner. (4) Documents of equal sets
become one class. (5) Each set's prefix, its rarest shared grams, brings it
into lists with others; in a list two sets are linked only if a bitmap of their
grams allows the overlap they need, and a spanning forest of these links is
kept. Qualifying pairs always share a prefix gram and pass the bitmap, so each
lies inside one connected component. (6) Each component, in blocks where it is
large, is searched: every set is a query over the inverted lists of its grams,
short lists are heap-merged, long ones probed by binary search (DivideSkip),
and sets that occur T times are kept, as counts of links and a forest.

The join is exact but for hash collisions: two sets of 100 grams share a false
48-bit hash with a probability of 4e-11, and two of 10^11 different sets of one
size the same 64-bit digest in about 3 cases.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K
from .components import components, forest

#: Entries that a task holds before it packs them.
FLUSH = 600_000
#: Parts that one exchange of a flush may fan out to; more are reached in two steps, so packed rows keep their size.
FAN = 2048
BLOCK_BYTES = 6 << 20
#: Documents of a prefix gram's list that one task compares; longer lists are compared in blocks of so many.
LIST = 2000
#: Bytes of text that the sample of hot grams is drawn from, and the part of its documents that makes a gram hot.
SAMPLE_BYTES, HOT_SHARE, HOT_LEAST = 8 << 20, 1 / 64, 32
#: Words of 64 bits in a set's bitmap.
WORDS = 16
_PART = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
_SETS = pa.schema([("key", pa.int64()), ("size", pa.int32()), ("digest", pa.int64()), ("grams", pa.binary()), ("ranks", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gram", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def _batch(part: list, payload: list, schema=_PART) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(payload, pa.binary())], schema=schema)


def _split(part_of: np.ndarray, parts: int):
    """Ranges of an array that is sorted by part."""
    at = np.searchsorted(part_of, np.arange(parts + 1))
    return ((p, at[p], at[p + 1]) for p in np.flatnonzero(np.diff(at)))


def _part_of_gram(gram: np.ndarray, parts: int) -> np.ndarray:
    return ((gram >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)


def _part_of_key(key: np.ndarray, parts: int) -> np.ndarray:
    return ((((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) * np.uint64(parts)) >> np.uint64(31)).astype(np.int64)


def _by_key(key, size, doc, gram, rank, parts: int):
    """Packed (part, payload) of shared grams by range of documents; doc: index into key."""
    part = _part_of_key(key, parts)[doc]
    order = np.lexsort((doc, part))
    gram, doc, rank, part = gram[order], doc[order], rank[order], part[order]
    for p, a, b in _split(part, parts):
        used, local = np.unique(doc[a:b], return_inverse=True)
        yield int(p), X.pack(key=key[used], size=size[used], count=np.bincount(local).astype(np.uint32), gram=gram[a:b], rank=rank[a:b])


def _by_gram(key, size, doc, gram, parts: int):
    """Packed (part, payload) of entries by range of grams, which are ascending."""
    for p, a, b in _split(_part_of_gram(gram, parts), parts):
        used, local = np.unique(doc[a:b], return_inverse=True)
        yield int(p), X.pack(gram=X.deltas(gram[a:b]), doc=local.astype(np.uint32 if len(used) >> 16 else np.uint16), key=key[used], size=size[used])


def _shingles(n: int, first: int, back: int, hot):
    """Packed (gram, document) entries of a batch by range of grams; hot grams, by range of documents, after part `first`."""

    @X.trimmed
    def run(batches):
        entries, keys, sizes = [], [], []
        known = hot.value

        def flush():
            if entries:
                key, size, e = np.concatenate(keys), np.concatenate(sizes), np.concatenate(entries)
                entries.clear()
                e.sort()
                gram, doc = e >> np.uint64(16), (e & np.uint64(0xFFFF)).astype(np.int64)
                del e
                if len(known):
                    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    on = known[at] == gram
                    if on.any():
                        for p, x in _by_key(key, size, doc[on], gram[on], np.full(int(on.sum()), 255, np.uint8), back):
                            yield _batch([first + p], [x])
                        gram, doc = gram[~on], doc[~on]
                for p, x in _by_gram(key, size, doc, gram, first):
                    yield _batch([p], [x])
            entries.clear(), keys.clear(), sizes.clear()

        held = docs = 0
        for batch in batches:
            col = K.strings(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in K.slices(col, max_bytes=1 << 20, max_rows=20_000):
                rows, grams = K.shingle_sets(K.tokenise(col.slice(a, b - a)), n)
                if docs + b - a > 60_000 or held + len(rows) > FLUSH:
                    yield from flush()
                    held = docs = 0
                entries.append((grams << np.uint64(16)) | (rows + docs).astype(np.uint64))
                keys.append(ids[a:b])
                sizes.append(np.bincount(rows, minlength=b - a).astype(np.int32))
                held += len(rows)
                docs += b - a
        yield from flush()

    return run


def _relay(first: int, parts: int):
    """From `first` ranges of grams to `parts` finer ones, `parts` being a multiple; what is past them goes on unchanged."""
    each = parts // first

    @X.trimmed
    def run(batches):
        held, n, now = [], 0, None

        def flush():
            if held:
                shift = np.cumsum([0] + [len(g["key"]) for g in held])
                gram, doc = np.concatenate([X.undeltas(g["gram"]) for g in held]), np.concatenate([g["doc"].astype(np.int64) + s for g, s in zip(held, shift)])
                key, size = np.concatenate([g["key"] for g in held]), np.concatenate([g["size"] for g in held])
                order = np.argsort(gram, kind="stable")
                for p, x in _by_gram(key, size, doc[order], gram[order], parts):
                    yield _batch([p], [x])
            held.clear()

        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p >= first:
                    yield _batch([p - first + parts], [x.as_py()])
                    continue
                if p != now or n > FLUSH:
                    yield from flush()
                    now, n = p, 0
                held.append(X.unpack(x.as_py()))
                n += len(held[-1]["gram"])
        yield from flush()

    assert each * first == parts
    return run


def _repeated(parts: int, back: int):
    """Of one range of grams: those of two or more documents, packed by document. Parts past them hold such already."""

    @X.trimmed_group
    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() >= parts:
            return pa.table([pa.array([p - parts for p in table["part"].to_pylist()], pa.int32()), table["payload"]], schema=_PART)
        got = [X.unpack(x.as_py()) for x in table["payload"]]
        gram = np.concatenate([X.undeltas(g["gram"]) for g in got])
        shift = np.cumsum([0] + [len(g["key"]) for g in got])
        doc = np.concatenate([g["doc"].astype(np.int64) + s for g, s in zip(got, shift)])
        key, inverse = np.unique(np.concatenate([g["key"] for g in got]), return_inverse=True)
        size = np.zeros(len(key), np.int32)
        size[inverse] = np.concatenate([g["size"] for g in got])
        del got
        doc = inverse[doc]
        if len(gram) and int(gram.max() - gram.min()) < 1 << 40 and not len(key) >> 23:
            order = np.argsort(((gram - gram.min()) << np.uint64(23)) | doc.astype(np.uint64))
        else:
            order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        gram, doc = gram[fresh], doc[fresh]
        start, length = X.runs(gram)
        rank = np.repeat(np.minimum(254, (8 * np.log2(np.maximum(length, 1))).astype(np.int64)).astype(np.uint8), length)
        keep = np.repeat(length > 1, length)
        out = list(_by_key(key, size, doc[keep], gram[keep], rank[keep], back))
        return pa.Table.from_batches([_batch([p for p, _ in out], [x for _, x in out])], _PART)

    return run


def _sets(threshold: float):
    """Of one range of documents: each one's shared grams, if enough of them; of equal sets the first alone has them."""

    @X.trimmed_group
    def run(table: pa.Table) -> pa.Table:
        got = [X.unpack(x.as_py()) for x in table["payload"]]
        key, inverse = np.unique(np.concatenate([g["key"] for g in got]), return_inverse=True)
        size = np.zeros(len(key), np.int32)
        size[inverse] = np.concatenate([g["size"] for g in got])
        doc = np.repeat(inverse, np.concatenate([g["count"] for g in got]))
        gram, rank = np.concatenate([g["gram"] for g in got]), np.concatenate([g["rank"] for g in got])
        del got
        order = np.lexsort((gram, doc))
        gram, rank, doc = gram[order], rank[order], doc[order]
        fresh = np.ones(len(gram), bool)  # rows of one document in several tasks repeat its hot grams
        fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        gram, rank, doc = gram[fresh], rank[fresh], doc[fresh]
        enough = np.bincount(doc, minlength=len(key)) >= np.ceil(threshold * size - 1e-9)
        on = enough[doc]
        gram, rank, doc = gram[on], rank[on], doc[on]
        start, length = X.runs(doc)
        with np.errstate(over="ignore"):
            mixed = np.add.reduceat(K.fmix(gram + np.uint64(1)), start) if len(start) else np.zeros(0, np.uint64)
        who = doc[start] if len(start) else np.zeros(0, np.int64)
        whole = length == size[who]  # others hold grams that no other document has
        mixed = np.where(whole, mixed, key[who].view(np.uint64))
        one = np.zeros(len(who), bool)
        one[np.unique(mixed, return_index=True)[1]] = True
        cut = [(a, a + b) if x else None for a, b, x in zip(start.tolist(), length.tolist(), one.tolist())]
        return pa.table(
            [key[who], size[who], mixed.view(np.int64), pa.array([c and gram[c[0] : c[1]].tobytes() for c in cut], pa.binary()), pa.array([c and rank[c[0] : c[1]].tobytes() for c in cut], pa.binary())],
            schema=_SETS,
        )

    return run


def bitmap_of(gram: np.ndarray) -> np.ndarray:
    """WORDS * 64 bits, those of the grams' hashes set."""
    out = np.zeros(WORDS, np.uint64)
    h = K.fmix(gram)
    np.bitwise_or.at(out, (h >> np.uint64(58)).astype(np.int64) % WORDS, np.uint64(1) << (h & np.uint64(63)))
    return out


def may_overlap(bits, n, size, other_bits, other_n, other_size, threshold: float) -> np.ndarray:
    """Whether sets can reach the threshold: every bit of one that another lacks is a gram that it lacks. Never false for a qualifying pair."""
    most = np.minimum(n - np.bitwise_count(bits & ~other_bits).sum(-1, dtype=np.int64), other_n - np.bitwise_count(other_bits & ~bits).sum(-1, dtype=np.int64))
    return most * (1 + threshold) >= threshold * (size.astype(np.int64) + other_size) - 1e-6


def forest_of(bits, n, size, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the sets that may overlap: each set reached is compared with all that are not."""
    todo = np.arange(len(n))
    a, b = [], []
    while len(todo) > 1:
        front, todo = [todo[-1]], todo[:-1]
        while front and len(todo):
            x = front.pop()
            on = may_overlap(bits[x], n[x], size[x], bits[todo], n[todo], size[todo], threshold)
            hit = todo[on]
            a += [x] * len(hit)
            b += hit.tolist()
            front += hit.tolist()
            todo = todo[~on]
    return np.array(a, np.int64), np.array(b, np.int64)


def _prefixes(threshold: float, parts: int):
    """Packed (gram, document) entries of each set's prefix: in order of rarity, all but what a partner can lack."""

    @X.trimmed
    def run(batches):
        grams, rows = [], []
        held = 0

        def flush():
            if rows:
                doc = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
                gram = np.concatenate(grams)
                order = np.argsort(gram, kind="stable")
                gram, doc = gram[order], doc[order]
                key, size, n = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int32, np.int32)))
                bits = np.array([r[3] for r in rows])
                for p, a, b in _split(_part_of_gram(gram, parts), parts):
                    used, local = np.unique(doc[a:b], return_inverse=True)
                    yield _batch([p], [X.pack(gram=X.deltas(gram[a:b]), doc=local.astype(np.uint32), key=key[used], size=size[used], n=n[used], bits=bits[used].ravel())])
            grams.clear(), rows.clear()

        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for key, size, g, r in zip(c["digest"].to_pylist(), c["size"].to_pylist(), c["grams"], c["ranks"]):
                g, r = np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(r.as_buffer(), np.uint8)
                n = len(g) - int(np.ceil(threshold * size - 1e-9)) + 1
                order = np.lexsort((g, r))[:n]
                grams.append(g[order])
                rows.append((key, size, len(g), bitmap_of(g)))
                held += n + WORDS
                if held > FLUSH // 4:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _links(threshold: float):
    """Of one range of prefix grams: forests of the links in each list (a, b); members of lists too long for one task, by gram."""

    @X.trimmed_group
    def run(table: pa.Table) -> pa.Table:
        got = [X.unpack(x.as_py()) for x in table["payload"]]
        gram = np.concatenate([X.undeltas(g["gram"]) for g in got])
        shift = np.cumsum([0] + [len(g["key"]) for g in got])
        doc = np.concatenate([g["doc"].astype(np.int64) + s for g, s in zip(got, shift)])
        key, at, inverse = np.unique(np.concatenate([g["key"] for g in got]), return_index=True, return_inverse=True)
        size, n = np.concatenate([g["size"] for g in got])[at], np.concatenate([g["n"] for g in got])[at].astype(np.int64)
        bits = np.concatenate([g["bits"].reshape(-1, WORDS) for g in got])[at]
        del got
        doc = inverse[doc]
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        start, length = X.runs(gram)
        with np.errstate(over="ignore"):
            sig = np.add.reduceat(K.fmix(doc.astype(np.uint64) + np.uint64(1)), start) + length.astype(np.uint64) if len(start) else np.zeros(0, np.uint64)
        once = np.unique(sig, return_index=True)[1]  # lists of the same sets are one
        start, length = start[once], length[once]
        two = start[length == 2]
        x, y = doc[two], doc[two + 1]
        on = may_overlap(bits[x], n[x], size[x], bits[y], n[y], size[y], threshold) if len(two) else np.zeros(0, bool)
        a, b = [x[on]], [y[on]]
        far = []
        for s, m in zip(start[length > 2].tolist(), length[length > 2].tolist()):
            if m > LIST:
                far.append((s, m))
                continue
            d = doc[s : s + m]
            i, j = forest_of(bits[d], n[d], size[d], threshold)
            a.append(d[i]), b.append(d[j])
        a, b = key[np.concatenate(a)], key[np.concatenate(b)]
        e = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        d = np.concatenate([doc[s : s + m] for s, m in far]) if far else np.zeros(0, np.int64)
        g = np.concatenate([gram[s : s + m] for s, m in far]) if far else np.zeros(0, np.uint64)
        none, void = [None] * len(e), [None] * len(d)
        return pa.table(
            [pa.array(np.concatenate([e["a"].to_numpy(), key[d]])), pa.array([*e["b"].tolist(), *void], pa.int64()), pa.array([*none, *g.view(np.int64).tolist()], pa.int64()), pa.array([*none, *size[d].tolist()], pa.int32()), pa.array([*none, *n[d].tolist()], pa.int32()), pa.array([*none, *(bits[i].tobytes() for i in d)], pa.binary())],
            schema=_LINKS,
        )

    return run


def _block_links(threshold: float):
    """Forests of the links of each run of rows with one (gram, i, j)."""

    @X.trimmed
    def run(batches):
        rows, now = {}, None

        def one():
            key, size, n = np.array(list(rows), np.int64), np.array([r[0] for r in rows.values()], np.int32), np.array([r[1] for r in rows.values()], np.int64)
            a, b = forest_of(np.array([np.frombuffer(r[2], np.uint64) for r in rows.values()]), n, size, threshold)
            return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], names=["a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(x).to_pylist() for x in ("gram", "i", "j", "a", "size", "n", "bits"))):
                if r[:3] != now and rows:
                    yield one()
                    rows = {}
                now = r[:3]
                rows[r[3]] = r[4:]
        if rows:
            yield one()

    return run


def _in_blocks(df: DataFrame, group: str, blocks, key: str) -> DataFrame:
    """Rows of a group of several blocks once for every pair (i, j) of blocks that theirs is part of."""
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(key), "blocks").cast("int"))
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("i", F.least("block", "__other")).withColumn("j", F.greatest("block", "__other")).drop("__other")


def hot_grams(rows: DataFrame, n: int) -> np.ndarray:
    """Grams in HOT_SHARE or more of the documents of a sample, ascending. Which they are changes how grams travel, never the result."""
    share = min(1.0, SAMPLE_BYTES / max(1, X.bytes_of(rows)))
    some = rows.sample(share, 3) if share < 1 else rows

    @X.trimmed
    def run(batches):
        held, docs = [], 0
        for batch in batches:
            col = K.strings(batch.column(1))
            for a, b in K.slices(col, max_bytes=1 << 20):
                held.append(K.shingle_sets(K.tokenise(col.slice(a, b - a)), n)[1])
                docs += b - a
        grams = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        start, length = X.runs(grams)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(grams[start].view(np.int64), -1)), pa.array(np.append(length, docs))], names=["gram", "n"])

    count = X.written(some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST), "sample")
    docs = count.where("gram = -1").agg(F.max("n")).first()[0] or 0
    got = count.where((F.col("gram") >= 0) & (F.col("n") >= HOT_SHARE * docs)).select("gram").toArrow()
    return np.sort(got["gram"].to_numpy().view(np.uint64)) if got.num_rows else np.zeros(0, np.uint64)


def merge_skip(lists: list[np.ndarray], least: int) -> tuple[list[int], list[int]]:
    """MergeSkip: ids that at least `least` of the ascending lists hold, with their counts, by a heap of the lists' heads.

    Heads of the least id are popped; if they are too few, heads are popped
    until `least` - 1 are out, and all of these lists skip by binary search to
    the id then on top, as no id before it can be in enough lists.
    """
    heap = [(int(x[0]), k, 0) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    ids, counts = [], []
    while len(heap) >= least:
        out = [heapq.heappop(heap)]
        while heap and heap[0][0] == out[0][0]:
            out.append(heapq.heappop(heap))
        if len(out) >= least:
            ids.append(out[0][0])
            counts.append(len(out))
            to = out[0][0] + 1
        else:
            while len(out) < least - 1:
                out.append(heapq.heappop(heap))
            if not heap:
                break
            to = heap[0][0]
        for _, k, at in out:
            at += int(np.searchsorted(lists[k][at:], to))
            if at < len(lists[k]):
                heapq.heappush(heap, (int(lists[k][at]), k, at))
    return ids, counts


#: The part of the lists an id has to be in, and the postings for each step, from which the heap's skips pay.
HEAP_SHARE, HEAP_SKIP = 0.8, 64


def t_occurrence(query: np.ndarray, at: np.ndarray, postings: np.ndarray, least: int, mu: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip: the ids that at least `least` of the query's lists hold, and their counts.

    query: numbers of the lists; list i is postings[at[i]:at[i+1]], ascending.
    The L longest lists are set apart, L = least / (mu * log2(longest) + 1) and
    under least. The others are merged for ids with least - L occurrences, by
    MergeSkip where its skips are long, which is where the shortest list is far
    shorter than the rest, else by one sort of all postings: on dense lists of
    1,000 numpy sorts 130 times faster than Python pops a heap. Each long list
    is then probed for the candidates by binary search.
    """
    length = at[query + 1] - at[query]
    order = np.argsort(length, kind="stable")
    query, length = query[order], length[order]
    if least > len(query):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = min(least - 1, int(least / (mu * np.log2(max(2, length[-1])) + 1)))
    short, long_ = query[: len(query) - far], query[len(query) - far :]
    lists = [postings[at[i] : at[i + 1]] for i in short]
    total = int(length[: len(short)].sum())
    if least - far >= HEAP_SHARE * len(short) and total >= HEAP_SKIP * length[0] * least:
        ids, count = (np.array(x, np.int64) for x in merge_skip(lists, least - far))
    else:
        merged = np.concatenate(lists)
        merged.sort(kind="stable")
        start, count = X.runs(merged)
        on = count >= least - far
        ids, count = merged[start[on]], count[on]
    for k, i in enumerate(long_):
        if not len(ids):
            break
        p = postings[at[i] : at[i + 1]]
        where = np.searchsorted(p, ids)
        where[where == len(p)] = len(p) - 1
        count = count + (p[where] == ids)
        on = count >= least - (far - k - 1)
        ids, count = ids[on], count[on]
    return ids, count


def search(grams: list[np.ndarray], size: np.ndarray, side: np.ndarray | None, threshold: float):
    """Pairs (i < j) of sets with Jaccard >= threshold, and their overlap; with sides, across them only.

    Sets are numbered by size; a query looks among the larger ones, up to
    size / threshold, as smaller queries have met the others.
    """
    order = np.argsort(size, kind="stable")
    lens = np.array([len(grams[i]) for i in order])
    who = np.repeat(np.arange(len(order)), lens)
    flat = np.concatenate([grams[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
    names, number = np.unique(flat, return_inverse=True)
    by = np.argsort(number, kind="stable")
    postings = who[by]
    at = np.searchsorted(number[by], np.arange(len(names) + 1))
    first = np.concatenate(([0], np.cumsum(lens)))
    n = size[order]
    out = []
    for q in range(len(order)):
        lists = number[first[q] : first[q + 1]]
        lists = lists[at[lists + 1] - at[lists] > 1]
        least = int(np.ceil(threshold * n[q] - 1e-9))
        if len(lists) < least:
            continue
        ids, count = t_occurrence(lists, at, postings, max(1, least))
        on = (ids > q) & (count >= threshold * (n[q] + n[ids] - count) - 1e-9)
        ids, count = ids[on], count[on]
        if side is not None:
            on = side[order[ids]] != side[order[q]]
            ids, count = ids[on], count[on]
        if len(ids):
            out.append((np.full(len(ids), order[q]), order[ids], count))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()), ("links", pa.int64())])


def _search_groups(threshold: float, all_pairs: bool):
    """Searches each run of rows with one (component, i, j).

    Gives rows (a, links): links of a met here; and (a, b): a forest of the
    pairs, or, if asked, all of them with their similarity.
    """

    def one(rows):
        key = np.array([r[0] for r in rows], np.int64)
        size = np.array([r[1] for r in rows], np.int64)
        mixed = rows[0][4] != rows[0][5]
        a, b, n = search([np.frombuffer(r[2], np.uint64) for r in rows], size, np.array([r[3] for r in rows]) if mixed else None, threshold)
        count = np.bincount(np.concatenate([a, b]).astype(np.int64), minlength=len(key))
        on = np.flatnonzero(count)
        if all_pairs:
            x, y, sim = np.minimum(key[a], key[b]), np.maximum(key[a], key[b]), n / (size[a] + size[b] - n)
        else:
            node, root = forest(a, b) if len(a) else (a, b)
            x, y = key[root[node != root]], key[node[node != root]]
            sim = np.full(len(x), np.nan)
        void = len(on)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[on], x])), pa.array(np.concatenate([key[on], y]), mask=np.arange(void + len(x)) < void), pa.array(np.concatenate([np.zeros(void), sim])), pa.array(np.concatenate([count[on], np.zeros(len(x), np.int64)]))], schema=_FOUND)

    @X.trimmed
    def run(batches):
        rows, now, weight = [], None, 0
        for batch in batches:
            for r in zip(*(batch.column(x).to_pylist() for x in ("digest", "size", "grams", "block", "i", "j", "component"))):
                # small components are searched together: no pair crosses them that is not in one of them
                group = (r[6], r[4], r[5]) if r[4] != r[5] or r[5] else "whole"
                if rows and (group != now or group == "whole" and weight > BLOCK_BYTES and rows[-1][6] != r[6]):
                    yield one(rows)
                    rows, weight = [], 0
                now = group
                weight += len(r[2])
                rows.append(r)
        if rows:
            yield one(rows)

    return run


class Joined:
    """keys: (__id, __key) of all rows; sets: (key, digest) of documents with enough shared grams; found: (a, b, jaccard, links) over digests."""

    def __init__(self, sets: DataFrame, found: DataFrame, keys: DataFrame):
        self.sets, self.found, self.keys = sets, found, keys


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", all_pairs: bool = False) -> Joined:
    """Exact self-join on Jaccard similarity of word n-gram sets.

    A row is known by its id and text: rows equal in both are one document,
    rows of one id and different texts are several. Null or wordless texts have
    no grams and join nothing; a text of under n words has one gram, of all its
    words. Null ids take part and are reported as null. Other columns are not
    read, whatever their names. An empty table gives empty results.
    """
    spark = docs.sparkSession
    keyed = X.with_row_key(docs, id_col, text_col)
    rows = keyed.where("__text is not null").select("__key", "__text")
    parts = X.parts_for(rows, 4 << 20)
    back = max(4, parts // 4)
    first = parts
    if parts > FAN:
        first = -(-parts // FAN)
        first = max(first, int(parts**0.5))
        parts = first * -(-parts // first)
    hot = spark.sparkContext.broadcast(hot_grams(rows, n))
    packed = rows.mapInArrow(_shingles(n, first, back, hot), "part int, payload binary")
    if first < parts:
        packed = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_relay(first, parts), "part int, payload binary")
    shared = packed.groupBy("part").applyInArrow(_repeated(parts, back), "part int, payload binary")
    raw = shared.groupBy("part").applyInArrow(_sets(threshold), "key long, size int, digest long, grams binary, ranks binary")
    sets = X.written(raw, "sets")
    reps = sets.where("grams is not null").groupBy("digest", "size").agg(F.first("grams").alias("grams"), F.first("ranks").alias("ranks"))
    reps = X.written(reps, "reps")
    links = reps.mapInArrow(_prefixes(threshold, back), "part int, payload binary").groupBy("part").applyInArrow(_links(threshold), "a long, b long, gram long, size int, n int, bits binary")
    links = X.written(links, "links")
    edges = links.where("gram is null").select("a", "b")
    far = links.where("gram is not null").drop("b")
    if not far.isEmpty():
        blocks = far.groupBy("gram").agg(F.ceil(F.count("*") / F.lit(LIST)).alias("__blocks"))
        split = _in_blocks(far.join(blocks, "gram"), "gram", F.col("__blocks"), "a")
        edges = edges.union(split.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").select("gram", "i", "j", "a", "size", "n", "bits").mapInArrow(_block_links(threshold), "a long, b long"))
    comp = components(edges)
    weight = comp.join(reps.select(F.col("digest").alias("node"), F.length("grams").alias("w")), "node")
    weight = weight.groupBy("component").agg(F.ceil(F.sum("w") / F.lit(BLOCK_BYTES)).cast("int").alias("n_blocks"))
    place = X.written(comp.join(weight, "component").withColumnRenamed("node", "digest"), "place")
    split = _in_blocks(reps.select("digest", "size", "grams").join(X.small_side(place), "digest"), "component", F.col("n_blocks"), "digest")
    order = split.repartition("component", "i", "j").sortWithinPartitions(F.col("blocks") > 1, "component", "i", "j")
    many = F.col("blocks") > 1
    units = order.select("digest", "size", "grams", "block", F.when(many, F.col("i") + 1).otherwise(0).alias("i"), F.when(many, F.col("j") + 1).otherwise(0).alias("j"), "component")
    found = X.written(units.mapInArrow(_search_groups(threshold, all_pairs), "a long, b long, jaccard double, links long"), "found")
    X.dropped(reps, links, place)  # what is returned reads sets and found alone
    return Joined(sets.select("key", "digest"), found, keyed.select("__id", "__key"))


def _ident(c: str = "__id"):
    """An id that sorts and groups with nulls last."""
    return F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("id"))


def near_pairs(docs: DataFrame, n: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, match_id, jaccard): every pair of different gram sets with Jaccard >= threshold, each named by its least document; and (doc_id, least id, 1) for every other document of a set.

    The lesser id comes first, null last. Copies are thus listed once each, not
    in pairs. Rows equal in id and text are one document (see jaccard_join).
    """
    j = jaccard_join(docs, n, threshold, id_col, text_col, all_pairs=True)
    named = X.written(j.keys.distinct().join(j.sets, j.keys["__key"] == j.sets["key"]).select("digest", "key", _ident().alias("i")), "named")
    least = X.written(named.groupBy("digest").agg(F.min(F.struct("i", "key")).alias("l")), "least")
    one, two = least.select(F.col("digest").alias("a"), F.col("l.i").alias("p")), least.select(F.col("digest").alias("b"), F.col("l.i").alias("q"))
    across = j.found.where("b is not null").join(one, "a").join(two, "b").select("p", "q", "jaccard")
    within = named.join(least, "digest").where("key <> l.key").select(F.col("l.i").alias("p"), F.col("i").alias("q"), F.lit(1.0).alias("jaccard"))
    return across.union(within).select(F.least("p", "q")["id"].alias(id_col), F.greatest("p", "q")["id"].alias("match_id"), "jaccard")


def _classes(j: Joined) -> DataFrame:
    """(digest, component, copies, least, links) of all sets: copies counts documents, least is (null flag, id, key)."""
    comp = components(j.found.where("b is not null").select("a", "b")).select(F.col("node").alias("digest"), "component")
    links = j.found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    keyed = j.keys.distinct().join(j.sets, j.keys["__key"] == j.sets["key"])
    size = keyed.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct(_ident().alias("i"), "key")).alias("least"))
    return size.join(comp, "digest", "left").join(links, "digest", "left").select("digest", F.coalesce("component", "digest").alias("component"), "copies", "least", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copies, links) of every document that has a copy or a near copy.

    links: other gram sets with Jaccard >= threshold; copies: documents of its
    own set, itself included. class_id is the least id of all that links and
    copies connect, null where all ids are null. Rows equal in id and text are
    one document with one row here (see jaccard_join); the result grows with
    the documents, not with the pairs.
    """
    j = jaccard_join(docs, n, threshold, id_col, text_col)
    sets = X.written(_classes(j), "classes")
    top = sets.groupBy("component").agg(F.min("least.i").alias("top"))
    out = X.written(sets.where("copies > 1 or links > 0").join(top, "component").select("digest", F.col("top.id").alias("class_id"), "copies", "links"), "named")
    member = j.keys.distinct().join(j.sets, j.keys["__key"] == j.sets["key"]).select("__id", "digest")
    return member.join(X.small_side(out), "digest").select(F.col("__id").alias(id_col), "class_id", "copies", "links")


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each group of near copies.

    A group is a connected component of qualifying pairs; the document of the
    least (id, text hash) stays, null ids last. Of rows equal in id and text
    one stays. Documents without partners stay as they are; so do all rows of
    null or wordless text. The columns are those of the input.
    """
    j = jaccard_join(docs, n, threshold, id_col, text_col)
    sets = X.written(_classes(j), "classes")
    top = sets.groupBy("component").agg(F.min("least").alias("top"), F.sum("copies").alias("all"))
    stay = sets.join(top.where("all > 1"), "component").select("digest", F.col("top.key").alias("stay"))
    lost = j.sets.join(X.small_side(X.written(stay, "stay")), "digest").where("key <> stay").select(F.col("key").alias("__key"), F.lit(False).alias("__first"))
    # rows equal in id and text share a key, whether they have partners or not; one of them is kept below
    wordy = X.with_row_key(docs, id_col, text_col).where(F.col("__text").rlike(r"[\p{L}\p{M}\p{N}_]"))
    again = wordy.groupBy("__key").agg(F.count("*").alias("__rows")).where("__rows > 1").select("__key", F.lit(True).alias("__first"))
    verdict = X.written(lost.unionByName(again.join(lost, "__key", "left_anti")), "verdict")
    packed = docs.select(F.struct("*").alias("__row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("__key"))
    judged = packed.join(X.small_side(verdict.select("__key", "__first")), "__key", "left").where("__first is null or __first")
    if verdict.where("__first").isEmpty():
        return judged.select("__row.*")
    single = judged.where("__first is null").select("__row.*")
    return single.unionByName(judged.where("__first").dropDuplicates(["__key"]).select("__row.*"))
