"""Information-theoretic sanitisation of personal data.

Direct identifiers (addresses, numbers, keys, passwords) are protected
entities and are replaced by their kind. A word that keeps company with an
entity can give it away as well: over the corpus, the pointwise mutual
information of word t and entity e is log2(N * n(t, e) / (n(t) * n(e))), and e
itself carries IC(e) = log2(N / n(e)). In documents of e, words near it whose
information reaches a share of IC(e) are generalised to [TERM], and those that
reach nearly all of it are removed.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K
from .decontaminate import bitmap, in_bitmap

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)+"),
    ("KEY", r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bap])[-_][A-Za-z0-9_-]{16,}|[0-9a-fA-F]{32,64})\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CARD", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("IP", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    ("SSN", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("PHONE", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d[\d ().-]{7,}\d(?!\w)"),
)
_NAMES = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)"


def pattern() -> re.Pattern:
    """All identifiers as one expression; of a secret only the value, after its name."""
    rest = "|".join(f"(?P<{n}>{p})" for n, p in PATTERNS)
    return re.compile(rf"(?P<NAME>{_NAMES}[\"']?\s*[=:]\s*[\"']?)(?P<SECRET>[^\s\"']{{6,}})|" + rest)


#: What keys without any digit begin with or consist of, and digits of other scripts.
_LETTERS_ONLY = r"(?:sk|pk|ghp|gho|xox[bap])[-_]|AKIA|ASIA|[0-9a-fA-F]{32}|[^\x00-\x7F\P{Nd}]"


def _hints(col: pa.Array) -> np.ndarray:
    """Rows that can hold an identifier: those with a digit, '@', '=' or ':', or the start of a key. No pattern matches another row."""
    buf, offs = K.buffers(col)
    lut = np.zeros(256, np.uint8)
    lut[[*range(48, 58), 64, 61, 58]] = 1
    out = np.zeros(len(col), bool)
    for a in range(0, len(buf), 1 << 22):
        hit = np.flatnonzero(lut[buf[a : a + (1 << 22)]]) + a
        if len(hit):
            at = np.searchsorted(offs, hit, "right") - 1
            out[at] = True
    return out | pc.match_substring_regex(col, _LETTERS_ONLY).to_numpy(zero_copy_only=False)


def _spans(rx: re.Pattern, text: str):
    """(start, end, kind) of each identifier."""
    for m in rx.finditer(text):
        kind = m.lastgroup
        yield (*m.span(kind), kind)


def _mentions(rx, window):
    """One row an entity of a document and word within `window` words: entity and word, with the document's digest.

    The words are whole ones, of any length, and identifiers don't count among them.
    """
    schema = pa.schema([("__key", pa.int64()), ("digest", pa.int64()), ("entity", pa.int64()), ("term", pa.int64())])

    @X.trimmed
    def run(batches):
        for batch in batches:
            keys, digests, col = batch.column(0), batch.column(1), K.strings(batch.column(2))
            rows, names, plain, mid, low, high = [], [], [], [], [], []
            for r in np.flatnonzero(_hints(col)).tolist():
                text, at, first = col[r].as_py(), 0, len(plain)
                for s, e, kind in _spans(rx, text):
                    plain.append(text[at:s])
                    at = e
                    rows.append(r), names.append(xxhash.xxh64_intdigest(f"{kind} {text[s:e]}".encode())), mid.append(len(plain)), low.append(first)
                if len(plain) > first:
                    plain.append(text[at:])
                    high += [len(plain)] * (len(mid) - len(high))
            if not rows:
                continue
            t = K.tokenise(pa.array(plain, pa.large_string()))
            first = t.first()
            middle = first[mid]
            terms = [np.append(np.unique(t.hash[a:b]), np.uint64(0)) for a, b in zip(np.maximum(first[low], middle - window).tolist(), np.minimum(first[high], middle + window).tolist())]
            count = [len(x) for x in terms]
            rows = pa.array(np.repeat(rows, count))
            yield pa.RecordBatch.from_arrays([keys.take(rows), digests.take(rows), pa.array(np.repeat(np.array(names, np.uint64), count).view(np.int64)), pa.array(np.concatenate(terms).view(np.int64))], schema=schema)

    return run


def _frequencies(bits):
    """Documents of each word that the bitmap lets pass, each by its weight, summed over a task."""

    @X.trimmed
    def run(batches):
        held = bits.value
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            col, weight = K.strings(batch.column(0)), batch.column(1).to_numpy()
            for lo, hi in K.slices(col):
                t = K.tokenise(col.slice(lo, hi - lo))
                on = in_bitmap(held, t.hash)
                h, row = t.hash[on], t.row[on]
                o = np.lexsort((row, h))
                h, row = h[o], row[o]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
                hashes, counts = np.concatenate([hashes, h[new]]), np.concatenate([counts, weight[lo + row[new]]])
            if len(hashes) > 1 << 20:
                hashes, counts = _sum(hashes, counts)
        hashes, counts = _sum(hashes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["term", "n"])

    return run


def _sum(h, c):
    o = np.argsort(h)
    h, c = h[o], c[o]
    s, _ = X.runs(h)
    return h[s], np.add.reduceat(c, s) if len(s) else c


def unlikely(own, both, rate):
    """-ln of Chernoff's bound on the chance of `both` or more of `own` trials at this rate; exact where both = own."""
    a = both / own
    rest = F.when(both < own, (1 - a) * F.log((1 - a) / (1 - rate))).otherwise(0.0)
    return F.when(a > rate, own * (a * F.log(a / rate) + rest)).otherwise(0.0)


def judged(docs: DataFrame, window: int = 10, share: float = 0.8, chance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every entity with every word near it: (entity, term, own, n, docs, total, part, told); and the mentions they come from.

    own = n(e), n = n(t, e), docs = n(t) and total = N all count distinct texts,
    so copies weigh nothing and a passage in several texts weighs the same in
    each. Rare entities are judged like others: a word tells if its part of
    IC(e) is at least `share` and if so many texts with it would come about by
    chance in at most a part `chance` of cases. Of one text that is n(t) / N.
    Both bounds are inclusive, so words that tie with them tell; all that tie
    are treated alike. Texts are told apart by 64 bits.
    """
    keyed = X.with_row_key(docs, id_col, text_col).where("__text is not null")
    keyed = keyed.withColumn("__digest", F.xxhash64("__text"))
    near = X.written(keyed.select("__key", "__digest", "__text").mapInArrow(_mentions(pattern(), window), "__key long, digest long, entity long, term long"), "mentions")
    pair = near.groupBy("entity", "term").agg(F.countDistinct("digest").alias("n"))
    pair = X.written(pair, "pairs")
    terms = pair.where("term <> 0").select("term").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(terms, "term"))
    # every copy of a text has the same words, so each counts for its part of one
    texts = X.written(keyed.groupBy("__digest").agg(F.count("*").alias("copies")), "texts")
    again = X.written(texts.where("copies > 1"), "again")
    weighed = keyed.select("__text", "__digest").join(X.small_side(again), "__digest", "left").select("__text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    df = weighed.mapInArrow(_frequencies(bits), "term long, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("docs"))
    total = texts.agg(F.count("*").alias("total"))
    own = pair.where("term = 0").select("entity", F.col("n").alias("own"))
    info = pair.where("term <> 0").join(own, "entity").join(df, "term").crossJoin(F.broadcast(total))
    part = F.log2(F.col("total") * F.col("n") / (F.col("docs") * F.col("own"))) / F.log2(F.col("total") / F.col("own"))
    rate = F.least(F.lit(1.0), F.col("docs") / F.col("total"))
    sure = unlikely(F.col("own"), F.col("n"), rate) >= -math.log(chance) - 1e-9
    return near, info.where("total > own").withColumn("part", part).withColumn("told", (F.col("part") >= share) & sure)


def disclosures(docs: DataFrame, window: int = 10, share: float = 0.8, chance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__key, terms, removed): per document the hashes of words that give away an entity it names (see judged).

    Documents without such words have no row.
    """
    near, info = judged(docs, window, share, chance, id_col, text_col)
    told = info.where("told").select("entity", "term", (F.col("part") >= (1 + share) / 2).alias("all"))
    mine = near.where("term = 0").select("__key", "entity").distinct().join(told, "entity")
    return X.written(mine.groupBy("__key").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("all"), F.col("term"))).alias("removed")), "told")


def _lower_hashes(col: pa.Array, t: K.Tokens) -> np.ndarray:
    """Of the tokens of texts as they stand, the hashes of their lower case."""
    low = K.tokenise(col)
    if len(low.hash) == len(t.hash):
        return low.hash
    low = K.tokenise(pa.array([bytes(t.buf[a:b]).decode() for a, b in zip(t.start, t.end)], pa.large_string()))
    out = np.zeros(len(t.hash), np.uint64)
    out[low.row] = low.hash
    return out


def _without(texts: list[str], terms: frozenset, removed: frozenset) -> list[str]:
    """Texts whose words of these hashes are generalised or removed."""
    col = pa.array(texts, pa.large_string())
    t = K.tokenise(col, lower=False)
    h = _lower_hashes(col, t).view(np.int64)
    hit = np.flatnonzero(np.isin(h, np.array(list(terms), np.int64)))
    raw, (_, offs), out = bytes(t.buf), K.buffers(col), list(texts)
    for r in np.unique(t.row[hit]).tolist():
        parts, at = [], int(offs[r])
        for i in hit[t.row[hit] == r].tolist():
            parts += [raw[at : t.start[i]], b"" if int(h[i]) in removed else b"[TERM]"]
            at = int(t.end[i])
        out[r] = b"".join([*parts, raw[at : offs[r + 1]]]).decode()
    return out


def clean_text(rx: re.Pattern, text: str, terms: frozenset = frozenset(), removed: frozenset = frozenset()) -> str:
    """The text with identifiers replaced by their kind and revealing words generalised or removed."""
    out, at = [], 0
    for s, e, kind in _spans(rx, text):
        out += [text[at:s], f"[{kind}]"]
        at = e
    if at == 0 and not terms:
        return text
    out.append(text[at:])
    if terms:
        out[0::2] = _without(out[0::2], terms, removed)
    return "".join(out)


def _cleaned(rx, text_at, size_at, terms_at):
    @X.trimmed
    def run(batches):
        for batch in batches:
            col = batch.column(text_at)
            texts = K.strings(col)
            todo = _hints(texts)
            if terms_at is not None:
                todo |= pc.is_valid(batch.column(terms_at)).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(todo)
            new = {}
            for r in rows.tolist():
                old = texts[r].as_py()
                t = gone = frozenset()
                if terms_at is not None and batch.column(terms_at)[r].is_valid:
                    t, gone = frozenset(batch.column(terms_at)[r].as_py()), frozenset(batch.column(terms_at + 1)[r].as_py())
                fresh = clean_text(rx, old, t, gone)
                if fresh != old:
                    new[r] = fresh
            cols = list(batch.columns)
            if new:
                mask = np.zeros(len(col), bool)
                mask[list(new)] = True
                cols[text_at] = pc.replace_with_mask(pc.cast(col, pa.large_string()), pa.array(mask), pa.array(list(new.values()), pa.large_string()))
                if size_at is not None:
                    cols[size_at] = pc.replace_with_mask(cols[size_at], pa.array(mask), pc.cast(pa.array([len(x) for x in new.values()]), cols[size_at].type))
            cols[text_at] = pc.cast(cols[text_at], col.type)
            names = batch.schema.names
            if terms_at is not None:
                cols, names = cols[:terms_at], names[:terms_at]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


#: Rows of disclosures up to which they are broadcast; beyond, the documents are shuffled to them.
BROADCAST_ROWS = 50_000


def sanitise(docs: DataFrame, window: int = 10, share: float = 0.8, chance: float = 0.01, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents, identifiers and revealing words replaced in their texts; size_col, where it exists, follows.

    Texts without either come back as they are; null and empty ones too. Rows
    equal in id and text share their verdict, null ids are like any other. All
    other columns are kept, whatever their names. An empty table stays empty.
    """
    told = disclosures(docs, window, share, chance, id_col, text_col)
    at = docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None
    if told.isEmpty():
        return docs.mapInArrow(_cleaned(pattern(), at, size, None), docs.schema)
    names = [f"__{n}" for n in ("key", "terms", "removed")]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    key, terms, removed = names
    told = told.select(F.col("__key").alias(key), F.col("terms").alias(terms), F.col("removed").alias(removed))
    if told.count() <= BROADCAST_ROWS:
        told = F.broadcast(told)
    wide = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col))).join(told, key, "left").select(*docs.columns, terms, removed)
    return wide.mapInArrow(_cleaned(pattern(), at, size, len(docs.columns)), docs.schema)
