"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: its
words, their character n-grams of 3 to 5 bytes with word ends, and word pairs.
A softmax layer over the average gives class probabilities. Training is
stochastic gradient descent in numpy on a bounded sample of labelled rows.
Scoring reads whole texts: as both layers are linear, each feature's vector is
multiplied by the output layer once, and a document's logits are the mean of
its features' class scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K

CLASSES = ("good", "low", "toxic")
GRAMS = (3, 4, 5)


@dataclass
class Model:
    """Class scores of each feature bucket, bias, and the least probability of "good" that is accepted."""

    scores: np.ndarray
    bias: np.ndarray
    threshold: float


def _subwords(buf, start, end, h, bits):
    """For distinct words: (word number, bucket) of the word itself and its character n-grams."""
    n = len(start)
    length = (end - start).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(length + 2)))
    chars = np.empty(off[-1], np.uint8)
    chars[off[:-1]], chars[off[1:] - 1] = 60, 62
    inner = np.ones(off[-1], bool)
    inner[off[:-1]] = inner[off[1:] - 1] = False
    take = np.arange(int(length.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    chars[inner] = buf[take]
    lut, _ = K._tables()
    word = np.repeat(np.arange(n), length + 2)
    words, buckets = [np.arange(n)], [h >> np.uint64(64 - bits)]
    code = lut[chars]
    with np.errstate(over="ignore"):
        for g in GRAMS:
            m = len(chars) - g + 1
            if m <= 0:
                continue
            x = np.full(m, g, np.uint64)
            for j in range(g):
                x *= np.uint64(0x9E3779B97F4A7C15)
                x += code[j : m + j]
            ok = word[g - 1 :] == word[:m]
            words.append(word[:m][ok])
            buckets.append(K.fmix(x[ok]) >> np.uint64(64 - bits))
    return np.concatenate(words), np.concatenate(buckets)


def _distinct(t: K.Tokens):
    """First token and number of each distinct word."""
    order = np.argsort(t.hash)
    s = t.hash[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _pairs(t: K.Tokens, bits: int):
    on = np.flatnonzero(t.row[1:] == t.row[:-1]) if len(t.row) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = K.fmix(t.hash[on] * np.uint64(0x9E3779B97F4A7C15) + t.hash[on + 1])
    return on, h >> np.uint64(64 - bits)


def logits(col: pa.Array, model: Model) -> np.ndarray:
    """Class scores of whole texts; a text without words has the bias alone."""
    bits = len(model.scores).bit_length() - 1
    out = np.tile(model.bias.astype(np.float64), (len(col), 1))
    for lo, hi in K.slices(col, max_bytes=1 << 19):
        t = K.tokenise(col.slice(lo, hi - lo), lower=False, classes="nonspace")
        if not len(t.hash):
            continue
        first, number = _distinct(t)
        word, bucket = _subwords(t.buf, t.start[first], t.end[first], t.hash[first], bits)
        on, pair = _pairs(t, bits)
        per_word = np.bincount(word, minlength=len(first))
        count = np.bincount(t.row, weights=per_word[number], minlength=t.rows) + np.bincount(t.row[on], minlength=t.rows)
        for c in range(len(model.bias)):
            s = np.ascontiguousarray(model.scores[:, c])
            w = np.bincount(word, weights=s[bucket], minlength=len(first))
            total = np.bincount(t.row, weights=w[number], minlength=t.rows) + np.bincount(t.row[on], weights=s[pair], minlength=t.rows)
            out[lo:hi, c] += np.where(count > 0, total / np.maximum(count, 1), 0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(col: pa.Array, bits: int):
    """Of each text: distinct buckets and their share of its features."""
    out = []
    for lo, hi in K.slices(col, max_bytes=1 << 20):
        t = K.tokenise(col.slice(lo, hi - lo), lower=False, classes="nonspace")
        if not len(t.hash):
            out += [(np.zeros(0, np.int32), np.zeros(0, np.float16))] * (hi - lo)
            continue
        first, number = _distinct(t)
        word, bucket = _subwords(t.buf, t.start[first], t.end[first], t.hash[first], bits)
        order = np.argsort(word, kind="stable")
        word, bucket = word[order], bucket[order].astype(np.int32)
        at = np.searchsorted(word, np.arange(len(first) + 1))
        on, pair = _pairs(t, bits)
        tok, prow = t.first(), t.row[on]
        pat = np.searchsorted(prow, np.arange(t.rows + 1))
        for r in range(t.rows):
            words, n = np.unique(number[tok[r] : tok[r + 1]], return_counts=True)
            size = at[words + 1] - at[words]
            where = np.arange(int(size.sum())) + np.repeat(at[words] - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(words) else np.zeros(0, np.int64)
            b = np.concatenate([bucket[where], pair[pat[r] : pat[r + 1]].astype(np.int32)])
            w = np.concatenate([np.repeat(n, size), np.ones(pat[r + 1] - pat[r])])
            o = np.argsort(b)
            b, w = b[o], w[o]
            s = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
            w = np.add.reduceat(w, s) if len(s) else w
            out.append((b[s], (w / max(1e-9, w.sum())).astype(np.float16)))
    return out


def fit(texts: pa.Array, classes: np.ndarray, dim: int = 8, bits: int = 18, epochs: int = 6, rate: float = 0.3, scale: float = 30.0, batch: int = 16, seed: int = 7, clean_loss: float = 0.02) -> tuple[Model, dict]:
    """Model and its held-out figures: of five rows three are for training, one sets the threshold, one is reported on.

    Averages are multiplied by `scale` before the output layer, as the share of
    telling words is small. SGD steps are scaled per vector by past gradients (AdaGrad), so rare features
    learn as fast as common ones. The threshold is the lower of 0.5 and what
    keeps all but `clean_loss` of the good rows set apart for it.
    """
    rng = np.random.default_rng(seed)
    turn = np.arange(len(texts)) % 5
    train = np.flatnonzero(turn < 3)
    bags = _bags(texts.take(pa.array(train)), bits)
    known = classes[train]
    k = len(CLASSES)
    e = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w = rng.normal(0, 0.5, (dim, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    ge, gw = np.full(1 << bits, 1e-8, np.float32), np.full((dim, k), 1e-8, np.float32)
    share = np.bincount(known, minlength=k) / max(1, len(train))
    weight = np.where(share > 0, 1 / np.maximum(share * (share > 0).sum(), 1e-9), 0).astype(np.float32)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(train)), max(1, len(train) // batch)):
            full = [i for i in at if len(bags[i][0])]
            if not full:
                continue
            idx = np.concatenate([bags[i][0] for i in full])
            val = np.concatenate([bags[i][1] for i in full]).astype(np.float32)
            size = np.array([len(bags[i][0]) for i in full])
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            x = np.add.reduceat(e[idx] * val[:, None], start, axis=0) * np.float32(scale)
            y = known[full]
            g = softmax(x @ w + bias).astype(np.float32)
            g[np.arange(len(full)), y] -= 1
            g *= (weight[y] / len(full))[:, None]
            gx = (g @ w.T) * np.float32(scale)
            dw = x.T @ g
            gw += dw * dw
            w -= rate * dw / np.sqrt(gw)
            bias -= 0.01 * g.sum(axis=0)
            doc = np.repeat(np.arange(len(full)), size)
            o = np.argsort(idx, kind="stable")
            s = np.flatnonzero(np.concatenate(([True], np.diff(idx[o]) != 0)))
            de = np.add.reduceat(gx[doc[o]] * val[o][:, None], s, axis=0)
            b = idx[o][s]
            ge[b] += (de * de).mean(axis=1)
            e[b] -= (rate * de / np.sqrt(ge[b])[:, None]).astype(np.float32)
    model = Model((e @ w * np.float32(scale)).astype(np.float32), bias, 0.5)
    tune, rows = np.flatnonzero(turn == 3), np.flatnonzero(turn == 4)
    report = {"train": len(train), "tune": len(tune), "held": len(rows)}
    if len(tune):
        good = np.sort(softmax(logits(texts.take(pa.array(tune)), model))[classes[tune] == 0, 0])
        if len(good):
            model.threshold = float(min(0.5, good[int(clean_loss * len(good))]))
    if len(rows):
        p = softmax(logits(texts.take(pa.array(rows)), model))
        y = classes[rows]
        keep = p[:, 0] >= model.threshold
        report |= {"accuracy": float(((p.argmax(axis=1)) == y).mean()), "good kept": float(keep[y == 0].mean()) if (y == 0).any() else None, "bad rejected": float((~keep[y != 0]).mean()) if (y != 0).any() else None, "threshold": model.threshold}
    return model, report


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[Model, dict]:
    """Fits a model to at most max_rows labelled documents, a third of each class (good; low; toxic of any quality).

    labels(doc_id, quality, toxic): rows with a null id, or null in both
    labels, are left out, a null in one counts as good in it; an id labelled
    twice counts as its worst. The rows are the first by a hash of the id, so
    the sample is the same at any partitioning. Of rows that share an id the
    least text is taken, and texts of over max_bytes are left out of the sample,
    so the driver gets max_rows * max_bytes at most; every text is scored
    whole. No labels at all give a model that accepts everything.
    """
    one = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.when(F.max(F.coalesce("toxic", F.lit(0))) > 0, 2).when(F.min(F.coalesce("quality", F.lit(1))) < 1, 1).otherwise(0).alias("class"))
    picked = None
    for c in range(len(CLASSES)):
        some = one.where(F.col("class") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // len(CLASSES))
        picked = some if picked is None else picked.union(some)
    picked = picked.select(F.col("doc_id").alias("__id"), "class")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.octet_length("__text") <= max_bytes).join(F.broadcast(picked), "__id").groupBy("__id", "class").agg(F.min("__text").alias("__text")).select("__id", "__text", "class").toArrow()
    rows = rows.sort_by([("__id", "ascending"), ("__text", "ascending")])
    y = rows["class"].to_numpy().astype(np.int64)
    if not len(y):
        return Model(np.zeros((2, len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32), 0.0), {"train": 0, "held": 0}
    mix = np.random.default_rng(1).permutation(len(y))
    texts = K.strings(rows["__text"]).take(pa.array(mix))
    del rows
    return fit(texts, y[mix], **options)


def _scored(model, at):
    def run(batches):
        for batch in batches:
            p = softmax(logits(K.strings(batch.column(at)), model.value))
            yield p, batch

    return run


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_good, p_low, p_toxic) of the documents that the model accepts.

    Every row is scored by itself over its whole text; repeated rows give
    repeated results. Null or empty texts have no features: their scores are
    the model's bias and they are rejected, as text without content has no
    quality. Null ids stay null.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    score = _scored(held, 1)
    sub = X.small_batches(docs).select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    kind = sub.schema[id_col].dataType.simpleString()

    @X.trimmed
    def run(batches):
        for p, b in score(batches):
            on = np.flatnonzero((p[:, 0] >= held.value.threshold) & _has_text(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on)), *(pa.array(np.round(p[on, c], 6)) for c in range(len(CLASSES)))], names=[id_col, "p_good", "p_low", "p_toxic"])

    return sub.mapInArrow(run, f"`{id_col}` {kind}, p_good double, p_low double, p_toxic double")


def _has_text(col) -> np.ndarray:
    _, offs = K.buffers(K.strings(col))
    return np.diff(offs) > 0


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model accepts, all columns as given (see accepted() for nulls)."""
    held = X.small_batches(docs).sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    score = _scored(held, at)

    @X.trimmed
    def run(batches):
        for p, b in score(batches):
            yield b.filter(pa.array((p[:, 0] >= held.value.threshold) & _has_text(b.column(at))))

    return docs.mapInArrow(run, docs.schema)
