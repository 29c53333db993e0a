"""Edit-aware token counts.

BPE never merges across pre-tokens, so a document's tokens are the sum over
its pre-tokens. A segment tree over blocks of pre-tokens keeps characters and
tokens. An edit re-splits from a little before the place it touches until a
boundary falls on an old one again (from there on the splits are equal, as the
pattern looks ahead only), encodes the new pre-tokens, and updates the sums on
the way to the root.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K
from .pii import _hints, _spans, pattern

#: The split of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters before an edit from which the split may change: a contraction's length and one to look ahead.
CONTEXT = 4
BLOCK = 32


class Memo(dict):
    """Tokens of each pre-token seen; emptied when large, as it only saves time."""

    def __init__(self, ranks: str | bytes, limit: int = 300_000):
        """ranks: a vocabulary file, or what it holds."""
        super().__init__()
        if isinstance(ranks, str):
            with open(ranks, "rb") as f:
                ranks = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split, self.match = regex.compile(PATTERN).findall, regex.compile(PATTERN).match
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8", "replace")
        n = 1 if raw in self.ranks else len(self.encoding._encode_single_piece(raw))
        if len(self) >= self.limit:
            self.clear()
        self[piece] = n
        return n

    def counts(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


class TokenTree:
    """Segment tree of a text's pre-tokens; leaves are blocks of about BLOCK of them."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        cut = range(0, len(chars), BLOCK)
        self.blocks = [(chars[i : i + BLOCK], tokens[i : i + BLOCK]) for i in cut]
        self._build()

    def _build(self) -> None:
        n = 1
        while n < max(1, len(self.blocks)):
            n *= 2
        self.size = n
        self.sums = np.zeros((2 * n, 2), np.int64)
        for i, (c, t) in enumerate(self.blocks):
            self.sums[n + i] = int(c.sum()), int(t.sum())
        for i in range(n - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def block_at(self, char: int) -> tuple[int, int]:
        """Block that holds a character, and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if char - begin >= self.sums[i, 0] and i + 1 < 2 * self.size and self.sums[i + 1, 0] > 0:
                begin += int(self.sums[i, 0])
                i += 1
        return i - self.size, begin

    def _set(self, i: int, block) -> None:
        self.blocks[i] = block
        j = self.size + i
        self.sums[j] = int(block[0].sum()), int(block[1].sum())
        while j > 1:
            j //= 2
            self.sums[j] = self.sums[2 * j] + self.sums[2 * j + 1]

    def edit(self, text: str, start: int, end: int, new: str, memo: Memo) -> tuple[str, int]:
        """Replaces text[start:end]; gives the new text and how many pre-tokens were encoded."""
        after = text[:start] + new + text[end:]
        if not self.blocks:
            pieces = memo.split(after)
            self.__init__(np.array([len(x) for x in pieces], np.int64), memo.counts(pieces))
            return after, len(pieces)
        b0, begin = self.block_at(max(0, start - CONTEXT))
        c0 = self.blocks[b0][0]
        ends = begin + np.cumsum(c0)
        skip = int(np.searchsorted(ends, max(0, start - CONTEXT), "right"))
        if skip:
            begin_new = int(ends[skip - 1])
        else:
            begin_new = begin
        shift = len(new) - (end - start)
        # new pre-tokens until a boundary past the edit is an old one, shifted
        bounds: dict[int, tuple[int, int]] = {}
        bi, pos = b0, begin
        reached = pos
        fresh, p = [], begin_new
        goal = None
        while True:
            q = p
            if q >= start + len(new):
                want = q - shift
                while reached <= want and bi < len(self.blocks):
                    x = reached
                    bounds[x] = (bi, 0)
                    for k, n in enumerate(self.blocks[bi][0].tolist()):
                        x += n
                        bounds[x] = (bi, k + 1)
                    reached = x
                    bi += 1
                if want in bounds and want >= end:
                    goal = bounds[want]
                    break
            if q >= len(after):
                goal = (len(self.blocks) - 1, len(self.blocks[-1][0]))
                break
            m = memo.match(after, q)
            fresh.append(m.group())
            p = m.end()
        gb, gk = goal
        tokens = memo.counts(fresh)
        chars = np.array([len(x) for x in fresh], np.int64)
        head, tail = self.blocks[b0], self.blocks[gb]
        c = np.concatenate([head[0][:skip], chars, tail[0][gk:]])
        t = np.concatenate([head[1][:skip], tokens, tail[1][gk:]])
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(c) <= 4 * BLOCK:
            self._set(b0, (c, t))
            for i in range(b0 + 1, gb + 1):
                self._set(i, empty)
        else:  # a large insertion: the leaves are laid out again
            self.blocks[b0 : gb + 1] = [(c[i : i + BLOCK], t[i : i + BLOCK]) for i in range(0, len(c), BLOCK)]
            self._build()
        return after, len(fresh)

    def pack(self) -> bytes:
        """The leaves as bytes, to keep a document's tree."""
        cat = lambda k: np.concatenate([b[k] for b in self.blocks]).astype(np.uint32) if self.blocks else np.zeros(0, np.uint32)
        return X.pack(chars=cat(0), tokens=cat(1))

    @classmethod
    def unpack(cls, data: bytes) -> TokenTree:
        x = X.unpack(data)
        return cls(x["chars"].astype(np.int64), x["tokens"].astype(np.int64))


def _sent(df: DataFrame, ranks_path: str):
    """The driver's vocabulary file, under its digest, for the executors."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast((xxhash.xxh64_hexdigest(raw), raw))


def _memo(sent) -> Memo:
    c = K._cache().setdefault("memo", {})
    name, raw = sent.value
    if name not in c:
        c[name] = Memo(raw)
    return c[name]


def tree_of(text: str, memo: Memo) -> TokenTree:
    pieces = memo.split(text)
    return TokenTree(np.fromiter(map(len, pieces), np.int64, len(pieces)), memo.counts(pieces))


def _with_trees(sent):
    """Rows of (id, text) with the count and the packed tree of each text."""

    def run(batches):
        memo = _memo(sent)
        for b in batches:
            got = [tree_of(x.as_py(), memo) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g and g.tokens for g in got], pa.int64()), pa.array([g and g.pack() for g in got], pa.binary())], names=[*b.schema.names, "tokens", "tree"])

    return run


def kept_trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __text, tokens, tree): every row with its text, count and packed tree, to be written and edited later."""
    sub = X.small_batches(docs).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = sub.schema["__id"].dataType.simpleString()
    return sub.mapInArrow(_with_trees(_sent(docs, ranks_path)), f"__id {kind}, __text string, tokens long, tree binary")


def trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, tokens, tree): each row's count and its packed tree; null texts have null in both.

    text_key is 64 bits of id and text, by which edited() finds a tree.
    """
    k = kept_trees(docs, ranks_path, id_col, text_col)
    return k.select(F.col("__id").alias(id_col), F.xxhash64("__id", "__text").alias("text_key"), "tokens", "tree")


def apart(edits: list[dict], length: int) -> list[tuple[int, int, str]]:
    """(start, end, new) in order, inside a text of this length, none of which overlap.

    An edit that begins before the one ahead of it ends begins where that one
    ends; so every edit is applied, and each character is replaced once.
    """
    out, at = [], 0
    for s, e, new in sorted((x["start"], x["end"], x["new"]) for x in edits):
        s = max(at, min(max(s, 0), length))
        at = max(s, min(e, length))
        out.append((s, at, new))
    return out


def edited(docs: DataFrame, kept: DataFrame, edits: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, tree, text) after edits(doc_id, start, end, new), from kept trees(doc_id, text_key, tree).

    Offsets are characters of the text before any edit; apart() says what
    becomes of edits that overlap, edits given twice count once. Edits without
    a document are ignored; nulls in an edit void it; out of range offsets are
    clipped. Only documents with edits have rows: one for every different text
    of an id, each with the tree of that text. Null ids and texts have none.
    """
    e = edits.where("doc_id is not null and start is not null and end is not null and new is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("start", "end", "new")).alias("e"))
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null").withColumn("text_key", F.xxhash64("__id", "__text"))
    k = kept.select(F.col(id_col).alias("__id"), "text_key", "tree")
    j = d.join(e, "__id").dropDuplicates(["__id", "text_key"]).join(k.dropDuplicates(["__id", "text_key"]), ["__id", "text_key"]).select("__id", "__text", "tree", "e")
    kind, sent = j.schema["__id"].dataType.simpleString(), _sent(docs, ranks_path)

    def run(batches):
        memo = _memo(sent)
        for b in batches:
            n, t, x = [], [], []
            for text, tree, es in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                tree = TokenTree.unpack(tree)
                for s, to, new in reversed(apart(es, len(text))):  # from the last: earlier offsets stay right
                    text, _ = tree.edit(text, s, to, new, memo)
                n.append(tree.tokens), t.append(tree.pack()), x.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(t, pa.binary()), pa.array(x, pa.string())], names=["__id", "tokens", "tree", "text"])

    return j.mapInArrow(run, f"__id {kind}, tokens long, tree binary, text string").withColumnRenamed("__id", id_col)


def redaction_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, tokens_after, edits, encoded_again): counts before and after identifiers are edited out.

    The trees of all rows are built from whole texts and written. Then every
    identifier found is an edit that replaces it by its kind: the row's kept
    tree is read, and the surroundings of its edits alone are encoded again.
    Null texts have null counts and no edits, empty ones 0 tokens; rows are
    judged each by itself, null ids stay null, and other columns are not read.
    """
    kept = X.written(kept_trees(docs, ranks_path, id_col, text_col), "trees", "zstd")
    kind, sent = kept.schema["__id"].dataType.simpleString(), _sent(docs, ranks_path)

    def run(batches):
        memo, rx = _memo(sent), pattern()
        for b in batches:
            tokens, trees_, out = b.column(2).to_pylist(), b.column(3), []
            hint = _hints(K.strings(b.column(1)))
            for i, h in enumerate(hint.tolist()):
                text = b.column(1)[i].as_py() if h else None
                spans = list(_spans(rx, text)) if text else []
                if not spans:
                    out.append((tokens[i], tokens[i], 0, 0))
                    continue
                tree, again = TokenTree.unpack(trees_[i].as_py()), 0
                for s, e, k in reversed(spans):
                    text, m = tree.edit(text, s, e, f"[{k}]", memo)
                    again += m
                out.append((tokens[i], tree.tokens, len(spans), again))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["__id", "tokens", "tokens_after", "edits", "encoded_again"])

    return kept.mapInArrow(run, f"__id {kind}, tokens long, tokens_after long, edits long, encoded_again long").withColumnRenamed("__id", id_col)
