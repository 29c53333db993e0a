"""Vectorised tokenising and hashing of whole Arrow batches of texts.

A word is a maximal run of Unicode letters, marks, numbers and underscores;
everything else separates. In scripts that are written without blanks (Han,
kana, Thai, Lao, Khmer, Burmese) every character is a word. Words are
lower-cased and hashed to 64 bits with prefix sums over the bytes, so no Python
code runs per word. Texts of any length are taken whole: long ones are gone
through in pieces, and a word that a piece's end would cut begins the next one.
"""

from __future__ import annotations

import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _cache() -> dict:
    """What a Python process keeps; it is not part of any pickled closure."""
    return sys.modules.setdefault("_rookery_cache", types.ModuleType("_rookery_cache")).__dict__


def fmix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(_MIX1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(_MIX2)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    c = _cache()
    if len(c.get("pow", ())) < n:
        n = max(n, PIECE)
        inv = pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, base in (("pow", _ODD), ("inv", inv)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                c[name] = np.multiply.accumulate(x)
    return c["pow"], c["inv"]


#: Scripts without blanks between words.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


def _tables(classes: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """Hash of each byte; class of each code point under 2^17: 0 separates, 1 is part of a word, 2 is a word."""
    c = _cache()
    if "lut" not in c:
        c["lut"] = fmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    if classes not in c:
        if classes == "word":
            t = np.array([unicodedata.category(chr(i))[0] in "LMN" for i in range(1 << 17)], np.uint8)
            t[95] = 1
            for a, b in ALONE:
                t[a : b + 1] *= 2
        else:
            t = np.array([not chr(i).isspace() for i in range(1 << 17)], np.uint8)
        c[classes] = t
    return c["lut"], c[classes]


def _class_of(cp: np.ndarray, table: np.ndarray, classes: str) -> np.ndarray:
    """Class of code points; past 2^17 there are Han characters, variation selectors and nothing else that is part of a word."""
    out = table[np.minimum(cp, len(table) - 1)]
    far = cp >= len(table)
    if far.any():
        out[far] = np.where(cp[far] < 0x40000, 2, (cp[far] >= 0xE0100) & (cp[far] <= 0xE01EF)) if classes == "word" else 1
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; faster on wide integers than numpy's own."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def strings(col) -> pa.Array:
    """A text column as one large_string array; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.cast(col, pa.large_string())
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a large_string array."""
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(col: pa.Array, max_bytes: int = 2 << 20, max_rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about max_bytes; a single longer text is a range of its own."""
    _, offs = buffers(col)
    a = 0
    while a < len(col):
        b = int(np.searchsorted(offs, offs[a] + max_bytes, "right")) - 1
        b = min(max(b, a + 1), a + max_rows, len(col))
        yield a, b
        a = b


class Tokens:
    """Tokens of a range of texts: row, 64-bit hash, byte range in `buf`."""

    def __init__(self, row, hash_, start, end, rows, buf=None):
        self.row, self.hash, self.start, self.end, self.rows, self.buf = row, hash_, start, end, rows, buf

    def first(self) -> np.ndarray:
        """Index of the first token of each row, and one past the last."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def _piece(buf: np.ndarray, offs: np.ndarray, classes: str):
    """Row, hash, start and end of the tokens of some bytes, which hold whole characters."""
    lut, table = _tables(classes)
    n = len(buf)
    power, inverse = _powers(n + 1)
    w = (table[:256] > 0)[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    alone = None
    if len(lead):
        far = np.append(buf, np.zeros(3, np.uint8))
        c0, c1, c2, c3 = (far[lead + k].astype(np.int32) for k in range(4))
        c1, c2, c3 = c1 & 63, c2 & 63, c3 & 63
        size = 2 + (c0 >= 0xE0) + (c0 >= 0xF0)
        cp = np.where(size == 2, ((c0 & 31) << 6) | c1, np.where(size == 3, ((c0 & 15) << 12) | (c1 << 6) | c2, ((c0 & 7) << 18) | (c1 << 12) | (c2 << 6) | c3))
        kind = _class_of(cp, table, classes)
        for k in range(4):
            on = size > k
            w[lead[on] + k] = kind[on] > 0
        if (kind == 2).any():
            alone = lead[kind == 2], size[kind == 2]
    before, after = np.empty(n, bool), np.empty(n, bool)
    np.greater(w[1:], w[:-1], out=before[1:])
    np.greater(w[:-1], w[1:], out=after[:-1])
    inner = offs[(offs >= 0) & (offs < n)]
    before[inner] = w[inner]
    before[0] = w[0]
    after[n - 1] = w[n - 1]
    inner = offs[(offs > 0) & (offs < n)]
    after[inner - 1] = w[inner - 1]
    if alone is not None:
        at, size = alone
        before[at] = after[at + size - 1] = True
        after[at[at > 0] - 1] = w[at[at > 0] - 1]
        past = (at + size)[at + size < n]
        before[past] = w[past]
    start = np.flatnonzero(before)
    end = np.flatnonzero(after) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(lut[buf] * power[:n], out=sums[1:])
        h = fmix((sums[end] - sums[start]) * inverse[start])
    return np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs))), h, start, end


def tokenise(col: pa.Array, lower: bool = True, classes: str = "word") -> Tokens:
    """All tokens of a range of texts. classes: "word", or "nonspace" for runs without white space."""
    if lower:
        col = pc.utf8_lower(col)
    buf, offs = buffers(col)
    rows, hashes, starts, ends = [], [], [], []
    a, n, most = 0, len(buf), PIECE
    while a < n:
        b, inside = min(a + most, n), False
        if b < n:
            at = int(np.searchsorted(offs, b, "right")) - 1
            if offs[at] > a:
                b = int(offs[at])
            else:  # inside one long text: cut between two characters
                inside = True
                while b > a + 1 and buf[b] & 0xC0 == 0x80:
                    b -= 1
        lo = int(np.searchsorted(offs, a, "right")) - 1
        hi = int(np.searchsorted(offs, b, "left"))
        local = np.clip(offs[lo : hi + 1] - a, 0, b - a)
        r, h, s, e = _piece(buf[a:b], local, classes)
        if inside and len(e) and e[-1] == b - a:  # the cut may be inside this token
            if s[-1] == 0:
                most *= 2  # nor does it begin here
                continue
            b = a + int(s[-1])
            r, h, s, e = r[:-1], h[:-1], s[:-1], e[:-1]
        most = PIECE
        rows.append(r + lo)
        hashes.append(h)
        starts.append(s + a)
        ends.append(e + a)
        a = b
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return Tokens(cat(rows, np.int64), cat(hashes, np.uint64), cat(starts, np.int64), cat(ends, np.int64), len(col), buf)


def ngrams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every n-gram; a text of 1 to n-1 tokens gives one shorter gram."""
    with np.errstate(over="ignore"):
        m = len(t.hash)
        rows, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        mult = [np.uint64(pow(_MIX2, j, 1 << 64)) for j in range(n)]
        if m >= n:
            h = np.zeros(m - n + 1, np.uint64)
            for j in range(n):
                h += t.hash[j : m - n + 1 + j] * mult[j]
            ok = t.row[n - 1 :] == t.row[: m - n + 1]
            rows, hashes = t.row[: m - n + 1][ok], fmix(h[ok])
        first = t.first()
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < n))
        if len(short):
            h = np.zeros(len(short), np.uint64)
            for j in range(n - 1):
                on = size[short] > j
                h[on] += t.hash[first[short[on]] + j] * mult[j]
            rows = np.concatenate([rows, short])
            hashes = np.concatenate([hashes, fmix(h + size[short].astype(np.uint64))])
    return rows, hashes


def shingle_sets(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (ascending) and distinct 48-bit n-gram hashes (ascending in a row)."""
    rows, h = ngrams(t, n)
    both = distinct((rows.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
