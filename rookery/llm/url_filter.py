"""URL filter over a sorted digest array.

A blocklist becomes files in the shared folder, one set for each range of
64-bit xxhash digests: the sorted digests, string offsets, and the strings. A
task maps the digests into memory, probes them by vectorised binary search and
confirms each hit against the stored string, so collisions block nothing.
"""

from __future__ import annotations

import re
import urllib.parse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K


def normalised(url: Column) -> Column:
    """host[:port]/path?query: without scheme, user, "www.", "m.", fragment, tracking parameters, default ports and final slashes; host in lower case."""
    u = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.regexp_replace(host, r"(:80|:443)$", "")
    host = F.regexp_replace(host, r"\.$", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    rest = F.regexp_replace(rest, r"&+", "&")
    rest = F.regexp_replace(rest, r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&/]+$", "")
    return F.concat(host, rest)


NORMALISED_SQL = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), '^([^/?]*)', 1)), '^.*@', ''), '(:80|:443)$', ''), '\.$', ''), '^(www|m)\.', '')
|| regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '')"""


def keys(norm: Column) -> Column:
    """What a rule may name: the URL, its path without query, each folder above, the host, each parent domain; the most specific first."""
    host = F.regexp_extract(norm, r"^([^/?]*)", 1)
    path = F.regexp_replace(norm, r"\?.*$", "")
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    labels = F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.array_distinct(F.concat(F.array(norm, path), folders, domains))


def _shards(path, shards):
    """Writes the digests of one range, their offsets and strings."""

    def run(table: pa.Table) -> pa.Table:
        s = table["rule"].to_pylist()
        k = int(table["shard"][0].as_py())
        raw = [x.encode() for x in s]
        h = np.array([xxhash.xxh64_intdigest(x) for x in raw], np.uint64)
        o = np.argsort(h, kind="stable")
        raw = [raw[i] for i in o]
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        for name, data in (("digest", h[o].tobytes()), ("offset", offs.tobytes()), ("text", b"".join(raw))):
            with fs.open_output_stream(f"{base}/{k}.{name}") as f:
                f.write(data)
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([len(s)], pa.int64())})

    return run


def build(rules: DataFrame, rule_col: str = "rule", rules_per_shard: int = 1 << 20) -> tuple[str, int]:
    """Folder and number of shards of a blocklist; rules are normalised like URLs, nulls and empty ones dropped.

    A rewritten shard holds the same bytes, so a task that runs again does no harm.
    """
    norm = rules.select(normalised(F.col(rule_col)).alias("rule")).where("rule <> ''").distinct()
    n = norm.count()
    shards = 1
    while shards * rules_per_shard < n:
        shards *= 2
    path = X.shared_dir(rules.sparkSession)
    if ":" not in path.split("/")[0]:
        path = "file://" + path
    path = urllib.parse.unquote(path) if path.startswith("file:") else path
    path = path.replace("file:///", "file:/").replace("file:/", "file:///")
    path = re.sub(r"^s3[an]://", "s3://", path)  # Arrow's name of what Hadoop calls s3a
    h = F.xxhash64("rule")
    done = norm.withColumn("shard", F.pmod(F.shiftrightunsigned(h, 32), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_shards(path, shards), "shard int, n long")
    done.agg(F.sum("n")).first()
    return path, shards


def _open(path: str, k: int):
    """Digests, offsets and strings of a shard: mapped where the folder is a file system, else read."""
    cache = K._cache().setdefault("url_shards", {})
    if (path, k) not in cache:
        fs, base = pafs.FileSystem.from_uri(path)
        got = []
        for name, kind in (("digest", np.uint64), ("offset", np.int64), ("text", np.uint8)):
            f = f"{base}/{k}.{name}"
            info = fs.get_file_info(f)
            if info.type == pafs.FileType.NotFound or info.size == 0:
                got.append(np.zeros(0, kind))
            elif isinstance(fs, pafs.LocalFileSystem):
                got.append(np.memmap(f, kind, "r"))
            else:
                with fs.open_input_file(f) as stream:
                    got.append(np.frombuffer(stream.read(), kind))
        cache[path, k] = got
    return cache[path, k]


def _probe(path, shards):
    """First of each URL's keys that the list holds."""

    def run(batches):
        for batch in batches:
            lists, shard_lists = batch.column(2), batch.column(3)
            offs = np.asarray(lists.offsets, np.int64)
            flat = K.strings(lists.flatten())
            shard = shard_lists.flatten().to_numpy()
            offs = offs - offs[0]
            buf, so = K.buffers(flat)
            data = buf.tobytes()
            h = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(so[:-1].tolist(), so[1:].tolist())], np.uint64)
            hit = np.zeros(len(h), bool)
            for k in np.unique(shard):
                digest, off, text = _open(path, int(k))
                if not len(digest):
                    continue
                mine = np.flatnonzero(shard == k)
                at = np.searchsorted(digest, h[mine])
                on = digest[np.minimum(at, len(digest) - 1)] == h[mine]  # the rest misses without a loop
                for i, p in zip(mine[on].tolist(), at[on].tolist()):
                    while p < len(digest) and digest[p] == h[i]:
                        if bytes(text[off[p] : off[p + 1]]) == data[so[i] : so[i + 1]]:
                            hit[i] = True
                            break
                        p += 1
            row = np.repeat(np.arange(len(lists)), np.diff(offs))
            first = np.full(len(lists), -1, np.int64)
            on = np.flatnonzero(hit)[::-1]
            first[row[on]] = on
            rule = flat.take(pa.array(np.where(first < 0, 0, first), mask=first < 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first >= 0), pa.array(rule.cast(pa.string()))], names=[batch.schema.names[0], "url", "blocked", "rule"])

    return run


def verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", rule_col: str = "rule") -> DataFrame:
    """(page_id, url, blocked, rule): for every row whether a rule blocks it, and the most specific that does.

    A rule blocks its own URL, all below its path, or all of its domain. Null
    and empty URLs are not blocked. Repeated rows are each judged, null ids
    stay null, other columns are not read. No rules block nothing.
    """
    path, shards = build(rules, rule_col)
    k = keys(normalised(F.coalesce(F.col(url_col), F.lit(""))))
    sub = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), k.alias("__keys"))
    sub = sub.withColumn("__shards", F.transform("__keys", lambda x: F.pmod(F.shiftrightunsigned(F.xxhash64(x), 32), F.lit(shards)).cast("int")))
    kind = sub.schema["__id"].dataType.simpleString()
    return sub.mapInArrow(_probe(path, shards), f"__id {kind}, url string, blocked boolean, rule string").withColumnRenamed("__id", id_col)
