"""Document fingerprints: a canonical exact digest.

A text is normalised (NFC), case-folded, its white space folded to single
blanks, and hashed to 128 bits (xxh3). Only digests that occur twice go on:
their texts are read again, grouped by digest, and inside a group compared
byte for byte, so a collision of digests never joins two documents.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkernel as K
from .decontaminate import bitmap, in_bitmap


def canonical(text: str, form: str = "NFC") -> str:
    """The text normalised, case-folded, with runs of white space as one blank and none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize(form, unicodedata.normalize(form, text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def _digests(form):
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches):
        for batch in batches:
            raw = b"".join(b"\0" * 16 if x is None else xxhash.xxh3_128_digest(canonical(x, form).encode("utf-8", "surrogatepass")) for x in (v.as_py() for v in batch.column(1)))
            both = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[0::2]), pa.array(both[1::2])], schema=pa.schema([batch.schema.field(0), *schema]))

    return run


def _texts(form, bits):
    """Canonical bytes of the texts whose digest may be among the repeated ones."""

    def run(batches):
        held = bits.value
        for batch in batches:
            canon = [canonical(v.as_py(), form).encode("utf-8", "surrogatepass") for v in batch.column(1)]
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, canon)), ">i8").astype(np.int64)
            hi, lo = both[0::2], both[1::2]
            on = np.flatnonzero(in_bitmap(held, K.fmix(lo.view(np.uint64))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on)), pa.array(hi[on]), pa.array(lo[on]), pa.array([canon[i] for i in on], pa.binary())], names=[batch.schema.names[0], "hi", "lo", "canon"])

    return run


def _mix(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(K.fmix(b.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["lo"])


def fingerprints(docs: DataFrame, form: str = "NFC", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, keep_id, copies): of each row the digest in hex, the least id of its group, the group's rows.

    Rows are one group where their canonical bytes are equal; repeated rows are
    copies too, each with its own row in the result. A null text has no digest
    and is a group of its own: digest null, keep_id its id, copies 1. Empty
    texts are equal to each other. Null ids are never the one kept where
    another is there. Other columns are not read.
    """
    sub = X.small_batches(docs).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = sub.schema["__id"].dataType.simpleString()
    full = sub.where("__text is not null")
    all_ = X.written(full.mapInArrow(_digests(form), f"__id {kind}, hi long, lo long"), "digests")
    twice = X.written(all_.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo"), "twice")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(twice.select("lo").mapInArrow(_mix, "lo long"), "lo"))
    text = full.mapInArrow(_texts(form, bits), f"__id {kind}, hi long, lo long, canon binary").join(twice, ["hi", "lo"], "left_semi")
    # copies are counted before the shuffle, so a text of any number of copies is one row a task
    same = X.written(text.groupBy("hi", "lo", "canon").agg(F.count("*").alias("copies"), F.min("__id").alias("keep_id")), "same")
    digest = F.lower(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0")))
    groups = same.groupBy("hi", "lo").agg(F.count("*").alias("texts"), F.max("copies").alias("copies"), F.max("keep_id").alias("keep_id"))
    groups = X.written(groups, "groups")
    placed = all_.join(X.small_side(groups), ["hi", "lo"], "left")
    one = placed.where("texts is null or texts = 1").select("__id", digest.alias("digest"), F.when(F.col("texts").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    clash = groups.where("texts > 1")
    if not clash.isEmpty():  # different texts of one digest: their rows are matched by their bytes
        many = text.join(F.broadcast(clash.select("hi", "lo")) if clash.count() <= X.SMALL_ROWS else clash.select("hi", "lo"), ["hi", "lo"], "left_semi").join(same, ["hi", "lo", "canon"])
        one = one.unionByName(many.select("__id", digest.alias("digest"), "keep_id", "copies"))
    none = sub.where("__text is null").select("__id", F.lit(None).cast("string").alias("digest"), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    return one.unionByName(none).withColumnRenamed("__id", id_col)


#: DuckDB SQL of fingerprints() without the digest; case folding as far as Latin scripts need it.
SQL = """
with c as (select doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', ' ', 'g')) as canon from documents)
select doc_id, case when canon is null then doc_id else min(doc_id) over (partition by canon) end as keep_id,
       case when canon is null then 1 else count(*) over (partition by canon) end as copies
from c"""
