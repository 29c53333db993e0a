"""Mixing sources to target weights by capped water-filling.

Every source gets the share of the budget that its weight asks for, but no
more than max_epochs of its own size; what a source can't take flows to the
others in proportion to their weights, until all fit. The fill level is found
in closed form: sources are sorted by the level at which they saturate, and a
source is saturated where filling all of them to its level costs no more than
the budget. Documents are repeated whole, and once more by a seeded hash of
their id for the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sources up to which the table of rates is broadcast; beyond, Catalyst picks the join.
BROADCAST_SOURCES = 200_000


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget: float = 1.0, max_epochs: float = 4.0, source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """(source, size, weight, rate): how often each source is to be read.

    budget is a multiple of the corpus's size. Sources not named in weights,
    the null source among them, have default_weight; a weight of 0 or less
    gives rate 0, a source of size 0 max_epochs. Null or negative sizes count
    as 0.
    """
    size = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0))).cast("double").alias("size"))
    weight = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))))
        weight = F.coalesce(F.when(F.col("source").isNotNull(), table[F.coalesce(F.col("source").cast("string"), F.lit(""))]), weight)
    s = size.withColumn("weight", F.greatest(weight, F.lit(0.0))).withColumn("total", F.sum("size").over(Window.partitionBy()) * float(budget))
    cap = F.col("size") * float(max_epochs)
    live = F.col("weight") > 0
    level = F.when(live, cap / F.col("weight"))
    every = Window.partitionBy(live.alias("l"))
    order = every.orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("cap", cap).withColumn("level", level)
    s = s.withColumn("cost", F.sum("cap").over(order) + F.col("level") * (F.sum("weight").over(every) - F.sum("weight").over(order)))
    s = s.withColumn("full", live & (F.col("cost") <= F.col("total")))
    filled = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    rate = F.when(~live, 0.0).when(F.col("full"), float(max_epochs)).otherwise((F.col("total") - filled) / open_ * F.col("weight") / F.col("size"))
    return s.select("source", "size", "weight", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget: float = 1.0, max_epochs: float = 4.0, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """The documents, each as often as its source's rate says, with `epoch` from 1.

    A document is repeated floor(rate) times, and once more where a hash of
    seed and id, as a fraction, is under the rest; so repeated rows of one id
    fare alike, as do null ids. An input column `epoch` is replaced. An empty
    table gives an empty result; rates() says what nulls and ties mean.
    """
    r = rates(docs, weights, default_weight, budget, max_epochs, source_col, size_col).where("rate > 0").select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    n_sources = docs.select(F.col(source_col)).distinct().limit(BROADCAST_SOURCES + 1).count()
    if n_sources <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = docs.drop("epoch").select(F.struct("*").alias("__row"), F.col(source_col).alias("__s"), u.alias("__u"))
    joined = rows.join(r, F.col("__s").eqNullSafe(F.col("__source")))
    whole = F.floor("__rate")
    times = (whole + F.when(F.col("__u") < F.col("__rate") - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn("__n", times).where("__n > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("epoch")).select("__row.*", "epoch")


def mix_sql(weights: dict[str, float], table: str = "documents", columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), default_weight: float = 1.0, budget: float = 1.0, max_epochs: float = 4.0, seed: int = 0) -> str:
    """DuckDB SQL of mix()."""
    case = "".join(f" when '{k}' then cast({v} as double)" for k, v in weights.items())
    return f"""
with s as (select source, cast(sum(greatest(coalesce(n_chars, 0), 0)) as double) as size from {table} group by source),
w as (select source, size, greatest(case source{case} else cast({default_weight} as double) end, cast(0 as double)) as weight, sum(size) over () * {float(budget)} as total from s),
l as (select *, size * {float(max_epochs)} as cap, size * {float(max_epochs)} / weight as level from w where weight > 0),
c as (select *, sum(cap) over (order by level range between unbounded preceding and current row) + level * (sum(weight) over () - sum(weight) over (order by level range between unbounded preceding and current row)) as cost from l),
f as (select *, case when cost <= total then cap else cast(0 as double) end as fc, case when cost <= total then cast(0 as double) else weight end as ow from c),
g as (select *, sum(fc) over () as filled, sum(ow) over () as open_ from f),
r as (select source, case when cost <= total then cast({float(max_epochs)} as double) else (total - filled) / open_ * weight / size end as rate from g),
n as (select d.*, cast(floor(r.rate) as bigint) + case when cast(cast('0x' || substr(md5('{seed}:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) as double) / 4294967296.0 < r.rate - floor(r.rate) then 1 else 0 end as n
      from {table} d join r on d.source is not distinct from r.source)
select {", ".join(columns)}, cast(e.epoch as integer) as epoch from n join (select unnest(range(1, {int(max_epochs) + 2})) as epoch) e on e.epoch <= n.n"""
