"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .exchange import dropped, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and least node of its component, for the components of two or more nodes."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _contract(batches):
    a, b = [], []
    for pdf in batches:
        a.append(pdf["a"].to_numpy())
        b.append(pdf["b"].to_numpy())
    if a:
        n, r = forest(np.concatenate(a), np.concatenate(b))
        on = n != r
        yield pd.DataFrame({"a": r[on], "b": n[on]})


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component), component being its least node.

    Each partition first replaces its edges by stars (the same components, at
    most one edge a node). Then rounds of large-star and small-star, the first
    hanging every greater neighbour on a node's least one, the second joining
    the lesser ones, run until an edge set comes back unchanged. Every round is
    written to the shared folder, so a lost executor costs one round at most.
    Self-edges and edges with nulls are ignored; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = written(e.mapInPandas(_contract, "a long, b long"), "stars")
    seen = None
    while True:
        stat = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(stat) == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", F.col("a")).distinct()).toDF("node", "component")
        seen = tuple(stat)
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        small = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        after = small.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        new = written(after, "stars")
        dropped(now)
        now = new
