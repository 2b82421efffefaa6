"""Connected components of a links table: in one task up to a bound, beyond it by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import release, small, written

#: Counted links that one task may hold (16 bytes each).
IN_TASK = 1_000_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable): labels fall to the least of both ends and of the labels' own labels until none does."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        for end in (x, y, a, b):
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _in_task(edges: DataFrame) -> DataFrame:
    def run(it):
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in it if x.num_rows]
        if parts:
            nodes, least = smallest_reachable(*(np.concatenate(x) for x in zip(*parts)))
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(least[i : i + 100_000])], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", in_task: int = IN_TASK) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Up to ``in_task`` links, which are counted first, one task takes them all.  Beyond, each step is two shuffles of the links, hubs are met by their minimum only, and the number of
    steps grows with the logarithm of the longest path.  Every step is written to the shared folder.
    Links with a null end and links of a node to itself are ignored; no links: no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges)
    if edges.count() <= in_task:
        return _in_task(edges)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        starred = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, written(starred)
        release(last)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged_components(found: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``found`` (node, component) after more links: only components that a new link joins are worked on.

    Ends of links become their components first, so the steps run over a graph of components, which
    a new link between two of the same leaves as it is.  Same result as all links at once.
    """
    n = found.count()

    def end(x):
        return small(found.select(F.col("node").alias(x), F.col("component").alias(f"__{x}")), n)

    met = links.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(end(a), a, "left").join(end(b), b, "left")
    joined = written(connected_components(met.select(F.coalesce(f"__{a}", a).alias("a"), F.coalesce(f"__{b}", b).alias("b"))))
    n_joined = joined.count()
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("__to"))
    moved = found.join(small(to, n_joined), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    return written(moved.unionByName(joined.join(small(found.select("node"), n), "node", "left_anti")))
