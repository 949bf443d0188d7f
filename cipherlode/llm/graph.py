"""Connected components: forests of each partition's edges, then alternating star operations as joins and groupings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlode.llm.text import settle

#: Edges that one step of a task holds.
HELD = 1 << 20


def lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The lowest node reachable, for nodes 0..n-1 and edges a-b."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        m = np.minimum(x, y)
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components with an edge a node at most: from each node to the lowest that these edges reach."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ends = np.concatenate([x for pair in zip(*held, strict=True) for x in pair])
        nodes, at = np.unique(ends, return_inverse=True)
        low = lowest(*np.split(at, 2), len(nodes))
        own = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[low[own]])], ["a", "b"])

    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        if sum(len(x) for x, _ in held) >= HELD:
            yield flush()
            held.clear()
    if held:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b), both long.

    Tasks first replace their own edges by a forest. Large-star and small-star
    steps then alternate until every node but a component's smallest has one edge, to that one;
    each round is written to the shared folder. A node's neighbours are only
    aggregated (min), never collected, so a hub may have any number. Without edges the result is empty.
    """
    edges = settle(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"))
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))
        seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.col("to").isNull()).alias("above"))
        if seen.where("low <> high OR (low IS NOT NULL AND above > 0)").isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = settle(small.distinct())
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops).distinct()
