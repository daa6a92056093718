"""Connected components of an edge table, without collecting edges or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.session import cut

# Up to so many edges (16 bytes each) are joined in one task; more are joined in rounds over all tasks.
TASK_EDGES = 1_000_000


def star_round(edges: DataFrame) -> DataFrame:
    """One round over edges (a, b) with a < b: the same components, in fewer and flatter stars.

    Large star: every node links its larger neighbours to its smallest neighbour or itself. Small star:
    every node links its smaller neighbours, and itself, to the smallest of them. Minima per node are
    combined before their exchange, and a node with very many neighbours only sends its minimum along a
    join whose skewed side Spark splits.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
    low = large.groupBy("b").agg(F.min("a").alias("m"))
    ends = F.explode(F.array(F.col("a"), F.col("b")))
    small = large.join(low, "b").select(F.col("m"), ends.alias("x"))
    return small.filter("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def ordered(edges: DataFrame) -> DataFrame:
    """The edges once each, smaller end first."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labels(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest neighbour of every larger end; other nodes name themselves."""
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``smallest_reachable`` of few edges: labels jump to their labels' labels until none changes."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]) for b in batches]
        pairs = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), dtype=np.int64)
        nodes, at = np.unique(pairs, return_inverse=True)
        low, high = np.sort(at.reshape(pairs.shape), axis=0)
        label = np.arange(len(nodes))
        while True:
            # The larger of two labels takes the smaller one on, then every node looks its label's up.
            x, y = np.sort(np.stack([label[low], label[high]]), axis=0)
            hooked = label.copy()
            np.minimum.at(hooked, y, x)
            hooked = hooked[hooked]
            if (hooked == label).all():
                break
            label = hooked
        moved = label != np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(join, "node long, component long")


def smallest_reachable(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b) that reach a smaller one: the smallest of all.

    At most ``task_edges`` edges are joined in one task. With more, rounds go on until the edges are stars, logarithmically many in practice. Each round's edges are
    written to the shared folder, so a lost executor repeats one round at most. Null ids are not edges.
    """
    edges = cut(ordered(edges))
    if edges.count() <= task_edges:
        return _in_one_task(edges)
    now, before = cut(star_round(edges)), None
    while True:
        # Order-free fingerprint of the edge set; stars are a fixed point.
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before or not state[0]:
            return labels(now)
        now, before = cut(star_round(now)), state
