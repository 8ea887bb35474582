"""Connected components of an edge table.

Up to ``ONE_TASK`` distinct edges (16 MB) go through a union-find in one task, on an executor. Larger graphs take alternating large-star and
small-star rounds, all distributed, until they have become stars. Each round is two aggregations (combined before the shuffle) and two equi-joins; its edges are written to the shared folder, so
the lineage is one round long and a lost executor costs a task, not the run. That takes about the logarithm of the longest path. The edges of a hub, a node of more
than ``HUB`` edges, don't meet in a task: hubs are few (two for each ``HUB`` edges at most) and are broadcast to their edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.shared import keep


ONE_TASK = 1_000_000
HUB = 200_000


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each): labels sink along edges and are then followed to their ends."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        nodes, comp = union_find(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], names=["node", "comp"])


def _are_stars(edges: DataFrame) -> bool:
    """Every upper end has one lower end, which is no upper end itself."""
    upper = edges.groupBy("u").agg(F.count("*").alias("n"))
    return upper.where(F.col("n") > 1).isEmpty() and edges.select("v").distinct().join(upper.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the ``m`` of their ``u``; ``least``: ``u``, ``m`` and its number of edges ``n``. Edges of hubs are joined where they are."""
    hubs = F.broadcast(least.where(F.col("n") > HUB).select("u", "m"))  # two for each HUB edges at most
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(others)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK, put: Callable[[DataFrame, str], DataFrame] = keep) -> DataFrame:
    """``node``, ``comp`` for every node of an edge: the smallest node of its component. Loops count as nodes; nulls are left out. ``put`` keeps the rounds' tables."""
    given = edges.select(F.col(a).cast("long").alias("p"), F.col(b).cast("long").alias("q")).where(F.col("p").isNotNull() & F.col("q").isNotNull())
    work = put(given.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(), "edges")
    if work.count() <= one_task:
        return work.coalesce(1).mapInArrow(_in_one_task, "node long, comp long")
    loops = work.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"))
    work = work.where(F.col("u") != F.col("v"))
    while not _are_stars(work):
        both = work.select("u", "v").unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = put(_with_least(both, least).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = put(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = _with_least(large, least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        work = put(small, "edges")
    found = work.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = found.select(F.col("comp").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    known = found.unionByName(roots)
    return known.unionByName(loops.join(known, "node", "left_anti").select("node", F.col("node").alias("comp")))
