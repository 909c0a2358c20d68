"""Connected components of a graph given by its edges, by local contraction.

Each phase gives every node the neighbour (or itself) that comes first in an
order drawn by hash for that phase, and replaces both ends of every edge by the
nodes so named. In expectation a fixed share of the nodes goes in every phase, whatever
the shape of the graph, so the phases grow with the logarithm of the nodes and
need no bound. Before each phase the edges are thinned where they lie: a block of
edges leaves the edges of its own components' stars; once all edges are one block,
that is the answer. Nothing is collected but counts, and the loop ends when no edge
is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import cut, cut_sized, release
from proofline.llm.shingles import mix

#: Edges that a worker thins at a time.
BLOCK = 1 << 20
#: Rows of a partition between steps, and of a table of names up to which it is broadcast (16 bytes a row).
ROWS_PER_PART = 1 << 17
MOST_NAMES = 1 << 18


def _rank(ids: np.ndarray, phase: int) -> np.ndarray:
    """The order of a phase; the same in all blocks."""
    return mix(ids.view(np.uint64) ^ mix(np.array([phase + 1], np.uint64))).view(np.int64)


def thinned(a: np.ndarray, b: np.ndarray, phase: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, centre) of the stars of the components of these edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.argsort(_rank(nodes, phase), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    u, v = place[at[: len(a)]], place[at[len(a) :]]
    label = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        apart = low < high
        u, v, low, high = u[apart], v[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[order[own]], nodes[order[label[own]]]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, to) for all nodes of the edges, which are one block, with a centre for each component."""
    held = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for batch in batches]
    if held:
        a, b = thinned(*(np.concatenate([h[k] for h in held]) for k in range(2)), 0)
        centres = np.unique(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, centres))), pa.array(np.concatenate((b, centres)))], names=["id", "to"])


def _thin(phase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def emit():
            a, b = thinned(*(np.concatenate([h[k] for h in held]) for k in range(2)), phase)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, _rank(a, phase), _rank(b, phase))], names=["a", "b", "ha", "hb"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
            rows += batch.num_rows
            if rows >= BLOCK:
                yield emit()
                held, rows = [], 0
        if held:
            yield emit()

    return run


def connected_components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, component) of the nodes of edges (a, b); component is the least id.

    ``labels`` (id, component): components found before from other edges. They
    are joined by ``edges``, and the result has their nodes too.

    Defined results: an edge from a node to itself, and one with a null end, say
    nothing, and a node that has no other is not in the result; repeated edges
    count once; no edges give an empty result, or ``labels``.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    if labels is not None:
        edges = _renamed(edges, bounded(labels.select("id", F.col("component").alias("to"))))
    edges, left = cut_sized(edges, ROWS_PER_PART)
    steps: list[DataFrame] = []
    while left > BLOCK:
        phase = len(steps)
        thin = cut(edges.mapInArrow(_thin(phase), "a long, b long, ha long, hb long"))
        both = thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("hb").alias("ha"), F.col("ha").alias("hb")))
        first = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min(F.struct("ha", "a")), F.min(F.struct(F.col("hb").alias("ha"), F.col("b").alias("a")))).alias("n"))
        steps.append(cut(first.select("id", F.col("n.a").alias("to"))))
        edges, left = cut_sized(_renamed(thin.select("a", "b"), steps[-1]), ROWS_PER_PART)
    if not left and not steps:
        return labels if labels is not None else spark.createDataFrame([], "id long, component long")
    found = edges.coalesce(1).mapInArrow(_solve, "id long, to long")  # at most BLOCK edges
    while steps:
        after = found.select(F.col("id").alias("to"), F.col("to").alias("_to"))
        found = steps.pop().join(after, "to", "left").select("id", F.coalesce("_to", "to").alias("to"))
    if labels is not None:
        found, many = cut_sized(found, ROWS_PER_PART)
        fresh = found.join(bounded(labels.select("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
        after = found.select(F.col("id").alias("component"), "to")
        after = F.broadcast(after) if many <= MOST_NAMES else after
        found = labels.select("id", "component").unionByName(fresh).join(after, "component", "left").select("id", F.coalesce("to", "component").alias("to"))
    found, many = cut_sized(found, ROWS_PER_PART)
    names = found.groupBy("to").agg(F.min("id").alias("component"))
    out, _ = cut_sized(found.join(F.broadcast(names) if many <= MOST_NAMES else names, "to").select("id", "component"), ROWS_PER_PART)
    release(spark)
    return out


def bounded(names: DataFrame) -> DataFrame:
    """``names``, marked for broadcast if its rows are few."""
    return F.broadcast(names) if names.count() <= MOST_NAMES else names


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Both ends by their names (id, to), where they have one; each edge once."""
    for end, other in (("a", "b"), ("b", "a")):
        named = edges.join(names.withColumnRenamed("id", end), end, "left")
        edges = named.select(F.coalesce("to", end).alias(end), other)
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
