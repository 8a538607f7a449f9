"""Connected components of a link table, distributed, by minimum labels and pointer jumping.

Only vertices that have a link appear. Links are first thinned inside tasks: those that are dealt to
one task leave one spanning forest, first by ``by`` and then by vertex, so that what is left of a large
component are mostly stars around few least vertices. Every round reads and writes tables in the shared folder, so
both sides of each join are plain scans that adaptive execution can split where a vertex is hot;
the driver sees one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.scratch import discard, materialise

#: Links that a task holds at once.
HELD = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex that is not the least it reaches, and that least one."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(node)))
    return node[root[other]], node[other]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) >= HELD:
            yield out()
    if held:
        yield out()


def components(links: DataFrame, by: str = "v") -> DataFrame:
    """``node`` and ``component`` (the least node it reaches) for each node of links ``u``, ``v``.

    ``by``: what links are dealt to tasks by, best one value for links that are likely connected.
    """
    pairs = links.where("u <> v").select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), F.col(by).alias("by"))
    thin = pairs.repartition("by").select("u", "v").mapInArrow(_thinned, "u long, v long")
    thin = materialise(thin.repartition("v").mapInArrow(_thinned, "u long, v long"), "links", 1 << 16)
    both = thin.union(thin.select("v", "u"))
    start = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    labels = materialise(start.select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        best = near.union(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        hop = materialise(best, "hop")
        to = hop.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = materialise(hop.join(to, F.col("label") == F.col("at")).select("node", F.col("next").alias("label"), "was"), "labels")
        discard(labels, hop)
        labels = moved
        if moved.where("label <> was").isEmpty():
            discard(thin)
            return labels.select("node", F.col("label").alias("component"))
