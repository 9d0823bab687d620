"""Spanning forests of what a task holds: components in numbers, with little left to shuffle."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.closure import staged

#: The functions travel with their code: the executors' Python workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges that are taken into a task's forest at a time.
CHUNK = 2_000_000
#: Nodes at which a task lets go of its forest and begins another.
MOST = 8_000_000
#: Edges for each part of the second pass: a part holds its nodes' rows.
PART = 2_000_000


def rooted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges in their order, and the least node of each one's component."""
    at, nodes = pd.factorize(np.concatenate([u, v]))
    order = np.argsort(nodes)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    nodes, at = nodes[order], place[at]
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))  # both ends are roots here
        while True:
            jump = up[up]
            if (jump == up).all():
                break
            up = jump
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[up]


def _grown(batches, most):
    """The forest of the batches' edges (u, v), as nodes and their roots: given out whenever it has over `most` nodes, and at the end."""
    none = np.zeros(0, dtype=np.int64)
    nodes, roots, held, n = none, none, [], 0
    for b in batches:
        held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
        n += b.num_rows
        if n >= CHUNK:
            nodes, roots = rooted(np.concatenate([nodes, *[h[0] for h in held]]), np.concatenate([roots, *[h[1] for h in held]]))
            held, n = [], 0
            if len(nodes) > most:
                yield nodes, roots
                nodes = roots = none
    yield rooted(np.concatenate([nodes, *[h[0] for h in held]]), np.concatenate([roots, *[h[1] for h in held]]))


def _stars(batches):
    import pyarrow as pa

    for nodes, roots in _grown(batches, MOST):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])


def _joined(batches):
    """Of a part that holds all rows (u, v) of its u: a row for each u with its root, and one for each other v with the root it shares."""
    import pyarrow as pa

    seen = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def noted(bs):
        for b in bs:
            for s, c in zip(seen, ("u", "v")):
                s.append(np.unique(b.column(c).to_numpy(zero_copy_only=False)))
                if len(s) > 64:
                    s[:] = [np.unique(np.concatenate(s))]
            yield b

    for nodes, roots in _grown(noted(batches), np.inf):
        for s, link in zip(seen, (False, True)):
            mine = np.unique(np.concatenate(s))
            root = roots[np.searchsorted(nodes, mine)]
            keep = mine != root if link else np.ones(len(mine), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(mine[keep]), pa.array(root[keep]), pa.array(np.full(int(keep.sum()), link))], ["u", "v", "link"])


def hung(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v: every node of the edges u, v (whole numbers) and a node it is joined with; and edges u, v between such v, which join what is
    still apart: two nodes are in one component if and only if their v are, by these edges.

    Each task makes a forest of its edges, so a row for each of its nodes is left; these go to the nodes' parts, where a forest again
    gives each node its one v. Only the edges between such v are left for loops.
    """
    spark = e.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), e.count() // PART)
    rows = e.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(_stars, "u long, v long")
    out = staged(rows.repartition(parts, "u").mapInArrow(_joined, "u long, v long, link boolean"))
    return out.where("not link").select("u", "v"), out.where("link").select("u", "v").distinct()
