"""Connected components of a graph of links, without a driver-side step.

Links are first contracted inside each partition with a union-find over numpy
arrays; the forest that is left is made into stars by alternating large-star
and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond").  Each step's links are a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch, map_batches

#: Links that a partition's union-find holds before it emits its forest.
FOREST_LINKS = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of links a-b that aren't smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _contract(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush():
        u, v = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= FOREST_LINKS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with a link to another one.

    links: two long columns, in any order and with repeats.  Self-links and
    links with a null count as none.  component: the smallest node reachable.
    No links: no rows.
    """
    a, b = links.columns
    found = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = scratch.save(map_batches(found, _contract, "u long, v long"), "forest")
    while True:
        large = _large_star(edges)
        small = _small_star(large)
        new = scratch.save(small, "stars")
        # stars: each non-root has one link, to its root, and no root has a link
        onward = new.join(new.select(F.col("u").alias("w")).hint("merge"), new["v"] == F.col("w"), "left_semi").select("u")
        if not onward.unionByName(new.groupBy("u").count().where("count > 1").select("u")).take(1):
            scratch.drop(edges)
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        scratch.drop(edges)
        edges = new


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    larger = both.where("v > u")
    # merged, so that the skew join splits the links of a large star
    return larger.join(low.hint("merge"), larger["u"] == low["k"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; links here point from larger to smaller."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    joined = edges.join(low.hint("merge"), edges["u"] == low["k"])
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
