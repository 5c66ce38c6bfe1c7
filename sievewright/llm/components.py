"""Connected components of an edge table: tasks contract their own links, alternating star rounds join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A node with more than a HUBS-th of all links, of which there are at most 2 * HUBS, has its links dealt out by a salt.
HUBS, SALTS = 256, 64
#: Links that a task contracts at once.
CONTRACTED = 200_000


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each of n nodes is linked with, over pairs that come in parts."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: within a part of CONTRACTED links, each node to the smallest it reaches."""

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("a", "b"))
        nodes = pc.unique(pa.concat_arrays([a, b]))
        nodes = nodes.take(pc.sort_indices(nodes))
        label = forest(len(nodes), iter([tuple(pc.index_in(x, nodes).to_numpy().astype(np.int64) for x in (a, b))]))
        other = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(other)), nodes.take(pa.array(label[other]))], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            held, n = [*held, batch], n + len(batch)
            if n >= CONTRACTED:
                yield one(held)
                held, n = [], 0
        if n:
            yield one(held)

    return links.mapInArrow(common.trimmed(run), links.schema)


def _star(pairs: DataFrame, both: bool, limit: int | None) -> DataFrame:
    if both:  # large star: larger neighbours move to the smallest
        sides = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # small star: smaller neighbours, and the node itself, move
        sides = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    if limit is None:
        joined = sides.join(low.drop("n"), "u")
    else:
        heavy = low.where(F.col("n") > limit).select("u", F.lit(True).alias("hub"))
        salted = sides.join(F.broadcast(heavy), "u", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hub")
        joined = salted.join(low.withColumn("salt", F.explode(F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))), ["u", "salt"]).select("u", "v", "m")
    moved = joined.where(F.col("v") > F.col("u")) if both else joined.where(F.col("v") != F.col("m")).unionByName(low.select("u", F.col("u").alias("v"), "m"))
    return moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b: both string or both long). Nodes
    without edges are absent.

    Each round replaces links by links to the smallest neighbour; the number of rounds grows with the logarithm of the
    longest chain that contraction leaves. Rounds are written to the shared folder, so a lost executor repeats one round
    at most.

    Defined results: links of a node to itself and repeated links change nothing; links with a null end are ignored; no
    links give no rows; other columns are ignored.
    """
    current = common.written(_contracted(edges.where(F.col("a") != F.col("b")).select("a", "b")), "edges")
    for _ in range(most_rounds):
        # settled: a node moves to one other at most, and what others move to doesn't move
        ends = current.select(F.col("a").alias("u"), F.lit(1).alias("moves"), F.lit(0).alias("holds")).unionByName(current.select(F.col("b").alias("u"), F.lit(0).alias("moves"), F.lit(1).alias("holds")))
        counts = ends.groupBy("u").agg(F.sum("moves").alias("moves"), F.sum("holds").alias("holds"))
        seen = counts.agg(F.count_if((F.col("moves") > 1) | ((F.col("moves") > 0) & (F.col("holds") > 0))).alias("open"), F.max("holds").alias("most"), F.sum("holds").alias("all")).first()
        if not seen["open"]:
            break
        limit = max(1000, seen["all"] // HUBS)
        limit = limit if seen["most"] > limit else None
        current = common.written(_star(_star(current, True, limit), False, limit), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
