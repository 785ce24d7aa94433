"""Connected components of an edge table by alternating stars, with union-find in tasks of bounded size.

Every task first reduces the edges it reads to stars. Rounds of a large and a small star over the
whole table follow until nothing changes, or until the edges left fit one task of ``EDGES``
rows, which settles them at once. Both ends give the same components.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import remove, write


EDGES = 1 << 18  # most edges of one task's union-find


def union_find(a, b) -> dict:
    """node -> smallest node reachable over the edges (a[i], b[i])."""
    up: dict = {}

    def top(x):
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(up)}


def _forest(edges: DataFrame) -> DataFrame:
    """Edges of each task reduced to stars around their smallest node (chunked: bounded memory)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = union_find(*(np.asarray(batch.column(c)).tolist() for c in (0, 1)))
            star = [(x, r) for x, r in root.items() if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([s[c] for s in star], pa.int64()) for c in (0, 1)], names=["u", "v"])
    return edges.select("u", "v").mapInArrow(work, "u long, v long")


def _settle(edges: DataFrame) -> DataFrame:
    """Stars of all edges, from one task; at most ``EDGES`` rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += np.asarray(batch.column(0)).tolist()
            b += np.asarray(batch.column(1)).tolist()
        star = [(x, r) for x, r in union_find(a, b).items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([s[c] for s in star], pa.int64()) for c in (0, 1)], names=["u", "v"])
    return edges.select("u", "v").coalesce(1).mapInArrow(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u long, v long) reaches.

    Every round replaces edges by stars to smaller neighbours (large star, then small
    star) and writes them to the shared folder; rounds end when nothing changes or when one
    task of bounded size can settle the rest. Minima are pre-aggregated before the shuffle, so a hub is not collected anywhere.
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        # large star: neighbours on both sides, larger ones move; small star: only smaller ones, all move
        n = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = n.join(low, "u")
        if both:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    spark, path, state = edges.sparkSession, None, None
    now = edges.select("u", "v").where("u <> v")
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if new == state:
            break
        settled = new[0] <= EDGES
        # the forest of the first round says nothing about edges of different tasks: stars follow it in any case
        state = None if path is None else new
        step = _settle(now) if settled else _forest(now).distinct() if path is None else star(star(now, True), False)
        last, path = path, write(step, "edges")
        now = spark.read.schema("u long, v long").parquet(path)
        if last:
            remove(spark, last)
        if settled:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
