"""Operator 8: embedding near-duplicates by the epsilon grid order join.

Unit vectors are projected on leading principal axes; a grid with cells of side epsilon
(the distance that cosine ``threshold`` means between unit vectors) is laid over them.
Vectors are sorted by their cells in lexicographic order and cut into sequence blocks.
Blocks meet if some of their leading cells are neighbours and their bounding boxes are
within epsilon; a pair of blocks is joined by halving both sequence intervals, dropping
pairs of intervals whose boxes are provably apart, down to small leaves that are compared
by matrix products: in single precision first, in double precision where that leaves a link possible. Projection never lengthens a distance, so no
link is lost.

Pairs of blocks are found by block numbers alone. Vectors join them afterwards, in the type that the table has: the
sequence is cut into bands of blocks, and a task gets a tile, the blocks of one band that meet blocks of another
and these, each once. Where most blocks meet (many dimensions), pairs grow with the square of the table; tiles are
therefore dealt in rounds that ship about ``SHIP`` times the table each, and a round's files go before the next.

The axes are fitted on at most ``FIT`` vectors (those with the smallest id digests);
a poor fit costs speed only. Exact copies of a vector are joined once and counted by
their number. A tile returns counts of links and a spanning forest, never its
links, so a large group of near copies stays linear in rows; components come from the
forests.

Defined results: null, zero or non-finite vectors link with nothing (n_links 0, their own
component, kept); vectors of different lengths are never linked; a repeated id is one
vector (valid rows first, then the smallest in array order); null ids are left out; an
empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.llm.common import materialize, remove, scratch, small, write
from feedlake.llm.components import components
from feedlake.llm.vectors import by_dimension, matrix, valid_vectors

FIT = 10_000      # vectors that the axes are fitted on
AXES = 8          # principal axes of the grid
KEYED = 3         # leading cells by which blocks find each other
BLOCK = 1024      # vectors of one sequence block
PARTNERS = 64     # most blocks of a band
BANDS = 8         # bands of a small table, at least, so that there are tasks enough
SIDE = 16 << 20   # about the most bytes of vectors of a band
SHIP = 4          # tables of vectors that a round of tiles ships
ROUND = 256 << 20 # bytes that a round may ship in any case
LEAF = 256        # vectors of one interval that is compared directly


_PACKED = pa.schema([("block", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()),
                     ("cells", pa.list_(pa.list_(pa.int32()))), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def fit_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from a bounded sample."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).toPandas()["embedding"]
    axes = {}
    for dim in {len(r) for r in rows}:
        x = np.array([r for r in rows if len(r) == dim], dtype=np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        x = x - x.mean(0)
        axes[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES]
    return axes


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def sequence_blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Blocks in grid order: (block, dim, ids, copies, vectors, cells, low, high), written to the shared folder."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)
    kind = classes.schema["embedding"].dataType.simpleString()
    real = np.float32 if kind == "array<float>" else np.float64

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dimension(batch):
                if dim not in shared.value:  # a length that the sample lacks: unit axes
                    shared.value[dim] = np.eye(dim)[:, :AXES]
                at = np.floor(_unit(matrix(part.column(1), dim)) @ shared.value[dim] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.full(len(at), dim)), pa.array(list(at), pa.list_(pa.int32()))],
                    names=["id", "embedding", "copies", "dim", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held = TaskContext.get().partitionId() << 32, []

        def block(rows):
            nonlocal number
            dim = rows[0][3]
            x = np.array([r[1] for r in rows], dtype=real)
            p = _unit(x.astype(np.float64)) @ shared.value.get(dim, np.eye(dim)[:, :AXES])
            number += 1
            cells = sorted({tuple(r[4][:KEYED]) for r in rows})
            ids, copies = (np.array([r[c] for r in rows], np.int64).tobytes() for c in (0, 2))
            return pa.RecordBatch.from_pylist([{
                "block": number, "dim": dim, "ids": ids, "copies": copies, "vectors": x.tobytes(),
                "cells": cells, "low": p.min(0).tolist(), "high": p.max(0).tolist()}], schema=_PACKED)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == BLOCK or held[-1][3] != row[3]):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    located = classes.mapInArrow(locate, f"id long, embedding {kind}, copies long, dim long, cell array<int>")
    ordered = located.repartitionByRange("dim", "cell", "id").sortWithinPartitions("dim", "cell", "id")
    return materialize(ordered.mapInArrow(
        pack, "block long, dim long, ids binary, copies binary, vectors binary, cells array<array<int>>, low array<double>, high array<double>"), "grid")


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a <= b: blocks with neighbouring leading cells whose boxes are within epsilon."""
    box = blocks.select("block", "dim", "cells", "low", "high").withColumn("cell", F.explode("cells")).drop("cells")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=KEYED)])
    near = F.transform(steps, lambda s: F.zip_with("cell", s, lambda x, y: x + F.coalesce(y, F.lit(0))))
    # vectors shorter than KEYED have shorter cells: cut the neighbours to their length
    near = F.array_distinct(F.transform(near, lambda c: F.slice(c, F.lit(1), F.size("cell"))))
    right = box.select(F.col("block").alias("b"), F.col("dim").alias("dim_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("cell").alias("cell_b"))
    apart = F.aggregate(
        F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_b", "high_b"),
                   lambda x, y: F.greatest(x["low"] - y["high_b"], y["low_b"] - x["high"], F.lit(0.0))),
        F.lit(0.0), lambda s, g: s + g * g)
    return (box.withColumn("cell", F.explode(near)).withColumnRenamed("block", "a")
            .join(right, (F.col("cell") == F.col("cell_b")) & (F.col("dim") == F.col("dim_b")) & (F.col("a") <= F.col("b")))
            .where(apart <= (eps + 1e-9) ** 2).select("a", "b").distinct())


def join_blocks(ua: np.ndarray, ub: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float, eps: float, same: bool):
    """Boolean link matrix of two sequence intervals, by recursive halving."""
    links = np.zeros((len(ua), len(ub)), dtype=bool)
    ua_, ub_ = ua.astype(np.float32), ub.astype(np.float32)
    least = threshold - (ua.shape[1] + 8) * 2.0 ** -23  # twice the most that rounding can take from a product of unit vectors
    stack = [(0, len(ua), 0, len(ub))]
    while stack:
        i, j, k, n = stack.pop()
        if same and n <= i:
            continue  # below the diagonal: its mirror is joined
        x, y = pa_[i:j], pb[k:n]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if (gap * gap).sum() > (eps + 1e-9) ** 2:
            continue
        if j - i > LEAF and j - i >= n - k:
            mid = (i + j) // 2
            stack += [(i, mid, k, n), (mid, j, k, n)]
        elif n - k > LEAF:
            mid = (k + n) // 2
            stack += [(i, j, k, mid), (i, j, mid, n)]
        else:
            if (ua_[i:j] @ ub_[k:n].T).max() < least:
                continue
            cosine = ua[i:j] @ ub[k:n].T
            edge = np.argwhere(np.abs(cosine - threshold) < 1e-12)
            for r, c in edge:  # decide the last bits by one plain sum
                cosine[r, c] = float((ua[i + r] * ub[k + c]).sum())
            links[i:j, k:n] = cosine >= threshold
    if same:
        links |= links.T
        np.fill_diagonal(links, False)
    return links


def _labels(links: np.ndarray, ida: np.ndarray, idb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of the labels ``ida`` and ``idb`` reachable inside the pair of blocks."""
    a, b = ida.copy(), idb.copy()
    big = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(links, b[None, :], big).min(1, initial=big))
        b2 = np.minimum(b, np.where(links, a2[:, None], big).min(0, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def tiles(blocks: DataFrame, met: DataFrame) -> list[DataFrame]:
    """Rounds of (tile, side, block, partners): side 0 are the blocks of a tile's first band, side 1 those that meet ``partners`` of it.

    Blocks are banded by their place in the sequence. Tiles of a round are numbered from 0.
    """
    spark = blocks.sparkSession
    parts = (blocks.groupBy(F.shiftright("block", 32).alias("part")).agg(F.count("*").alias("blocks"), F.sum(F.octet_length("vectors")).alias("bytes"))
             .orderBy("part").collect())  # one row per task that wrote blocks
    total, ship = sum(r["blocks"] for r in parts), sum(r["bytes"] for r in parts)
    if not total:
        return []
    wide = max(1, min(PARTNERS, SIDE * total // max(ship, 1), -(-total // BANDS)))
    before = np.cumsum([0] + [r["blocks"] for r in parts]).tolist()
    offset = F.broadcast(spark.createDataFrame([(r["part"], n) for r, n in zip(parts, before, strict=False)], "part long, before long"))
    for c in "ab":
        told = offset.select(F.col("part").alias(f"part_{c}"), F.col("before").alias(f"before_{c}"))
        met = met.join(told, F.shiftright(c, 32) == F.col(f"part_{c}")).withColumn(
            f"band_{c}", F.floor((F.col(f"before_{c}") + F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) - 1) / wide).cast("long"))
    met = met.select("a", "b", "band_a", "band_b")
    bands, rounds, room = -(-total // wide), [], 0
    for band in range(bands):  # a band ships itself and another with each tile
        cost = 2 * (bands - band) * wide * ship // total
        if not rounds or cost > room:
            rounds.append([])
            room = max(SHIP * ship, ROUND)
        rounds[-1].append(band)
        room -= cost

    def of(first: int, last: int) -> DataFrame:
        now = met.where(F.col("band_a").between(first, last)).withColumn("tile", (F.col("band_a") - first) * bands + F.col("band_b"))
        own = now.select("tile", F.lit(0).alias("side"), F.col("a").alias("block"), F.array().cast("array<long>").alias("partners")).distinct()
        other = now.groupBy("tile", F.lit(1).alias("side"), F.col("b").alias("block")).agg(F.collect_set("a").alias("partners"))
        return own.unionByName(other)
    return [of(r[0], r[-1]) for r in rounds]


def near_duplicates(df: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per id. Written before it returns; the tables between are removed."""
    with scratch(df.sparkSession) as result:
        found = materialize(_near_duplicates(df, threshold, key, vector), "near")
        result.append(found)
    return found


def _near_duplicates(df: DataFrame, threshold: float, key: str, vector: str) -> DataFrame:
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    spark, path = df.sparkSession, write(valid_vectors(df, key, vector), "vectors")
    vectors = spark.read.parquet(path)
    grouped = vectors.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    member = materialize(vectors.join(grouped, "embedding").select("vec_id", "id", "copies"), "member")
    kind = "array<float>" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "array<double>"
    real = np.float32 if kind == "array<float>" else np.float64
    classes_path = write(member.where("vec_id = id").join(vectors, "vec_id").select("id", F.col("embedding").cast(kind).alias("embedding"), "copies"), "classes")
    axes = fit_axes(vectors)
    remove(spark, path)
    blocks = sequence_blocks(spark.read.parquet(classes_path), axes, eps)
    remove(spark, classes_path)
    shared = spark.sparkContext.broadcast(axes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, labels, counts = None, {}, {}, {}

        def rows(ids, n, label):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(label, pa.int64())], names=["id", "n", "label"])

        def linked(ids, n):
            return rows(ids[n > 0], n[n > 0], ids[n > 0])

        for batch in batches:
            for row in range(batch.num_rows):
                now, side, block, partners, dim, ids, copies, x = (batch.column(c)[row].as_py() for c in range(8))
                if now != tile:  # a tile's first band comes before the blocks that it meets
                    yield from (linked(held[a][0], n) for a, n in counts.items())
                    tile, held, labels, counts = now, {}, {}, {}
                ids, copies = (np.frombuffer(v, np.int64) for v in (ids, copies))
                x, axis = np.frombuffer(x, real).reshape(-1, dim), shared.value.get(dim, np.eye(dim)[:, :AXES])
                if side == 0:
                    held[block] = ids, copies, x
                    continue
                unit = _unit(x.astype(np.float64))
                place, here = unit @ axis, np.zeros(len(ids), np.int64)
                for a in sorted(partners):
                    ids_a, copies_a, xa = held[a]
                    ua = unit if a == block else _unit(xa.astype(np.float64))
                    links = join_blocks(ua, unit, ua @ axis, place, threshold, eps, a == block)
                    if not links.any():
                        continue
                    old = labels.get(a, ids_a), labels.get(block, ids)
                    new = _labels(links, *old)
                    labels[a], labels[block] = new
                    moved = np.concatenate([np.stack([o, w])[:, o != w] for o, w in zip(old, new, strict=True)], axis=1)
                    if moved.shape[1]:  # what had the old label has the new one now
                        u, v = np.unique(moved, axis=1)
                        yield rows(u, np.zeros(len(u), np.int64), v)
                    counts[a] = counts.get(a, 0) + links @ copies
                    if a != block:
                        here += links.T @ copies_a
                yield linked(ids, here)
        yield from (linked(held[a][0], n) for a, n in counts.items())

    met, shape = materialize(block_pairs(blocks, eps), "pairs"), "id long, n long, label long"
    payload, found = blocks.select("block", "dim", "ids", "copies", "vectors"), spark.createDataFrame([], shape)
    for turn in tiles(blocks, met):
        turn = materialize(turn, "tiles")
        dealt = (payload.join(small(turn, 1 << 16), "block").select("tile", "side", "block", "partners", "dim", "ids", "copies", "vectors")
                 .repartitionById(1 + (turn.agg(F.max("tile")).first()[0] or 0), F.col("tile").cast("int")).sortWithinPartitions("tile", "side", "block"))
        found = found.unionByName(materialize(dealt.mapInArrow(work, shape), "links"))

    count = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("id").alias("u"), F.col("label").alias("v")))
    every = df.select(F.col(key).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    return (every.join(member, "vec_id", "left").join(count, "id", "left")
            .join(group.withColumnRenamed("node", "id"), "id", "left")
            .select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
                    F.coalesce("component", "id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
