"""Operator 2: approximate nearest neighbours by randomly rotated one-bit codes.

Index: a vector x is rotated by a fixed random orthogonal matrix; its code is the sign
of every rotated component (one bit each). With o = x/|x| and the code's unit vector c,
the scalars |x| and f = <c, o> are kept. For a query q, <c, q>/f estimates <o, q> without
bias, and its error exceeds ``eps * |q| * sqrt((1 - f^2) / (f^2 (D - 1)))`` rarely. A search
scans the packed codes of a block, takes the k-th best lower bound as threshold, and
computes exact inner products only for the vectors whose upper bound reaches it.

Every row is coded; nothing is fitted on data (the rotation depends on the dimension and
a seed). The stated query set meets all rows in blocks: a query block and a code block
are one task's work, with the k best per query and block going on to the final ranking.

Defined results: rows with null ids, null, zero or non-finite vectors take no part;
vectors of different lengths are never compared; a repeated id counts once (smallest
vector in array order); equal scores rank by smaller id; fewer candidates than k give
fewer rows; an empty table or query set gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import materialize
from feedlake.llm.vectors import by_dimension, matrix, valid_vectors

BLOCK_BYTES = 8 << 20   # double vectors of one code block
QUERY_BLOCK = 1024      # queries in one query block


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode_block(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norms, correction f) of float64 rows."""
    norm = np.sqrt((x * x).sum(1))
    turned = (x / norm[:, None]) @ rotation(x.shape[1], seed)
    return np.packbits(turned >= 0, axis=1), norm, np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def build_index(vectors: DataFrame, seed: int = 7) -> DataFrame:
    """Code blocks (dim, n, ids, vectors, codes, norms, f) over every valid vector, written to the shared folder."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
            codes, norm, f = encode_block(x, seed)
            return pd.DataFrame({"dim": [dim], "n": [len(ids)], "ids": [ids.tobytes()], "vectors": [x.tobytes()],
                                 "codes": [codes.tobytes()], "norms": [norm.tobytes()], "f": [f.tobytes()]})

        for frame in batches:
            for dim, part in by_dimension(frame):
                ids, x = np.asarray(part.column(0), dtype=np.int64), matrix(part.column(1), dim)
                step = max(1, BLOCK_BYTES // (8 * dim))
                for at in range(0, len(ids), step):
                    held.setdefault(dim, []).append((ids[at : at + step], x[at : at + step]))
                    if sum(len(i) for i, _ in held[dim]) >= step:
                        yield _table(block(dim))
        for dim in list(held):
            yield _table(block(dim))

    def _table(p: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(p, preserve_index=False)

    schema = "dim long, n long, ids binary, vectors binary, codes binary, norms binary, f binary"
    return materialize(vectors.mapInArrow(work, schema), "codes")


def search_block(ids, x, codes, norm, f, qids, q, k: int, eps: float, seed: int, step: int = 4096):
    """k nearest rows of one code block for every query: (query id, id, exact score) arrays."""
    dim = x.shape[1]
    turned = (q @ rotation(dim, seed)).astype(np.float32)
    qnorm = np.sqrt((q * q).sum(1))
    best = np.full(len(q), -np.inf)          # k-th best exact score so far
    found: list[list] = [[] for _ in qids]
    width = eps * norm * np.sqrt(np.maximum(1 - f * f, 0) / (f * f * max(dim - 1, 1)))
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        signs = np.unpackbits(codes[part], axis=1, count=dim).astype(np.float32) * 2 - 1
        estimate = (signs @ turned.T) * (norm[part] / (f[part] * np.sqrt(dim)))[:, None].astype(np.float32)
        slack = (width[part][:, None] * qnorm[None, :]).astype(np.float32)
        own = ids[part][:, None] == qids[None, :]
        lower = np.where(own, -np.inf, estimate - slack)
        floor = np.partition(lower, len(lower) - k, axis=0)[len(lower) - k] if len(lower) > k else np.full(len(q), -np.inf)
        reach = (estimate + slack >= np.maximum(floor, best)[None, :].astype(np.float32)) & ~own
        for j in range(len(qids)):
            near = np.flatnonzero(reach[:, j]) + at
            if len(near):
                score = (x[near] * q[j]).sum(1)
                if len(near) > k:  # ties at the edge go by id
                    top = np.lexsort((ids[near], -score))[:k]
                    near, score = near[top], score[top]
                found[j].append((near, score))
                if len(found[j]) > 1:
                    near, score = (np.concatenate(p) for p in zip(*found[j], strict=True))
                    top = np.lexsort((ids[near], -score))[:k]
                    found[j] = [(near[top], score[top])]
                if len(found[j][0][1]) >= k:
                    best[j] = found[j][0][1].min()
    rows = [(np.full(len(n), qids[j]), ids[n], s) for j, parts in enumerate(found) for n, s in parts]
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, eps: float = 1.9, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` nearest by inner product for every row of ``queries``."""
    spark = vectors.sparkSession
    index = build_index(vectors, seed)
    wanted = materialize(queries, "queries")
    blocks = -(-wanted.count() // QUERY_BLOCK) or 1
    query_blocks = (wanted.withColumn("q_dim", F.size("embedding").cast("long"))
                    .groupBy((F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).alias("q_block"), "q_dim")
                    .agg(F.collect_list(F.struct("vec_id", "embedding")).alias("qs")))  # about QUERY_BLOCK hashed ids
    pairs = (index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ids", "block")
             .join(query_blocks, (F.col("block") == F.col("q_block")) & (F.col("dim") == F.col("q_dim")))
             .select("dim", "ids", "vectors", "codes", "norms", "f", "qs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, x, codes, norm, f = (batch.column(c)[i].as_py() for c in range(6))
                qs = batch.column(6)[i].values
                ids = np.frombuffer(ids, np.int64)
                out = search_block(
                    ids, np.frombuffer(x, np.float64).reshape(len(ids), dim), np.frombuffer(codes, np.uint8).reshape(len(ids), -1),
                    np.frombuffer(norm), np.frombuffer(f), np.asarray(qs.field(0), dtype=np.int64), matrix(qs.field(1), dim), k, eps, seed)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInArrow(work, "query_id long, vec_id long, score double")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search_every(df: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The stated query set (ids divisible by ``every``) against all rows."""
    vectors = materialize(valid_vectors(df, key, vector), "vectors")
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
