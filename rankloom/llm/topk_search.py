"""Exact top-k search by inner product: tiles of queries and vectors, lists merged as a tree.

Queries come in blocks of bounded size, and a block is sent to all tasks. A task
multiplies it with one tile of its vectors at a time, selects the best k of each query
in the tile, and merges them into the task's own lists. Those are merged in two rounds,
first over some of the tasks, then over all. No pair of rows leaves a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.shared import staged

SCALE = 256
QUERY_BLOCK = 4_096
TILE_QUERIES = 1_024
TILE_VECTORS = 2_048
#: Products and sums below this are exact in a double.
_EXACT = float(1 << 53)
_LONGEST = (1 << 63) - 1


def _matrices(column: pa.Array, ids: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of a list column by length: ids and scaled integer components, as doubles."""
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten().cast(pa.float64())
    values = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))  # nulls become NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        matrix = values[starts[rows][:, None] + np.arange(n)]
        good = np.isfinite(matrix).all(1)
        if good.any():
            yield ids[rows[good]], matrix[good]


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray | None:
    """Inner products as doubles, or None where they might not be exact."""
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1] >= _EXACT / (2 * TILE_VECTORS):
        return None
    return queries @ vectors.T


def tile_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's best k in a tile, its own vec_id left out; ties to the smaller vec_id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    scores = _products(queries, vectors)
    if scores is None:  # components so large that only whole numbers of any size are safe
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(q, v)) for v in vectors] for q in queries], object)
        rows, picked, best = [], [], []
        for i, line in enumerate(exact):
            some = sorted((-s, j) for j, s in enumerate(line) if ids[j] != query_ids[i])[:k]
            rows += [i] * len(some)
            picked += [j for _, j in some]
            best += [max(-_LONGEST, min(_LONGEST, -s)) for s, _ in some]
        return np.array(rows, np.int64), ids[np.array(picked, np.int64)] if picked else ids[:0], np.array(best, np.int64)
    # One number that sorts by score, then by the smaller id; still exact.
    ranked = scores * len(ids) + np.arange(len(ids) - 1, -1, -1)
    ranked[ids[None, :] == query_ids[:, None]] = -np.inf
    m = min(k, len(ids))
    at = np.argpartition(ranked, len(ids) - m, axis=1)[:, len(ids) - m :]
    rows = np.repeat(np.arange(len(query_ids)), m)
    at = at.ravel()
    kept = np.isfinite(ranked[rows, at])
    rows, at = rows[kept], at[kept]
    return rows, ids[at], scores[rows, at].astype(np.int64)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row's entries."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    kept = rank < k
    return rows[kept], ids[kept], scores[kept]


def _search(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_blocks = shared.value  # length -> (ids, matrix)
        held = {n: tuple(np.zeros(0, np.int64) for _ in range(3)) for n in query_blocks}
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for own, vectors in _matrices(batch.column("vector"), ids, scale):
                n = vectors.shape[1]
                if n not in query_blocks:
                    continue
                query_ids, queries = query_blocks[n]
                for v in range(0, len(own), TILE_VECTORS):
                    found = [held[n]]
                    for q in range(0, len(query_ids), TILE_QUERIES):
                        some = slice(q, q + TILE_QUERIES)
                        rows, got, scores = tile_best(query_ids[some], queries[some], own[v : v + TILE_VECTORS], vectors[v : v + TILE_VECTORS], k)
                        found.append((rows + q, got, scores))
                    held[n] = _best(*(np.concatenate(x) for x in zip(*found)), k)
        group = TaskContext.get().partitionId()
        for n, (rows, got, scores) in held.items():
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_blocks[n][0][rows]), pa.array(rows + (n << 32)), pa.array(got), pa.array(scores), pa.array(np.full(len(rows), group, np.int32))],
                    ["query_id", "query_row", "vec_id", "score", "task"],
                )

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's best k of all other vectors by the inner
    product of floor(scale * component); fewer if there are fewer. Ties go to the smaller vec_id.

    Vectors that are null or empty, or hold null or non-finite components, and rows without
    an id take no part; only vectors of the query's length are compared. Rows with a
    query's own id are left out; rows of one query id with the same vector are one query.
    Scores beyond a long are cut to its range.
    """
    spark = vectors.sparkSession
    own = lambda df: df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    shards, results = own(vectors), []
    asked, done = own(queries).distinct().toLocalIterator(), False
    while not done:
        ids, rows = [], []
        for r in asked:
            ids.append(r["id"])
            rows.append(r["vector"])
            if len(ids) == block:
                break
        done = len(ids) < block
        if not ids and results:
            break
        column = pa.array(rows, pa.list_(pa.float64()))
        blocks = {m.shape[1]: (i, m) for i, m in _matrices(column, np.array(ids, np.int64), scale)}
        found = shards.mapInArrow(
            _search(spark.sparkContext.broadcast(blocks), k, scale), "query_id long, query_row long, vec_id long, score long, task int"
        )
        best_first = [F.desc("score"), F.asc("vec_id")]
        rank = F.row_number().over(W.partitionBy("query_id", "query_row", "part").orderBy(*best_first))
        some = found.withColumn("part", F.col("task") % 16).withColumn("rank", rank).where(F.col("rank") <= k)
        rank = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(*best_first))
        merged = some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(merged if done and not results else staged(merged, "top-k-block"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
