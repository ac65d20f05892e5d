"""Operator 4, exact top-k search by tiled matrix products.

Queries go out in blocks of a bounded size, one block a pass, and every shard of vectors multiplies itself with
the block tile by tile; each tile keeps every query's best k by partial selection, a task merges its tiles, and
the tasks' lists are merged in a tree of groups of `fan` lists.  Scores are integer inner products: they are taken in
float64 where all sums are below 2**53, and in integers of any size else; a score beyond a long's range is the nearest long, and such
scores tie.

Vectors that are null, or hold null or non-finite components (also those above some 1e305, which are not once scaled), or whose ids
are null, take no part; vectors of
other lengths than the query's give no score to it.  Rows with the query's id are the query's own.  Ties go to
the smaller id; rows repeated under one id are candidates of their own, and as a query the smallest of their vectors counts.  Empty tables give empty results; other columns
are not read.  Vectors of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import record, staged

K, TILE, FAN = 10, 2048, 32
#: Bytes of query components in one pass, as they reach the driver and every task.
BLOCK_BYTES = 16 << 20
_EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    # of so large a component the scaled one is no longer finite
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * float(scale) == float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", bad))


def quantised(rows: list, scale: int) -> np.ndarray:
    return np.floor(np.array(rows, np.float64) * scale)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exact at any size; one that a long cannot hold is the nearest long."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([[min(max(int(x), low), high) for x in r] for r in exact], np.int64).reshape(len(a), len(b))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score down, id up)."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], ~score[at]))[:k]]


def _search(batches: Iterator[pa.RecordBatch], block: tuple[list[int], list], k: int, scale: int, task_of) -> Iterator[pa.RecordBatch]:
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(v) for v in block[1]}:
        at = [i for i, v in enumerate(block[1]) if len(v) == size]
        by_size[size] = np.array([block[0][i] for i in at], np.int64), quantised([block[1][i] for i in at], scale).reshape(len(at), size)
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {s: [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q[0]) for s, q in by_size.items()}
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            part = batch.slice(start, TILE)
            column, ids = part.column("v"), part.column("vec_id").to_numpy()
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
            flat = column.flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            for size in np.unique(sizes).tolist():
                if size not in by_size:
                    continue
                at = np.flatnonzero(sizes == size)
                shard = quantised(flat[begin[at][:, None] + np.arange(size)], scale)
                names, queries = by_size[size]
                for low in range(0, len(names), 256):
                    product = scores(queries[low : low + 256], shard)
                    for q in range(len(product)):
                        score, own = product[q], ids[at]
                        if (same := own == names[low + q]).any():
                            score, own = score[~same], own[~same]
                        take = best(score, own, k)
                        old_score, old_ids = held[size][low + q]
                        s, i = np.concatenate((old_score, score[take])), np.concatenate((old_ids, own[take]))
                        take = best(s, i, k)
                        held[size][low + q] = s[take], i[take]
    task = task_of()
    for size, (names, _) in by_size.items():
        query = np.repeat(names, [len(x[0]) for x in held[size]])
        if len(query):
            yield record(query_id=pa.array(query), vec_id=pa.array(np.concatenate([x[1] for x in held[size]])), score=pa.array(np.concatenate([x[0] for x in held[size]])), task=pa.array(np.full(len(query), task), pa.int32()))


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where the condition `is_query` on column vec_id holds, against all rows."""
    rows = usable(vectors, id_col, vector_col, scale)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = queries.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    # hashing deals ids unevenly: blocks are aimed at half the bound
    blocks = max(1, -(-2 * int(size.b) // block_bytes))
    spark, found = vectors.sparkSession, None
    partitions = max(1, rows.rdd.getNumPartitions())
    for n in range(blocks):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()  # one block, within block_bytes
        sent = spark.sparkContext.broadcast(([r.vec_id for r in got], [list(r.v) for r in got]))
        one = rows.mapInArrow(lambda batches, sent=sent: _search(batches, sent.value, k, scale, _task), "query_id long, vec_id long, score long, task int")
        one = staged(one, "top") if blocks > 1 else one
        found = one if found is None else found.unionByName(one)
    width = partitions
    while width > FAN:  # the tree: lists of FAN tasks at a time
        found = _ranked(found.withColumn("task", (F.col("task") / FAN).cast("int")), ["query_id", "task"], k).drop("rank")
        width = -(-width // FAN)
    return _ranked(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _ranked(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
