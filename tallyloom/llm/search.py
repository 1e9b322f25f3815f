"""Exact top-k search by inner product with a vector-approximation file.

Every component is cut into CELLS quantised cells per block; a scan of the cells alone
bounds each vector's score, and exact vectors are read in the order of those bounds until
the kth result can't change. Queries and vectors meet block by block on a grid: both
sides are dealt into parts by a hash of the id, and each cell of the grid is one task's
group, bounded whatever the input; only the k best of a query in each cell go on.

Defined cases: vectors that are null, or hold null, NaN or infinite components, take no
part; vectors of another number of components never meet; empty vectors meet each other
with score 0; a query's own id is no candidate, repeated rows of it included; repeated rows
of another id are candidates once each; ties go to the smaller vec_id; an empty table gives
none. Very long vectors make longer rows, not more of them. Other columns of the input,
whatever their names, are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Cells a component, results a query, and rows of queries and of vectors that meet in one task on average.
CELLS, K, QUERY_ROWS, VECTOR_ROWS = 16, 5, 4096, 8192
_SAFE = float(1 << 53)


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, null where the vector can't take part."""
    ok = embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class ApproximationFile:
    """Vectors as cell numbers, a byte a component. Cells of a component are equally wide, so
    a query's bounds on a vector are one product with its cell numbers, and two constants."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        self.low = vectors.min(axis=0).astype(float) if len(vectors) else np.zeros(vectors.shape[1])
        self.step = np.maximum(((vectors.max(axis=0) if len(vectors) else self.low) - self.low) / cells, 1e-9)
        self.cells = np.minimum((vectors - self.low) / self.step, cells - 1).astype(np.uint8)
        self.most = float(np.abs(self.low).max(initial=0) + (self.step * cells).max(initial=0))

    def bounds(self, queries: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each vector's cells allow for each query, rounded outwards."""
        queries = queries.astype(float)
        base = np.empty((len(queries), len(self.cells)))
        for at in range(0, len(self.cells), rows):
            base[:, at : at + rows] = (queries * self.step) @ self.cells[at : at + rows].T.astype(float)
        base += (queries @ self.low)[:, None]
        slack = 1 + 1e-9 * np.abs(queries).sum(axis=1) * max(1.0, self.most)
        return base + (np.minimum(queries, 0) @ self.step - slack)[:, None], base + (np.maximum(queries, 0) @ self.step + slack)[:, None]


def top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K, step: int = 64) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best vectors, its own id left out."""
    file, out = ApproximationFile(vectors), []
    exact = float if len(vectors) and float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1] < _SAFE else np.int64
    for at in range(0, len(queries), 64):
        part = queries[at : at + 64]
        least, most = file.bounds(part)
        for i, query in enumerate(part):
            qid = query_ids[at + i]
            others = np.flatnonzero(ids != qid)
            if not len(others):
                continue
            n = min(k, len(others))
            floor = np.partition(least[i, others], len(others) - n)[len(others) - n]
            left = others[most[i, others] >= floor]  # n vectors are sure to reach the floor
            left = left[np.argsort(-most[i, left], kind="stable")]
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for j in range(0, len(left), step):
                if len(best) >= n and most[i, left[j]] < best[n - 1]:
                    break
                rows = left[j : j + step]
                scores = (vectors[rows].astype(exact) @ query.astype(exact)).astype(np.int64)
                best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, scores])
                order = np.lexsort((best_ids, -best))[:n]
                best_ids, best = best_ids[order], best[order]
            out += [(int(qid), int(a), int(b)) for a, b in zip(best_ids, best, strict=True)]
    return out


def _array(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _meet(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        size = key[0].as_py()
        rows = []
        if left.num_rows and right.num_rows:
            rows = top_k(left["vec_id"].to_numpy(), _array(left["v"], size), right["vec_id"].to_numpy(), _array(right["v"], size), k)
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64())})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = K, query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """queries, vectors: vec_id and v (array of long). query_id, rank, vec_id, score of each query's k best."""
    queries = queries.groupBy("vec_id", "v").agg(F.lit(1)).select("vec_id", "v")
    n_q = max(1, -(-queries.count() // query_rows))
    n_v = max(1, -(-vectors.count() // vector_rows))
    size = F.size("v").alias("size")
    q = queries.select(size, F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int").alias("qp"), "vec_id", "v").withColumn("vp", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    # Another seed than the queries' parts, as a query's id says nothing about a candidate's part.
    v = vectors.select(size, F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_v)).cast("int").alias("vp"), "vec_id", "v").withColumn("qp", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    keys = ["size", "qp", "vp"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_meet(k), "query_id long, vec_id long, score long")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null")
    return nearest(rows.filter(F.col("vec_id") % every == 0), rows, k)


#: The same results from plain SQL.
ORACLE = """
WITH ok AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
