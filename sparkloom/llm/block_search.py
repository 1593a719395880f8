"""Nearest neighbours by a block matrix join of int8 tiles with quantisation error bounds.

Every vector is scaled to length 1 and kept as int8 codes, a scale, and the length r of what the codes miss. For unit vectors
u, v with codes u', v' the cosine differs from the codes' product by at most ``|u'| r_v + r_u``. Codes alone, a quarter of
float32 vectors, are dealt to a grid of blocks of queries and candidates; each tile multiplies them exactly (in float32, in runs of
``RUN`` dimensions whose sums stay below 2 ** 24, added up in float64) and keeps the pairs whose upper bound reaches the k-th
largest lower bound of their query, as the pairs of all tiles together then have to again. The original vectors of the pairs
that survive are fetched, their cosines computed in double precision, and a heap a query keeps the k nearest. Nothing is
sampled: all candidates are looked at, but of equal vectors only as many as can be in one list.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do rows without a
vec_id; vectors of another length than the query's are never neighbours; vectors of any length are compared whole; ties go to the
smaller vec_id; a query's own vec_id is not a candidate; repeated rows of a candidate count once each, a query that is
repeated is asked once, with its least vector; an empty table gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, key_bitmap, maybe_among, release, stage, without

NEAREST = 5
QUERY_STEP = 50
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
#: Dimensions whose products of codes are exact in float32: 1024 * 127 * 127 < 2 ** 24.
RUN = 1024
_STRIP = 128
_CODED = "row long, id long, d int, codes binary, scale double, near double, miss double"


def usable(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the codes' vectors and of what they miss, rounded up."""
    with np.errstate(over="ignore"):
        unit = x / lengths(x)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    near = codes * scale[:, None]
    slack = 1e-9  # covers rounding in these lengths and in the tile's product
    return codes.astype(np.int8), scale, np.sqrt((near**2).sum(axis=1)) + slack, np.sqrt(((unit - near) ** 2).sum(axis=1)) + slack


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row products, summed from left to right: equal vectors get equal results wherever they stand."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of the rows of two matrices of codes, exactly."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], RUN):
        total += a[:, at : at + RUN].astype(np.float32) @ b[:, at : at + RUN].astype(np.float32).T
    return total


def coded(rows: DataFrame) -> DataFrame:
    """row, id, d, codes, scale, near, miss of ``rows`` (row, id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                codes, scale, near, miss = quantised(_matrix(v.take(pa.array(at)), d))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(pa.array(at)), batch.column("id").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)),
                        pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(near), pa.array(miss),
                    ],
                    names=["row", "id", "d", "codes", "scale", "near", "miss"],
                )

    return rows.select("row", "id", "v").mapInArrow(run, _CODED)


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def survivors(q: pa.Table, c: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one tile: numbers of queries and of candidates, and the bounds of their cosines, for all pairs that may be among the k
    nearest of the tile."""
    d = q.column("d")[0].as_py()
    codes = [np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(-1, d) for t in (q, c)]
    q_ids, q_scale, q_near, q_miss = (q.column(x).to_numpy() for x in ("id", "scale", "near", "miss"))
    c_ids, c_scale, c_miss = (c.column(x).to_numpy() for x in ("id", "scale", "miss"))
    for at in range(0, len(q_ids), _STRIP):
        to = min(at + _STRIP, len(q_ids))
        score = products(codes[0][at:to], codes[1]) * (q_scale[at:to, None] * c_scale)
        error = q_near[at:to, None] * c_miss + q_miss[at:to, None]
        own = q_ids[at:to, None] == c_ids
        score[own] = -np.inf
        low = score - error
        floor = np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k] if len(c_ids) > k else np.full(to - at, -np.inf)
        rows, cols = np.nonzero((score + error >= floor[:, None]) & ~own)
        yield at + rows, cols, low[rows, cols], (score + error)[rows, cols]


def _surplus_copies(candidates: DataFrame, k: int) -> DataFrame:
    """row of the candidates that ``k + 1`` equal vectors of smaller ids stand before. They are in no list: all copies are equally
    near to any query, ties go to the smaller ids, and at most one of those is the query's own."""
    same = ["first", "second"]  # 128 bits of hash
    narrow = candidates.select("row", "id", F.xxhash64("v").alias("first"), F.xxhash64(F.lit(7), "v").alias("second"))
    # the limit by rank is taken in every task before the shuffle, so that a vector of many copies is few rows
    least = narrow.withColumn("nth", F.dense_rank().over(Window.partitionBy(*same).orderBy("id"))).filter(F.col("nth") <= k + 1)
    ends = stage(least.groupBy(*same).agg(F.max("nth").alias("n"), F.max("id").alias("last")).filter(F.col("n") == k + 1).select(*same, "last"), "ends")
    return narrow.join(ends, same).filter("id > last").select("row")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors of largest cosine for each row of ``queries``; both frames have
    vec_id and embedding. The grid follows the tables' counts, so tiles keep their size as the tables grow."""
    bounded_batches(vectors.sparkSession)
    held: list[str] = []

    def given(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))

    asked = stage(given(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("row", F.monotonically_increasing_id()), "queries", held)
    # rows are told by a number, as several may have one vec_id
    candidates = stage(given(vectors).withColumn("row", F.monotonically_increasing_id()), "candidates", held)
    candidates = without(candidates, "row", _surplus_copies(candidates, k), keep=True)
    down, across = max(1, -(-asked.count() // query_block)), max(1, -(-candidates.count() // candidate_block))
    row = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(down)).cast("int")
    column = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(across)).cast("int")
    left = coded(asked).withColumns({"r": row, "c": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    right = coded(candidates).withColumns({"c": column, "r": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        found = [*survivors(q, c, k)] if q.num_rows and c.num_rows else []
        i, j, low, high = (np.concatenate(x) for x in zip(*found)) if found else ([np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2)
        ids, rows = q.column("id").to_numpy(), c.column("row").to_numpy()
        return pa.table({"query_id": pa.array(ids[i], pa.int64()), "row": pa.array(rows[j], pa.int64()), "low": pa.array(low), "high": pa.array(high)})

    found = left.groupBy("r", "c", "d").cogroup(right.groupBy("r", "c", "d")).applyInArrow(tile, "query_id long, row long, low double, high double")
    own = Window.partitionBy("query_id")
    found = found.withColumn("nth", F.row_number().over(own.orderBy(F.desc("low"))))
    found = found.withColumn("floor", F.max(F.when(F.col("nth") == k, F.col("low"))).over(own)).filter("floor IS NULL OR high >= floor")
    found = stage(found.select("query_id", "row"), "survivors", held)
    bits = key_bitmap(found, "row")

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_among(bits.value, batch.column("row").to_numpy())))

    fetched = candidates.mapInArrow(among, candidates.schema).select("row", F.col("id").alias("vec_id"), F.col("v").alias("w"))
    pairs = found.join(fetched, "row").join(asked.select(F.col("id").alias("query_id"), "v"), "query_id")
    ranked = stage(_merged(pairs.select("query_id", "vec_id", "v", "w"), k), "nearest")
    release(held)
    return ranked


def _merged(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query, from ``pairs`` (query_id, vec_id, v, w)."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = batch.column("v"), batch.column("w")
            sizes, scores = v.value_lengths().to_numpy(), np.empty(batch.num_rows)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x, y = _matrix(v.take(pa.array(at)), d), _matrix(w.take(pa.array(at)), d)
                scores[at] = dots(x, y) / (lengths(x) * lengths(y))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(scores)], names=["query_id", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []

        def out(query: int, heap: list[tuple[float, int]]) -> Iterator[tuple[int, int, int, float]]:
            for rank, (score, negative) in enumerate(sorted(heap, reverse=True), 1):
                yield query, rank, -negative, score

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            rows = []
            for q, vec, score in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if q != query:
                    if heap:
                        rows.extend(out(query, heap))
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
            yield batch_of(rows)
        if heap:
            yield batch_of([*out(query, heap)])

    scored = pairs.mapInArrow(exact, "query_id long, vec_id long, score double")
    return scored.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


ORACLE = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
      FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {NEAREST}
"""
