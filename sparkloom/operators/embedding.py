"""A map of vectors in two dimensions that keeps neighbours together: a neighbour graph by cosine, laid out from the first principal
components by pulls along its edges and pushes between cells of the plane."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.vectors import two_dimensions
from sparkloom.scratch import written

NEAREST, TABLES, BUCKET = 10, 6, 1024
ROUNDS, CUT, PULL, PUSH, CELL = 12, 3, 0.5, 0.6, 0.5


def neighbours(rows: DataFrame, key: str, vector: str, k: int = NEAREST, tables: int = TABLES, bucket: int = BUCKET, seed: int = 5) -> DataFrame:
    """a, b, similarity: for each row about its ``k`` most similar others by cosine. Rows meet in buckets of about ``bucket`` rows by the
    signs of random projections, in several tables; a larger bucket, as of equal vectors, is cut into blocks of that size."""
    v = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.exists("v", lambda x: x != 0))
    count, size = v.agg(F.count("*"), F.max(F.size("v"))).first()
    bits = max(0, math.ceil(math.log2(max(1, count) / bucket)))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, size or 1))
    kind = dict(v.dtypes)["key"]

    def codes(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            for t in range(tables):
                code = ((x @ planes[t].T > 0) * (1 << np.arange(bits))).sum(axis=1) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64))], names=["key", "v", "t", "code"])

    def nearest(table: pa.Table) -> pa.Table:
        x = _matrix(pa.concat_arrays(table.column("v").chunks))
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        like = x @ x.T
        np.fill_diagonal(like, -np.inf)
        most = min(k, len(x) - 1)
        other = np.argpartition(-like, most - 1, axis=1)[:, :most] if most > 0 else np.empty((len(x), 0), np.int64)
        first = np.repeat(np.arange(len(x)), other.shape[1])
        keys, second = table.column("key"), other.ravel()
        return pa.table({"a": keys.take(pa.array(first)), "b": keys.take(pa.array(second)), "similarity": pa.array(like[first, second])})

    coded = v.mapInArrow(codes, f"key {kind}, v array<double>, t int, code long")
    blocks = coded.groupBy("t", "code").agg(F.ceil(F.count("*") / (2 * bucket)).cast("int").alias("blocks"))
    dealt = coded.join(blocks, ["t", "code"]).withColumn("block", F.pmod(F.xxhash64("key", "t"), F.col("blocks")))
    found = dealt.groupBy("t", "code", "block").applyInArrow(nearest, f"a {kind}, b {kind}, similarity double")
    best = found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return best.withColumn("nth", nth).filter(F.col("nth") <= k).select("a", "b", "similarity")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def neighbour_map(rows: DataFrame, key: str, vector: str, k: int = NEAREST, rounds: int = ROUNDS) -> DataFrame:
    """key, x, y of ``rows``. Keys are unique and vectors of one length; zero vectors stay where the components put them."""
    edges = neighbours(rows, key, vector, k)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    edges = written(both, "edges")
    degrees = written(edges.groupBy("a").agg(F.count("*").alias("degree")), "degrees")
    flat = two_dimensions(rows.select(key, vector), vector).select(F.col(key).alias("key"), "x", "y")
    width = flat.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    scale = max(width[2] or 0, width[3] or 0) or 1.0
    at = written(flat.select("key", ((F.col("x") - (width[0] or 0)) / scale).alias("x"), ((F.col("y") - (width[1] or 0)) / scale).alias("y")), "at")
    count = at.count()
    for r in range(rounds):
        at = _moved(at, edges, degrees, (1 - r / rounds), count)
        if r % CUT == CUT - 1:
            at = written(at, "at")
    return at.select(F.col("key").alias(key), "x", "y")


def _moved(at: DataFrame, edges: DataFrame, degrees: DataFrame, step: float, count: int) -> DataFrame:
    """``at`` (key, x, y) after all rows went part of the way to their neighbours' mean, and away from the crowds around them."""
    there = at.select(F.col("key").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    sums = edges.join(there, "b").groupBy("a").agg(F.sum("bx").alias("sx"), F.sum("by").alias("sy"))
    mean = sums.join(degrees, "a").select(F.col("a").alias("key"), (F.col("sx") / F.col("degree")).alias("mx"), (F.col("sy") / F.col("degree")).alias("my"))
    cell = lambda c: F.floor(F.col(c) / CELL)
    crowds = at.groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    around = at.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps)).select("key", "x", "y", (cell("x") + F.col("di")).alias("i"), (cell("y") + F.col("dj")).alias("j"))
    far = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + 0.05
    push = lambda a, c: F.sum(F.col("n") * (F.col(a) - F.col(c)) / far)
    pushes = around.join(crowds, ["i", "j"]).groupBy("key").agg(push("x", "cx").alias("px"), push("y", "cy").alias("py"))
    joined = at.join(mean, "key", "left").join(pushes, "key", "left")
    new = lambda v, m, p: F.col(v) + step * (PULL * F.coalesce(F.col(m) - F.col(v), F.lit(0.0)) + PUSH / max(1, count) * F.coalesce(F.col(p), F.lit(0.0)))
    return joined.select("key", new("x", "mx", "px").alias("x"), new("y", "my", "py").alias("y"))
