"""Relaxation of overlapping dots: repeated small pushes between near dots, and a spring to where each belongs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, SPRING = 70, 0.09
#: Places of a cell that one task holds at a time, dots of one place that meet in one join group, and pairs that are in memory at once.
TILE, CROWD, PAIRS = 4096, 1024, 1 << 16


def _pushed(places: DataFrame, radius: float, tile: int) -> DataFrame:
    """x, y, dx, dy: what the dots at other places nearer than ``radius`` push a dot at (x, y). ``places`` (x, y, n) are distinct and
    finite. Each grid cell is dealt in tiles of about ``tile`` places; the places of the nine cells around are read past
    each tile in batches, so neither a dense cell nor the number of pairs is held anywhere."""
    cell = lambda c: F.floor(F.col(c) / radius)
    placed = places.select("x", "y", F.col("n").cast("double").alias("n"), cell("x").alias("i"), cell("y").alias("j"))
    cells = placed.groupBy("i", "j").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = placed.join(cells, ["i", "j"]).select("i", "j", F.pmod(F.xxhash64("x", "y"), "tiles").cast("int").alias("tile"), F.lit(0).alias("other"), "x", "y", "n")
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    near = placed.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    near = near.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "x", "y", "n").join(cells, ["i", "j"])
    near = near.select("i", "j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("other"), "x", "y", "n")

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, y, dx, dy = None, *[np.empty(0)] * 4

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (x, y, dx, dy)], names=["x", "y", "dx", "dy"])

        for batch in batches:
            i, j, t, other, bx, by, n = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (t[1:] != t[:-1]) | (other[1:] != other[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
                if not other[s]:
                    if at != (key := (i[s], j[s], t[s])):
                        if len(x):
                            yield done()
                        at, x, y, dx, dy = key, *[np.empty(0)] * 4
                    x, y = np.concatenate([x, bx[s:e]]), np.concatenate([y, by[s:e]])
                    dx, dy = np.zeros(len(x)), np.zeros(len(x))
                    continue
                rows = max(1, PAIRS // (e - s))
                for a in range(0, len(x), rows):
                    ux, uy = x[a : a + rows, None] - bx[s:e], y[a : a + rows, None] - by[s:e]
                    far = np.sqrt(ux * ux + uy * uy)
                    # the place itself is infinitely far; others may be so near that their squares vanish
                    zero = far == 0
                    far[zero] = np.hypot(ux[zero], uy[zero])
                    far[far == 0] = np.inf
                    force = np.maximum(radius - far, 0) / 2 / far * n[s:e]
                    dx[a : a + rows] += np.einsum("ij,ij->i", force, ux)
                    dy[a : a + rows] += np.einsum("ij,ij->i", force, uy)
        if len(x):
            yield done()

    # a number of partitions is named as arithmetic counts here, not bytes: few tasks would be made of these
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(near).repartition(parts, "i", "j", "tile").sortWithinPartitions("i", "j", "tile", "other")
    return dealt.mapInArrow(push, "x double, y double, dx double, dy double")


def _parted(points: DataFrame, places: DataFrame, radius: float, crowd: int) -> DataFrame:
    """id, px, py: what the other dots at a dot's place push it. The dots of a place meet in groups of at most about ``crowd`` by
    ``crowd``."""
    held = points.select("id", "x", "y").join(places.filter("n > 1"), ["x", "y"]).withColumn("blocks", F.ceil(F.col("n") / crowd).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("all", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = held.select("x", "y", F.col("own").alias("p"), F.col("all").alias("q"), F.col("id").alias("a"))
    b = held.select("x", "y", F.col("all").alias("p"), F.col("own").alias("q"), F.col("id").alias("b"))
    angle = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(360)) * 3.141592653589793 / 180
    sign = F.when(F.col("a") < F.col("b"), radius / 2).otherwise(-radius / 2)
    return a.join(b, ["x", "y", "p", "q"]).filter("a <> b").groupBy(F.col("a").alias("id")).agg(F.sum(F.cos(angle) * sign).alias("px"), F.sum(F.sin(angle) * sign).alias("py"))


def relax_step(points: DataFrame, radius: float, spring: float = SPRING, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """id, x, y, home_x, home_y after one step; ids are unique. All dots move at once (from the same positions), so the order of dots
    does not matter; coincident dots part in a direction that their ids give.

    Dots of one place are pushed alike by those of other places, so places meet places, with their numbers of dots. No pair is
    stored or shuffled; what grows with the number of near pairs is arithmetic alone."""
    finite = points.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    places = finite.groupBy("x", "y").agg(F.count("*").alias("n"))
    joined = points.join(_pushed(places, radius, tile), ["x", "y"], "left").join(_parted(finite, places, radius, crowd), "id", "left")
    pulled = lambda v: F.col(v) + F.coalesce(f"d{v}", F.lit(0.0)) + F.coalesce(f"p{v}", F.lit(0.0)) + (F.col(f"home_{v}") - F.col(v)) * spring
    return joined.select("id", pulled("x").alias("x"), pulled("y").alias("y"), "home_x", "home_y")


def relaxed(points: DataFrame, radius: float, rounds: int = ROUNDS, cut: int = 10) -> DataFrame:
    """``points`` (id, x, y) after some rounds; lineage is cut by a checkpoint every ``cut`` of them, and steps between are kept, as each
    is read several times by the next."""
    df, kept = points.select("id", "x", "y", F.col("x").alias("home_x"), F.col("y").alias("home_y")), []
    for i in range(1, rounds + 1):
        df = relax_step(df, radius).persist()
        kept.append(df)
        if i % cut == 0:
            df = df.checkpoint()
            while kept:
                kept.pop().unpersist()
    return df.select("id", "x", "y")
