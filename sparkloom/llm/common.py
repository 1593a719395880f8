"""What the operators of this subpackage share: staged tables, rows taken out of them, and Arrow batches in bounded slices."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker takes from a batch at a time.
SLICE_BYTES = 4 << 20
#: How staged tables of whole texts are compressed: they stay until the driver ends and take a quarter less room than by default.
TEXTS = "zstd"
#: Bits of a bitmap of keys, which spares a pass most rows; fixed, whatever the input.
FILTER_BITS = 1 << 24
#: Spark's setting by which a query's shuffle files go when it has ended, instead of at some later collection of garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Low bits of ``monotonically_increasing_id`` that count inside a partition.
_PART_BITS = 33
_own: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, an own one on a local master, and an
    error on any other, whose executors would each write to a disk of their own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stage(df: DataFrame, name: str, held: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and lost executors cost one stage. What was shuffled
    for it is removed, as later plans read the table. The path is added to ``held``, for ``release``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(paths: list[str]) -> None:
    """Removes staged tables that no later plan reads."""
    while paths:
        path = paths.pop()
        spark = _made.pop(path)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for path in list(_made):
        with contextlib.suppress(Exception):
            release([path])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a shared path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def without(numbered: DataFrame, row: str, gone: DataFrame, keep: bool = False) -> DataFrame:
    """``numbered`` without the rows whose number, in column ``row``, is among those of ``gone`` (row), and without that column,
    unless it is to be kept.

    The numbers are those of ``monotonically_increasing_id``, which hold the partition that gave them. Those of ``gone`` are
    written to a folder for each such partition, and a task that meets rows of a partition reads its folder: no text is
    shuffled and nothing is broadcast, however many rows go."""
    spark, at = numbered.sparkSession, numbered.columns.index(row)
    path = shared_path(spark, "gone")
    gone.select("row", F.shiftright("row", _PART_BITS).alias("part")).repartition("part").write.partitionBy("part").parquet(path)

    def read(part: int) -> np.ndarray:
        system, place = file_system(f"{path}/part={part}")
        files = [f.path for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.base_name.endswith(".parquet")]
        held = [np.empty(0, np.int64)]
        for name in files:
            with system.open_input_file(name) as f:
                held.append(pq.read_table(f, columns=["row"]).column("row").to_numpy())
        return np.sort(np.concatenate(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, np.empty(0, np.int64)
        for batch in batches:
            number = batch.column(at).to_numpy()
            stays = np.ones(len(number), bool)
            for own in np.unique(number >> _PART_BITS).tolist():
                if own != part:
                    part, held = own, read(own)
                if len(held):
                    stays &= held[np.minimum(np.searchsorted(held, number), len(held) - 1)] != number
            left = batch if stays.all() else batch.filter(pa.array(stays))
            if keep:
                yield left
            else:
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(left.columns) if i != at], schema=left.schema.remove(at))

    bounded_batches(spark)
    return numbered.mapInArrow(run, numbered.schema if keep else numbered.drop(row).schema)


def key_bitmap(keys: DataFrame, column: str, bits: int = FILTER_BITS):
    """A broadcast bitmap of ``bits`` bits with those of a column of 64-bit keys set: 2 MB whatever their number."""
    words = keys.select(F.pmod(column, F.lit(bits)).alias("place")).selectExpr("int(place div 32) AS w", "shiftleft(1L, int(place % 32)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(bits // 32, np.uint32)
    found = words.toArrow()
    table[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(table)


def maybe_among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are set: of all keys of the bitmap, and of some others."""
    place = keys % np.int64(len(table) * 32)
    return (table[place // 32] >> (place % 32).astype(np.uint32)) & np.uint32(1) == 1


def bounded_batches(spark: SparkSession, most: int = 2 * SLICE_BYTES) -> None:
    """Arrow batches to Python workers hold about this many bytes, however long the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


#: What a worker keeps between tasks, by owner: how to drop it.
kept_by: dict[str, Callable[[], None]] = {}


def slices(batches: Iterable[pa.RecordBatch], column: int | str, most: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` (string or binary) holds about ``most`` bytes in each, one row at least. What other owners
    keep in this worker is dropped first, so that the stages of a pipeline do not pile up memory."""
    for other in [o for o in kept_by if o != owner]:
        kept_by.pop(other)()
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        at = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(sizes):
            yield batch.slice(at)


def utf8(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null: empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]
