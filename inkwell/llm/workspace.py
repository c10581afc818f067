"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a Parquet table and reading it again, so a
lost executor costs the running stage only.  The folder is the one named by
``spark.checkpoint.dir``.  Where a local session leaves it unset (tests), a folder of its own is
made; on a cluster an unset folder is an error, because machine-local files are invisible to the
other machines.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 512
SIFT, BLOCK = 1 << 27, 1 << 15  # bits at most, and bits of one value of bitmap_construct_agg
_local_root: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _local_root:
        _local_root[sc.applicationId] = tempfile.mkdtemp(prefix="inkwell-")
    return "file://" + _local_root[sc.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session sets another number than Spark's default.

    Ten thousand texts at once would hold tens of megabytes several times over in each task.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def spread(table: DataFrame, key: str) -> DataFrame:
    """A small table that arrives in fewer partitions than there are cores, dealt out; any other as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def sifted(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` is in the small, written table ``wanted`` of different keys, and a few others.

    Keys hash to one of 16 bits for each wanted one; the bits go to every task, so that a join on the key afterwards shuffles little
    besides what it keeps.  Beyond SIFT bits, 16 MB, they grow no more and more other rows pass.
    """
    blocks = max(1, min(SIFT, 16 * wanted.count()) // BLOCK)
    spot = F.xxhash64(key)
    block, bit = F.pmod(F.shiftright(spot, 16), F.lit(blocks)).alias("block"), F.pmod(spot, F.lit(BLOCK))
    bits = wanted.where(F.col(key).isNotNull()).groupBy(block).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    marked = table.where(F.col(key).isNotNull()).select(*table.columns, block, bit.cast("int").alias("bit"))
    return marked.join(F.broadcast(bits), "block").where(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0).select(*table.columns)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass whose worker hands freed memory back when a task ends, as workers live on and their peaks would add up."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


class Workspace:
    """One folder of intermediate tables; removed when the Python process ends."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table read back with the same schema."""
        path, conf = self.path(name), self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")  # the step's shuffle files go with the step
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)
