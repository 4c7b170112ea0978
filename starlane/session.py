"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

R = TypeVar("R")

# Settings that matter at scale.  AQE re-plans joins at runtime from real
# shuffle sizes (sort-merge -> broadcast only when the measured side is below
# the adaptive threshold), coalesces small shuffle partitions and splits
# skewed ones, even when the split costs an extra shuffle downstream.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # Target size of post-shuffle partitions and of split skewed partitions.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}

#: Input bytes (Parquet) for each partition that a shuffle begins with, partitions at
#: most, and the size up to which AQE merges them again.
PARTITION_BYTES, MOST_PARTITIONS, MERGED = 4 << 20, 20_000, "16MB"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

#: Whether the shuffle files of a query are deleted when it ends, not when its plan is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch that a Python worker gets, at most (or one longer row).
BATCH_SIZE, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2MB"


def get_session(
    master: str | None = None,
    app: str = "starlane",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the scale settings applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; without it this raises, because executors could not read
    what others wrote to their own disks.  Only a local master (tests) gets a
    fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="starlane-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for written tables, under the session's reliable checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the reliable checkpoint folder and read
    it back.  Cuts lineage like ``materialize`` but keeps a columnar file:
    later scans prune columns, push filters and report their real size to
    the broadcast decision."""
    return read_table_of(df.sparkSession, write_table(df, name), df.schema)


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet under a new path of the reliable checkpoint
    folder; the path, for ``remove_path`` once nothing reads it any more."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return path


def read_table_of(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a written table; its schema is known, so no footer is opened for it."""
    return spark.read.schema(schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in it, as the JVM sees them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(target)


def write_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file under the reliable checkpoint folder; its path."""
    path = scratch_path(spark, name)
    _put(spark, path, content)
    return path


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    system, target = _hadoop(spark, path)
    out = system.create(target)
    try:
        out.write(content)
    finally:
        out.close()


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Put a small file in the place of another in one step: readers find the
    old content or the new one."""
    fresh = f"{path}.{uuid.uuid4().hex[:12]}"
    _put(spark, fresh, content)
    (_, source), (_, target) = _hadoop(spark, fresh), _hadoop(spark, path)
    fs = spark._jvm.org.apache.hadoop.fs
    how = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)


def file_content(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    system, target = _hadoop(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _hadoop(spark, path)
    return system.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that is no longer needed, in whatever file
    system it lies."""
    system, target = _hadoop(spark, path)
    system.delete(target, True)


def input_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Number of files below ``paths`` and a checksum of their names, sizes and
    times, read from listings only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    state = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return tuple(state)


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Size of the files below ``paths``, read from listings only."""
    found = [_hadoop(spark, path) for path in paths]
    return sum(system.getContentSummary(target).getLength() for system, target in found)


def shuffle_partitions(spark: SparkSession) -> int:
    """As many partitions as the session's shuffles begin with."""
    plain = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merging = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    if any(spark.conf.get(name) != "true" for name in merging):
        return plain
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or plain)


def size_shuffles(spark: SparkSession, size: int) -> None:
    """Have shuffles begin with as many partitions as ``size`` bytes of input need, and
    merge no more than ``MERGED``, so that a task holds no more of a larger
    input.  A session that has as many partitions already keeps them; sizes it
    merges up to are lowered all the same, or its tasks would grow up to those."""
    wanted = min(MOST_PARTITIONS, -(-size // PARTITION_BYTES))
    if wanted > shuffle_partitions(spark):
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    _lower(spark, ADVISORY_SIZE, MERGED)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have queries within delete their shuffle files as soon as they end.  For steps that
    write each frame once: a frame that is run again has its stages run again.
    Otherwise the files of every step lie on the executors' disks until the driver
    happens to collect the plans."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def bound_batches(spark: SparkSession) -> None:
    """Have tasks hand rows to their Python workers in batches of ``BATCH`` bytes: the
    executor holds a batch in Arrow's vectors and again as written, the worker
    as read, and none of them returns all of that memory.  By rows alone 10,000
    texts are one batch, however long they are."""
    _lower(spark, BATCH_SIZE, BATCH)


def _lower(spark: SparkSession, name: str, size: str) -> None:
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(name)) > as_bytes(size):
        spark.conf.set(name, size)


def run_concurrently(actions: dict[str, Callable[[], R]], max_workers: int = 8) -> dict[str, R]:
    """Run independent Spark actions from a few driver threads so their jobs
    share the cluster; results by name, the first failure re-raised."""
    if len(actions) <= 1:
        return {name: fn() for name, fn in actions.items()}
    with ThreadPoolExecutor(max_workers=min(max_workers, len(actions))) as pool:
        futures = {name: pool.submit(fn) for name, fn in actions.items()}
        return {name: f.result() for name, f in futures.items()}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage.

    Used where a plan is read several times or contains a sampled step
    (range partitioning) that must not be recomputed differently.  Unlike a
    local checkpoint the files survive the loss of the executor that wrote
    them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
