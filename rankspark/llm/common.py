"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def on_cluster(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local-cluster") or not master.startswith("local")


def shrink_heaps(spark: SparkSession) -> None:
    """Let each executor and the driver collect its garbage: a heap that has grown in one job gives memory back to the
    machine, and not to the next job only. Between jobs there is little to collect.

    Hadoop's local file system starts a process (chmod) for each file that it makes; until that process runs a program of
    its own it has its parent's memory, so a heap counts twice for as long.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - on_cluster(spark))  # a task for each
    spark._jvm.System.gc()
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Where it is unset, a local session (all in one process, as in tests) gets a temporary folder; on a cluster that is an
    error, as no folder of one machine will do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if on_cluster(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_rankspark_shared", None) or tempfile.mkdtemp(prefix="rankspark-")
        spark._rankspark_shared = base
    return base.rstrip("/")


#: Folders below the shared one: this process' tables, and those of the steps that are running.
_folders: list[str] = [f"tables-{uuid.uuid4().hex[:12]}"]
_cleaning: set[str] = set()


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The table lasts until the step it belongs to ends (see step), or the process; with `outer`, longer than the step.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/{_folders[0]}"
    if top not in _cleaning:
        _cleaning.add(top)
        atexit.register(remove, spark, top)
    path = f"{shared_dir(spark)}/{'/'.join(_folders[: len(_folders) - outer])}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if on_cluster(spark):
        shrink_heaps(spark)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored; a session that has ended can't."""
    with contextlib.suppress(Exception):
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


@contextlib.contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go when the step ends: what it leaves must have been written with `outer`."""
    _folders.append(f"step-{uuid.uuid4().hex[:12]}")
    path = f"{shared_dir(spark)}/{'/'.join(_folders)}"
    try:
        yield
    finally:
        _folders.pop()
        remove(spark, path)


#: Rows of an Arrow batch: with long texts, Spark's default of 10,000 is many tens of MB for each of a task's buffers.
BATCH_ROWS = 2000
#: Bytes at which an Arrow batch is closed, whatever its rows: texts may be long. A row beyond that is a batch of its own.
BATCH_BYTES = 4 << 20


def share_imports(spark: SparkSession) -> None:
    """Python workers are forked from a daemon: let it import the libraries that all of them need (see preload)."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent / "preload")
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), here])


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of rows and bytes of an Arrow batch, if they are higher than BATCH_ROWS and
    BATCH_BYTES, and let workers share what they import. On a cluster, heaps shrink to what they hold."""
    share_imports(spark)
    if on_cluster(spark):
        shrink_heaps(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size(spark.conf.get(key, "1g")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold that the contracts name."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch that yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch) or ()

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or a variant that no column of df has (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to write (its own result wins over a clashing input column)."""
    drop = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def with_fields(schema: StructType, ddl: str) -> StructType:
    """schema and the fields of a DDL string after it; schema itself stays as it is."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


_held: dict[tuple, object] = {}


def per_worker(kind, *args):
    """One object for each Python worker: a worker that turns to another operator lets go of those it has had, with what
    they keep, as workers outlive the stages they serve."""
    key = (kind, *args)
    if key not in _held:
        make_room(kind.__module__)
        _held[key] = kind(*args)
    return _held[key]


def make_room(operator: str = "") -> None:
    """At a task's start: drop what other operators than this module's have kept in this worker, and give memory that is
    free, but held by Arrow's pool or the C library, back to the machine."""
    for key in [k for k in _held if k[0].__module__ != operator]:
        del _held[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(operator: str, run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """A function of Arrow batches that makes room in its worker when it begins and when it ends, as an idle worker holds
    what it has. forget: lets go of what would otherwise be kept for the next task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(operator)
        yield from run(batches)
        if forget:
            forget()
        make_room(operator if forget is None else "")

    return tidied


def trim(cache: dict, most: int) -> None:
    """If there are more than `most` entries, the newest half goes: words that are used often were met first."""
    if len(cache) > most:
        while len(cache) > most // 2:
            cache.popitem()
