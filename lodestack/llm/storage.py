"""Shared storage: the folder that all executors see, written tables in place of lineage, raw files.

Everything goes through Spark's writers or `pyarrow.fs`, so the folder may be any URI both know.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_owner: list[str] = []
_kept: dict[str, object] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under `spark.checkpoint.dir`; a temporary one only where that is unset and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not base:
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='lodestack-')}")
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` gave, once all that was made from them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system of a URI and the path within it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextlib.contextmanager
def new_file(uri: str):
    """A stream to a file under a name of its own, renamed at the end: readers see all of it or nothing, and a retried task replaces it."""
    files, path = file_system(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        yield out
    files.move(part, path)


def put_file(uri: str, write) -> None:
    """`new_file`, with what `write` writes."""
    with new_file(uri) as out:
        write(out)


def _libc(name: str, *args: int) -> None:
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        getattr(ctypes.CDLL("libc.so.6"), name)(*args)


def kept(name: str, build):
    """What `build` gives, kept by this Python worker for its next tasks, until a function of another module runs in it."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = build()
    return _kept[name]


def tidied(run):
    """A function over batches that gives memory back, as Python workers live on between tasks: at its start
    what other modules' functions kept, at its end what is free."""
    module = run.__module__

    @functools.wraps(run)
    def tidy(batches):
        if not _owner:  # a new worker
            pa.set_memory_pool(pa.system_memory_pool())
            _libc("mallopt", -3, 4 << 20)  # M_MMAP_THRESHOLD: what is larger goes back at once,
            _libc("mallopt", -1, 64 << 20)  # M_TRIM_THRESHOLD: and what is smaller, at the end or beyond so much
        if _owner[:] != [module]:
            _kept.clear()
            _owner[:] = [module]
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _libc("malloc_trim", 0)

    return tidy


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows within this block, for plans that are run in it; whole texts make wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what is made of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
