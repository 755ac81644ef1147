"""Session helpers: the shared scratch folder, shipping this package to workers, distributed ranks."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Scratch paths of this thread.
_made = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/folioscope-{name}-{uuid.uuid4().hex}"
    _made.paths = [*getattr(_made, "paths", []), path]
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path; silent once the session is gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the gateway may be closed at exit
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was stored within, but for the tables given to the function it yields."""
    before, kept = set(getattr(_made, "paths", [])), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._folioscope_path)
        return table

    yield keep
    for path in getattr(_made, "paths", []):
        if path not in before | kept:
            discard(spark, path)
    _made.paths = [p for p in getattr(_made, "paths", []) if p in before | kept]


def drop(table: DataFrame) -> None:
    """Deletes a :func:`stored` table that nothing reads any more."""
    discard(table.sparkSession, table._folioscope_path)


_caches: list[Callable[[], None]] = []
_stage: list[int] = [-1]


def forgets(clear: Callable[[], None]) -> None:
    """Registers what a worker drops when it begins another stage."""
    _caches.append(clear)


def _begin() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    if stage != _stage[0]:
        _stage[0] = stage
        for clear in _caches:
            clear()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        return


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers, which Spark uses again and again, don't keep the memory of earlier stages."""

    def own(parts):
        _begin()
        try:
            yield from run(parts)
        finally:
            _release()

    return df.mapInArrow(own, schema)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="folioscope-ship-")
    target = os.path.join(folder, "folioscope_shipped.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".json")):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("folioscope", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
