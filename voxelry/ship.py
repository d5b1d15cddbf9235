"""What every operator needs to run Python on executors."""

from __future__ import annotations

import gc
import inspect
import os
import py_compile
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[tuple[str, str]] = set()
#: Bytes of an Arrow batch of rows, about; a longer row is a batch of its own.
BATCH = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, and bound the batches that they hand to Python.

    A bound that the session sets itself, if it is smaller, stays.
    """
    app = spark.sparkContext.applicationId
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if now <= 0 or now > BATCH:
        spark.conf.set(_BATCH_SETTING, str(BATCH))
    if (app, "") in _shipped:
        return
    from pyspark import SparkFiles

    archive = Path(SparkFiles.getRootDirectory()) / f"voxelry-{app}.zip"  # the driver's own folder; Spark sends it on
    with zipfile.ZipFile(archive, "w") as z, tempfile.TemporaryDirectory() as folder:
        for p in _PACKAGE.rglob("*.py"):
            name = p.relative_to(_PACKAGE.parent)
            z.write(p, name)
            compiled = py_compile.compile(str(p), cfile=f"{folder}/c.pyc", dfile=str(name), doraise=True, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
            z.write(compiled, name.with_suffix(".pyc"))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add((app, ""))


def send(spark: SparkSession, path: str) -> str:
    """A file that Python on executors reads, at the same path or as Spark has sent it there; give local() what this returns."""
    app = spark.sparkContext.applicationId
    if (app, path) not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add((app, path))
    return path


def local(path: str) -> str:
    """Where send()'s file is, on whichever machine asks."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


# --- in a worker ------------------------------------------------------------------------------

_kept: dict = {}


def kept(key, make: Callable):
    """What `make` gives, remembered from task to task while the worker's tasks ask for the same key; others' goes first."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy() -> None:
    """Give back memory that is free: Arrow's, and the C library's if it can."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def _trim():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not the GNU library
        return None


def tidied(function: Callable, keeps: bool = False) -> Callable:
    """A function for mapInArrow or applyInArrow that gives memory back behind it; keeps: it uses kept(), else what is kept goes."""
    if inspect.isgeneratorfunction(function):

        def over(batches):
            if not keeps:
                _kept.clear()
            gc.disable()  # the memories hold many small objects without cycles
            try:
                yield from function(batches)
            finally:
                gc.enable()
                tidy()

        return over

    def call(*args):
        if not keeps:
            _kept.clear()
        try:
            return function(*args)
        finally:
            tidy()

    n = len(inspect.getfullargspec(function).args)
    return (lambda a: call(a)) if n == 1 else (lambda a, b: call(a, b)) if n == 2 else (lambda a, b, c: call(a, b, c))


def by_batch(df: DataFrame, function: Callable, schema: str, keeps: bool = False) -> DataFrame:
    """function(batch) -> batch over Arrow batches; one to one, no shuffle."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(tidied(run, keeps), schema)
