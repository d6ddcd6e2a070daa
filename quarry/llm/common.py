"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: Rows that a Python worker takes up at a time, and of an Arrow batch on its way there: texts can be long.
ARROW_ROWS = 500
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tune(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ARROW_ROWS; never raise them.

    A query whose last step runs in Python is executed by its caller, under the caller's setting, so it asks for this; operators
    only need it for their peak memory, not for their results.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= ARROW_ROWS:
        spark.conf.set(BATCH, str(ARROW_ROWS))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``tune`` for the jobs that run inside; the session's setting comes back after them."""
    before = spark.conf.get(BATCH)
    tune(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that Python objects of few rows live at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a cluster that is an error, as executors wouldn't
    see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: cuts lineage, survives lost executors.

    Tables of a session lie in the folder quarry/<application id>, which can be deleted after it; ``release`` deletes one earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for rows whose crc32 of the id as text leaves ``fold``; a null id is held out, as it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))
