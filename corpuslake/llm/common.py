"""Shared helpers: the cluster's shared folder, spooled tables, row identity."""

from __future__ import annotations

import ctypes
import multiprocessing
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ProcessPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and \t \n \v \f \r.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder is made on one machine; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpuslake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def spool_path(spark: SparkSession, name: str) -> str:
    """A new place for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/corpuslake/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str, compression: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage the way checkpoint() does, survives lost executors, and
    keeps later consumers from computing ``df`` again.
    """
    path = path or spool_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a spooled table that nothing reads any more: all that came of it has been written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of a batch that is sent to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Have the session send at most BATCH_BYTES at a time to Python (or one row), so that whole texts of a batch fit in a worker.

    Plans read the setting when they run, so it stays; it changes no results.  A smaller one is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", conf.get(name)) or 0) if re.fullmatch(r"\d+b?", conf.get(name)) else 0
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give memory that a worker has freed back to the system: workers live on, and what each keeps adds up in an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fit_on_worker(rows: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """What ``fit`` makes of a bounded number of rows, in one task instead of the driver; it comes back pickled.

    The task has a child process do it, whose memory goes when it ends; Python workers live on.
    A lost executor has the task run again.  ``fit``, a function of a module, gets the rows in
    no particular order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [r for batch in batches for r in batch.to_pylist()]
        with ProcessPoolExecutor(1, mp_context=multiprocessing.get_context("fork")) as child:
            model = child.submit(_pickled, fit, own).result()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([])  # no task at all for an empty table


def _pickled(fit: Callable[[list[dict]], Any], rows: list[dict]) -> bytes:
    return pickle.dumps(fit(rows))


def hide_private(docs: DataFrame, *named: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like an operator's own (_cl_...) under other names, and what brings their names back.

    Columns that the operator is told to use (``named``) keep their names.
    """
    clashing = [c for c in docs.columns if c.lower().startswith("_cl_") and c not in named]
    free = (n for i in range(10**9) if (n := f"kept_{i}") not in docs.columns)
    names = {next(free): c for c in clashing}
    return docs.withColumnsRenamed({c: n for n, c in names.items()}), names


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
