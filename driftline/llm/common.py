"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word of the mixing and near-duplicate operators: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_shipped: set[str] = set()


#: Rows of a batch that a Python worker holds at a time: whole texts, in and out.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Makes a session ready for functions in Python workers: sends them this package, once, and bounds their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        name = f"{tempfile.mkdtemp(prefix='run-')}/{package.name}"
        context.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))


def give_back() -> None:
    """Returns memory that a task has freed to the system: Python workers outlive their tasks."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    from driftline.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder: read again by column, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
