"""Sessions and the shared folder: what operators need besides DataFrames."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application, so that none need it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship")) / "readcollapse_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not folder:
        current = context.getCheckpointDir()
        if not current.isDefined() and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="checkpoints")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of ids and numbers that a stored partition should hold at least, where their number is known.
PART_ROWS = 1 << 15


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint in the shared folder: lineage is cut, executors may go.

    rows: a bound of df's rows, if one is known.  Every partition is a file, so few rows are then stored in few partitions.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PART_ROWS)))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, as a URI."""
    folder = shared_folder(spark)
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet, in no order: for tables of many rows smaller and faster than a checkpoint."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is.  df should be cheap (checkpointed)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
