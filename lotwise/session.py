"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import SparkSession

from lotwise.errors import InputError


def configure(spark: SparkSession) -> SparkSession:
    """Set the few runtime options that results or plans depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_master(master: str) -> bool:
    """One machine and one process: ``local`` or ``local[n]``, not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for cut lineage and small model files.

    The cluster names it in ``spark.checkpoint.dir``. Where none is set, a
    temporary one is made on a local master; on a cluster that is an error, since
    executors do not see the driver's folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not local_master(context.master):
            raise InputError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpoint(df):
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df) -> str:
    """Write ``df`` to a folder of its own beside the checkpoints, and return its path."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    untyped = [c for c, kind in df.dtypes if kind == "void"]
    df.withColumns({c: df[c].cast("string") for c in untyped}).write.option("compression", "zstd").parquet(path)
    return path


def stored_batches(path: str, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``stored``, streamed inside a task; a few batches are held at a time."""
    files, inner = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
    found = pyarrow.dataset.dataset(inner, format="parquet", filesystem=files)
    return found.to_batches(columns=list(columns), batch_size=1 << 14, batch_readahead=1, fragment_readahead=1, use_threads=False)
