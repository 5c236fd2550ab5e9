"""Session helpers shared by every subpackage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}
#: Spark's setting by which the shuffles of a finished query are deleted.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Functions given to Arrow or pandas operators are pickled by reference, so
    the workers need the package. Where it is already on their path this is a
    harmless second copy.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    path = f"{shared_dir(spark)}/lexloom/package-{uuid.uuid4().hex}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path)
    _SHIPPED[app] = path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where no such setting exists, in a session on one machine, is a
    temporary folder made and set; executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found and sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lexloom-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def spread(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``df``, dealt over the cores if it is one small file.

    Such a file is often one row group, which one task reads whatever the split
    size; everything after the scan would run in that task too. Tables of
    several files, or above ``most_bytes``, are not shuffled.
    """
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes
    if not small or len(df.inputFiles()) != 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts in ``column`` have at most ``most`` bytes together; a longer text is a part by itself.

    Spark's batches are bounded by rows, so long texts would make large ones.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a place that survives the loss of executors. The files
    belong to the application's checkpoint folder and go with it. What the job
    has shuffled is deleted when it is over, not at some garbage collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made and nothing reads any more."""
    spark = df.sparkSession
    ours = f"{shared_dir(spark)}/lexloom/"
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if ours.split(":", 1)[-1].lstrip("/") in folder:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
