"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the folder that the cluster names; where none is set (tests), in the warehouse, which executors share."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    # the driver's own copy, which Spark serves to the executors
    folder = os.path.realpath(tempfile.mkdtemp(prefix=f"{name}-"))
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
