"""Intermediate tables of a plan, in the folder that driver and executors share.

A step that several later ones read is written once, so that no plan holds its copies
and a lost executor costs no more than the step that was running.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers, once a session: tasks import its modules."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    handle, path = tempfile.mkstemp(prefix="gleaner", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(top, name)
                z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(path)


class Scratch:
    """``put`` writes a frame and rereads it; ``drop`` deletes all that was put."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="gleaner-scratch")
        ship(spark)
        self.spark, self.root, self.count = spark, f"{base.rstrip('/')}/gleaner-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
