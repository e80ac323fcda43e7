"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and ship the package to Python workers (once a session).

    Long texts make row-counted Arrow batches unbounded, so both limits are set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        fd, path = tempfile.mkstemp(prefix="gleaner", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w") as z:
            for top, _, names in os.walk(_PACKAGE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
        spark.sparkContext.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a session without
    that setting (a local test) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-shared"))
            known = spark.sparkContext.getCheckpointDir()
        base = known
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gleaner-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and reread it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one computation, dropped when their readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def written(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete these tables, or all of them."""
        for key in [id(f) for f in frames] or list(self.held):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.held.pop(key)[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
