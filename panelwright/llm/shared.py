"""Working folders that every executor and the driver can see.

Operators cut lineage by writing Parquet below the folder named in ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a re-run of its tasks and never a stored intermediate. A folder of this session's own is used only where the
setting is absent in local mode, as in tests; a cluster without the setting is an error.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` or, where that is unset, a checkpoint folder made for this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelwright-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Workspace:
    """One operator call's folder of intermediate tables below :func:`shared_root`."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables = 0

    def folder(self, name: str) -> str:
        self._tables += 1
        return f"{self.path}/{self._tables:02d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back: its lineage ends at the files."""
        to = self.folder(name)
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self) -> None:
        """Delete the folder. Call it only when nothing that reads these tables will run again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator(spark, ...)`` with Arrow batches of at most 4 MB in what it runs itself; the session's setting is put back.

    By default 10,000 texts go to a worker at once, and both it and the executor beside it hold them more than once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @functools.wraps(operator)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        before = spark.conf.get(name)
        spark.conf.set(name, f"{min(int(before.rstrip('b')), 4 << 20)}b" if before.rstrip("b").isdigit() else f"{4 << 20}b")
        try:
            return operator(spark, *args, **kwargs)
        finally:
            spark.conf.set(name, before)

    return run
