"""Session helpers: where shared intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it, and must on a cluster. Only where that is unset and the master is
    local (tests, a laptop) a temporary folder is made and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="proxweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, survives the loss of any executor, and stays
    columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/proxweave-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/proxweave-" in name:
            _delete(spark, name)


def release_tables(spark: SparkSession) -> int:
    """Delete all intermediate tables this process has written; call it once results are stored elsewhere."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, max_bytes: int) -> bool:
    """True if the optimizer's size estimate of ``df`` is at most ``max_bytes``."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast if the estimated size allows it; beyond that a sort-merge join, which AQE can split by skew.

    The estimate of a stored table is that of its compressed files; in memory it takes several times
    as much, so the bound is well under what an executor can hold.
    """
    return F.broadcast(df) if small_enough(df, max_bytes) else df.hint("merge")
