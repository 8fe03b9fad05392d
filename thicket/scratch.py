"""Intermediate tables in the folder that the whole cluster shares.

Long pipelines cut their lineage by writing a table and reading it again, so a
lost executor costs the tasks that it ran and never the stages before them.
The folder is the one that the session names in ``spark.checkpoint.dir``; only
where that is unset and the session is a local one (tests, a laptop) a
temporary one is made; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="thicket-"))
        base = _local[0]
    path = f"{base.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone already: the folder stays for the cluster's cleaner
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
