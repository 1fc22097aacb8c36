"""Lineage cuts on shared storage.

Iterative operators must not recompute their whole history when an executor is
lost, and must not keep their only copy on one machine. The helpers therefore
write to the folder that the cluster names in ``spark.checkpoint.dir``, below
one folder an application, which goes when the driver ends. Tables that a later
one replaces are dropped at once.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the session's shared folder.

    Without ``spark.checkpoint.dir`` it lies in the warehouse folder, which all
    machines share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    named = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/tracegrain"
    app = spark.sparkContext.applicationId
    root = f"{named.rstrip('/')}/tracegrain-{app}"
    if app not in _ROOTS:
        _ROOTS[app] = (spark, root)
        atexit.register(_leave, app)
    return root


def _leave(app: str) -> None:
    spark, root = _ROOTS.pop(app)
    if spark.sparkContext._jsc is not None:  # not stopped yet
        remove(spark, root)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def staged(df: DataFrame, tag: str, instead: tuple[DataFrame | None, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; then drop the staged tables it takes the place of."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    dropped(*instead)
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "__dict__", {}).pop("_staged_at", None)
        if path:
            remove(t.sparkSession, path)
