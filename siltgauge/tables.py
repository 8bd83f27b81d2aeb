"""Tables that cut lineage: written below the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def _folder(spark: SparkSession) -> str:
    """This process's own folder below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:  # one machine, as in tests
            base = tempfile.mkdtemp(prefix="shared-")
        _FOLDERS[app] = (spark, f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}")
    return _FOLDERS[app][1]


@atexit.register
def _sweep() -> None:
    for spark, folder in _FOLDERS.values():
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended and the folder stays
            pass


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written in the shared folder; it outlives any executor.

    The folder is removed when the process ends, as results read from it until then.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
