"""Lineage cuts that survive the loss of an executor: tables written to a folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Folders written by application, removed when the Python process ends.
_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master without that setting.

    On a cluster the setting is required, as executors on other machines don't see this one's folders.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if conf.get("spark.master", "").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="estrado-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Writes ``df`` once as Parquet (in folders by the columns ``by``) and reads it back, so that several consumers share one computation.

    The folder is removed by ``clean`` or when the Python process ends, not earlier: the frame that reads it is lazy.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/estrado-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.option("compression", "zstd").mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Removes what ``materialize`` wrote for this application so far and tells how many folders; frames that read them are void."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = files.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _WRITTEN else None
    if spark is not None:
        with contextlib.suppress(Exception):  # a stopped or lost JVM leaves the folders to the owner of the shared folder
            clean(spark)
