"""Written tables under the folder that the session's machines share, where lineage ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_inside: ContextVar[str | None] = ContextVar("workspace", default=None)
_own: list[str] = []  # the folder made where the session names none


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none and runs on one machine (tests, a laptop) a temporary folder is made, once a
    process; on a cluster that is an error, as executors would not see the folder.
    """
    root = _inside.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tesselune-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = _own[0]
    return f"{root.rstrip('/')}/tesselune-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a written table: lineage ends here, and a lost executor costs no recomputation."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables or folders written by ``stored``."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go to one folder, which is deleted at the end: what is to stay must be stored outside of it by then."""
    path = shared_dir(spark)
    token = _inside.set(path)
    try:
        yield path
    finally:
        _inside.reset(token)
        remove(spark, path)
