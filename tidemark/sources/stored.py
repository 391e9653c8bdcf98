"""Tables written between the passes of one query, in the folder that driver and executors share."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_kept: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a new local folder, removed at exit; on a cluster that is an error, since executors could not read it."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _local:
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[context.applicationId] = "file://" + folder
    return _local[context.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which `scratch` deletes."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for paths in _kept:
        paths.append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written and read again: its plan ends there, and a lost executor repeats nothing before it."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what `stored` wrote inside, so that nothing read from it may be used after."""
    paths: list[str] = []
    _kept.append(paths)
    try:
        yield
    finally:
        _kept.remove(paths)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
