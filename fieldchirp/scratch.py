"""Tables written to the folder that all executors share.

Iterative and multi-pass operators cut their lineage here.  The folder is the
one named by ``spark.checkpoint.dir``; written Parquet survives the loss of any
executor, is compressed and can be read column by column.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_ends: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="fieldchirp-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which the file system deletes when the driver ends."""
    home = f"{shared_dir(spark)}/fieldchirp/{spark.sparkContext.applicationId}"
    if home not in _ends:
        _ends.add(home)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(home)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
