"""Tables that cut lineage, in the folder that all machines of the cluster share.

The folder is the one the session names in ``spark.checkpoint.dir``; only where that is
unset and all runs on one machine (tests) a temporary folder is used instead. On a cluster
without that setting nothing is written: it is an error. Tables are
plain Parquet, so a lost executor loses nothing: any other can read them again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import driver_memory

_CONF = "spark.checkpoint.dir"
_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a local temporary one only where none is set."""
    named = spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CONF} has to name a folder that all machines share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(_remove_local, _fallback[0].removeprefix("file://"))
    return _fallback[0]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Written tables of one operator call.

    A table stays until ``drop`` is called with its name, or until the operator's folder is
    removed; results are lazy, so those that a result still reads must stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df as a table and return the table's reader."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        driver_memory.give_back(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
