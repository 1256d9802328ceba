"""Access to tables, and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set once if all work is done on
    this machine; it goes when the process ends. On a cluster that is an error.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lexloom.shared.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("lexloom.shared.dir", at)
    return at


#: Folders written by this process.
_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> None:
    """Remove all that shelves have written so far; results that still read it can't be used any more."""
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())


def _remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Shelf:
    """Tables written to the shared folder to cut lineage and to be read more than once.

    A lost executor costs only the tasks it ran: what is on the shelf is read again.
    ``drop`` removes tables that no later step reads, ``clear`` all of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _WRITTEN.append(self.at)

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df``; return it as a table to be read, with its place."""
        self.n += 1
        place = f"{self.at}/{self.n}"
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place), place

    def drop(self, place: str) -> None:
        _remove(self.spark, place)
