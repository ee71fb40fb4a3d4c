"""Tables that an iteration writes and lets go again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; only a local session without one gets a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="assayer-")


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Calling it computes a frame once, as a table in the shared folder, and gives the frame that reads it. A table rather than a
    checkpoint: its size is known, where the estimates of a checkpoint's size multiply from round to round of an
    iteration until planning stands still.

    ``written`` counts the tables. ``drop`` removes those of the frames given; ``clear`` removes all but those.
    """

    def __init__(self):
        self.written, self._root, self._at = 0, None, {}

    def __call__(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        self._root = self._root or f"{folder(spark)}/tables-{uuid.uuid4().hex}"
        path = f"{self._root}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = (out, path)
        return out

    def frames(self) -> list[DataFrame]:
        return [df for df, _ in self._at.values()]

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and (held := self._at.pop(id(df), None)):
                removed(df.sparkSession, held[1])

    def clear(self, *but: DataFrame) -> None:
        keep = {id(df) for df in but}
        self.drop(*[df for key, (df, _) in list(self._at.items()) if key not in keep])


def made_folder(spark: SparkSession, path: str) -> str:
    """``path`` as a folder that stands, so that it can be read before anything is in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return path
