"""What the operators of this package share: table reads, checkpoints, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: bytes -> bytes: ASCII letters in lower case, digits and all bytes of non-ASCII characters kept, the rest blank
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the same with underscores behind it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task holds the Python objects of few texts at once; then what the task's memory pool
    holds beyond need goes back, as workers live on from task to task."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (runs of digits, letters and non-ASCII characters) as UTF-8; null has none."""
    return text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Only a local session without one gets a new
    temporary folder; on a cluster executors couldn't share that, so it is an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="assayer-")


def removed(spark: SparkSession, path: str) -> None:
    """A table that nothing reads any more, taken from its store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the context's checkpoint folder where it has one, else ``shared_folder``."""
    return spark.sparkContext.getCheckpointDir() or shared_folder(spark)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def tabled(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path. For iterations: a table's size is known, where the estimates of a
    checkpoint's size multiply from round to round until planning stands still."""
    path = f"{settled_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps. Every step is one grouped minimum (combined before the shuffle)
    and one join; each round's edges are a table that goes when the next but one stands. Nodes without an edge don't occur in
    the result. Rounds grow with the logarithm of the longest chain; only that mark reaches the driver.
    """
    e, path = tabled(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    # distinct edges by their number and a 64-bit mark of all of them
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        # small star: each node's smaller neighbours, and the node itself, point at the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        new, at = tabled(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        seen, before = mark(new), seen
        removed(e.sparkSession, path)
        e, path = new, at
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
