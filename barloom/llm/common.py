"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Target of words per in-worker slice of an Arrow batch, in bytes of text.
SLICE_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``, or where it is unset the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


class Scratch:
    """Written tables under the shared folder; each cuts lineage and survives lost executors.

    Once a table is written, the shuffle files of its plan go.  ``drop`` removes tables that no later
    plan reads; what remains goes when the driver ends.
    """

    _left: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/barloom-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            if before is not None:  # known from Spark 4.1 on
                self.spark.conf.set(_CLEANUP, "true")
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(_CLEANUP, before)
        self._paths[name] = path
        Scratch._left[path] = self.spark
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            path = self._paths.pop(name, None)
            if path:
                _delete(self.spark, path)
                Scratch._left.pop(path, None)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(Scratch._left.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def binary_text(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    return [x or b"" for x in col.to_pylist()]


def slices(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``most`` bytes, so that working lists stay bounded."""
    return size_slices([len(t) for t in texts], most)


def size_slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node, and that points nowhere."""
    if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        return edges.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()
    return False


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Large-star and small-star rounds alternate until no edge changes.  Every round is a grouped
    minimum (partially aggregated before its shuffle) and a join that adaptive execution can split,
    so one component may hold any share of the nodes; each round is written to the shared folder.
    """
    u, v = F.col("u"), F.col("v")
    ordered = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    current = scratch.write(ordered, f"{name}-0")
    step = 0
    while not _stars(current):
        # large star: of every node, connect the larger neighbours to the smallest of all, itself included
        both = current.select("u", "v").union(current.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        # small star: of every node, connect the smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        step += 1
        nxt = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        current = nxt
    roots = current.select(v.alias("node"), v.alias("component")).distinct()
    return current.select(u.alias("node"), v.alias("component")).union(roots)
