"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts go to Python in batches of about so many bytes: a batch is held several times over, by the JVM and by each worker.
BATCH_BYTES = 2 << 20
#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; one in the warehouse where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        found = f"{warehouse.rstrip('/')}/_shared"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is read instead of recomputed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run, which clear() removes once what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.frames, self.tables = spark, [], []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.frames.append(f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        df.write.parquet(self.frames[-1])
        return self.spark.read.schema(df.schema).parquet(self.frames[-1])

    def table(self, saved: DataFrame) -> DataFrame:
        """saved: a whole table of the catalogue."""
        self.tables += re.findall(r"kf_parts_\w+", saved._jdf.queryExecution().analyzed().toString())[:1]
        return saved

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark.sparkContext._jvm
        for root in self.frames:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.frames, self.tables = [], []


def unused(name: str, df: DataFrame) -> str:
    """name, with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain_text(name: str = "text"):
    """The column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: idle workers stay for reuse, several to an executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run):
    """The generator function run, with trim() at its end."""

    def outer(batches):
        yield from run(batches)
        trim()

    return outer


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow of run, with trim() at its end, in batches of about BATCH_BYTES: the session's bound is lowered to that where it is higher."""
    spark, bound = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound)) > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)
