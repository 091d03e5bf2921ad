"""Tables that operators write to the folder all executors share, so that a lost executor costs a reread only."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from veilscan.session import ship


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; one of our own only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("veilscan.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilscan")
        spark.conf.set("veilscan.shared.dir", found)
    return found.rstrip("/")


class Work:
    """Names tables under one folder of the shared directory; ``drop`` frees those that are no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_dir(spark)}/veilscan-{what}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)
        # Small Arrow batches: texts may be very long, and a batch is held whole by a Python worker.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df written as Parquet and read back: cuts the lineage, survives lost executors. ``by``: a folder for each value of it."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        write = df.write.option("compression", "zstd")
        (write.partitionBy(by) if by else write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out = out.select(*df.columns) if by else out
        out._veilscan_path = path
        return out

    def drop(self, *tables: DataFrame, only: str = "") -> None:
        """Frees tables, or of one that is saved by a column the folder ``only``."""
        for t in tables:
            self._delete(t._veilscan_path + (f"/{only}" if only else ""))

    def close(self) -> None:
        """All that is left, when the driver ends: results may read it until then."""
        with contextlib.suppress(Exception):
            self._delete(self.root)

    def _delete(self, at: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shard_bits(docs: DataFrame, least: int, most: int = 16, each: int = 8 << 20, parts: bool = True) -> int:
    """Log2 of a number of shards for what docs holds: one for ``each`` bytes that Spark expects, and (if ``parts``, or where it
    has no idea) one for each partition."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 55
    n = max(1, size // each if known else 1, docs.rdd.getNumPartitions() if parts or not known else 1)
    return min(most, max(least, (n - 1).bit_length()))


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns asked for: extra ones, and whatever names they have, never meet ours."""
    return df.select(*[df[c] for c in columns])
