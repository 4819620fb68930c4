"""Reading the input tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: What a batch for a Python worker may hold while a table is written, where the session does not say. Whole texts
#: are long rows: 10,000 of them, Spark's default, would be tens of megabytes in each worker.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if nothing else ships it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for the jobs started inside; the session is as before afterwards."""
    named = spark.conf.getAll
    mine = {k: v for k, v in _BATCH.items() if k not in named}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    prepare(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only on a single machine whose session names none (tests) is a temporary folder made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` for the broadcast side of a join if it has ``rows`` rows at most, else for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


class Scratch:
    """Intermediate tables of one job, in the shared folder.

    ``put`` writes a DataFrame and reads it back: recovery restarts from files that every executor can
    read, the plan stays short, and the planner sees a measured size instead of a guess.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, narrow: bool = False) -> DataFrame:
        """Write ``df`` and return the table read back.

        ``narrow`` is for tables of keys and links: at most four files for each of the cluster's task slots, as
        many small files would cost more than their rows.
        """
        if narrow:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        self.count += 1
        path = f"{self.root}/{self.count}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def put_counted(self, df: DataFrame, narrow: bool = False) -> tuple[DataFrame, int]:
        """``put``, and the number of rows, counted while they are written."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count(F.lit(1)).alias("n")), narrow)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``put`` that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def collect_garbage(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps before the next large one."""
        self.spark._jvm.System.gc()
