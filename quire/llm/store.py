"""Where intermediate tables go, and how the operators read their inputs."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor. All tables of an application are in one folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _kept[out] = path
    return out


_kept: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more."""
    for df in kept:
        if path := _kept.pop(df, None):
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    if kept:
        release(kept[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that nothing reads any more.

    They go when the driver's JVM collects the plans that made them, which it seldom does by itself
    in a long job of small plans; so it is asked to, once Python has let go of its own cycles.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The setting that ends an Arrow batch by bytes, Spark's default and ours: some texts are very long, and a worker holds a batch or two.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session end at ``BATCH_BYTES``, unless it has a bound of its own."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
