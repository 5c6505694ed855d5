"""What the corpus operators share: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Rows of an Arrow batch, where the session leaves it at Spark's own number: texts are long,
#: and a batch is held several times, by the JVM and by its Python worker.
BATCH_ROWS, SPARKS_BATCH_ROWS = "1000", "10000"
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session may go without the setting; it gets a folder of its own.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[sc.applicationId]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches of ``BATCH_ROWS`` from now on in its session."""
    conf = df.sparkSession.conf
    if conf.get(BATCHES) == SPARKS_BATCH_ROWS:
        conf.set(BATCHES, BATCH_ROWS)
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage; the copy outlives lost executors. The shuffle files that it took go
    with the end of the job, as nothing reads them again.
    """
    spark = small_batches(df).sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, was) if was is not None else spark.conf.unset(CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote, when all that was made of it is written too."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` agrees on ASCII and is much the faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
