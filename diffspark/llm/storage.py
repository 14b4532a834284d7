"""Where operators keep intermediate tables: the shared checkpoint folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from diffspark.session import ensure_checkpoint_dir


def shared_path(spark, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark) -> None:
    """From now on the session's rows go to Python workers in batches of a few MB.

    Spark's own limits, 10,000 rows or 64 MB, let a batch of long texts or packed rows take as much several times over: in the JVM's
    buffers, which double as they grow, and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def delete(*tables: DataFrame) -> None:
    """Remove tables written by :func:`kept` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
