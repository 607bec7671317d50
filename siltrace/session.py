"""Session helpers: the shared folder that holds checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where that setting is absent and all runs on one machine (tests), a temporary folder is set
    as the session's checkpoint folder, so every caller sees the same one. On a cluster a folder
    of the driver's own would lose data, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-shared-"))
    return configured or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches at 4 MB from now on, unless the session has a limit of its own.

    By default a batch of texts has up to 64 MB in the JVM and again in the Python worker of each task.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, "4m")


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Prefer this to ``checkpoint`` for wide rows: Parquet is compressed and later reads are
    column-pruned, while a checkpoint holds raw rows. With ``by``, folders of those columns' values
    let later filters on them skip the rest.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made, once no plan that is still to run reads them.

    A lost executor's work is made again from stored tables, so whatever was derived from a table
    has to be stored itself before the table goes.
    """
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = sc._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
