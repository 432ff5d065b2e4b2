"""Input tables and scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests, a laptop) a temporary folder is taken, once a session;
    on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorekeep-"))
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/lorekeep-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    This cuts the lineage and survives the loss of executors; the files go when the driver's
    interpreter ends, or by ``free``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorekeep_path = path
    return out


def free(df: DataFrame | None) -> None:
    """Delete the files of a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_lorekeep_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass
