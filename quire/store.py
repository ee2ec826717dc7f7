"""Tables written in the shared folder, so that lineage is cut and lost executors cost no more than a reread."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        where = getattr(spark.sparkContext, "_quire_dir", None) or f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.sparkContext._quire_dir = where
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder made here; a session that has ended leaves it to the cluster's own cleaning."""
    if spark.sparkContext._jsc is None:
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, in a folder for each value of the columns ``by``, read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression="zstd", partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, by: list[str]) -> DataFrame:
    """df, whose partitions hold a bucket of ``key`` each, as a table of such buckets in the shared folder: what joins or
    groups its rows by the key and more columns moves none of them, and has a bucket in a task. Spark joins such tables by
    more than their key without a shuffle only if a setting of the session allows it, which this makes."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    path = new_folder(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).partitionBy(*by).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)
