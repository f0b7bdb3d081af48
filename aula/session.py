"""Session set-up, and tables that cut lineage in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "aula", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.autoBroadcastJoinThreshold", "10m")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster in ``spark.checkpoint.dir``; a folder of our own only if that is unset."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="aula-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Later uses read the table instead of computing it again, and losing an executor does not lose it.
    Tables are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aula-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path, as the cluster's own objects: no local files are assumed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.delete(at, True)


@atexit.register
def _remove_tables() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended already
            return
