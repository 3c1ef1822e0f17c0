"""Session helpers shared by the entry module, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "clausemill", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context_dir.isDefined():
            return context_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clausemill-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that the session reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: worked out once, whatever reads them and is run again."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def packed(df: DataFrame, name: str) -> DataFrame:
    """``written`` for whole texts: smaller files, and no shuffle files are left."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` or ``packed`` made and nothing reads any more."""
    spark = df.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data_root() -> str:
    return os.environ.get("CLAUSEMILL_DATA", "/root/testdata")
