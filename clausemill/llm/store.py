"""Tables written in the shared checkpoint folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from clausemill.session import checkpoint_dir


class Store:
    """A folder of one run under ``spark.checkpoint.dir``; tables can be dropped before the run ends."""

    #: Lists that note the stores made while they are open.
    _watching: list[list[Store]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        for noted in Store._watching:
            noted.append(self)

    @staticmethod
    @contextmanager
    def noted() -> Iterator[list[Store]]:
        """The stores made inside."""
        made: list[Store] = []
        Store._watching.append(made)
        try:
            yield made
        finally:
            Store._watching.remove(made)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(at)

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")
            self.names.remove(name)

    def keep(self, *names: str) -> None:
        """Drops all tables but the named ones."""
        self.drop(*[n for n in self.names if n not in names])

    def remove(self) -> None:
        """Drops the whole folder; what still reads from it fails."""
        self._delete(self.path)
        self.names.clear()
