"""Session settings and shared-folder tables that the operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.functions import broadcast, count, lit

from tesselune.session import ready
from tesselune.storage import remove, shared_dir, stored

#: A side of a join of at most so many bytes, as counted, is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def tune(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, and shuffle files that go when the write that needed them is over."""
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small(df: DataFrame, rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of df if its counted rows keep to ``most`` bytes; otherwise the join shuffles."""
    return broadcast(df) if rows * row_bytes <= most else df


class Scratch:
    """The written tables of one call under one shared folder; each can be dropped when it is read no more.

    Broadcasts of the call keep to ``most`` bytes each, which the driver holds while it builds them.
    """

    def __init__(self, spark: SparkSession, most: int = BROADCAST_BYTES):
        self.spark, self.root, self.made, self.most = spark, shared_dir(spark), 0, most
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.rows: dict[int, int] = {}

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        out = stored(df, path)
        self.paths[id(out)] = out, path
        return out

    def counted(self, df: DataFrame) -> DataFrame:
        """The same, with its rows counted as they are written, for ``size``."""
        seen = Observation()
        out = self.put(df.observe(seen, count(lit(1)).alias("n")))
        self.rows[id(out)] = seen.get["n"]
        return out

    def seen(self, df: DataFrame, what: Column) -> tuple[DataFrame, int]:
        """The same, and an aggregate of the rows taken as they are written, so that no job reads them again; 0 for null."""
        seen = Observation()
        out = self.put(df.observe(seen, what.alias("what")))
        return out, seen.get["what"] or 0

    def size(self, df: DataFrame) -> int:
        return self.rows[id(df)]

    def small(self, df: DataFrame, row_bytes: int) -> DataFrame:
        """``small`` of a counted table."""
        return small(df, self.size(df), row_bytes, self.most)

    def view(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """df, columns of a written table, to be dropped in its stead."""
        self.paths[id(df)] = df, self.paths.pop(id(table))[1]
        if id(table) in self.rows:
            self.rows[id(df)] = self.rows.pop(id(table))
        return df

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if df is not None and id(df) in self.paths:
                remove(self.spark, self.paths.pop(id(df))[1])
                self.rows.pop(id(df), None)

    def drop_all_but(self, *tables: DataFrame | None) -> None:
        keep = {id(df) for df in tables}
        self.drop(*(df for df, _ in list(self.paths.values()) if id(df) not in keep))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
