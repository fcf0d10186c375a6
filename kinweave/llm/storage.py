"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column of ``columns`` has, in any case."""
    taken = {x.lower() for x in columns}
    lead = "_"
    while any((lead + x).lower() in taken for x in names):
        lead += "_"
    return [lead + x for x in names]


class Scratch:
    """Cuts lineage with Parquet tables under the shared folder, which survive the loss of executors.

    ``keep`` writes and rereads; ``drop`` deletes what no later plan reads. A table that the returned
    DataFrame still reads stays for the life of the session, as a checkpoint would.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._written: list[str] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.write(df, name)[0]

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        to = self.path(name)
        df.write.option("compression", "zstd").parquet(to)
        self._written.append(to)
        return self.spark.read.schema(df.schema).parquet(to), to

    def drop(self, path: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


    def sweep(self, *keep: str) -> None:
        """Drops all tables but these paths: the last step before a lazy result is returned."""
        for path in self._written:
            if path not in keep:
                self.drop(path)
        self._written = list(keep)


@lru_cache(maxsize=64)
def _place_keys(spark: SparkSession, width: int) -> tuple[int, ...]:
    """For each of ``width`` partitions, a number that Spark's hash partitioning sends there."""
    n, found = 16 * width, {}
    while len(found) < width:
        for row in spark.range(n).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(width)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect():  # at most width rows
            found[row["p"]] = row["k"]
        n *= 4
    return tuple(found[p] for p in range(width))


def deal(df: DataFrame, width: int, number: str) -> DataFrame:
    """Rows by a dense number to the partition of that number modulo ``width``: evenly, where a hash of few numbers isn't."""
    keys = F.array(*map(F.lit, _place_keys(df.sparkSession, width)))
    return df.repartition(width, F.element_at(keys, F.pmod(F.col(number), F.lit(width)).cast("int") + 1))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size, file sizes for a scan; 0 if it has none. Runs no job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
