"""Sinks that a batch may reach twice: a keyed table of last writes, and a split of late rows. Both are for foreachBatch.

A batch writes only below a folder of its own number and overwrites what an earlier try has left there, so a batch that is
run again after a failure changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.store import shared_dir


def written(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has written the folder to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete folders n=<number> below a path, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n[2:]) for n in names if n.startswith("n=") and written(spark, f"{path}/{n}"))


class LastWrites:
    """A table with one row a key, the last of all its writes by `order`, in a folder.

    A batch adds its own last writes to changes/n=<batch>; compact() folds all changes into base/n=<batch>, from where
    reading goes on. Nothing that is there is rewritten, so a batch costs what it holds and not what the table holds.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str]):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order

    def last(self, rows: DataFrame) -> DataFrame:
        """Each key's row that is last by `order`; a null comes before all others."""
        found = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(*self.order)).alias("_row"))
        return found.select("_row.*")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        self.last(batch).write.mode("overwrite").parquet(f"{self.path}/changes/n={number}")

    def _parts(self) -> tuple[list[int], list[int]]:
        base = versions(self.spark, f"{self.path}/base")[-1:]
        return base, [n for n in versions(self.spark, f"{self.path}/changes") if not base or n > base[0]]

    def rows(self) -> DataFrame:
        base, changes = self._parts()
        paths = [f"{self.path}/base/n={n}" for n in base] + [f"{self.path}/changes/n={n}" for n in changes]
        return self.last(self.spark.read.schema(self.schema).parquet(*paths)) if paths else self.spark.createDataFrame([], self.schema)

    def compact(self) -> None:
        """Reads fewer folders from now on; run again after a failure, it starts anew."""
        _, changes = self._parts()
        if changes:
            self.rows().write.mode("overwrite").parquet(f"{self.path}/base/n={changes[-1]}")


class LateRows:
    """Splits a stream at its watermark: rows in time go to on_time/n=<batch>, those behind it to late/n=<batch>.

    The watermark of a batch is the highest `ts` of the batches before it less the lateness; rows that are not later are late.
    Spark's own stateful operators drop no other rows, and of these only those behind the watermark of one batch before. A batch leaves its highest time in highest/n=<batch>; rows without a time
    are in time.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str, lateness: str):
        self.spark, self.path, self.ts, self.lateness = spark, path, ts, lateness

    def split(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        before = [n for n in versions(self.spark, f"{self.path}/highest") if n < number]
        highest = self.spark.read.schema("ts timestamp").parquet(*[f"{self.path}/highest/n={n}" for n in before[-1:]]).first()[0] if before else None
        mark = F.date_trunc("millisecond", F.lit(highest).cast("timestamp")) - F.expr(f"interval {self.lateness}")
        late = F.coalesce(F.col(self.ts).cast("timestamp") <= mark, F.lit(False)) if highest is not None else F.lit(False)
        batch.where(~late).write.mode("overwrite").parquet(f"{self.path}/on_time/n={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{self.path}/late/n={number}")
        top = F.greatest(F.max(F.col(self.ts).cast("timestamp")), F.lit(highest).cast("timestamp"))
        batch.agg(top.alias("ts")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/highest/n={number}")

    def rows(self, side: str, schema: str) -> DataFrame:
        """on_time or late rows of all batches."""
        found = versions(self.spark, f"{self.path}/{side}")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{side}/n={n}" for n in found]) if found else self.spark.createDataFrame([], schema)


def drained_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], label: str, mode: str = "append"):
    """Gives all that is there now to a foreachBatch sink; the query, which has ended."""
    path = f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", path).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return run
