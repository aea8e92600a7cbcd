"""Tables in the folder that all executors share, which end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local session gets one of its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="leafmill-"))
    return _OWN[0]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_table(df: DataFrame, label: str, key: str) -> tuple[DataFrame, Callable[[], object]]:
    """df stored in buckets of the key, as many as a shuffle has partitions, so that joins on the key shuffle only their other side.

    Spark reads buckets from named tables only; the second result drops the name when nothing reads the table any more.
    The files lie in the shared folder as those of stored() do.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name), lambda: spark.sql(f"DROP TABLE {name}")


def write_by_key(df: DataFrame, path: str, key: str, most: int = 1_000_000) -> None:
    """df as one folder a key, with one file of at most `most` rows, or more files where a key has more rows.

    Keys should be few beside the rows (sources, days, shelves of ids); a reader that filters on the key opens its folders only.
    Writing again replaces the folder.
    """
    df.repartition(key).write.mode("overwrite").option("maxRecordsPerFile", most).partitionBy(key).parquet(path)
