"""Cutting lineage with tables written to the session's shared checkpoint folder.

Iterative operators write each round as Parquet there, so a lost executor costs
a re-read and not a recomputation of every earlier round. Parquet also gives the
next round exact sizes, which is what the optimizer picks join strategies from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's folder; else a folder of the session's
    warehouse, which every executor reaches too. Never a machine's temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediates").rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/spark_climbs/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return it as a scan of the written table."""
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    written = spark.read.schema(df.schema).parquet(path)
    written.__dict__["_materialized_at"] = path
    for made in _OPEN:
        made.append((spark, path, None))
    return written


def save_bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """Write ``df`` once as a table bucketed and sorted by a column, so that joins on it
    read the table without a shuffle."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    for made in _OPEN:
        made.append((spark, f"/{name}", name))
    return spark.table(name)


#: Lists in which open ``made_here`` blocks note tables.
_OPEN: list[list] = []


@contextmanager
def made_here() -> Iterator[Callable[[list[str]], None]]:
    """Note the tables written inside the block; gives what deletes them, but for those
    that hold one of the given files (which something still reads)."""
    made: list = []

    def delete(read: list[str]) -> None:
        for spark, path, table in made:
            if any(path in f for f in read):
                continue
            if table is None:
                _delete(spark, path)
            else:
                spark.sql(f"drop table if exists {table}")

    _OPEN.append(made)
    try:
        yield delete
    finally:
        _OPEN.remove(made)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more, as those of the round
    before the last. Anything else is left alone."""
    for table in tables:
        path = None if table is None else table.__dict__.pop("_materialized_at", None)
        if path:
            _delete(table.sparkSession, path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete every table this application has materialized. DataFrames built on them
    can no longer be computed."""
    _delete(spark, _session_dir(spark))
