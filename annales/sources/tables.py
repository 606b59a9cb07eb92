"""Parquet scans by table name and the keyed de-duplication of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def latest(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row per `key`: the one with the largest `order` values (null is smallest).

    Rows whose key is null are dropped. Built as one hash aggregation with a
    map-side combine, so a key that holds a third of all rows sends one row per
    input partition, not all of them. Ties on every order column fall to an
    arbitrary row of equal rank.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]) if order else F.lit(0)
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), rank).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in df.columns])


#: Bytes a core below which a table is spread over all cores before costly work on each row.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The table dealt out to all cores where its files, by their size, would keep only a few busy; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df
