"""Line-JSON and keyed Parquet sources and sinks, small dimensions, reports, and a memo of costly calls."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything on its file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Lines of JSON under an explicit schema; blank lines are passed over, a missing path is an empty table, patterns are allowed."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str, schema: str | StructType) -> DataFrame:
    """Appends rows whose key the output lacks; returns those appended, read back."""
    done = read_json_lines(df.sparkSession, path, schema).select(key).distinct()
    fresh = df.join(done, key, "left_anti").dropDuplicates([key])
    fresh.select(*[f.split()[0] for f in schema.split(", ")] if isinstance(schema, str) and "<" not in schema else df.columns).write.mode("append").json(path)
    return fresh


def merged(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of `new` in place of old ones with their key; nulls in keys are dropped."""
    rows = new.withColumn("_run", F.lit(1)) if old is None else new.withColumn("_run", F.lit(1)).unionByName(old.withColumn("_run", F.lit(0)))
    best = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*[c for c in rows.columns]), "_run").alias("_r"))
    return best.select("_r.*").drop("_run")


def merge_partitions(spark: SparkSession, new: DataFrame, path: str, key: str, partition: str, fresh: bool = False) -> None:
    """Keyed merge into a partitioned table: moved rows change their folder, emptied folders vanish.

    The merged table is written beside the old one, which is set aside before
    the new one takes its place and deleted last: whenever a run is cut off, one
    whole table stands at the path, beside it as `.next` or set aside as `.old`,
    and the next run puts it back. `fresh` starts anew.
    """
    jvm = spark.sparkContext._jvm
    target, beside, aside = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".next", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(aside):
        fs.rename(aside, target)
    old = spark.read.parquet(path) if not fresh and fs.exists(target) else None
    rows = merged(old.select(*new.columns) if old is not None else None, new, key)
    rows.write.mode("overwrite").partitionBy(partition).parquet(beside.toString())
    fs.delete(aside, True)
    if fs.exists(target):
        fs.rename(target, aside)
    fs.rename(beside, target)
    fs.delete(aside, True)


def dimension(spark: SparkSession, path: str, schema: str | StructType, root: str | None = None) -> DataFrame:
    """A small table from a JSON or, where a reader is installed, YAML file: a list of records, or one below `root`."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading YAML needs a YAML reader; JSON always works") from e
            data = yaml.safe_load(file)
        else:
            data = json.load(file)
    return spark.createDataFrame(data[root] if root else data, schema)


def write_report(df: DataFrame, path: str, *order: Column | str) -> None:
    """A tab-separated report in order, in as many files as its size asks for; the names of the files follow the order."""
    df.orderBy(*order).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def unique(df: DataFrame, key: str) -> DataFrame:
    """The table, checked: raises if a key repeats."""
    repeated = df.groupBy(key).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"{key} is not unique")
    return df


def memo_key(*parts: Column) -> Column:
    """Key of a costly call: hash of its parts, composed and trimmed."""
    return F.sha2(F.to_json(F.array(*[F.trim(p.cast("string")) for p in parts])), 256)


def memoised(rows: DataFrame, memo: DataFrame | None, call, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(results of all rows, results to add to the memo): only keys the memo lacks are called, each once.

    `call` maps rows with `key` to rows (key, value); memo rows with a null value are as if missing.
    """
    if memo is None:
        new = call(rows.dropDuplicates([key]))
        return rows.join(new, key, "left"), new
    good = memo.where("value IS NOT NULL").dropDuplicates([key])
    new = call(rows.join(good.select(key), key, "left_anti").dropDuplicates([key]))
    return rows.join(good.select(key, "value").unionByName(new.select(key, "value")), key, "left"), new


def claims(entities: DataFrame, times: tuple[str, ...], relations: tuple[str, ...]) -> DataFrame:
    """(id, times map, rels map) of raw entities (id, claims map of statement arrays): deprecated ranks and missing values are left out."""
    good = lambda s: (F.coalesce(s["rank"], F.lit("normal")) != "deprecated") & (s["snaktype"] == "value")

    def kept(names: tuple[str, ...], field: str) -> Column:
        chosen = F.map_filter("claims", lambda p, _: p.isin(*names))
        return F.map_filter(F.transform_values(chosen, lambda _, v: F.transform(F.filter(v, good), lambda s: s[field])), lambda _, v: F.size(v) > 0)

    return entities.select("id", kept(times, "time").alias("times"), kept(relations, "target").alias("rels"))


def latest_by(df: DataFrame, keys: Mapping[str, str] | list[str], order: list[Column]) -> DataFrame:
    """One row per key by a window; for keys without heavy repeats."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
