"""Writers: Parquet rows first, the file shapes of the outside world on export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2, and SNK-1 in the form that can be written in parallel."""
    df.write.mode(mode).json(path)


def _one_file(rows: DataFrame, path: str, order: tuple[str, ...], ends: str) -> None:
    """rows (order, _row) as one text file between two brackets: one task, as such a file is, which sorts and streams but holds no list."""
    last = rows.limit(0).sparkSession.range(1).select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order), F.lit(None).cast("string").alias("_row"))
    every = rows.withColumn("_last", F.lit(0)).unionByName(last.withColumn("_last", F.lit(1)))
    every = every.coalesce(1).sortWithinPartitions("_last", *order).withColumn("_at", F.monotonically_increasing_id())
    opened = F.when(F.col("_at") == 0, ends[0]).otherwise(F.when(F.col("_last") == 0, ",").otherwise(""))
    every.select(F.concat(opened, F.coalesce("_row", F.lit(ends[1]))).alias("value")).write.mode("overwrite").text(path)


def json_array(df: DataFrame, path: str, *order: str) -> None:
    """SNK-1: one file that is one array, in order."""
    _one_file(df.select(*order, F.to_json(F.struct(*df.columns)).alias("_row")), path, order, "[]")


def by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """SNK-3: a folder for each split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def json_map(df: DataFrame, path: str, key: str) -> None:
    """SNK-4: one object by key, in its order; rows stay in Parquet for further use."""
    name = F.to_json(F.struct(F.col(key).cast("string").alias("k")))
    entry = F.concat(name.substr(F.lit(6), F.length(name) - 6), F.lit(": "), F.to_json(F.struct(*(c for c in df.columns if c != key))))
    _one_file(df.select(key, entry.alias("_row")), path, (key,), "{}")


def vectors(df: DataFrame, path: str) -> None:
    """SNK-5: key, embedding."""
    df.select("key", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def metrics_csv(tables: dict[str, DataFrame], base: str) -> None:
    """SNK-6: a CSV file for each of a few small tables."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{base}/{name}", header=True)


def metrics_json(df: DataFrame, path: str) -> None:
    """SNK-7."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK-8: entries added to those there are."""
    df.write.mode("append").json(path)


def flush(df: DataFrame, path: str, batch: int) -> None:
    """SNK-9: one batch of predictions, whole as soon as it is written; writing it once more, after a failure, replaces it."""
    df.write.mode("overwrite").json(f"{path}/batch={batch:06d}")


def per_parameters(df: DataFrame, path: str, *parameters: str) -> None:
    """SNK-10: a folder for each combination; those already there are kept, so a sweep can go on."""
    spark = df.sparkSession
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    if held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held):
        done = spark.read.parquet(path).select(*parameters).distinct()
        df = df.join(done, list(parameters), "left_anti")
    df.write.mode("append").partitionBy(*parameters).parquet(path)
