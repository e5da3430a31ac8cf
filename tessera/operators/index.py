"""Fragments of free text: links to their records, counts, stable ids, batches, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import cut


def fragments(records: DataFrame, key: str, reason: str, *carried: str) -> DataFrame:
    """key, carried columns, pos, fragment: the distinct fragments of each normalized reason in order (STR-1, STR-2, AGG-4, FLT-5)."""
    parts = F.array_distinct(T.split_fragments(T.normalize_reason(F.col(reason))))
    return records.where(F.length(reason) > 0).select(key, *carried, F.posexplode(parts).alias("pos", "fragment"))


def split_compound(links: DataFrame, split_map: DataFrame) -> DataFrame:
    """JOI-4, STR-4: fragments of six words and more that the map splits give its parts, unless all of them are blank.

    links: fragment and more; split_map: fragment, parts.
    """
    mapped = split_map.select("fragment", F.filter(F.transform("parts", T.pstrip), lambda x: x != "").alias("parts"))
    gate = (T.word_count(F.col("fragment")) >= 6) & (F.size("parts") > 0)
    joined = links.join(mapped, "fragment", "left")
    return joined.select(*(c for c in links.columns if c != "fragment"), F.posexplode(F.when(gate, F.col("parts")).otherwise(F.array("fragment"))).alias("part_pos", "part"))


def counts(links: DataFrame, key: str) -> DataFrame:
    """AGG-1: fragment, cnt, first_ord (the least key that has it)."""
    return links.groupBy("fragment").agg(F.count(F.lit(1)).alias("cnt"), F.min(key).alias("first_ord"))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with ids from 0 in an order that tells all rows apart.

    No task ranks the whole table: rows are sorted within ranges that Spark balances by a sample, and written; a row's
    place in its part, which is read in that order, is offset by the counts of the parts before.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sizes = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def ranked(df: DataFrame, text: str, name: str = "idx") -> DataFrame:
    """WIN-1: ids from 0 by word count, most first, then by text."""
    return numbered(df.withColumn("word_count", T.word_count(F.col(text))), name, F.desc("word_count"), F.asc(text))


def batch_id(idx: Column, size: int = 20) -> Column:
    """WIN-2."""
    return F.format_string("batch_%06d", F.floor(idx / size))


def pending(batches: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JOI-10, LLM-3: what no successful log entry has."""
    return batches.join(done.select(key).distinct(), key, "left_anti")


#: The lower and upper word counts of the histogram's buckets.
BUCKETS = ((1, 1), (2, 2), (3, 3), (4, 5), (6, 10), (11, 20), (21, 50), (51, None))


def length_histogram(df: DataFrame, count: str = "word_count") -> DataFrame:
    """AGG-11: bucket, lo, cnt, pct for every bucket, empty ones too."""
    spark = df.sparkSession
    edges = spark.createDataFrame([(f"{a}+" if b is None else f"{a}" if a == b else f"{a}-{b}", a) for a, b in BUCKETS], "bucket string, lo int")
    at = F.col(count)
    lo = F.coalesce(*(F.when((at >= a) & (F.lit(True) if b is None else at <= b), a) for a, b in reversed(BUCKETS)))
    got = df.groupBy(lo.alias("lo")).count()
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    out = edges.join(got, "lo", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return out.select("bucket", "lo", F.col("n").alias("cnt"), F.round(F.col("n") / total * 100, 6).alias("pct"))


def length_positions(df: DataFrame, count: str = "word_count") -> DataFrame:
    """AGG-10: values at fixed places of the lengths sorted downwards, by the place they are at; and their mean.

    The places are found in the counts of each length, of which there are few.
    """
    sizes = df.groupBy(F.col(count).alias("v")).count()
    down = Window.orderBy(F.desc("v"))
    sizes = sizes.select("v", "count", F.sum("count").over(down).alias("upto"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("n"))
    places = {"at_0": F.lit(0), "at_1_4": F.expr("n div 4"), "at_1_2": F.expr("n div 2"), "at_3_4": F.expr("3 * n div 4"), "at_90": F.floor(F.col("n") * F.lit(0.9)), "at_95": F.floor(F.col("n") * F.lit(0.95)), "at_99": F.floor(F.col("n") * F.lit(0.99)), "at_last": F.col("n") - 1}
    picks = [F.max(F.when(F.col("upto") > p, F.col("v"))).alias(name) for name, p in places.items()]
    return sizes.agg(*picks, F.round(F.sum(F.col("v") * F.col("count")) / F.sum("count"), 6).alias("mean"))
