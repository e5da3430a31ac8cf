"""Turning raw corpora into records: filters, ordered deduplication, joins by file name, record shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import cut


def keep_first(df: DataFrame, key: str, ord_: str) -> DataFrame:
    """AGG-5: of the rows with one key (nulls are one key) the first in order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(ord_))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def greedy_dedup(df: DataFrame, ord_: str, keys: list[Column], within: str | None = None) -> DataFrame:
    """AGG-6: in order, a row is kept unless one of its key values has been seen in a row that was kept.

    Rounds over what is undecided: a row that comes first under all of its keys is kept, and decides every row that
    shares a key with it. The first undecided row is always kept, so rounds end; each is a few aggregates and joins
    over narrow rows. Nulls are values. within: keys count separately in each of its values.
    """
    part = F.col(within).cast("string") if within else F.lit("")
    values = F.array(*(F.struct(F.lit(i).alias("k"), F.sha2(F.to_json(F.struct(part.alias("p"), c.alias("v"))), 256).alias("value")) for i, c in enumerate(keys)))
    left = cut(df.select(F.col(ord_).alias("ord"), F.inline(values)))
    kept, rounds = None, 0
    while not left.isEmpty():
        first = left.groupBy("k", "value").agg(F.min("ord").alias("first"))
        seen = cut(left.join(first, ["k", "value"]))
        new = seen.groupBy("ord").agg(F.every(F.col("ord") == F.col("first")).alias("all")).where("all").select("ord")
        kept = new if kept is None else kept.unionByName(new)
        rounds += 1
        if rounds % 8 == 0:  # what is kept stays one table, however many rounds there are
            kept = cut(kept)
        decided = seen.join(new.withColumnRenamed("ord", "first"), "first", "left_semi").select("ord").distinct()
        left = cut(left.join(decided, "ord", "left_anti"))
    return df.limit(0) if kept is None else df.join(kept.withColumnRenamed("ord", ord_), ord_, "left_semi")


def until_first(df: DataFrame, ord_: str, stop: Column) -> DataFrame:
    """FLT-8: the rows before the first for which stop holds; all of them if there is none. The place of that row is a plain filter, which reaches the scan."""
    at = df.where(stop).agg(F.min(ord_)).first()[0]
    return df if at is None else df.where(F.col(ord_) < F.lit(at))


def with_files(df: DataFrame, path: str, files: DataFrame, file: str) -> DataFrame:
    """JOI-1, PRJ-3, STR-22: rows whose path's base name is listed, with the path that is listed last for its stem."""
    listed = files.select(T.basename(F.col(file)).alias("_name"), T.stem(F.col(file)).alias("_stem"), F.col(file).alias("_file"))
    paths = listed.groupBy("_stem").agg(F.max("_file").alias("_found"))
    out = df.withColumn("_name", T.basename(F.col(path))).withColumn("_stem", T.stem(F.col(path)))
    out = out.join(listed.select("_name").distinct(), "_name", "left_semi").join(paths, "_stem", "left")
    return out.withColumn(path, F.coalesce("_found", path)).drop("_name", "_stem", "_found")


def last_turn(turns: Column, role: str) -> Column:
    """PRJ-5: the value of the last turn of a role, without the image mark; null without one."""
    found = F.filter(turns, lambda t: t["from"] == role)
    return T.pstrip(F.replace(F.get(found, F.size(found) - 1)["value"], F.lit("<image>"), F.lit("")))


def first_match(values: Column, views: Column, wanted: tuple[str, ...]) -> Column:
    """AGG-7, ARR-1, FLT-6, FLT-7: the first value whose view is wanted; null if the arrays disagree in length."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (values, views))
    pairs = F.filter(F.arrays_zip(a.alias("value"), b.alias("view")), lambda x: x["view"].isin(*wanted))
    return F.when(F.size(a) == F.size(b), F.get(pairs, F.lit(0))["value"])


def concat_sources(*sources: DataFrame) -> DataFrame:
    """SET-1: one after another, with the source's rank."""
    return reduce(DataFrame.unionByName, (s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)))


def latest(df: DataFrame, key: str, ord_: str) -> DataFrame:
    """SET-2, AGG-14: the last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ord_)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def resolve(df: DataFrame, candidates: Column, table: DataFrame, key: str) -> DataFrame:
    """JOI-9: for each row the entry of the first candidate key that the table has; null if none."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    tried = rows.select("_row", F.posexplode(candidates).alias("_prio", key))
    hit = tried.join(table, key).groupBy("_row").agg(F.min_by(F.struct(*table.columns), "_prio").alias("hit"))
    return rows.join(hit, "_row", "left").drop("_row")
