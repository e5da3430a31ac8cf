"""Exact deduplication: local winners, salted merges of hot digests, then a global merge, by full content.

Native: DataFrame operations only.

Defined cases: a null text counts as empty; a null id is below every other id; rows that repeat an id within
a group of equal texts count one by one, and exactly one of the rows with the largest id stays; very long texts are
compared whole; an empty table
gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import HOT_SHARE, SALTS, cut, fresh, lower_az, table


def _sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _normal(c: Column) -> Column:
    return lower_az(F.coalesce(c, F.lit("")))


def _hot(ids: DataFrame) -> DataFrame:
    """Digests of more than HOT_SHARE of all rows: at most 1 / HOT_SHARE rows, so a broadcast is bounded."""
    least = int(ids.count() * HOT_SHARE)
    return ids.groupBy("digest").count().where(F.col("count") > F.lit(max(least, 1))).select("digest")


def _salt(c: Column) -> Column:
    return F.pmod(F.hash(c), F.lit(SALTS))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row for each row of docs: id, digest, keep_id, group_size, kept.

    Rows are keyed by digest, but every merge also compares the full text: first within each task (the partial
    aggregate before the exchange), then within each salt of a hot digest, then over the salts' winners. One
    aggregate serves the first two, as digests that aren't hot have one salt; only hot digests need the third, so each
    distinct text of the others crosses the network once. The way
    back to the rows uses digests alone; should two texts ever share one, it compares full texts too.
    """
    rows = docs.select(F.col(id_col).alias("id"), _normal(F.col(text_col)).alias("norm"))
    rows = rows.select("id", "norm", digest(F.col("norm")).alias("digest"))
    ids = cut(rows.select("id", "digest"))
    hot = F.broadcast(_hot(ids))
    merge = (F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    marked = rows.join(hot.withColumn("hot", F.lit(True)), "digest", "left").withColumn("salt", F.when(F.col("hot"), _salt(F.col("id"))).otherwise(0))
    # A flag of the aggregate, not of its rows, tells them apart, so both branches read one exchange.
    salted = marked.groupBy("digest", "norm", "salt").agg(*merge, F.bool_or(F.col("hot")).alias("many"))
    cold = salted.where("many is null").select("digest", "norm", "keep_id", "group_size")
    warm = salted.where("many").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    won = cold.unionByName(warm)
    winners = cut(won.select("digest", "keep_id", "group_size"))
    if winners.groupBy("digest").count().where("count > 1").isEmpty():
        few = F.broadcast(winners.join(hot, "digest", "left_semi"))
        out = ids.join(few, "digest").unionByName(ids.join(hot, "digest", "left_anti").join(winners, "digest"))
    else:
        out = rows.join(won, ["digest", "norm"]).drop("norm")
    again = Window.partitionBy("digest", "keep_id", "id").orderBy("id")
    return out.select("id", "digest", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(again) == 1)).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without copies, all columns kept: of equal texts the row with the largest id stays.

    The same three stages on whole rows: a window keeps the first row of each group, which Spark applies within
    each task before the exchange as well; hot digests go through salted groups before the global one.
    """
    digest, norm, salt = fresh(docs, "digest", "norm", "salt")
    rows = docs.withColumn(norm, _normal(F.col(text_col))).withColumn(digest, _sha256(F.col(norm)))
    hot = F.broadcast(_hot(cut(rows.select(F.col(digest).alias("digest")))).withColumnRenamed("digest", digest))

    def first(df: DataFrame, *keys: str) -> DataFrame:
        (rank,) = fresh(df, "rank")
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(id_col)))).where(F.col(rank) == 1).drop(rank)

    cold = first(rows.join(hot, digest, "left_anti"), digest, norm)
    warm = first(rows.join(hot, digest, "left_semi").withColumn(salt, _salt(F.col(id_col))), digest, norm, salt)
    return cold.unionByName(first(warm.drop(salt), digest, norm)).select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY norm)
    """,
}
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
