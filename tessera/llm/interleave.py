"""Sharding by proportional stratified interleaving: every shard matches the mixture of sources.

Rows are shuffled within their source by a seeded digest, ranked there, sorted by the rank's fraction of the
source, and cut into shards whose row counts differ by one at most (law `rows`). Native: no Python runs on rows.

Both rankings are exact without a task that holds a whole source or the whole table: a row's rank is the count
of the rows in lower buckets (a running sum over their counts) plus its place within its bucket, and
buckets, whose number grows with the rows, are cut from a digest or from an evenly spread fraction, so a source of a third of all rows spreads
over all of them. Texts never leave the scan; only narrow rows are exchanged.

Defined cases: a null text has size 16 and checksum 0; null sources form one stratum; null ids and repeated
rows are ordered by what else is known of them, and rows alike in all of it are interchangeable; with fewer rows
than shards some shards are empty; very long texts are measured where they are read; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Buckets of each ranking, and rows that one may hold on average: with more rows there are more buckets. Running sums are
#: over that many counts.
BUCKETS, BUCKET_ROWS = 4096, 16_384
OVERHEAD = 16


def shards(docs: DataFrame, n_shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, source, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("stratum"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
    )
    bits = max(BUCKETS, docs.count() // BUCKET_ROWS).bit_length() - 1
    rows = rows.withColumn("bucket", F.shiftrightunsigned(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits).cast("int"))
    order = ("key", "id", "text_crc32", "size")
    whole, before = Window.partitionBy("stratum"), Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("stratum", "bucket").count().select("stratum", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"), F.sum("count").over(whole).alias("of"))
    place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order))
    ranked = rows.join(sums, ["stratum", "bucket"]).withColumn("fraction", (F.col("below") + place - F.lit(0.5)) / F.col("of"))
    ranked = cut(ranked.select("id", "stratum", "size", "text_crc32", "key", "fraction", F.least(F.floor(F.col("fraction") * (1 << bits)), F.lit((1 << bits) - 1)).cast("int").alias("cell")))
    # One row for each bucket reaches this window.
    one = Window.partitionBy(F.lit(0))
    cells = ranked.groupBy("cell").count().select("cell", F.coalesce(F.sum("count").over(one.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("count").over(one).alias("total"))
    at = F.col("below") + F.row_number().over(Window.partitionBy("cell").orderBy("fraction", "stratum", *order)) - 1
    out = ranked.join(cells, "cell").withColumn("at", at)
    # Integer arithmetic: the first place of a shard is the least one that the division sends to it.
    out = out.withColumn("shard", F.expr(f"cast((at * {n_shards}) div total as int)")).withColumn("slot", F.expr(f"at - ((shard * total + {n_shards - 1}) div {n_shards})"))
    return out.select("id", F.expr("if(stratum = '', null, substring(stratum, 2))").alias("source"), "size", "text_crc32", "shard", "slot")


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = {
    # The checksum is CRC-32 of the UTF-8 bytes, from its polynomial.
    "op3_interleave": """
        WITH crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
        ), d AS (
            SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size,
                   md5('17:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
        ), c AS (
            SELECT doc_id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT),
                       lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
            FROM d, crc
        ), f AS (
            SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM d
        ), r AS (
            SELECT *, row_number() OVER (ORDER BY fraction, source, key, doc_id) - 1 AS pos, count(*) OVER () AS total FROM f
        ), s AS (SELECT *, (pos * 40 // total)::INTEGER AS shard FROM r)
        SELECT s.doc_id, size::BIGINT AS size, coalesce(text_crc32, 0)::BIGINT AS text_crc32, 'rows' AS law, shard,
               pos - (shard * total + 39) // 40 AS slot, NULL::INTEGER AS grown_shard
        FROM s JOIN c USING (doc_id)
    """,
}
QUERIES = {"op3_interleave": op3_interleave}
