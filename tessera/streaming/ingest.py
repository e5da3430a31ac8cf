"""An extra beyond batch: the stateless text operators over a stream, with logs that let a run go on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import index as I


def records(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """New JSON lines files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def categorized(stream: DataFrame, key: str, reason: str, categories: DataFrame) -> DataFrame:
    """key, pos, fragment, final_category: a static table of fragments joined to a stream's (JOI-5's shape); "" where unknown. Spark broadcasts the table if its size allows."""
    parts = I.fragments(stream, key, reason)
    return parts.join(categories.select("fragment", "final_category"), "fragment", "left").withColumn("final_category", F.coalesce("final_category", F.lit("")))


def append(stream: DataFrame, out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Writes what the output doesn't hold yet; a batch that is repeated after a failure adds nothing twice."""

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.withColumn("epoch", F.lit(epoch).cast("long"))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out)

    return stream.dropDuplicates([key, "pos"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts and sums of events by window and kind; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), kind).agg(F.count(F.lit(1)).alias("n"))
