"""What the corpus operators share: table access, checkpoints, text normalisation, row names."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 2000
#: Ways a hot key is split.
SALTS = 32


#: Bytes of a batch of rows that goes to a Python worker; workers hold a few at a time.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is given at once by bytes, so long texts don't add up to more than it may hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Gives a Python worker's freed memory back to the system; workers idle on between tasks, beside the next stage's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by path; only Spark's readers open it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session without it gets its own."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from reliable files, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables of one job in a folder of its own below the shared one. Loops keep their state here: unlike a checkpoint, which carries
    the size estimate of its whole history (a product over its joins), a table is as large as its files."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have (column names clash without regard to case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


#: Rows (an id and a digest, 40 bytes or so) that every worker may be given; more are exchanged and joined.
FEW_ROWS = 500_000


def without(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, few: int = FEW_ROWS) -> DataFrame:
    """docs but for the rows in lost (id, key: XXH64 of the text). Texts stay where they are while lost is small, which is checked."""
    id_, key = fresh(docs, "lost_id", "lost_key")
    lost = cut(lost.select(F.col("id").alias(id_), F.col("key").alias(key)).distinct())
    lost = F.broadcast(lost) if lost.count() <= few else lost
    return docs.join(lost, docs[id_col].eqNullSafe(lost[id_]) & (F.xxhash64(docs[text_col]) == lost[key]), "left_anti")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the fast lower(), which is the same there."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for, at least one for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with one row for each key. per_key counts, in column count, how many of rows have its key.

    Keys of more than HOT_SHARE of what is counted are few by arithmetic, so they are broadcast and their rows stay
    where they are; the others are exchanged by key.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) > max(1, int(total * HOT_SHARE))
    hot = F.broadcast(per_key.where(large))
    rest = rows.join(hot.select(key), key, "left_anti").join(per_key.where(~large), key)
    return rows.join(hot, key).unionByName(rest)
