"""Language identification by n-gram filters whose cells are bitmasks of languages.

Each learned language puts its frequent letter trigrams into a Bloom filter of BITS cells. The filters are stored
bit-sliced: one array whose cell holds a mask with a bit for each language, so one look-up of HASHES cells returns
all languages that contain a trigram. Over the trigrams of a text, the set bits are counted for each language,
corrected for the false positives that the language's filled share predicts, and the highest count decides.

Learning reads a bounded sample: up to SAMPLE learnable documents of each language, those least in a hash of id and text;
prediction reads every whole text, and nothing but the text, a very long one a part at a time.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text with letters but no trigram of any
language gets the most common learned language, with score 0; ties go to the name first in order; without learnable
rows all are `und`; null ids and null labels are not learned from; repeated rows are predicted alike; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, table

SAMPLE = 1500
#: Cells of the hash in which the sample's rows are counted.
CELLS = 1 << 16
#: Size of the model, not of what it learns from: trigrams that a language puts in, the most frequent first, as far as all that are
#: equally frequent fit in (the first of these always do). More of them fill the filter, so that false positives, for which the counts are corrected, weigh more.
GRAMS = 8000
#: A trigram is put in where the share of documents with it is this part of its greatest share in a language at least.
TYPICAL = 0.25
BITS = 1 << 18
HASHES = 3
UNKNOWN = "und"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CHUNK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Codes of the text's trigrams, lower-cased, whose middle is a letter; other characters are all the blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for k in range(0, len(codes), _CHUNK):
        part = np.r_[codes[k - 1] if k else 32, codes[k : k + _CHUNK + 1]].astype(np.uint64)
        if k + _CHUNK >= len(codes):
            part = np.r_[part, np.uint64(32)]
        ok = _letters()[part]
        part = np.where(ok, part, np.uint64(32))
        yield (part[:-2] << np.uint64(42) | part[1:-1] << np.uint64(21) | part[2:])[ok[1:-1]]


def cells(codes: np.ndarray) -> list[np.ndarray]:
    """The filter cells of each trigram, one array for each hash."""
    out = []
    for m in _MIX[:HASHES]:
        h = (codes ^ (codes >> np.uint64(29))) * np.uint64(m)
        out.append(((h ^ (h >> np.uint64(32))) * np.uint64(m) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64))
    return out


class Filters:
    """Bit-sliced filters: masks[cell, i] has bit j for language 64 i + j."""

    def __init__(self, grams: dict[str, np.ndarray], counts: dict[str, int]) -> None:
        self.names = sorted(grams)
        self.common = max(self.names, key=lambda n: (counts.get(n, 0), n)) if self.names else UNKNOWN
        self.masks = np.zeros((BITS, -(-len(self.names) // 64)), dtype=np.uint64)
        for i, name in enumerate(self.names):
            for c in cells(grams[name]):
                self.masks[c, i // 64] |= np.uint64(1 << i % 64)
        self.false = np.array([np.mean(self.masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) ** HASHES for i in range(len(self.names))])

    def predict(self, text: str | None) -> tuple[str, float]:
        hits, total = np.zeros(len(self.names)), 0
        for codes in trigrams(text or ""):
            total += len(codes)
            if not len(codes) or not self.names:
                continue
            first, *rest = cells(codes)
            found = self.masks[first]
            for c in rest:
                found &= self.masks[c]
            for j in range(found.shape[1]):
                own = slice(64 * j, min(64 * j + 64, len(self.names)))
                if own.stop - own.start <= 12:  # few languages: count each mask, then add up its bits
                    n = np.bincount(found[:, j].astype(np.int64), minlength=1 << (own.stop - own.start))
                    hits[own] += n @ (np.arange(len(n))[:, None] >> np.arange(own.stop - own.start) & 1)
                else:
                    hits[own] += [np.count_nonzero(found[:, j] >> np.uint64(b) & np.uint64(1)) for b in range(own.stop - own.start)]
        if not total or not self.names:
            return UNKNOWN, 0.0
        real = np.maximum((hits - total * self.false) / (1 - np.minimum(self.false, 0.999)), 0.0)
        if not real.any():
            return self.common, 0.0
        return self.names[int(np.argmax(real))], float(min(1.0, real.max() / real.sum()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, trigram, documents that have it."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(np.unique(np.concatenate([*trigrams(text), np.empty(0, np.uint64)])))
        for lang, found in by.items():
            codes, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of the languages in docs, which must hold learnable rows only."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # One row for each language and cell of hashes is counted, one for each language reaches the driver: its rows.
    cell = F.shiftrightunsigned(F.col("h"), 64 - CELLS.bit_length() + 1)
    cells_ = rows.groupBy("lang", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in cells_.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cells_.withColumn("before", before).where(F.col("before") < SAMPLE).groupBy("lang").agg(F.max("cell").alias("last"), F.max_by("before", "cell").alias("before"))
    near = rows.withColumn("cell", cell).join(F.broadcast(first), "lang").where("cell <= last")
    # Whole cells below the last one, and of that one its first rows: all told SAMPLE rows of a language at most.
    rank = F.row_number().over(Window.partitionBy("lang", "cell").orderBy("h", "text"))
    sample = near.where("cell < last").unionByName(near.where("cell = last").withColumn("rank", rank).where((F.col("rank") <= SAMPLE) & (F.col("rank") <= SAMPLE - F.col("before"))).drop("rank"))
    sample = cut(sample.select("lang", "text"))
    grams = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    drawn = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    share = F.col("n") / F.col("docs")
    grams = grams.join(F.broadcast(drawn), "lang").withColumn("share", share).withColumn("most", F.max(share).over(Window.partitionBy("gram"))).where(F.col("share") >= F.col("most") * TYPICAL)
    # Trigrams in equally many documents stay or go together: a language's counts, not its trigrams, are put in order.
    grams = cut(grams.select("lang", "gram", "n"))
    upto = F.sum("many").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    classes = grams.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("many")).withColumn("upto", upto).where((F.col("upto") <= GRAMS) | (F.col("upto") == F.col("many")))
    kept = grams.join(F.broadcast(classes), ["lang", "n"]).select("lang", "gram").toPandas()
    return Filters({k: g["gram"].to_numpy().view(np.uint64) for k, g in kept.groupby("lang")}, counts)


def predict(text: Column, filters: Filters) -> Column:
    """struct<lang, score> of every text."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        own = held.value
        found = [own.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang", "score"])

    return of(text)


def held_out(id_: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), filters).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


SQL: dict[str, str] = {}
QUERIES = {"op7_language": op7_language}
