"""Near-duplicates by SimHash: fingerprints, pivot distance tables, connected components.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's word shingles, repeats included.
Distinct fingerprints stand for all their documents, so copies cost nothing further. Two fingerprints within
MAX_BITS = 3 bits agree wholly in two of five blocks of bits at least; each is listed under each pair of blocks,
which brings every such pair into one run, and few others. Within a run rows carry their Hamming distances to PIVOTS
fixed reference fingerprints, and are sorted by the first: a row meets those within MAX_BITS of it in that coordinate
alone, and of them two that differ in any other coordinate by more than MAX_BITS can't be close either
(triangle inequality) and are discarded; the exact distance is taken of the survivors only.

A key with more than LIMIT fingerprints is listed again under pairs of blocks of its remaining bits, and so on
until it is small or its remaining bits allow no more, so no task gathers an unbounded group, nothing is dropped
and no pair is lost. Of a key's links only a spanning forest is kept, so links stay below the rows listed.

Defined cases: a null text counts as empty; texts without a word have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; null ids are ignored when a component is named by its least id
(null when it has no other); very long texts are hashed whole, a part at a time; repeated rows count one by one; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, partitions, spread_join, table
from tessera.llm.components import components

MAX_BITS = 3
BLOCKS = 5
LIMIT = 4096
#: Reference fingerprints: fixed, spread over the space by a multiplicative sequence.
PIVOTS = np.cumsum(np.full(24, 0x9E3779B97F4A7C15, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
SEED = 42
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text. bytes.lower() and bytes.split() touch A-Z and the six ASCII white-space characters alone."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    rows = zip(*(found[i:] for i in range(words))) if len(found) >= words else iter([found])
    ones, total = np.zeros(64, dtype=np.int64), 0
    hashed = (xxhash.xxh64_intdigest(b" ".join(row), SEED) for row in rows)
    while len(block := np.fromiter(itertools.islice(hashed, _CHUNK), dtype=np.uint64)):
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: Column, words: int = 3) -> Column:
    """Fingerprints as signed longs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(x.as_py(), words) for x in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(fixed: int = 0) -> list[int]:
    """fixed and two of the five blocks of the other bits, for each two."""
    free = [i for i in range(64) if not fixed >> i & 1]
    blocks = [sum(1 << int(i) for i in x) for x in np.array_split(free, BLOCKS)]
    return [fixed | a | b for a, b in itertools.combinations(blocks, 2)]


def _listed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp under its bits in each mask."""
    listed = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    return listed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def close_in_run(fps: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) within equal runs whose fingerprints are within MAX_BITS bits; runs is sorted."""
    tables = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)  # the pivot distance table of these rows
    order = np.lexsort((tables[:, 0], runs))
    fps, tables = fps[order], tables[order]
    left, right, i, step = [], [], np.arange(len(fps)), 1
    while True:
        i = i[i + step < len(fps)]
        i = i[(runs[i] == runs[i + step]) & (tables[i + step, 0] - tables[i, 0] <= MAX_BITS)]  # sorted, so what fails here fails further on
        if not len(i):
            break
        near = i[(np.abs(tables[i, 1:] - tables[i + step, 1:]) <= MAX_BITS).all(axis=1)]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= MAX_BITS]
        left.append(near)
        right.append(near + step)
        step += 1
    return (order[np.concatenate(left)], order[np.concatenate(right)]) if left else (i, i)


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Which of the links join what isn't joined yet."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if (ra := root(a)) != (rb := root(b)):
            up[max(ra, rb)] = min(ra, rb)
            kept.append(k)
    return kept


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key); the last run of a batch waits for the next batch."""
    held: np.ndarray = np.empty((0, 3), dtype=np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        runs = np.cumsum(new)
        many = np.bincount(runs)[runs] > 1
        fps, runs = rows[many, 2], runs[many]
        i, j = close_in_run(fps.view(np.uint64), runs)
        k = _forest(i, j)
        return pa.record_batch({"a": fps[i[k]], "b": fps[j[k]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    for batch in batches:
        rows = np.concatenate([held, np.column_stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")])])
        if len(rows):
            last = np.searchsorted((rows[:, :2] == rows[-1, :2]).all(axis=1), True)
            held = rows[last:]
            if last:
                yield links(rows[:last])
    if len(held) > 1:
        yield links(held)


def near_links(fps: DataFrame) -> DataFrame:
    """fps: distinct column fp. Links (a, b) within MAX_BITS bits that join exactly what all such links join."""
    spark = fps.sparkSession
    todo, out = _listed(fps, block_masks()), None
    masks = {_signed(m): m for m in block_masks()}
    while True:
        # 12 bits that aren't fixed yet make no more than 4096 fingerprints.
        done = min(64 - m.bit_count() for m in masks.values()) <= 12
        large = todo.select("mask", "key").limit(0) if done else cut(todo.groupBy("mask", "key").count().where(F.col("count") > LIMIT).select("mask", "key"))
        done = done or large.isEmpty()
        small = todo if done else todo.join(large, ["mask", "key"], "left_anti")
        found = small.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linked, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if done:
            return out
        used = [masks[r.mask] for r in large.select("mask").distinct().collect()]  # no more than there are masks of this level
        finer = spark.createDataFrame([(_signed(m), [_signed(x) for x in block_masks(m)]) for m in used], "mask long, masks array<long>")
        masks = {_signed(x): x for m in used for x in block_masks(m)}
        todo = todo.join(large, ["mask", "key"]).join(F.broadcast(finer), "mask").select("fp", F.explode("masks").alias("mask"))
        todo = cut(todo.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct())


def groups(fps: DataFrame) -> DataFrame:
    """fps: columns id, fp. One row for each: id, fp, component_id (the least id of its component)."""
    least = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = components(near_links(least.select("fp")))
    named = linked.join(least.select(F.col("fp").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    # A component may hold any number of nodes.
    named = spread_join(linked, cut(named), "root", "nodes").select(F.col("node").alias("fp"), "component_id")
    every = cut(least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"))
    return spread_join(fps, every, "fp", "n").select("id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row for each row of docs: id, fp, component_id."""
    bound_batches(docs.sparkSession)
    return groups(cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp"))))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
QUERIES = {"op1_simhash": op1_simhash}
