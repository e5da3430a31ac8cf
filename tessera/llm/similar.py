"""Near-duplicates by word-shingle similarity, on wide SimHash fingerprints with pivot distance tables.

The three-bit links of simhash.py find texts that hardly differ. This interface finds texts whose sets of five-word
shingles are alike to a similarity (Jaccard) of 0.8 or more: at that similarity the fingerprints of BITS = 256 bits of
two texts differ in a known share of their bits, acos(2 s / (1 + s)) / pi, give or take a fiftieth.

Texts are brought together by their fingerprints: each is listed under BANDS keys of ROWS of its bits, of which two texts at
0.8 share one with a probability of 0.999 and more. Rows of one key are a run, and the first rows of a run are its pivots: rows
carry their distances to them and are sorted by the first, so a row meets those within a bound (with a margin) of it in that
coordinate, those further off in another can't be close either (triangle inequality), and the distance is taken of the
survivors. Those within the bound are put into one loose group. Loose groups decide nothing: within each, every pair of texts
that isn't joined yet is compared by its whole sets of shingles, and those of 0.8 and more are the links. A group of more than a
task should hold is dealt into blocks; what these leave apart is then compared block against block, so no task holds an
unbounded group and no pair is left out. A run of more than LIMIT texts is dealt into blocks likewise.

Defined cases: a null or wordless text is like no other but its copies; equal texts are one; of a group the least id
stays (nulls last, then the least digest of the text); rows equal in id and text all stay or go together; an empty
table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, bound_batches, cut, partitions, spread_join, trim, without
from tessera.llm.components import components
from tessera.llm.simhash import SEED
from tessera.llm.simhash import _forest as spanning

WORDS, SIMILARITY = 5, 0.8
BITS, BANDS, ROWS = 256, 80, 13
LIMIT = 2048
_WIDE = BITS // 64
_RNG = np.random.default_rng(20)
_SPREAD = _RNG.integers(0, 1 << 63, _WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits of a fingerprint that make each key.
_TAKEN = np.array([_RNG.choice(BITS, ROWS, replace=False) for _ in range(BANDS)])
#: Pivots of a run, and rows of a run whose pairs are taken with those of other runs.
PIVOTS, SHORT = 4, 128
_CHUNK = 4096


def bound(similarity: float) -> int:
    """Differing bits expected at a similarity, and four times their deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * share + 4 * math.sqrt(BITS * share * (1 - share)))


def hashes(text: str | None, words: int = WORDS) -> Iterator[int]:
    """Hashes of the text's shingles, repeats included; a text of fewer words is one shingle, one without a word none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    rows = zip(*(found[i:] for i in range(words))) if len(found) >= words else iter([found] if found else [])
    return (xxhash.xxh64_intdigest(b" ".join(row), SEED) for row in rows)


def sketch(text: str | None, words: int = WORDS) -> tuple[np.ndarray, int] | None:
    """Fingerprint words of one text and how many distinct shingles it has, None without a word."""
    hashed = np.unique(np.fromiter(hashes(text, words), dtype=np.uint64))  # distinct, as in the similarity
    if not len(hashed):
        return None
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashed), _CHUNK):
        h = hashed[k : k + _CHUNK]
        spread = (h ^ h >> np.uint64(31))[:, None] * _SPREAD
        ones += np.unpackbits((spread ^ spread >> np.uint64(29)).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashed)).view(np.uint64), len(hashed)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            found = [sketch(x.as_py()) for x in part.column(2)]
            fps = pa.array([x and x[0].tobytes() for x in found], pa.binary())
            yield pa.record_batch([part.column(0), part.column(1), fps], names=["id", "key", "fp"])
    trim()


def _words(fps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint64).reshape(-1, _WIDE)


def run_keys(fps: np.ndarray) -> np.ndarray:
    """The BANDS keys of each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return (bits[:, _TAKEN].astype(np.int32) << np.arange(ROWS)).sum(axis=2) + (np.arange(BANDS) << ROWS)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, fp: each under its run keys."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            again = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
            yield pa.record_batch([pa.array(run_keys(_words(part.column(1))).ravel(), pa.int64()), part.column(0).take(again), part.column(1).take(again)], names=["band", "key", "fp"])
    trim()


def _frequent(least: float):  # noqa: ANN202
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The run keys that more than least of a task's rows have."""
        counts = np.zeros(BANDS << ROWS, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                counts += np.bincount(run_keys(_words(batch.column(1).slice(k, 512))).ravel(), minlength=len(counts))
        yield pa.record_batch([pa.array(np.flatnonzero(counts > least), pa.int64())], names=["band"])

    return bands


def forest(node: np.ndarray, fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within most bits of one run."""
    pivots = fps[np.linspace(0, len(fps) - 1, 4 * PIVOTS).astype(np.int64)]
    tables = np.bitwise_count(fps[:, None, :] ^ pivots).sum(axis=2, dtype=np.int16)  # the pivot distance table of these rows
    label, out = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[(np.abs(tables[j] - tables[i]) <= most).all(axis=1)]
        j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1, dtype=np.int16) <= most]
        _join(label, node, i, j, out)
    return out


def close_in_runs(fps: np.ndarray, runs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) within equal runs whose fingerprints are within most bits; runs is sorted."""
    first, last = np.searchsorted(runs, runs), np.searchsorted(runs, runs, "right") - 1
    tables = np.column_stack([np.bitwise_count(fps ^ fps[np.minimum(first + k, last)]).sum(axis=1, dtype=np.int16) for k in range(PIVOTS)])
    order = np.lexsort((tables[:, 0], runs))
    fps, tables = fps[order], tables[order]
    left, right, i, step = [], [], np.arange(len(fps)), 1
    while True:
        i = i[i + step < len(fps)]
        i = i[(runs[i] == runs[i + step]) & (tables[i + step, 0] - tables[i, 0] <= most)]  # sorted, so what fails here fails further on
        if not len(i):
            break
        near = i[(np.abs(tables[i, 1:] - tables[i + step, 1:]) <= most).all(axis=1)]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]).sum(axis=1, dtype=np.int16) <= most]
        left.append(near)
        right.append(near + step)
        step += 1
    return (order[np.concatenate(left)], order[np.concatenate(right)]) if left else (i, i)


def _join(label: np.ndarray, node: np.ndarray, i: int, found: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Joins row i with the rows found, noting one link for each label that is new to it."""
    for x, j in zip(*np.unique(label[found], return_index=True), strict=True):
        if x != label[i]:
            label[label == x] = label[i]
            out.append((int(node[i]), int(node[found[j]])))


def alike(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what all pairs of sets alike to the similarity join, beyond what equal roots say."""
    sizes = np.array([len(x) for x in sets])
    known, places = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(places, np.cumsum(sizes)[:-1])
    label, mark, out = np.unique(root, return_inverse=True)[1], np.zeros(len(known), dtype=np.int32), []
    for i in range(len(sets) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i])]
        if len(j):
            mark[sets[i]] = 1
            same = np.add.reduceat(mark[np.concatenate([sets[k] for k in j])], np.r_[0, np.cumsum(sizes[j])[:-1]])
            mark[sets[i]] = 0
            _join(label, node, i, j[same >= similarity * (sizes[i] + sizes[j] - same)], out)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, its distinct shingle hashes."""
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            found = [np.unique(np.fromiter(hashes(x.as_py()), dtype=np.uint64)).view(np.int64) for x in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "shingles"])
    trim()


def _linked(most: int):  # noqa: ANN202
    def found(run: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, run[1:] != run[:-1]]
        start, run = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.bincount(run)
        out = [x for r in np.flatnonzero(size > SHORT) for x in forest(*(c[start[r] : start[r] + size[r]] for c in (node, fps)), most)]
        short = ((size > 1) & (size <= SHORT))[run]
        node = node[short]
        i, j = close_in_runs(fps[short], run[short], most)
        place = np.unique(node, return_inverse=True)[1]
        kept = spanning(place[i], place[j])
        a, b = (np.concatenate([np.array([x[k] for x in out], dtype=np.int64), node[c[kept]]]) for k, c in enumerate((i, j)))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task, with no more than about twice LIMIT of each; the last of a batch wait for the next batch."""
        held = None
        for batch in batches:
            rows = batch.column("task").to_numpy(), batch.column("key").to_numpy(), _words(batch.column("fp"))
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True)) if held else rows
            if len(rows[0]):
                last = int(np.argmax(rows[0] == rows[0][-1]))
                held = tuple(x[last:] for x in rows)
                if last:
                    yield found(*(x[:last] for x in rows))
        if held:
            yield found(*held)
        trim()

    return links


def _compared(similarity: float):  # noqa: ANN202
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task: task, key, root, shingles."""
        task, node, root, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            out = alike(np.array(node), np.array(root), sets, similarity) if len(node) > 1 else []
            return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            for t, k, r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if t != task:
                    yield done()
                    task, node, root, sets = t, [], [], []
                node.append(k)
                root.append(r)
                sets.append(x.values.to_numpy(zero_copy_only=False).copy())
        yield done()
        trim()

    return links


def _compare(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: task, key, root, shingles. Links (a, b) within the tasks."""
    rows = rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task")
    return rows.select("task", "key", "root", "shingles").mapInArrow(_compared(similarity), "a bigint, b bigint")


def exact_links(loose: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join exactly what all pairs of the similarity and more within the groups of loose (node, root) join.

    A text weighs 1 and its shingles' share of _CHUNK; a task takes LIMIT at a time, of two blocks twice that.
    """
    rows = cut(sets.join(loose.select(F.col("node").alias("key"), F.col("root").alias("group")), "key").withColumn("weight", 1 + F.size("shingles") / _CHUNK))
    many = rows.groupBy("group").agg(F.ceil(F.sum("weight") / LIMIT).alias("blocks"))
    dealt = rows.join(many, "group").withColumn("task", F.xxhash64("group", F.expr("pmod(xxhash64(key, 1), blocks)")))
    out = cut(_compare(dealt.withColumn("root", F.col("key")), similarity))
    many = cut(many.where("blocks > 1"))
    if many.isEmpty():
        return out
    # Texts of one root need no comparison. The heaviest root's blocks meet those of all other texts, and these each other.
    found = components(out).withColumnRenamed("node", "key")
    apart = rows.join(many.select("group"), "group").join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    weights = apart.groupBy("group", "root").agg(F.sum("weight").alias("weight"))
    mass = weights.groupBy("group").agg(F.max_by("root", F.struct("weight", "root")).alias("mass"), F.max("weight").alias("heavy"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("roots"))
    mass = mass.where("roots > 1").select("group", "mass", F.ceil(F.col("heavy") / LIMIT).alias("m"), F.ceil((F.col("all") - F.col("heavy")) / LIMIT).alias("n"))
    apart = apart.join(cut(mass), "group").withColumn("own", F.expr("pmod(xxhash64(key, 2), if(root = mass, m, n))"))
    rest = "concat(transform(sequence(0L, m - 1), i -> xxhash64(group, 'm', i, own)), transform(filter(sequence(0L, n - 1), k -> k != own), k -> xxhash64(group, 'n', least(k, own), greatest(k, own))))"
    pairs = apart.withColumn("task", F.explode(F.expr(f"if(root = mass, transform(sequence(0L, n - 1), k -> xxhash64(group, 'm', own, k)), {rest})")))
    return out.unionByName(cut(_compare(pairs, similarity)))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: id, key (digest of the text), root (of its group)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    known = cut(rows.mapInArrow(_sketches, f"id {kind}, key bigint, fp binary"))
    texts = cut(known.where("fp is not null").select("key", "fp").dropDuplicates(["key"]))
    listed = texts.mapInArrow(_listed, "band bigint, key bigint, fp binary")
    # A run of more than LIMIT texts has more than its share of them in a task at least.
    large = cut(texts.mapInArrow(_frequent(LIMIT / max(1, texts.rdd.getNumPartitions())), "band bigint").distinct())
    dealt = listed.withColumn("task", F.col("band"))
    if not large.isEmpty():
        large = listed.select("band").join(large, "band").groupBy("band").agg(F.ceil(F.count(F.lit(1)) / LIMIT).alias("n"))
        large = cut(large.where("n > 1"))
        blocks = listed.join(large, "band").withColumn("own", F.expr("pmod(xxhash64(key, 3), n)"))
        blocks = blocks.withColumn("task", F.explode(F.expr("transform(sequence(0L, n - 1), k -> xxhash64(band, least(k, own), greatest(k, own)))")))
        dealt = dealt.join(large, "band", "left_anti").unionByName(blocks.select(dealt.columns))
    rows_of = dealt.select("task", "key", "fp").repartition(partitions(spark), "task").sortWithinPartitions("task")
    links = rows_of.mapInArrow(_linked(bound(similarity)), "a bigint, b bigint")
    loose = components(cut(links.distinct()))
    nodes = loose.select(F.col("node").alias("key"))
    nodes = F.broadcast(nodes) if nodes.count() <= FEW_ROWS else nodes  # texts of no group stay where they are
    sets = rows.select("key", "text").join(nodes, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(_sets, "key bigint, shingles array<bigint>")
    joined = components(exact_links(loose, sets, similarity))
    return known.select("id", "key").join(joined.withColumnRenamed("node", "key"), "key", "left").select("id", "key", F.coalesce("root", "key").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group, all columns kept."""
    found = cut(groups(docs, id_col, text_col, similarity))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A group may hold any number of rows.
    lost = spread_join(found, cut(best), "root", "n").where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))))
    return without(docs, lost, id_col, text_col)
