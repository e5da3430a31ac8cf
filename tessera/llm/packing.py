"""Best-fit packing of tokenized documents into sequences by swap-based local search.

Only lengths matter to a packing, so it is planned over the histogram of piece lengths, which has at most SIZE
entries whatever the corpus. Lengths are dealt to bins in falling order, each bin closed when the next one doesn't fit;
the local search makes the packing of these underfull bins, as many with equal loads at once as there are: documents
move to the bin they fill best, or are exchanged one for one or two for one, each step raising the sum of squared fills,
until bins empty or nothing helps. Where that leaves more bins than the sum of lengths needs, the search starts once more
from the bins that best-fit decreasing leaves underfull, and the better of its two results is taken.

The plan says which ranks of each length go to which run of bins. Pieces are ranked within their length without
gathering one: rows are counted by buckets of a hash, and ranked within a bucket; a length has as many buckets as the
square root of its rows, and as many cells of the plan as runs, so no length, however common, meets in one task.

Defined cases: a null text counts as empty and packs as its end token alone; very long texts are encoded whole and cut
into pieces; repeated rows are packed each; an empty table gives an empty result; null ids stay null; other columns
play no part.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import bound_batches, cut, table, trim

SIZE = 4096
END_ID = 1
#: Rows of the plan (about 60 bytes each) that every worker may be given; a longer plan is exchanged and joined.
FEW = 500_000
#: Lengths in a bin, sorted.
Load = tuple[int, ...]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's ids, an end token last, cut into pieces of size: id, piece, start, length, ids_crc32 (and ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokens.word_bpe_path()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows: list[tuple] = []
                take: list[int] = []
                for i, ids in enumerate(tokens.encode(part.column(1).to_pylist(), file)):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        rows.append((n, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").tolist()] * with_ids)))
                        take.append(i)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.record_batch([part.column(0).take(pa.array(take)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
        trim()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut_up, schema)


def next_fit(counts: dict[int, int], size: int) -> Counter:
    """How many bins have each load, dealt in falling order: a bin is closed when the next length doesn't fit. The start of the search."""
    loads: Counter = Counter()
    load: list[int] = []
    room = size
    for length in sorted(counts, reverse=True):
        left, whole = counts[length], size // length
        while left:
            if length > room:
                loads[tuple(reversed(load))] += 1
                load, room = [], size
            if not load and left >= whole:  # as many bins of this length alone as there are
                loads[(length,) * whole] += left // whole
                left %= whole
                continue
            taken = min(left, room // length)
            load += [length] * taken
            room, left = room - taken * length, left - taken
    if load:
        loads[tuple(reversed(load))] += 1
    return loads


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """How many bins have each load by best-fit decreasing.

    Longest first; each goes where the least room is left over. Bins with equal room are alike, so as many as
    there are take one each at once.
    """
    rooms: dict[int, deque] = {}
    held: list[int] = []  # rooms that have bins, sorted
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(held, length)
            if k == len(held):  # no bin has room: open as many as whole runs of this length fill
                rooms[size] = deque([((), -(-left // (size // length)))])
                insort(held, size)
                continue
            room = held[k]
            load, many = rooms[room].popleft()
            taken = min(many, left)
            if taken < many:
                rooms[room].appendleft((load, many - taken))
            elif not rooms[room]:
                del rooms[room], held[k]
            if room - length not in rooms:
                rooms[room - length] = deque()
                insort(held, room - length)
            rooms[room - length].append(((length, *load), taken))
            left -= taken
    out: Counter = Counter()
    for load, many in itertools.chain.from_iterable(rooms.values()):
        out[load] += many
    return out


class _Open:
    """Loads (sorted lengths) of underfull bins, how many bins have each, and by sum of at most two of a load's lengths the rooms there are."""

    def __init__(self, size: int) -> None:
        self.size, self.count = size, Counter()
        self.loads: list[dict[int, dict[Load, None]]] = [{} for _ in range(size + 1)]
        self.rooms: list[list[int]] = [[] for _ in range(size + 1)]
        self.reach = np.full(size + 1, -1, dtype=np.int64)  # the sum and the largest room: what a load takes in at most in exchange

    def _backs(self, load: Load) -> set[int]:
        own = Counter(load)
        return {0, *own, *(2 * y for y, n in own.items() if n > 1), *(y + z for y, z in itertools.combinations(own, 2))}

    def put(self, load: Load, n: int) -> None:
        room = self.size - sum(load)
        if not self.count[load]:
            for s in self._backs(load):
                if room not in self.loads[s]:
                    self.loads[s][room] = {}
                    insort(self.rooms[s], room)
                    self.reach[s] = s + self.rooms[s][-1]
                self.loads[s][room][load] = None
        self.count[load] += n

    def take(self, load: Load, n: int) -> None:
        self.count[load] -= n
        if self.count[load]:
            return
        del self.count[load]
        room = self.size - sum(load)
        for s in self._backs(load):
            del self.loads[s][room][load]
            if not self.loads[s][room]:
                del self.loads[s][room]
                self.rooms[s].pop(bisect_left(self.rooms[s], room))
                self.reach[s] = s + self.rooms[s][-1] if self.rooms[s] else -1

    def best(self, giver: Load) -> tuple[int, int, Load] | None:
        """(length given, sum taken back, receiver's load): the largest gain, then the least room."""
        best, slack = None, self.size - sum(giver)  # a receiver must get fuller than the giver was
        for x in sorted(set(giver), reverse=True):
            s = -1
            while s < x - 1:
                after = self.reach[s + 1 : x] >= x
                s += 1 + int(after.argmax())
                if not self.reach[s] >= x or best and x - s < best[0][0]:
                    break
                room = self.rooms[s][bisect_left(self.rooms[s], x - s)]
                if room - (x - s) >= slack:
                    continue
                if best is None or (x - s, -room) > best[0]:
                    best = ((x - s, -room), x, s, next(iter(self.loads[s][room])))
                break
            if best and not best[2]:
                break
        return best and best[1:]


def _without(load: Load, lengths: tuple[int, ...]) -> Load:
    left = list(load)
    for x in lengths:
        left.remove(x)
    return tuple(left)


def search(loads: dict[Load, int], size: int, least: int) -> Counter:
    """loads: how many bins have each load (sorted lengths). The same lengths in as few bins as moves and exchanges allow, least at least.

    The least full bins give: each of their documents moves to the bin it fills best, or is exchanged for a smaller
    one, or for two that are smaller together, where the receiver gets fuller. Every step raises the sum of
    squared fills and is made by as many bins with the same loads as there are. A bin that can't give any more may still receive.
    """
    open_, done = _Open(size), Counter()
    todo: list[tuple[int, Load]] = []

    def add(load: Load, n: int) -> None:
        if sum(load) == size:
            done[load] += n
        elif load:
            if load not in open_.count:
                heapq.heappush(todo, (sum(load), load))
            open_.put(load, n)

    for load, n in loads.items():
        add(load, n)
    full = sum(n for load, n in loads.items() if load)
    while todo and full > least:
        load = heapq.heappop(todo)[1]
        many = open_.count.get(load, 0)
        if not many:
            continue
        n = min(many - many // 2, full - least)  # the others may receive
        open_.take(load, n)
        giver = load
        while giver and (found := open_.best(giver)):
            x, s, receiver = found
            back = () if not s else (s,) if s in receiver else next(p for p in itertools.combinations(receiver, 2) if sum(p) == s)
            if (m := min(n, open_.count[receiver])) < n:
                add(giver, n - m)
                n = m
            open_.take(receiver, n)
            add(tuple(sorted((*_without(receiver, back), x))), n)
            giver = tuple(sorted((*_without(giver, (x,)), *back)))
        if giver:
            open_.put(giver, n)  # may still receive
        else:
            full -= n
        if giver != load and load in open_.count:
            heapq.heappush(todo, (sum(load), load))
    done.update(open_.count)
    return done


def swap_search(bins: list[list[int]], size: int, least: int) -> None:
    """search over single bins, in place."""
    loads = search(Counter(tuple(sorted(b)) for b in bins), size, least)
    found = [list(load) for load, n in loads.items() for _ in range(n)]
    bins[:] = found + [[] for _ in range(len(bins) - len(found))]


def plan(counts: dict[int, int], size: int = SIZE) -> pd.DataFrame:
    """Runs: the ranks first..first+many-1 of a length go to bins bin..bin+many-1, each at the offset."""
    least = -(-sum(n * c for n, c in counts.items()) // size)
    found = search(next_fit(counts, size), size, least)
    if found.total() > least:
        found = min(found, search(best_fit(counts, size), size, least), key=Counter.total)
    runs, at, upto = [], 0, dict.fromkeys(counts, 0)
    for load, many in found.items():
        offset = 0
        for length in load:
            runs.append((length, upto[length], many, at, offset))
            upto[length] += many
            offset += length
        at += many
    return pd.DataFrame(np.array(runs, dtype=np.int64).reshape(-1, 5), columns=["length", "first", "many", "bin", "offset"])


def in_cells(runs: pd.DataFrame, counts: dict[int, int]) -> tuple[pd.DataFrame, dict[int, int]]:
    """runs, each once for every cell of its length's ranks that it meets, and the width of each length's cells.

    A length has as many cells as runs, so all in all there are twice as many rows at most.
    """
    own = runs.groupby("length")["first"].count()
    width = {int(n): -(-counts[int(n)] // int(k)) for n, k in own.items()}
    w = runs["length"].map(width).to_numpy(dtype=np.int64)
    first = runs["first"].to_numpy() // w
    times = (runs["first"].to_numpy() + runs["many"].to_numpy() - 1) // w - first + 1
    out = runs.loc[runs.index.repeat(times)].copy()
    out["cell"] = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return out, width


def pack(parts: DataFrame, size: int = SIZE, few: int = FEW) -> DataFrame:
    """parts: id, piece, length and more. The same rows with sequence_id and offset."""
    spark = parts.sparkSession
    # At most size rows reach the driver.
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    cells, width = in_cells(plan(counts, size), counts)
    runs = spark.createDataFrame(pa.Table.from_pandas(cells.astype("int64"), preserve_index=False))
    lengths = spark.createDataFrame([(n, w, math.isqrt(counts[n]) + 1) for n, w in width.items()], "length long, width long, buckets long")
    rows = parts.join(F.broadcast(lengths), "length").withColumn("bucket", F.expr("pmod(xxhash64(id, piece, ids_crc32), buckets)"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    ranked = rows.join(below, ["length", "bucket"]).withColumn("rank", F.col("below") + place - 1).withColumn("cell", F.expr("rank div width"))
    out = ranked.join(F.broadcast(runs) if len(cells) <= few else runs, ["length", "cell"]).where("rank >= first and rank < first + many")
    return out.select(*(parts[c] for c in parts.columns), (F.col("bin") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return pack(cut(pieces(docs, id_col, text_col, size, path=path, with_ids=with_ids)), size)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL: dict[str, str] = {}
QUERIES = {"op10_best_fit": op10_best_fit}
