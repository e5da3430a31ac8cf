"""Benchmark decontamination by template canonicalisation.

A text becomes a template: lower-case words, with a placeholder for each number, for each name (a capitalised word
within a sentence, or a common given name) and for each unit after a number; names in a row are one. Windows of
five template words of the documents are hash-joined with those of the benchmark. Where document and item run in
parallel (one difference of places), their slots must be consistent: what stood for one value of the item must be one
value throughout. An item is found in a document if consistent parts hold SHARE of its windows, be it verbatim or
with other numbers, names and units.

The words under a window of the item are joined as they are, too, in lower case without placeholders: what is a name
depends on capitals, so a passage whose case was changed has other templates. A window counts that is found by either.

Windows of an item need LITERAL words that aren't placeholders; an item without such windows is compared by its plain
words alone. Items shorter than a window are one window of their length. The benchmark's window hashes go to every
worker while they take no more than FEW_BYTES; beyond that all windows of the documents are exchanged and joined.

Defined cases: null or wordless items match nothing; a null text matches nothing; equal rows are found alike; rows
with equal ids but other texts are told apart by a digest of the text; null ids are kept as such; very long texts are
read whole, in parts that overlap by more than an item; an empty table on
either side gives an empty result; other columns play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, table, trim, without

WORDS, SHARE, LITERAL, FEW_BYTES = 5, 0.8, 2, 64 << 20
#: Units and common given names by language; all are looked for in every text.
UNITS = {
    "en": "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent mph kph kmh degree degrees",
    "de": "zoll fuß meile meilen gramm kilogramm pfund liter sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad meter kilometer",
    "fr": "pouce pouces pied pieds mille milles gramme grammes kilogramme kilogrammes livre livres litre secondes heure heures jour jours semaine semaines mois an ans année années degré degrés mètre mètres kilomètre kilomètres",
    "es": "pulgada pulgadas pie pies milla millas gramo gramos kilogramo kilogramos libra libras litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados metro metros kilómetro kilómetros",
}
GIVEN = {
    "en": "john mary james robert michael david william richard joseph thomas charles daniel matthew mark paul george peter tom tim bob bill jack sam ben alex max leo anna emma olivia sarah susan karen lisa nancy betty helen sandra laura alice jane julia kate lucy maria tina amy emily jessica jennifer linda patricia elizabeth",
    "de": "hans karl klaus jürgen wolfgang uwe dieter heinz lukas jonas felix ursula monika petra sabine renate lena hanna greta",
    "fr": "jean pierre jacques michel louis henri françois luc marie anne claire sophie camille chloé juliette margot",
    "es": "juan josé luis carlos miguel javier pablo diego pedro carmen isabel pilar lucía sofía elena",
}
_UNITS, _GIVEN = (tuple(w for words in x.values() for w in words.split()) for x in (UNITS, GIVEN))
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SLOT = {"number": 0xA24BAED4963EE407, "name": 0x9FB21C651E98DF25, "unit": 0xC13FA9A902A6328F}
_CHUNK = 1 << 18
_END = np.array([ord(c) for c in ".!?:\n"])


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case (of one code point), kind (1 letter, 2 digit), upper case."""
    low, kind, up = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=np.uint8), np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        kind[i] = 1 if c.isalpha() else 2 if c.isdecimal() else 0
        if c.isupper():
            up[i] = True
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
    return low, kind, up


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64."""
    one = np.ones(n, dtype=np.uint64)
    return tuple(np.multiply.accumulate(np.r_[one[:1], one[1:] * np.uint64(x)]) for x in (_P, pow(_P, -1, 1 << 64)))


def _hash_of(word: str) -> int:
    h = 0
    for i, c in enumerate(word):
        h += ord(c) * pow(_P, i, 1 << 64)
    return h % (1 << 64)


@functools.cache
def _known(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(np.array([_hash_of(w) for w in words], dtype=np.uint64))


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def template(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, template word, slot value or 0, place among the plain words) of each template word of the texts; (text number, lower-case word) of each plain word."""
    low, kind, up = _tables()
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    stops = np.cumsum([len(t) + 1 for t in texts])
    k = kind[codes]
    digit = k == 2
    inner = np.flatnonzero((codes[1:-1] == 46) | (codes[1:-1] == 44)) + 1
    k[inner[digit[inner - 1] & digit[inner + 1]]] = 2
    edge = np.flatnonzero(k[1:] != k[:-1]) + 1
    starts = np.r_[0, edge]
    starts = starts[k[starts] > 0]
    if not len(starts):
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.uint64))
    ends = np.searchsorted(edge, starts, side="right")
    ends = np.r_[edge, len(codes)][ends]
    power, inverse = _powers(1 << max(19, int(len(codes)).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(low[codes] * power[: len(codes)])]
    words = (sums[ends] - sums[starts]) * inverse[starts]
    owner = np.searchsorted(stops, starts, side="right")
    number = k[starts] == 2
    breaks = np.r_[0, np.cumsum(np.isin(codes, _END))]
    first = np.r_[True, (breaks[starts[1:]] > breaks[ends[:-1]]) | (owner[1:] != owner[:-1])]
    capital = up[codes[starts]] & (ends - starts > 1) & ~up[codes[np.minimum(starts + 1, len(codes) - 1)]]
    name = capital & (~first | _within(words, _known(_GIVEN)))
    unit = np.r_[False, number[:-1] & ~first[1:]] & _within(words, _known(_UNITS))
    value = np.where(number | name | unit, np.maximum(words, np.uint64(1)), np.uint64(0))
    plain = words
    words = words.copy()
    for flag, slot in ((number, "number"), (name, "name"), (unit, "unit")):
        words[flag] = np.uint64(_SLOT[slot])
    keep = ~np.r_[False, name[1:] & name[:-1] & ~first[1:]]
    return owner[keep], words[keep], value[keep], np.flatnonzero(keep), owner, plain


def windows(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows of size words within one text."""
    if len(words) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        h = (h ^ words[at + i]) * np.uint64(_Q)
        h ^= h >> np.uint64(29)
    return at, h + np.uint64(size)


def _values(value: np.ndarray, at: np.ndarray, size: int) -> list[list[int]]:
    return value[at[:, None] + np.arange(size)].view(np.int64).tolist()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The benchmark's windows: item, of (windows of the item), plain, hash, place, size, values."""
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            owner, words, value, base, all_owner, all_words = template([text or ""])
            if not len(words):
                continue
            size = min(WORDS, len(words))
            at, h = windows(words, owner, size)
            literal = (value[at[:, None] + np.arange(size)] == 0).sum(axis=1)
            keep = literal >= min(LITERAL, size)
            both = keep.any()
            if both:
                at, h = at[keep], h[keep]
            n = len(at)
            spans = base[at + size - 1] - base[at] + 1
            found = [(False, h, at, np.full(n, size), _values(value, at, size))] * bool(both)
            for length in np.unique(spans):
                own = at[spans == length]
                starts, plain = windows(all_words, all_owner, int(length))
                found.append((True, plain[np.searchsorted(starts, base[own])] ^ np.uint64(_Q), own, np.full(len(own), length), [[]] * len(own)))
            for plain, h, at, sizes, values in found:
                k = len(at)
                yield pa.record_batch([pa.array([item.as_py()] * k, batch.column(0).type), pa.array([n] * k, pa.int64()), pa.array([plain] * k), pa.array(h.view(np.int64)), pa.array(at), pa.array(sizes, pa.int32()), pa.array(values, pa.list_(pa.int64()))], names=["item", "of", "plain", "hash", "place", "size", "values"])


def _segments(text: str, overlap: int) -> Iterator[str]:
    """The text, or parts of it that overlap by more than an item and begin at white space where there is some."""
    at = 0
    while True:
        stop = at + _CHUNK + overlap
        yield text[at:stop]
        if stop >= len(text):
            return
        space = text.rfind(" ", at + 1, at + _CHUNK + 1)
        at = space if space > at else at + _CHUNK


def template_windows(docs: DataFrame, sizes: list[int], plain: list[int], known: np.ndarray | None, overlap: int) -> DataFrame:
    """docs: id, key, text. The windows of these sizes, of template and plain words (of known hashes only, if given): id, key, hash, at, values (none if plain)."""
    kind = docs.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(known)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            parts: list[str] = []
            waiting = 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or waiting > _CHUNK:
                    if parts:
                        yield from scanned(batch, rows, parts)
                    rows, parts, waiting = [], [], 0
                if i < batch.num_rows and (text := batch.column(2)[i].as_py()):
                    for part in _segments(text, overlap):
                        rows.append(i)
                        parts.append(part)
                        waiting += len(part)
                        if waiting > _CHUNK:
                            yield from scanned(batch, rows, parts)
                            rows, parts, waiting = [], [], 0
        trim()

    def scanned(batch: pa.RecordBatch, rows: list[int], parts: list[str]) -> Iterator[pa.RecordBatch]:
        known = held.value
        owner, words, value, _, all_owner, all_words = template(parts)
        for mark, lengths, whose, use in ((0, sizes, owner, words), (_Q, plain, all_owner, all_words)):
            row = np.array(rows)[whose]
            for size in lengths:
                at, h = windows(use, whose, size)
                h ^= np.uint64(mark)
                ok = np.ones(len(h), dtype=bool) if known is None else _within(h, known)
                at, h = at[ok], h[ok]
                if len(at):
                    take = pa.array(row[at])
                    values = [[]] * len(at) if mark else _values(value, at, size)
                    # Parts of one text lie far apart, so that none continues another.
                    yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(h.view(np.int64)), pa.array(at + (whose[at] << 32)), pa.array(values, pa.list_(pa.int64()))], names=["id", "key", "hash", "at", "values"])

    return docs.select("id", "key", "text").mapInArrow(found, f"id {kind}, key bigint, hash bigint, at bigint, values array<bigint>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", few: int = FEW_BYTES) -> DataFrame:
    """One row for each pair of a text and an item it holds: id, key (digest of the text), item, found, of, changed."""
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    longest = items.agg(F.max(F.length("text"))).first()[0] or 0
    known = cut(items.mapInArrow(_items, f"item {items.schema['item'].dataType.simpleString()}, of bigint, plain boolean, hash bigint, place bigint, size int, values array<bigint>"))
    shape = known.agg(F.collect_set(F.expr("if(plain, null, size)")), F.collect_set(F.expr("if(plain, size, null)")), F.coalesce(F.sum(F.size("values") * 8 + 64), F.lit(0))).first()
    small = shape[2] <= few
    hashes = np.unique(known.select("hash").distinct().toArrow().column(0).to_numpy().view(np.uint64)) if small else None
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    hits = template_windows(rows, sorted(shape[0]), sorted(shape[1]), hashes, 2 * longest + 1024)
    own = known.select("item", "of", "plain", "hash", "place", F.col("values").alias("own"))
    both = hits.join(F.broadcast(own) if small else own, "hash")
    pairs = F.filter(F.arrays_zip("own", "values"), lambda x: x["own"] != 0)
    both = both.select("id", "key", "item", "of", "plain", "place", F.expr("if(plain, 0, at - place)").alias("shift"), pairs.alias("pairs"))
    parts = both.groupBy("id", "key", "item", "of", "plain", "shift").agg(F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    single = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["own"])))
    same = F.forall("pairs", lambda x: x["own"] == x["values"])
    parts = parts.where(single).withColumn("same", same)
    places = F.array_distinct(F.flatten(F.collect_list("places")))
    verbatim = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("plain"), F.col("places")))))) >= F.col("of") * SHARE
    out = parts.groupBy("id", "key", "item", "of").agg(F.size(places).cast("long").alias("found"), (~(verbatim | F.coalesce(F.max(F.when(~F.col("plain"), F.col("same"))), F.lit(False)))).alias("changed"))
    return out.where(F.col("found") >= F.col("of") * SHARE).select("id", "key", "item", "found", "of", "changed")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item, all columns kept."""
    return without(docs, contaminated(docs, benchmark, id_col, text_col), id_col, text_col)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("found").alias("windows_found"), F.col("of").alias("windows"), "changed")


SQL: dict[str, str] = {}
QUERIES = {"op4_decontaminate": op4_decontaminate}
