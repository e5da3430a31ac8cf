"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: a word is the bag of its three-character subsequences, read with its two ends marked, that span five
characters at most; each occurrence weighs DECAY per character spanned. The bags are normalised and their product
is taken to the power DEGREE. Insults with gaps or inserted letters keep most of their subsequences; a word with
other characters inside is also read without them.

Labels are of documents, whose sentences are bags: all words of a clean document's sentences are clean; a toxic
document has at least one toxic word, its witness, which training and machine pick in turn (multiple-instance
learning). The machine is linear over Nyström features of LANDMARKS words, most of them witnesses. A document
scores by its worst words, wherever they stand, through a logistic curve fitted on the training documents. Words are
scored once and kept in a bounded cache.

Training reads a bounded sample: up to SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows, those least in a hash of the id;
WORDS bounds the size of the machine's clean class, the half most frequent, the other half drawn by a hash: fewer leave
rare clean words unseen, which then score by their likeness to the landmarks alone. Scoring reads every whole text.

Defined cases: a null or wordless text has score 0; very long texts are scored whole, very long words by their parts; without labelled rows of both classes every score is 0; null
labels, null ids and labels of absent documents are not learned from; repeated rows score alike; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, table, trim

SAMPLE_TOXIC, SAMPLE_CLEAN, WORDS = 2000, 4000, 20_000
LANDMARKS = 128
DECAY = 0.9
DEGREE = 2
ROUNDS = 4
#: Words of a document that its score weighs.
TOP = 3
THRESHOLD = 0.3
_STEPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_LONG = 48
_WORD = re.compile(r"[^\W\d_](?:\S*[^\W\d_])?")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s+){2,}[^\W\d_](?!\w)")
_CACHE = 150_000


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, trimmed to letters at both ends; letters written apart also count as one word, long words as overlapping parts."""
    low = (text or "").lower()
    found = set(_WORD.findall(low))
    found.update("".join(m.split()) for m in _SPACED.findall(low))
    found.update(["".join(filter(str.isalpha, x)) for x in found if not x.isalpha()])
    for x in [x for x in found if len(x) > _LONG]:
        found.remove(x)
        found.update(x[i : i + _LONG] for i in range(0, len(x) - _LONG // 2, _LONG // 2))
    return found


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, weight) of each distinct subsequence of each word, word by word; a word's squared weights sum to one."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    key, own, weight = [], [], []
    for a, b in _STEPS:
        at = np.flatnonzero(owner[:-b] == owner[b:])
        key.append(codes[at] << np.uint64(42) | codes[at + a] << np.uint64(21) | codes[at + b])
        own.append(owner[at])
        weight.append(np.full(len(at), DECAY ** (b + 1)))
    key, own, weight = np.concatenate(key), np.concatenate(own), np.concatenate(weight)
    # Grouped by word and a 44-bit digest of the subsequence.
    group = own.astype(np.uint64) << np.uint64(44) | key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    order = np.argsort(group)
    group = group[order]
    first = np.flatnonzero(np.r_[len(group) > 0, group[1:] != group[:-1]])
    weight = np.add.reduceat(weight[order], first)
    own, key = own[order][first], key[order][first]
    return own, key, weight / np.sqrt(np.bincount(own, weight * weight, len(words)))[own]


class Landmarks:
    """Words that others are compared with: their distinct subsequences, in order, and for each of these the landmarks that have it, with weights."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        i, u, w = subsequences(words)
        self.keys, first = np.unique(np.sort(u), return_index=True)
        order = np.argsort(u, kind="stable")
        self.first, self.marks, self.weights = np.r_[first, len(u)], i[order], w[order]

    def kernel(self, words: list[str]) -> np.ndarray:
        """Words x landmarks: the normalised subsequence kernel to the power DEGREE. Few landmarks share a subsequence, so the products are sparse."""
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        for k in range(0, len(words), 512):
            part = words[k : k + 512]
            i, u, w = subsequences(part)
            j = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
            ok = self.keys[j] == u
            i, j, w = i[ok], j[ok], w[ok]
            many = self.first[j + 1] - self.first[j]
            at = np.repeat(self.first[j] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            cells = np.repeat(i * len(self.words), many) + self.marks[at]
            out[k : k + 512] = np.bincount(cells, np.repeat(w, many) * self.weights[at], len(part) * len(self.words)).reshape(len(part), -1)
        return out**DEGREE


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.001) -> np.ndarray:
    """Squared-hinge support vector machine by Newton's method; the last column of x is one."""
    w = np.zeros(x.shape[1])
    reg = ridge * weight.sum() * np.eye(x.shape[1])
    reg[-1, -1] *= 1e-3
    for _ in range(20):
        on = y * (x @ w) < 1
        new = np.linalg.solve((x[on] * weight[on, None]).T @ x[on] + reg, (x[on] * weight[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _spread(words: list[str], many: int) -> list[str]:
    """many of the words, each as unlike those before it as can be, beginning with the first."""
    if len(words) <= many:
        return words
    k = Landmarks(words[:1024]).kernel(words[:1024])
    nearest, out = k[0].copy(), [0]
    while len(out) < min(many, len(k)):
        out.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, k[out[-1]])
    return [words[i] for i in out]


def train_words(bags: list[list[str]], first: list[str], clean: list[str]) -> tuple[Landmarks, np.ndarray, float]:
    """Landmarks, their weights and the bias. bags: the words of each toxic document; first: its first witness."""
    count = Counter(first)
    bank = sorted(count, key=lambda x: (-count[x], x))
    marks = Landmarks(list(dict.fromkeys(_spread(bank, LANDMARKS * 3 // 4) + _spread(clean, LANDMARKS // 4))))
    every = list(dict.fromkeys([x for b in bags for x in b] + clean))
    number = {x: k for k, x in enumerate(every)}
    values, vectors = np.linalg.eigh(marks.kernel(marks.words).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T  # Nyström: the landmarks' kernel to the power -1/2
    z = np.column_stack([marks.kernel(every) @ root, np.ones(len(every))])
    members = [np.array([number[x] for x in b]) for b in bags]
    negative = np.array(sorted({number[x] for x in clean}))
    chosen = np.array([number[x] for x in first])
    svm = np.zeros(z.shape[1])
    for _ in range(ROUNDS):
        mine = np.setdiff1d(np.unique(chosen), negative)
        if not len(mine):
            break
        times = np.bincount(chosen, minlength=len(every))[mine]
        x = np.concatenate([z[mine], z[negative]])
        y = np.r_[np.ones(len(mine)), -np.ones(len(negative))]
        svm = _fit(x, y, np.r_[times / times.sum(), np.full(len(negative), 1 / len(negative))])
        f = z @ svm
        again = np.array([m[np.argmax(f[m])] for m in members])
        if (again == chosen).all():
            break
        chosen = again
    return marks, (root @ svm[:-1]).astype(np.float32), float(svm[-1])


def worst_words(text: Column, marks: Landmarks, weights: np.ndarray, bias: float) -> Column:
    """The TOP highest scores of a text's distinct words, the bias where it has fewer; null without a word."""

    def scored(bags: list[set[str]], cache: dict[str, float]) -> pa.Array:
        new = [w for w in set().union(*bags) if w not in cache]
        if len(cache) + len(new) > _CACHE:
            cache.clear()
            new = list(set().union(*bags))
        for n in range(0, len(new), 4096):
            part = new[n : n + 4096]
            cache.update(zip(part, (marks.kernel(part) @ weights + bias).tolist(), strict=True))
        return pa.array([heapq.nlargest(TOP, map(cache.__getitem__, b)) + [bias] * (TOP - len(b)) if b else None for b in bags], pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, float] = {}
        for texts in batches:
            parts = [scored([words_of(t) for t in texts.slice(k, 64).to_pylist()], cache) for k in range(0, len(texts), 64)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))
        cache.clear()
        trim()

    return of(text)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            bags = [sorted(words_of(t)) for t in part.column(2).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(bags)), [len(b) for b in bags]))
            yield pa.record_batch([part.column(0).take(take), part.column(1).take(take), pa.array([w for b in bags for w in b], pa.string())], names=["id", "y", "word"])


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's scaling over the highest word scores, with his smoothed targets: the weights, the constant last."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, p = np.column_stack([f, np.ones(len(f))]), np.zeros(f.shape[1] + 1)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(p)), x.T @ (t - q) - 1e-2 * p)
        p += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return p


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """The model, or None without both classes. labels must hold learnable rows only."""
    bound_batches(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    least = (F.xxhash64("id"), F.col("id"))
    picked = rows.where("y = 1").orderBy(*least).limit(SAMPLE_TOXIC).unionByName(rows.where("y = 0").orderBy(*least).limit(SAMPLE_CLEAN))
    # The sample's bound makes the broadcast safe.
    sample = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text").where("text is not null"))
    least = (F.xxhash64("id"), F.xxhash64("text"), F.col("id"))  # an id may have many rows, so the bound is taken once more
    sample = sample.where("y = 1").orderBy(*least).limit(SAMPLE_TOXIC).unionByName(sample.where("y = 0").orderBy(*least).limit(SAMPLE_CLEAN))
    sample = cut(sample.repartition(sample.sparkSession.sparkContext.defaultParallelism))
    words = cut(sample.mapInArrow(_words, f"id {sample.schema['id'].dataType.simpleString()}, y int, word string"))
    of = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of) < 2:
        return None
    stats = cut(words.groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")))
    clean = [r["word"] for r in stats.where("clean > 0").orderBy(F.desc("clean"), "word").limit(WORDS // 2).collect()]
    clean += [r["word"] for r in stats.where("clean > 0").orderBy(F.xxhash64("word"), "word").limit(WORDS // 2).collect()]
    odds = F.log((F.col("toxic") + 0.1) / of[1]) - F.log((F.col("clean") + 0.5) / of[0])
    strong = stats.where("toxic > 0").withColumn("odds", odds * F.sqrt("toxic")).where(odds > 1).select("word", "odds")
    # Few rows: words of the sampled toxic documents that clean ones hardly have.
    found = words.where("y = 1").join(strong, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("odds", "word")), asc=False).alias("bag")).select("bag").collect()
    bags = [[w["word"] for w in r["bag"]] for r in found]
    if not bags or not clean:
        return None
    marks, weights, bias = train_words(bags, [b[0] for b in bags], list(dict.fromkeys(clean)))
    scored = sample.select("y", worst_words(F.col("text"), marks, weights, bias).alias("f")).where("f is not null").toPandas()
    curve = _logistic(np.array(scored["f"].tolist()), scored["y"].to_numpy())
    return {"marks": marks, "weights": weights, "bias": bias, "curve": curve.tolist()}


def score(text: Column, model: dict | None) -> Column:
    """Toxicity from 0 to 1 of every text."""
    if model is None:
        return F.lit(0.0)
    *slopes, at = model["curve"]
    worst = worst_words(text, model["marks"], model["weights"], model["bias"])
    x = F.aggregate(F.zip_with(worst, F.array(*map(F.lit, slopes)), lambda f, a: f * a), F.lit(at), lambda a, b: a + b)
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))).otherwise(0.0)


def held_out(id_: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """Rows outside the held-out fold."""
    return labels.where(~held_out(F.col("doc_id")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


SQL: dict[str, str] = {}
QUERIES = {"op9_toxicity": op9_toxicity}
