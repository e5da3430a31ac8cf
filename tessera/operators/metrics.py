"""Scores of generated text: n-gram overlap, multi-label reports, agreement, fact overlap, bootstrap intervals."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

POSITIVE, NEGATIVE, UNCERTAIN, BLANK = 1, 2, 3, 0


def tokens(c: Column) -> Column:
    """The tokenizer of all n-gram scores: lower case, split at white space."""
    return T.words(F.lower(c))


def ngrams(toks: Column, n: int) -> Column:
    """The n-grams of a token array that is bound or a column already: it is used for each of them."""
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def numbered(grams: Column) -> Column:
    """The elements, each marked with which of its equals it is, so that sets of them meet as multisets do."""

    def of(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def run(at: Column, after: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), after - at), lambda k: F.concat_ws("\x01", F.get(s, at), k.cast("string")))

        return T.bound(starts, lambda x: F.flatten(F.transform(x, lambda at, j: run(at, F.coalesce(F.get(x, j + 1), n)))))

    return T.bound(F.array_sort(grams), lambda s: F.when(F.size(s) > 0, of(s)).otherwise(s))


def overlap(p: Column, r: Column, n: int) -> Column:
    """The n-grams of token array p found in r, each as often as r has it at most; counted within the row."""
    return F.size(F.array_intersect(numbered(ngrams(p, n)), numbered(ngrams(r, n)))).cast("long")


def _hits(n: int) -> Column:
    """overlap() of columns p and r; bound, so that they aren't tokenized again however the optimizer merges projections."""
    return T.bound(F.col("p"), lambda p: T.bound(F.col("r"), lambda r: overlap(p, r, n)))


def bleu_parts(pairs: DataFrame, n: int) -> DataFrame:
    """id, pred_len, ref_len, and total_k and hit_k of each order up to n, of pairs (id, pred, ref)."""
    t = pairs.select("id", tokens(F.col("pred")).alias("p"), tokens(F.col("ref")).alias("r"))
    each = [F.struct(F.greatest(F.size("p") - (k - 1), F.lit(0)).cast("long").alias("total"), _hits(k).alias("hit")) for k in range(1, n + 1)]
    out = t.select("id", F.size("p").cast("long").alias("pred_len"), F.size("r").cast("long").alias("ref_len"), F.array(*each).alias("x"))
    return out.select("id", "pred_len", "ref_len", *(F.col("x")[k - 1][c].alias(f"{c}_{k}") for k in range(1, n + 1) for c in ("total", "hit")))


def bleu_score(n: int) -> Column:
    """The score from the sums of the parts. Without smoothing: 0 if an order has no hit."""
    logs = [F.log(F.col(f"hit_{k}") / F.col(f"total_{k}")) for k in range(1, n + 1)]
    short = F.when(F.col("pred_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.col("pred_len")))
    some = reduce(lambda a, b: a & b, (F.col(f"hit_{k}") > 0 for k in range(1, n + 1)))
    return F.when(some, short * F.exp(reduce(lambda a, b: a + b, logs) / n)).otherwise(0.0)


def _part_names(n: int) -> list[str]:
    return ["pred_len", "ref_len", *(f"{c}_{k}" for k in range(1, n + 1) for c in ("total", "hit"))]


def bleu(pairs: DataFrame, n: int) -> DataFrame:
    """EVL-1, EVL-2: corpus BLEU of pairs (id, pred, ref) up to n-grams: the hits and totals of each order, the lengths and the score."""
    out = bleu_parts(pairs, n).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _part_names(n)))
    return out.withColumn("score", bleu_score(n))


def bootstrap_bleu(pairs: DataFrame, n: int, replicates: int = 500, seed: int = 3) -> DataFrame:
    """EVL-1: replicate, score of BLEU over redrawn rows."""
    return resampled(bleu_parts(pairs, n), replicates, seed, *_part_names(n)).select("replicate", bleu_score(n).alias("score"))


def _f(hit: Column, n_pred: Column, n_ref: Column) -> Column:
    """The harmonic mean of hit / n_pred and hit / n_ref, 0 without a hit."""
    return F.when(hit > 0, 2 * hit / (n_pred + n_ref)).otherwise(0.0)


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """EVL-4: id, f."""
    t = pairs.select("id", tokens(F.col("pred")).alias("p"), tokens(F.col("ref")).alias("r"))
    x = F.struct(*(F.greatest(F.size(s) - (n - 1), F.lit(0)).alias(s) for s in ("p", "r")), _hits(n).alias("hit"))
    return t.select("id", F.array(x)[0].alias("x")).select("id", _f(F.col("x.hit"), F.col("x.p"), F.col("x.r")).alias("f"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Bit-parallel length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    for y in b:
        u = row & places.get(y, 0)
        row = (row + u | row - u) & (1 << len(a)) - 1
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """EVL-3: id, f by the longest common subsequence."""

    @F.pandas_udf("long")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    t = pairs.select("id", tokens(F.col("pred")).alias("p"), tokens(F.col("ref")).alias("r"))
    return t.select("id", _f(lcs("p", "r"), F.size("p"), F.size("r")).alias("f"))


def best_reference(scores: DataFrame, id_: str, f: str = "f") -> DataFrame:
    """EVL-3 with several references to a row: the best of each row."""
    return scores.groupBy(id_).agg(F.max(f).alias(f))


def mean_std(rows: DataFrame, f: str = "f") -> DataFrame:
    """EVL-5: mean and sample deviation."""
    return rows.agg(F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"))


def to_binary(label: Column, mode: str = "rrg") -> Column:
    """EVL-6: positive is 1; uncertain as well in mode rrg+."""
    if mode not in ("rrg", "rrg+", "classification"):
        raise ValueError(f"unknown mode {mode}")
    yes = label == POSITIVE
    return (yes | (label == UNCERTAIN) if mode == "rrg+" else yes).cast("int")


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def label_counts(long: DataFrame, *keys: str) -> DataFrame:
    """keys, tp, fp, fn of rows with y and p of 0 or 1."""
    y, p = F.col("y") == 1, F.col("p") == 1
    return long.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))


def label_report(long: DataFrame) -> DataFrame:
    """EVL-7: name, precision, recall, f1, support of each class and of micro, macro, weighted and samples averages.

    long: id, condition, y, p. Divisions by zero give 0.
    """
    by = label_counts(long, "condition").withColumn("support", F.col("tp") + F.col("fn"))
    each = by.select(F.col("condition").alias("name"), *_rates(F.col("tp"), F.col("fp"), F.col("fn")), "support")
    total = by.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")))
    micro = total.select(F.lit("micro avg").alias("name"), *_rates(F.col("tp"), F.col("fp"), F.col("fn")), "support")
    macro = each.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")).withColumn("name", F.lit("macro avg"))
    n = F.sum("support")
    weighted = each.agg(*(F.when(n > 0, F.sum(F.col(c) * F.col("support")) / n).otherwise(0.0).alias(c) for c in ("precision", "recall", "f1")), n.alias("support")).withColumn("name", F.lit("weighted avg"))
    one = label_counts(long, "id").select(*_rates(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))
    samples = one.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")).withColumn("name", F.lit("samples avg"))
    return reduce(DataFrame.unionByName, (each, micro, macro, weighted, samples))


def recoded(label: Column, task: str) -> tuple[Column, int]:
    """EVL-9: the label as the task sees it, and the value that counts as positive."""
    mention = F.when(label.isin(NEGATIVE, UNCERTAIN), 1).otherwise(label)
    table = {"mention": (mention, 1), "blank": (mention, 0), "negation": (label, NEGATIVE), "positive": (label, POSITIVE), "uncertain": (label, UNCERTAIN)}
    return table[task]


def task_f1(long: DataFrame, task: str) -> DataFrame:
    """EVL-9: condition, f1. long: id, condition, t, q (codes of truth and prediction)."""
    (t, at), (q, _) = recoded(F.col("t"), task), recoded(F.col("q"), task)
    by = label_counts(long.select("condition", (t == at).cast("int").alias("y"), (q == at).cast("int").alias("p")), "condition")
    return by.select("condition", _rates(F.col("tp"), F.col("fp"), F.col("fn"))[2])


def class_weights(long: DataFrame) -> DataFrame:
    """EVL-10: condition and the shares of negation, uncertain and positive among its non-blank labels of all annotators."""
    n = {k: F.count_if(F.col("label") == v) for k, v in (("negation", NEGATIVE), ("uncertain", UNCERTAIN), ("positive", POSITIVE))}
    by = long.groupBy("condition").agg(*(c.alias(k) for k, c in n.items()))
    total = F.col("negation") + F.col("uncertain") + F.col("positive")
    return by.select("condition", *(F.when(total > 0, F.col(k) / total).otherwise(0.0).alias(k) for k in n))


def confusion(long: DataFrame, *keys: str) -> DataFrame:
    """EVL-11: keys, t, q, cnt."""
    return long.groupBy(*keys, "t", "q").agg(F.count(F.lit(1)).alias("cnt"))


def kappa(long: DataFrame, *keys: str) -> DataFrame:
    """EVL-11: Cohen's kappa of t and q, null where chance agreement is whole."""
    cells = confusion(long, *keys)
    n = cells.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("t") == F.col("q"), F.col("cnt")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*keys, F.col("t").alias("c")).agg(F.sum("cnt").alias("a"))
    cols = cells.groupBy(*keys, F.col("q").alias("c")).agg(F.sum("cnt").alias("b"))
    chance = rows.join(cols, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    pe, po = F.coalesce(F.col("ab"), F.lit(0)) / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    return n.join(chance, list(keys), "left").select(*keys, F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def facts(entities: Column, level: str) -> Column:
    """EVL-13: the distinct facts, as texts, of array<struct<id, tokens, label, relations: array<struct<type, target>>>>.

    simple: tokens and label; partial: and whether it has a relation; complete: one for each relation, with its type
    and the target's tokens in lower case, as are the entity's own in that case alone.
    """

    def text(*fields: Column) -> Column:
        return F.concat_ws("\x01", *(F.coalesce(f, F.lit("\x02")) for f in fields))

    none = F.lit(None).cast("string")
    if level == "simple":
        return F.array_distinct(F.transform(entities, lambda e: text(e["tokens"], e["label"])))
    if level == "partial":
        return F.array_distinct(F.transform(entities, lambda e: text(e["tokens"], e["label"], F.when(F.size(e["relations"]) > 0, "some"))))

    def of(e: Column, held: Column) -> Column:
        each = F.transform(e["relations"], lambda r: text(F.lower(e["tokens"]), e["label"], r["type"], F.lower(F.try_element_at(held, r["target"]))))
        return F.when(F.size(e["relations"]) > 0, each).otherwise(F.array(text(e["tokens"], e["label"], none, none)))

    # Of entities with one id the first is the target.
    first = F.filter(entities, lambda e, i: F.array_position(F.transform(entities, lambda x: x["id"]), e["id"]) == i + 1)
    names = T.bound(F.transform(entities, lambda e: e["id"]), lambda ids: F.when(F.size(F.array_distinct(ids)) == F.size(ids), entities).otherwise(first))
    by_id = F.map_from_entries(F.transform(names, lambda e: F.struct(e["id"], e["tokens"])))
    return T.bound(by_id, lambda held: F.array_distinct(F.flatten(F.transform(entities, lambda e: of(e, held)))))


def fact_reward(pred: Column, ref: Column, prefix: str = "") -> list[Column]:
    """EVL-13, JOI-12, SET-5: f1, precision and recall of two distinct fact arrays; 0 if a side is empty."""
    same, a, b = F.size(F.array_intersect(pred, ref)), F.size(pred), F.size(ref)
    some = (a > 0) & (b > 0)
    return [F.when(some, 2 * same / (a + b)).otherwise(0.0).alias(f"{prefix}f1"), F.when(some, same / a).otherwise(0.0).alias(f"{prefix}precision"), F.when(some, same / b).otherwise(0.0).alias(f"{prefix}recall")]


#: The chance, under a Poisson law of mean 1, of at most 0, 1, 2, ... draws.
_POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))


def resampled(rows: DataFrame, replicates: int, seed: int, *sums: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """EVL-15, EVL-16: replicate, keys and the weighted sums over redrawn rows (with column id).

    A row's weight in a replicate is how often it is drawn: a Poisson draw of mean 1 from a digest of (seed, id, replicate),
    which is what drawing n of n rows comes to as n grows. Weights are the row's own, so nothing is joined or numbered
    and sums are partial before their exchange; one digest serves four replicates.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(":"), F.col("_four").cast("string")))
    each = rows.withColumn("_four", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))).withColumn("_digest", digest)
    each = each.select(*keys, *sums, "_four", F.posexplode(F.array(*(F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("double") / 4294967296.0 for k in range(4)))).alias("_k", "_u"))
    each = each.withColumn("replicate", F.col("_four") * 4 + F.col("_k")).where(F.col("replicate") < replicates)
    times = sum((F.when(F.col("_u") >= p, 1).otherwise(0) for p in _POISSON[1:]), F.when(F.col("_u") >= _POISSON[0], 1).otherwise(0))
    return each.withColumn("_times", times).where("_times > 0").groupBy("replicate", *keys).agg(*(F.sum(F.col(c) * F.col("_times")).alias(c) for c in sums))


def bootstrap_f1(rows: DataFrame, replicates: int = 500, keys: tuple[str, ...] = (), seed: int = 3) -> DataFrame:
    """EVL-15, EVL-16: replicate, keys and rates over redrawn rows. rows: id, keys, tp, fp, fn."""
    sums = resampled(rows, replicates, seed, "tp", "fp", "fn", keys=keys)
    return sums.select("replicate", *keys, *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def bootstrap_macro(rows: DataFrame, condition: str, replicates: int = 500, seed: int = 3) -> DataFrame:
    """EVL-15: replicate, f1: the mean over conditions of the F1 over redrawn rows."""
    return bootstrap_f1(rows, replicates, (condition,), seed).groupBy("replicate").agg(F.avg("f1").alias("f1"))


def bootstrap_mean(rows: DataFrame, value: str, replicates: int = 500, seed: int = 3) -> DataFrame:
    """EVL-15: replicate, mean of a value over redrawn rows (id, value)."""
    sums = resampled(rows.select("id", F.col(value).alias("_sum"), F.lit(1).alias("_n")), replicates, seed, "_sum", "_n")
    return sums.select("replicate", (F.col("_sum") / F.col("_n")).alias("mean"))


def averages(scores: DataFrame, left_out: dict[str, tuple[str, ...]]) -> DataFrame:
    """EVL-12: task, mean_f1, n over conditions (task, condition, f1), without those that a task leaves out."""
    skip = reduce(lambda a, b: a | b, ((F.col("task") == t) & F.col("condition").isin(*cs) for t, cs in left_out.items()), F.lit(False))
    return scores.where(~skip).groupBy("task").agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("n"))


def interval(replicated: DataFrame, value: str, *keys: str) -> DataFrame:
    """The 2.5, 50 and 97.5 percentiles, interpolated."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = replicated.groupBy(*keys).agg(p.alias("p"))
    return out.select(*keys, F.col("p")[0].alias("low"), F.col("p")[1].alias("median"), F.col("p")[2].alias("high"))


def flat(scores: DataFrame, *names: str) -> DataFrame:
    """EVL-18: metric, value, one row for each column."""
    return scores.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("m.*")


#: EVL-17: scorers by name, each from pairs (id, pred, ref) to one row.
SCORERS = {
    "BLEU-1": lambda pairs: bleu(pairs, 1).select("score"),
    "BLEU-4": lambda pairs: bleu(pairs, 4).select("score"),
    "ROUGE-2": lambda pairs: mean_std(rouge_n(pairs, 2)).withColumnRenamed("mean", "score"),
    "ROUGE-L": lambda pairs: mean_std(rouge_l(pairs)).withColumnRenamed("mean", "score"),
}


def nonblank(pairs: DataFrame) -> DataFrame:
    """FLT-9."""
    return pairs.where((T.pstrip(F.col("pred")) != "") & (T.pstrip(F.col("ref")) != ""))


def evaluate(pairs: DataFrame, *names: str) -> DataFrame:
    """metric, value of the named scorers over the pairs that aren't blank; an unknown name raises."""
    for name in names:
        if name not in SCORERS:
            raise ValueError(f"unknown scorer {name}")
    rows = nonblank(pairs)
    return reduce(DataFrame.unionByName, (SCORERS[n](rows).select(F.lit(n).alias("metric"), F.col("score").alias("value")) for n in names))


def printed(scores: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """EVL-19: ord and line of the metrics that there are, in a fixed order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("metric"))
    return scores.where(F.col("metric").isin(*order)).select(place.cast("int").alias("ord"), F.format_string("%-20s%10.4f", "metric", "value").alias("line"))
