"""Queries on scores: a rule's predictions against labels, answers against the turns before them, facts, bootstraps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import metrics as M
from tessera.plans import sql as S
from tessera.plans.catalogue import query
from tessera.session import cut, table

#: id, condition, y, p: gold labels and a fixed rule's.
_LONG = f"""lg AS (SELECT doc_id AS id, 'quality' AS condition, quality AS y, (n_chars >= 1000)::INTEGER AS p FROM labels JOIN documents USING (doc_id)
    UNION ALL SELECT doc_id, 'toxic', toxic, (contains(lower(text), 'stupid') OR contains(lower(text), 'idiot'))::INTEGER FROM labels JOIN documents USING (doc_id))"""
#: The same with the codes of truth t and prediction q (0 blank, 1 positive, 2 negative, 3 uncertain).
_CODES = f"""{_LONG}, cd AS (SELECT id, condition, CASE WHEN y = 1 THEN 1 WHEN id % 5 = 0 THEN 3 WHEN id % 3 = 0 THEN 2 ELSE 0 END AS t, CASE WHEN p = 1 THEN 1 WHEN id % 7 = 0 THEN 3 WHEN id % 3 = 0 THEN 2 ELSE 0 END AS q FROM lg)"""


def _long(spark, d) -> DataFrame:
    df = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    low = F.lower("text")
    said = F.contains(low, F.lit("stupid")) | F.contains(low, F.lit("idiot"))
    rows = F.array(
        F.struct(F.lit("quality").alias("condition"), F.col("quality").alias("y"), (F.col("n_chars") >= 1000).cast("int").alias("p")),
        F.struct(F.lit("toxic").alias("condition"), F.col("toxic").alias("y"), said.cast("int").alias("p")),
    )
    return df.select(F.col("doc_id").alias("id"), F.inline(rows))


def _codes(spark, d) -> DataFrame:
    i = F.col("id")

    def code(c, k):
        return F.when(F.col(c) == 1, 1).when(i % k == 0, 3).when(i % 3 == 0, 2).otherwise(0)

    return _long(spark, d).select("id", "condition", code("y", 5).alias("t"), code("p", 7).alias("q"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return reduce(lambda x, n: x.withColumn(n, F.round(n, 6)), names, df)


def _rates(tp="tp", fp="fp", fn="fn") -> str:
    def r(a, b):
        return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"

    return f"{r(tp, f'{tp} + {fp}')} AS precision, {r(tp, f'{tp} + {fn}')} AS recall, {r(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1"


_CNT = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn"


def _report(source: str) -> str:
    return f"""b AS (SELECT condition AS name, {_CNT} FROM {source} GROUP BY condition), e AS (SELECT name, {_rates()}, tp + fn AS support FROM b),
    o AS (SELECT id, {_CNT} FROM {source} GROUP BY id), os AS (SELECT {_rates()}, tp + fn AS support FROM o),
    rep AS (SELECT * FROM e UNION ALL SELECT 'micro avg', {_rates()}, tp + fn FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM b)
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM e
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e
    UNION ALL SELECT 'samples avg', avg(precision), avg(recall), avg(f1), sum(support) FROM os)"""


_OUT = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query("q_label_f1", f"WITH {_LONG}, {_report('lg')} SELECT name, {_OUT}, support::BIGINT AS support FROM rep")
def label_f1(spark, d):
    """EVL-7."""
    return _rounded(M.label_report(cut(_long(spark, d))), "precision", "recall", "f1")


@query(
    "q_label_variants",
    f"""WITH {_CODES}, vr AS (SELECT id, condition, v.mode || '/' || s.subset AS variant, (t = 1 OR (v.mode = 'rrg+' AND t = 3))::INTEGER AS y, (q = 1 OR (v.mode = 'rrg+' AND q = 3))::INTEGER AS p FROM cd, (VALUES ('rrg'), ('rrg+')) v(mode), (VALUES ('all'), ('some')) s(subset) WHERE s.subset = 'all' OR condition = 'toxic'),
    b AS (SELECT variant, condition, {_CNT} FROM vr GROUP BY ALL), r AS (SELECT variant, {_rates()} FROM b), m AS (SELECT variant, {_rates('sum(tp)', 'sum(fp)', 'sum(fn)')} FROM b GROUP BY variant)
    SELECT m.variant, round(m.f1, 6) AS micro_f1, round((SELECT avg(f1) FROM r WHERE r.variant = m.variant), 6) AS macro_f1 FROM m""",
)
def label_variants(spark, d):
    """EVL-6, EVL-8, ARR-5: all and some conditions, uncertain as negative and as positive, in one pass."""
    rows = _codes(spark, d)
    variants = [F.struct(F.lit(f"{mode}/{subset}").alias("variant"), M.to_binary(F.col("t"), mode).alias("y"), M.to_binary(F.col("q"), mode).alias("p")) for mode in ("rrg", "rrg+") for subset in ("all", "some")]
    long = rows.select("id", "condition", F.inline(F.array(*variants))).where(~F.endswith("variant", F.lit("/some")) | F.col("condition").isin("toxic"))
    counts = M.label_counts(long, "variant", "condition")
    total = counts.groupBy("variant").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    micro = total.select("variant", F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6).alias("micro_f1"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return micro.join(counts.groupBy("variant").agg(F.round(F.avg(f1), 6).alias("macro_f1")), "variant").withColumn("micro_f1", F.coalesce("micro_f1", F.lit(0.0)))


def _task_sql(task: str, source: str = "cd") -> str:
    at = {"mention": ("t IN (1, 2, 3)", "q IN (1, 2, 3)"), "blank": ("t = 0", "q = 0"), "negation": ("t = 2", "q = 2"), "positive": ("t = 1", "q = 1"), "uncertain": ("t = 3", "q = 3")}[task]
    return f"SELECT '{task}' AS task, condition, {_CNT} FROM (SELECT condition, ({at[0]})::INTEGER AS y, ({at[1]})::INTEGER AS p FROM {source}) GROUP BY condition"


_TASKS = ("mention", "blank", "negation", "positive", "uncertain")
_TASK = f"{_CODES}, tk AS ({' UNION ALL '.join(map(_task_sql, _TASKS))}), ts AS (SELECT task, condition, {_rates()} FROM tk)"


def _task_scores(spark, d) -> DataFrame:
    rows = cut(_codes(spark, d))
    return reduce(DataFrame.unionByName, (M.task_f1(rows, t).select(F.lit(t).alias("task"), "condition", "f1") for t in _TASKS))


@query("q_task_f1", f"WITH {_TASK} SELECT task, condition, round(f1, 6) AS f1 FROM ts")
def task_f1(spark, d):
    """EVL-9."""
    return _rounded(_task_scores(spark, d), "f1")


#: The labels of each language as conditions of their own; of these negation leaves out one, uncertain two.
_BY_LANG = f"{_CODES}, cl AS (SELECT cd.id, cd.condition || '/' || d.lang AS condition, t, q FROM cd JOIN documents d ON d.doc_id = cd.id)"
_LEFT_OUT = {"negation": ("quality/fr",), "uncertain": ("quality/fr", "toxic/fr")}


@query(
    "q_task_averages",
    f"""WITH {_BY_LANG}, tk AS ({' UNION ALL '.join(_task_sql(t, 'cl') for t in _TASKS)}), ts AS (SELECT task, condition, {_rates()} FROM tk)
    SELECT task, round(avg(f1), 6) AS mean_f1, count(*) AS n FROM ts WHERE NOT (task = 'negation' AND condition = 'quality/fr') AND NOT (task = 'uncertain' AND condition IN ('quality/fr', 'toxic/fr')) GROUP BY task""",
)
def task_averages(spark, d):
    """EVL-12: averages over conditions, of which negation leaves out the last and uncertain the last two."""
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    rows = cut(_codes(spark, d).join(lang, "id").withColumn("condition", F.concat_ws("/", "condition", "lang")))
    scores = reduce(DataFrame.unionByName, (M.task_f1(rows, t).select(F.lit(t).alias("task"), "condition", "f1") for t in _TASKS))
    return _rounded(M.averages(scores, _LEFT_OUT), "mean_f1")


@query("q_label_weights", f"WITH {_CODES}, a AS (SELECT condition, t AS label FROM cd UNION ALL SELECT condition, q FROM cd), w AS (SELECT condition, count(*) FILTER (label = 2) AS ng, count(*) FILTER (label = 3) AS un, count(*) FILTER (label = 1) AS po FROM a GROUP BY condition) SELECT condition, round(ng / (ng + un + po)::DOUBLE, 6) AS negation, round(un / (ng + un + po)::DOUBLE, 6) AS uncertain, round(po / (ng + un + po)::DOUBLE, 6) AS positive FROM w")
def label_weights(spark, d):
    """EVL-10: truth and prediction are the two annotators."""
    c = _codes(spark, d)
    both = c.select("condition", F.explode(F.array("t", "q")).alias("label"))
    return _rounded(M.class_weights(both), "negation", "uncertain", "positive")


@query("q_weighted_f1", f"WITH {_TASK}, a AS (SELECT condition, t AS label FROM cd UNION ALL SELECT condition, q FROM cd), w AS (SELECT condition, unnest(['negation', 'uncertain', 'positive']) AS task, unnest([count(*) FILTER (label = 2), count(*) FILTER (label = 3), count(*) FILTER (label = 1)]) / count(*) FILTER (label <> 0)::DOUBLE AS w FROM a GROUP BY condition) SELECT condition, round(sum(w * f1), 6) AS weighted_f1 FROM ts JOIN w USING (condition, task) GROUP BY condition")
def weighted_f1(spark, d):
    """VEC-10."""
    c = cut(_codes(spark, d))
    w = M.class_weights(c.select("condition", F.explode(F.array("t", "q")).alias("label")))
    long = w.select("condition", F.inline(F.array(*(F.struct(F.lit(t).alias("task"), F.col(t).alias("w")) for t in ("negation", "uncertain", "positive")))))
    f1 = reduce(DataFrame.unionByName, (M.task_f1(c, t).withColumn("task", F.lit(t)) for t in ("negation", "uncertain", "positive")))
    return f1.join(long, ["condition", "task"]).groupBy("condition").agg(F.round(F.sum(F.col("w") * F.col("f1")), 6).alias("weighted_f1"))


@query("q_confusion", f"WITH {_CODES} SELECT condition, t, q, count(*) AS cnt FROM cd GROUP BY ALL")
def confusion(spark, d):
    """EVL-11."""
    return M.confusion(_codes(spark, d), "condition")


@query("q_kappa", f"WITH {_CODES}, n AS (SELECT condition, count(*)::DOUBLE AS n, count(*) FILTER (t = q) AS s FROM cd GROUP BY condition), a AS (SELECT condition, t AS c, count(*)::DOUBLE AS a FROM cd GROUP BY ALL), b AS (SELECT condition, q AS c, count(*)::DOUBLE AS b FROM cd GROUP BY ALL), e AS (SELECT condition, sum(a * b) AS ab FROM a JOIN b USING (condition, c) GROUP BY condition) SELECT condition, round((s / n - ab / (n * n)) / (1 - ab / (n * n)), 6) AS kappa FROM n JOIN e USING (condition)")
def kappa(spark, d):
    """EVL-11."""
    return _rounded(M.kappa(_codes(spark, d), "condition"), "kappa")


@query("q_expert_codes", "SELECT doc_id, CASE quality WHEN 0 THEN 2 WHEN -1 THEN 3 ELSE coalesce(quality, 0) END AS quality_ann1, CASE toxic WHEN 0 THEN 2 WHEN -1 THEN 3 ELSE coalesce(toxic, 0) END AS toxic_ann1 FROM labels")
def expert_codes(spark, d):
    """SRC-7: annotations renamed and recoded."""
    from tessera.sources.readers import expert_annotations

    return expert_annotations(table(spark, d, "labels"), {"quality": "quality_ann1", "toxic": "toxic_ann1"}).select("doc_id", "quality_ann1", "toxic_ann1")


@query("q_transpose", f"WITH {_LONG} SELECT id, max(p) FILTER (condition = 'quality') AS quality, max(p) FILTER (condition = 'toxic') AS toxic FROM lg GROUP BY id")
def transpose(spark, d):
    """ARR-4."""
    return _long(spark, d).groupBy("id").pivot("condition", ["quality", "toxic"]).agg(F.max("p"))


@query("q_subset_conditions", f"WITH {_LONG} SELECT condition, count(*) AS n, sum(y)::BIGINT AS positives FROM lg WHERE condition IN ('toxic') GROUP BY condition")
def subset_conditions(spark, d):
    """ARR-5."""
    return _long(spark, d).where(F.col("condition").isin("toxic")).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("q_flat_scores", f"WITH {_LONG}, {_report('lg')}, m AS (SELECT * FROM rep WHERE name = 'micro avg') SELECT 'precision' AS metric, round(precision, 6) AS value FROM m UNION ALL SELECT 'recall', round(recall, 6) FROM m UNION ALL SELECT 'f1', round(f1, 6) FROM m")
def flat_scores(spark, d):
    """EVL-18."""
    micro = M.label_report(cut(_long(spark, d))).where("name = 'micro avg'")
    return _rounded(M.flat(micro, "precision", "recall", "f1"), "value")


#: Pairs of an answer and the user's turn before it, neither blank.
_PAIRS = f"""pr AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS pred, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant' AND b.role = 'user' AND {S.strip('a.text')} <> '' AND {S.strip('b.text')} <> ''),
    tk AS (SELECT id, {S.words('lower(pred)')} AS p, {S.words('lower(ref)')} AS r FROM pr)"""


def _pairs(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    b = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    a = t.where("role = 'assistant'").join(b, ["conv_id", "turn"])
    return M.nonblank(a.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("pred"), "ref"))


def _grams(n: int) -> str:
    def side(c: str) -> str:
        return f"(SELECT id, g, count(*) AS k FROM (SELECT id, unnest(list_transform(range(1, greatest(len({c}) - {n - 1}, 0) + 1), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))) AS g FROM tk) GROUP BY id, g)"

    return f"h{n} AS (SELECT a.id, sum(least(a.k, b.k))::BIGINT AS hit FROM {side('p')} a JOIN {side('r')} b USING (id, g) GROUP BY a.id)"


def _bleu_value(n: int) -> str:
    ks = range(1, n + 1)
    return f"CASE WHEN {' AND '.join(f'hit_{k} > 0' for k in ks)} THEN CASE WHEN pred_len >= ref_len THEN 1 ELSE exp(1 - ref_len / pred_len::DOUBLE) END * exp(({' + '.join(f'ln(greatest(hit_{k}, 1) / total_{k}::DOUBLE)' for k in ks)}) / {n}) ELSE 0 END"


def _bleu_sum(n: int) -> str:
    ks = range(1, n + 1)
    return f"{', '.join(_grams(k) for k in ks)}, t AS (SELECT sum(len(p))::BIGINT AS pred_len, sum(len(r))::BIGINT AS ref_len, {', '.join(f'sum(greatest(len(p) - {k - 1}, 0))::BIGINT AS total_{k}' for k in ks)}, {', '.join(f'coalesce((SELECT sum(hit) FROM h{k}), 0)::BIGINT AS hit_{k}' for k in ks)} FROM tk)"


def _bleu(n: int) -> str:
    return f"WITH {_PAIRS}, {_bleu_sum(n)} SELECT pred_len, ref_len, {', '.join(f'total_{k}, hit_{k}' for k in range(1, n + 1))}, round({_bleu_value(n)}, 6) AS score FROM t"


@query("q_bleu1", _bleu(1))
def bleu1(spark, d):
    """EVL-2."""
    return _rounded(M.bleu(cut(_pairs(spark, d)), 1), "score")


@query("q_bleu4", _bleu(4))
def bleu4(spark, d):
    """EVL-1."""
    return _rounded(M.bleu(cut(_pairs(spark, d)), 4), "score")


_ROUGE2 = "f AS (SELECT tk.id, CASE WHEN coalesce(hit, 0) > 0 THEN 2 * hit / (greatest(len(p) - 1, 0) + greatest(len(r) - 1, 0))::DOUBLE ELSE 0 END AS f FROM tk LEFT JOIN h2 USING (id))"
#: The table of the longest common subsequence, a row of it for each word of p: the running maximum over r's words.
_LCS = """dp AS (SELECT id, p, r, 0 AS k, list_transform(range(len(r)), lambda j: 0) AS l FROM tk
    UNION ALL SELECT id, p, r, k + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(l[i], CASE WHEN r[i] = p[k + 1] THEN coalesce(l[i - 1], 0) + 1 ELSE 0 END)))) FROM dp WHERE k < len(p)),
    lc AS (SELECT id, CASE WHEN l[len(r)] > 0 THEN 2 * l[len(r)] / (len(p) + len(r))::DOUBLE ELSE 0 END AS f FROM dp WHERE k = len(p))"""


@query("q_rouge2", f"WITH {_PAIRS}, {_grams(2)}, {_ROUGE2} SELECT round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS std FROM f")
def rouge2(spark, d):
    """EVL-4, EVL-5."""
    return _rounded(M.mean_std(M.rouge_n(cut(_pairs(spark, d)), 2)), "mean", "std")


@query("q_rougel", f"WITH RECURSIVE {_PAIRS}, {_LCS} SELECT id, round(f, 6) AS f FROM lc")
def rougel(spark, d):
    """EVL-3."""
    return _rounded(M.rouge_l(_pairs(spark, d)), "f")


@query(
    "q_scorers",
    f"""WITH RECURSIVE {_PAIRS}, {_bleu_sum(4)}, {_ROUGE2}, {_LCS} SELECT 'BLEU-1' AS metric, round({_bleu_value(1)}, 6) AS value FROM t UNION ALL SELECT 'BLEU-4', round({_bleu_value(4)}, 6) FROM t
    UNION ALL SELECT 'ROUGE-2', round(avg(f), 6) FROM f UNION ALL SELECT 'ROUGE-L', round(avg(f), 6) FROM lc""",
)
def scorers(spark, d):
    """EVL-17: all registered scorers."""
    return _rounded(M.evaluate(cut(_pairs(spark, d)), *M.SCORERS), "value")


@query(
    "q_printed",
    f"""WITH {_PAIRS}, {_bleu_sum(1)}, {_grams(2)}, {_ROUGE2} SELECT 1::INTEGER AS ord, printf('%-20s%10.4f', 'ROUGE-2', avg(f)) AS line FROM f UNION ALL SELECT 3::INTEGER, printf('%-20s%10.4f', 'BLEU-1', {_bleu_value(1)}::DOUBLE) FROM t""",
)
def printed(spark, d):
    """EVL-19: a score that isn't there has no line."""
    return M.printed(M.evaluate(cut(_pairs(spark, d)), "BLEU-1", "ROUGE-2"), ("ROUGE-2", "ROUGE-L", "BLEU-1", "BLEU-4"))


#: Facts of a turn: its distinct words with their first letters as labels; one relation, to the word after, for words of five letters and more.
_FACTS = """fa AS (SELECT id, list_distinct(list_transform(p, lambda w: w || '/' || w[1:1])) AS ps, list_distinct(list_transform(r, lambda w: w || '/' || w[1:1])) AS rs,
    list_distinct(list_transform(p, lambda w, i: w || '/' || w[1:1] || CASE WHEN length(w) >= 5 AND i < len(p) THEN '/some' ELSE '' END)) AS pp, list_distinct(list_transform(r, lambda w, i: w || '/' || w[1:1] || CASE WHEN length(w) >= 5 AND i < len(r) THEN '/some' ELSE '' END)) AS rp,
    list_distinct(list_transform(p, lambda w, i: w || '/' || w[1:1] || CASE WHEN length(w) >= 5 AND i < len(p) THEN '/next/' || p[i + 1] ELSE '' END)) AS pc, list_distinct(list_transform(r, lambda w, i: w || '/' || w[1:1] || CASE WHEN length(w) >= 5 AND i < len(r) THEN '/next/' || r[i + 1] ELSE '' END)) AS rc FROM tk)"""


def _reward(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))::DOUBLE ELSE 0 END"


@query("q_entity_f1", f"WITH {_PAIRS}, {_FACTS} SELECT id, round({_reward('ps', 'rs')}, 6) AS simple_f1, round({_reward('pp', 'rp')}, 6) AS partial_f1, round({_reward('pc', 'rc')}, 6) AS complete_f1 FROM fa")
def entity_f1(spark, d):
    """EVL-13."""
    return _rounded(_entity_scores(spark, d), "simple_f1", "partial_f1", "complete_f1")


def _entity_scores(spark, d) -> DataFrame:
    def entities(w):
        def of(x, i):
            linked = (F.length(x) >= 5) & (i < F.size(w) - 1)
            target = F.array(F.struct(F.lit("next").alias("type"), (i + 1).cast("string").alias("target")))
            return F.struct(i.cast("string").alias("id"), x.alias("tokens"), F.substring(x, 1, 1).alias("label"), F.when(linked, target).otherwise(F.array().cast("array<struct<type:string,target:string>>")).alias("relations"))

        return F.transform(w, of)

    def scores(p, r):
        return F.struct(*(M.fact_reward(M.facts(p, level), M.facts(r, level), f"{level}_")[0] for level in ("simple", "partial", "complete")))

    def sides(c):
        return T.bound(M.tokens(F.col(c)), entities)

    out = T.bound(sides("pred"), lambda p: T.bound(sides("ref"), lambda r: scores(p, r)))
    return _pairs(spark, d).select("id", F.inline(F.array(out)))


@query("q_entity_mean", f"WITH {_PAIRS}, {_FACTS} SELECT round(sum(f) / (SELECT count(*) FROM conversations WHERE role = 'assistant'), 6) AS mean_f1, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS n FROM (SELECT {_reward('ps', 'rs')} AS f FROM fa)")
def entity_mean(spark, d):
    """EVL-14: answers without a pair score 0 and count."""
    every = table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    f = every.join(_entity_scores(spark, d), "id", "left").select(F.coalesce("simple_f1", F.lit(0.0)).alias("f"))
    return f.agg(F.round(F.avg("f"), 6).alias("mean_f1"), F.count(F.lit(1)).alias("n"))


#: Weights of rows (source: id and values) in 500 replicates: a Poisson draw of mean 1 from a digest of (seed, id, replicate).
_POISSON = " + ".join(f"(u >= {p!r}::DOUBLE)::INTEGER" for p in M._POISSON)


def _drawn(source: str) -> str:
    four = f"(SELECT *, md5('3:' || id || ':' || b.i) AS h, b.i AS four FROM {source}, range(125) b(i))"
    return f"(SELECT *, {_POISSON} AS times FROM (SELECT *, four * 4 + k.i AS replicate, ('0x' || substr(h, 1 + 8 * k.i, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {four}, range(4) k(i)))"


_ONE = f"{_LONG}, one AS (SELECT id, condition, {_CNT} FROM lg GROUP BY id, condition)"
_BOOT = f"{_ONE}, bt AS (SELECT replicate, condition, sum(tp * times) AS tp, sum(fp * times) AS fp, sum(fn * times) AS fn FROM {_drawn('one')} WHERE times > 0 GROUP BY ALL), rt AS (SELECT replicate, condition, {_rates()} FROM bt)"


def _pct(value: str = "f1") -> str:
    return f"round(quantile_cont({value}, 0.025), 6) AS low, round(quantile_cont({value}, 0.5), 6) AS median, round(quantile_cont({value}, 0.975), 6) AS high"


def _counted(spark, d) -> DataFrame:
    return cut(M.label_counts(_long(spark, d), "id", "condition"))


@query(
    "q_bootstrap",
    f"""WITH {_BOOT}, mi AS (SELECT replicate, {_rates('sum(tp)', 'sum(fp)', 'sum(fn)')} FROM bt GROUP BY replicate), ma AS (SELECT replicate, avg(f1) AS f1 FROM rt GROUP BY replicate)
    SELECT 'micro' AS average, {_pct()} FROM mi UNION ALL SELECT 'macro', {_pct()} FROM ma""",
)
def bootstrap(spark, d):
    """EVL-15: the micro and the macro F1 of 500 replicates."""
    rows = _counted(spark, d)
    micro, macro = M.bootstrap_f1(rows), M.bootstrap_macro(rows, "condition")
    out = M.interval(micro.select(F.lit("micro").alias("average"), "f1").unionByName(macro.select(F.lit("macro").alias("average"), "f1")), "f1", "average")
    return _rounded(out, "low", "median", "high")


@query("q_bootstrap_classes", f"WITH {_BOOT} SELECT condition, s.score, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS high FROM (SELECT condition, unnest(['precision', 'recall', 'f1']) AS score, unnest([precision, recall, f1]) AS value FROM rt) s GROUP BY condition, s.score")
def bootstrap_classes(spark, d):
    """EVL-16: precision, recall and F1 of each condition over 500 replicates."""
    rates = M.bootstrap_f1(_counted(spark, d), keys=("condition",))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).alias("value")) for c in ("precision", "recall", "f1"))))
    return _rounded(M.interval(rates.select("condition", each), "value", "condition", "score"), "low", "median", "high")


@query("q_bootstrap_reward", f"WITH {_PAIRS}, {_FACTS}, one AS (SELECT id, {_reward('ps', 'rs')} AS f FROM fa), m AS (SELECT replicate, sum(f * times) / sum(times) AS mean FROM {_drawn('one')} GROUP BY replicate) SELECT {_pct('mean')} FROM m")
def bootstrap_reward(spark, d):
    """EVL-15: the mean reward of 500 replicates."""
    rows = cut(_entity_scores(spark, d).select("id", "simple_f1"))
    return _rounded(M.interval(M.bootstrap_mean(rows, "simple_f1"), "mean"), "low", "median", "high")


def _bleu_sums(n: int) -> str:
    ks = range(1, n + 1)
    one = f"one AS (SELECT tk.id, len(p) AS pred_len, len(r) AS ref_len, {', '.join(f'greatest(len(p) - {k - 1}, 0) AS total_{k}, coalesce(h{k}.hit, 0) AS hit_{k}' for k in ks)} FROM tk {' '.join(f'LEFT JOIN h{k} ON h{k}.id = tk.id' for k in ks)})"
    names = ["pred_len", "ref_len", *(f"{c}_{k}" for k in ks for c in ("total", "hit"))]
    return f"WITH {_PAIRS}, {', '.join(_grams(k) for k in ks)}, {one}, sm AS (SELECT replicate, {', '.join(f'sum({c} * times) AS {c}' for c in names)} FROM {_drawn('one')} GROUP BY replicate), m AS (SELECT {_bleu_value(n)} AS score FROM sm) SELECT {_pct('score')} FROM m"


@query("q_bootstrap_bleu", _bleu_sums(4))
def bootstrap_bleu(spark, d):
    """EVL-1: the interval of BLEU-4 over 500 replicates."""
    return _rounded(M.interval(M.bootstrap_bleu(cut(_pairs(spark, d)), 4), "score"), "low", "median", "high")
