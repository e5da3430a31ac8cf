"""Queries on what is to be protected: spans in whole documents, short forms, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import curate as C
from tessera.operators import privacy as P
from tessera.plans import sql as S
from tessera.plans.catalogue import query
from tessera.session import table


@query("q_spans")
def spans(spark, d):
    """2.13, STR-18, STR-19: no SQL, as DuckDB's patterns have no look-around and its matches no places; tested against a plain loop."""
    out = P.general_spans(table(spark, d, "documents"), "text")
    return out.select("doc_id", F.size("spans").alias("n_spans"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["kind"])), ",").alias("spans"))


_RUNS = "'[0-9]+[.,;:]*'"


@query(
    "q_number_spans",
    f"""WITH n AS (SELECT doc_id, regexp_extract_all(lower(text), {_RUNS}) AS m, regexp_split_to_array(lower(text), {_RUNS}) AS g FROM documents)
    SELECT doc_id, len(m) AS n_runs, coalesce(array_to_string(list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT
    || ':' || length(m[i])), ','), '') AS spans FROM n""",
)
def number_spans(spark, d):
    """STR-18, STR-19: the digit runs among the spans, their places and lengths."""
    out = P.general_spans(table(spark, d, "documents"), "text").select("doc_id", F.filter("spans", lambda s: s["kind"] == "number").alias("s"))
    return out.select("doc_id", F.size("s").cast("long").alias("n_runs"), F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["start"].cast("string"), (s["end"] - s["start"]).cast("string"))), ",").alias("spans"))


def _uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


def _gauss(key: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(key + " || ':a'")})) * cos(2 * pi() * {_uniform(key + " || ':b'")}))"


_ONE_WORD = "(male|female|white|asian|black|hispanic/latino|non-hispanic/non-latino)"


@query(
    "q_selective_noise",
    f"""WITH d AS (SELECT doc_id, string_split(lower(text), ' ') AS t FROM documents WHERE strlen(text) = length(text)),
    w AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS i, unnest(list_concat([NULL], t[1:len(t) - 1])) AS before, unnest(list_concat(t[2:], [NULL])) AS after FROM d),
    k AS (SELECT doc_id, i, w, regexp_matches(w, '[0-9]') OR regexp_matches(w, '(^|[^a-z0-9]){_ONE_WORD}($|[^a-z0-9])')
        OR coalesce((regexp_matches(w, '(^|[^a-z0-9])pacific$') AND regexp_matches(after, '^islander($|[^a-z0-9])')) OR (regexp_matches(before, '(^|[^a-z0-9])pacific$') AND regexp_matches(w, '^islander($|[^a-z0-9])'))
        OR (regexp_matches(w, '(^|[^a-z0-9])native$') AND regexp_matches(after, '^american($|[^a-z0-9])')) OR (regexp_matches(before, '(^|[^a-z0-9])native$') AND regexp_matches(w, '^american($|[^a-z0-9])')), false) AS mask FROM w),
    v AS (SELECT *, {_gauss("w || ':0'")} AS x, {_gauss("w || ':1'")} AS y FROM k),
    c AS (SELECT *, least(1.0::DOUBLE, 1.0::DOUBLE / greatest(sqrt(x * x + y * y), 1e-6::DOUBLE)) AS f FROM v),
    z AS (SELECT doc_id, mask, CASE WHEN mask THEN x * f + 0.5::DOUBLE * {_gauss("'7:' || doc_id || ':' || i || ':0'")} + y * f + 0.5::DOUBLE * {_gauss("'7:' || doc_id || ':' || i || ':1'")} ELSE x + y END AS s FROM c)
    SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (mask) AS n_masked, round(sum(s) FILTER (NOT mask), 4) AS plain, round(sum(s) FILTER (mask), 4) AS noised FROM z GROUP BY doc_id""",
)
def selective_noise(spark, d):
    """2.13, VEC-4, VEC-5: text, spans, tokens (between blanks), mask, and vectors clipped and noised where the mask holds alone. Vectors are drawn by the token; texts of ASCII."""
    docs = table(spark, d, "documents").where(F.octet_length("text") == F.length("text"))
    words = F.split(F.lower("text"), " ", -1)
    vectors = F.transform(words, lambda w: F.array(V.gaussian(F.concat(w, F.lit(":0"))), V.gaussian(F.concat(w, F.lit(":1")))))
    rows = docs.select("doc_id", P.sensitive_words(F.col("text")).alias("mask"), vectors.alias("vectors"))
    # A generator keeps arrays from being computed once for each use.
    rows = rows.select("doc_id", F.explode(F.array(F.struct("mask", "vectors"))).alias("x")).select("doc_id", F.col("x.mask").alias("mask"), F.col("x.vectors").alias("vectors"))
    noised = T.bound(F.col("mask"), lambda m: V.selectively_noisy(F.col("vectors"), m, F.col("doc_id"), 1.0, 0.5, 7))
    each = rows.select("doc_id", F.inline(F.arrays_zip(F.col("mask").alias("m"), noised.alias("v"))))
    total = F.col("v")[0] + F.col("v")[1]
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if("m").alias("n_masked"), F.round(F.sum(F.when(~F.col("m"), total)), 4).alias("plain"), F.round(F.sum(F.when(F.col("m"), total)), 4).alias("noised"))


@query("q_part_spans")
def part_spans(spark, d):
    """JOI-8, FLT-11, STR-17: each document's own first words, flagged no, sought in all of it."""
    df = table(spark, d, "documents").withColumn("low", F.lower("text"))
    term = F.array_join(F.slice(T.words(F.col("text")), 1, 2), " ")
    parts = F.array(F.struct(F.lit(" NO ").alias("image_inferable"), term.alias("part_text"), F.lit("").alias("reason_text")))
    out = df.select("doc_id", P.merged(P.part_spans(F.col("low"), P.sensitive_terms(parts))).alias("spans"))
    return out.select("doc_id", F.size("spans").alias("n_spans"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))



_SHORT = [(long, short.lower()) for long, shorts in P.SHORT_FORMS.items() for short in shorts]
_VARIANTS = ", ".join(f"CASE WHEN contains(b, '{a}') THEN replace(b, '{a}', '{s}') END" for a, s in _SHORT)


@query("q_variants", f"WITH c AS (SELECT conv_id, turn, {S.canonical(chr(39) + 'Evaluate for  pneumonia; rule out chest pain ' + chr(39) + ' || text')} AS b FROM conversations), v AS (SELECT conv_id, turn, list_sort(list_distinct([b, {_VARIANTS}])) AS v FROM c) SELECT conv_id, turn, len(v) AS n_variants, md5(array_to_string(v, '|')) AS variants FROM v")
def variants(spark, d):
    """STR-17, STR-16."""
    t = F.concat(F.lit("Evaluate for  pneumonia; rule out chest pain "), F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array_sort(T.variants(t, P.SHORT_FORMS)).alias("v"))
    return rows.select("conv_id", "turn", F.size("v").cast("long").alias("n_variants"), F.md5(F.array_join("v", "|")).alias("variants"))


@query("q_canonical", f"SELECT doc_id, md5({S.canonical('text')}) AS canonical_md5 FROM documents")
def canonical(spark, d):
    """STR-16."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.canonical(F.col("text"))).alias("canonical_md5"))


@query(
    "q_resolve_id",
    """WITH k AS (SELECT CASE WHEN lang = 'en' THEN doc_id::VARCHAR WHEN lang = 'fr' THEN 'a:' || doc_id WHEN lang = 'de' THEN 'b:' || doc_id || '.jpg' END AS key, lang FROM documents)
    SELECT doc_id, coalesce(x.key, y.key, z.key) AS key FROM documents d LEFT JOIN k x ON x.key = d.doc_id::VARCHAR LEFT JOIN k y ON y.key = 'a:' || d.doc_id || '.png' OR y.key = 'a:' || d.doc_id LEFT JOIN k z ON z.key = 'b:' || d.doc_id || '.jpg'""",
)
def resolve_id(spark, d):
    """JOI-9."""
    docs = table(spark, d, "documents")
    i, lang = F.col("doc_id").cast("string"), F.col("lang")
    key = F.when(lang == "en", i).when(lang == "fr", F.concat(F.lit("a:"), i)).when(lang == "de", F.concat(F.lit("b:"), i, F.lit(".jpg")))
    keys = docs.select(key.alias("key")).where("key is not null")
    tried = F.array(i, F.concat(F.lit("a:"), i), F.get(P.key_candidates(F.concat(i, F.lit(".png")), "a", "b"), F.lit(2)))
    return C.resolve(docs.select("doc_id", "lang"), tried, keys, "key").select("doc_id", F.col("hit.key").alias("key"))
