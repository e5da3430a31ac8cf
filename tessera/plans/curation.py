"""Queries on records: filters, ordered deduplication, joins by name, record shapes, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import curate as C
from tessera.operators import metrics as M
from tessera.plans import sql as S
from tessera.plans.catalogue import query
from tessera.session import table

_FILTERS = {
    # name: (table, column condition, the same in SQL)
    "flt_1_equals": ("documents", lambda: F.col("lang") == "en", "lang = 'en'"),
    "flt_2_all_present": ("labels", lambda: F.col("quality").isNotNull() & F.col("toxic").isNotNull(), "quality IS NOT NULL AND toxic IS NOT NULL"),
    "flt_3_mandatory": ("documents", lambda: F.col("doc_id").isNotNull() & (F.col("source") != "") & F.col("text").isNotNull(), "doc_id IS NOT NULL AND source <> '' AND text IS NOT NULL"),
    "flt_4_not_the_word": ("conversations", lambda: F.col("role").isNotNull() & (T.pstrip(F.lower("role")) != "system"), f"role IS NOT NULL AND {S.strip('lower(role)')} <> 'system'"),
    "flt_5_not_empty": ("documents", lambda: F.length("text") > 0, "length(text) > 0"),
    "flt_7_in_set": ("orders", lambda: F.col("o_orderstatus").isin("O", "P"), "o_orderstatus IN ('O', 'P')"),
    "flt_9_not_blank": ("pages", lambda: (T.pstrip(F.col("url")) != "") & (T.pstrip(F.col("html")) != ""), f"{S.strip('url')} <> '' AND {S.strip('html')} <> ''"),
    "flt_10_complete": ("conversations", lambda: F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull(), "conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL"),
    "flt_11_flag": ("documents", lambda: F.lower(T.pstrip(F.col("lang"))) == "de", f"lower({S.strip('lang')}) = 'de'"),
}


@query("q_filters", " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS kept FROM {t} WHERE {sql}" for k, (t, _, sql) in _FILTERS.items()))
def filters(spark, d):
    """FLT-1 to FLT-5, FLT-7, FLT-9 to FLT-11: rows kept by each."""
    return reduce(DataFrame.unionByName, (table(spark, d, t).where(c()).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(k).alias("filter"), "kept") for k, (t, c, _) in _FILTERS.items()))


@query("q_prefix_scan", "SELECT doc_id, source FROM documents WHERE doc_id < coalesce((SELECT min(doc_id) FROM documents WHERE source LIKE 'src7%'), 9223372036854775807)")
def prefix_scan(spark, d):
    return C.until_first(table(spark, d, "documents").select("doc_id", "source"), "doc_id", F.startswith("source", F.lit("src7")))


@query("q_keep_first", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def keep_first(spark, d):
    return C.keep_first(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "q_greedy_dedup",
    """WITH RECURSIVE r AS (SELECT doc_id, md5(coalesce(text, '?')) AS a, md5(coalesce(left(text, 40), '?')) AS b, coalesce(n_chars, -1) AS c, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
    g AS (
        SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, []::VARCHAR[] AS sa, []::VARCHAR[] AS sb, []::BIGINT[] AS sc, false AS kept
        UNION ALL
        SELECT r.n, r.doc_id, CASE WHEN k THEN list_append(sa, a) ELSE sa END, CASE WHEN k THEN list_append(sb, b) ELSE sb END, CASE WHEN k THEN list_append(sc, c) ELSE sc END, k
        FROM (SELECT r.*, g.sa, g.sb, g.sc, NOT (list_contains(g.sa, r.a) OR list_contains(g.sb, r.b) OR list_contains(g.sc, r.c)) AS k FROM g JOIN r ON r.n = g.n + 1) r
    ) SELECT doc_id FROM g WHERE kept""",
)
def greedy_dedup(spark, d):
    """AGG-6 under four keys, of which one is the id."""
    df = table(spark, d, "documents")
    return C.greedy_dedup(df.select("doc_id", "text", "n_chars"), "doc_id", [F.col("text"), F.substring("text", 1, 40), F.col("n_chars"), F.col("doc_id")]).select("doc_id")


@query("q_semi_files", "WITH p AS (SELECT page_id, url, split_part(url, '/', -1) AS name FROM pages), f AS (SELECT name, regexp_replace(name, '(.)[.][^.]*$', '\\1') AS stem, url FROM p WHERE url LIKE 'https:%'), s AS (SELECT stem, max(url) AS found FROM f GROUP BY stem) SELECT page_id, coalesce(found, url) AS url FROM p LEFT JOIN s ON regexp_replace(p.name, '(.)[.][^.]*$', '\\1') = s.stem WHERE name IN (SELECT name FROM f)")
def semi_files(spark, d):
    """JOI-1, PRJ-3, STR-22: the listed files are the secure pages'."""
    pages = table(spark, d, "pages").select("page_id", "url")
    return C.with_files(pages, "url", pages.where(F.startswith("url", F.lit("https:"))), "url")


@query("q_image_path", "SELECT page_id, CASE WHEN p[1:1] = '/' THEN p ELSE 'root/' || p END AS path FROM (SELECT page_id, replace(CASE WHEN page_id % 2 = 0 THEN '../' ELSE '/' END || split_part(url, '/', -1), '..', '.') AS p FROM pages)")
def image_path(spark, d):
    """PRJ-6."""
    lead = F.when(F.col("page_id") % 2 == 0, "../").otherwise("/")
    return table(spark, d, "pages").select("page_id", T.resolve_path("root/", F.concat(lead, T.basename(F.col("url")))).alias("path"))


def _turns(spark, d):
    """Conversations as arrays of turns in order."""
    t = table(spark, d, "conversations")
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("turns"))
    return rows


@query(
    "q_chat_pairs",
    f"""SELECT conv_id, {S.strip("replace(max_by(text, turn) FILTER (role = 'user'), '<image>', '')")} AS question, {S.strip("replace(max_by(text, turn) FILTER (role = 'assistant'), '<image>', '')")} AS answer FROM conversations GROUP BY conv_id""",
)
def chat_pairs(spark, d):
    """PRJ-5, SRC-4's shape: the last turn of each side."""
    return _turns(spark, d).select("conv_id", C.last_turn(F.col("turns"), "user").alias("question"), C.last_turn(F.col("turns"), "assistant").alias("answer"))


@query("q_first_view", "SELECT conv_id, min_by(text, turn) FILTER (role IN ('assistant', 'tool')) AS first_value FROM conversations GROUP BY conv_id")
def first_view(spark, d):
    """AGG-7, ARR-1, FLT-6, FLT-7."""
    return _turns(spark, d).select("conv_id", C.first_match(F.col("turns.value"), F.col("turns.from"), ("assistant", "tool")).alias("first_value"))


def _three(spark, d):
    """Three corpora under keys source:id."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("documents:"), F.col("doc_id").cast("string")).alias("key"), F.col("doc_id").alias("ord"), "text")
    bench = table(spark, d, "benchmark").select(F.concat(F.lit("benchmark:"), F.col("item_id").cast("string")).alias("key"), F.col("item_id").alias("ord"), "text")
    conv = table(spark, d, "conversations").select(F.concat(F.lit("conversations:"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    return C.concat_sources(docs, bench, conv)


_THREE = """t AS (SELECT 'documents:' || doc_id AS key, doc_id AS ord, text, 0 AS source_rank FROM documents UNION ALL SELECT 'benchmark:' || item_id, item_id, text, 1 FROM benchmark
    UNION ALL SELECT 'conversations:' || conv_id || '-' || turn, conv_id * 1000 + turn, text, 2 FROM conversations)"""


@query("q_three_sources", f"WITH {_THREE} SELECT key, source_rank, row_number() OVER (PARTITION BY source_rank ORDER BY ord) AS place FROM t")
def three_sources(spark, d):
    """SET-1; the place within its source is found among its counts per block of ids."""
    rows = _three(spark, d).select("key", "ord", "source_rank", F.expr("ord div 4096").alias("block"))
    n = rows.groupBy("source_rank", "block").count()
    before = Window.partitionBy("source_rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("source_rank", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"))
    place = F.row_number().over(Window.partitionBy("source_rank", "block").orderBy("ord"))
    return rows.join(n, ["source_rank", "block"]).select("key", "source_rank", (F.col("below") + place).alias("place"))


@query("q_distinct_union", f"WITH {_THREE} SELECT DISTINCT md5(text) AS text_md5 FROM t WHERE text IS NOT NULL")
def distinct_union(spark, d):
    """SET-3."""
    return _three(spark, d).where("text is not null").select(F.md5("text").alias("text_md5")).distinct()


@query("q_multiset_count", f"WITH {_THREE} SELECT md5(text) AS text_md5, count(*) AS cnt FROM t WHERE text IS NOT NULL GROUP BY text")
def multiset_count(spark, d):
    """SET-4."""
    return _three(spark, d).where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("cnt"))


@query("q_source_counts", "SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts FROM documents GROUP BY source, lang")
def source_counts(spark, d):
    """AGG-8, AGG-9."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"))


@query("q_latest", f"WITH {_THREE} SELECT text_md5, max_by(key, (source_rank, ord)) AS key FROM (SELECT *, md5(text) AS text_md5 FROM t WHERE text IS NOT NULL) GROUP BY text_md5")
def latest(spark, d):
    """SET-2, AGG-14: of equal texts the entry that came last."""
    rows = _three(spark, d).where("text is not null").withColumn("text_md5", F.md5("text"))
    return rows.groupBy("text_md5").agg(F.max_by("key", F.struct("source_rank", "ord")).alias("key"))


_PROMPT = "'<image>' || chr(10) || 'Describe the findings of the chest x-ray given the following indications: ' || {} || '{}' || chr(10)"


@query(
    "q_record_outer",
    f"""WITH a AS (SELECT doc_id::VARCHAR AS id, lang AS indication, text AS findings, coalesce('Ethnicity: ' || source || '. ', '') || coalesce('Sex: ' || CASE quality WHEN 1 THEN 'male' WHEN 0 THEN 'female' END || '. ', '') || lang AS reason, source AS view FROM documents LEFT JOIN labels USING (doc_id))
    SELECT id, reason, 'rule-based' AS generate_method, {_PROMPT.format('reason', '.')} AS question, md5(findings) AS answer_md5, view FROM a WHERE id <> '' AND findings IS NOT NULL AND indication IS NOT NULL""",
)
def record_outer(spark, d):
    """PRJ-1, STR-12, STR-14, FLT-3: records with a full stop after the reason."""
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    sex = T.sex_word(F.when(F.col("quality") == 1, "M").when(F.col("quality") == 0, "F"))
    reason = T.prefixed(F.col("lang"), ("Sex", sex), ("Ethnicity", F.col("source")))
    turns = F.array(F.struct(F.lit("human").alias("from"), T.prompt(F.col("reason"), ".").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("text").alias("value")))
    out = df.where("doc_id is not null and text is not null and lang is not null").withColumn("reason", reason)
    out = out.select(F.col("doc_id").cast("string").alias("id"), "reason", F.lit("rule-based").alias("generate_method"), turns.alias("conversations"), F.col("source").alias("view"))
    return out.select("id", "reason", "generate_method", F.col("conversations")[0]["value"].alias("question"), F.md5(F.col("conversations")[1]["value"]).alias("answer_md5"), "view")


@query(
    "q_record_contained",
    f"""WITH a AS (SELECT doc_id, CASE WHEN lang <> 'en' AND NOT contains(lower(text), lang) THEN 'Race: ' || lang || '. ' || text ELSE text END AS r FROM documents WHERE text <> '' AND text <> 'nan')
    SELECT sha256('documents' || chr(31) || doc_id) AS id, md5(r) AS reason_md5, md5({_PROMPT.format('r', '')}) AS question_md5 FROM a""",
)
def record_contained(spark, d):
    """PRJ-1, STR-13, STR-14, STR-26, STR-27: records without one."""
    df = table(spark, d, "documents").withColumn("reason", T.null_if_blank(F.col("text"))).where("reason is not null")
    df = df.withColumn("reason", T.prefixed_unless_held(F.col("reason"), ("Race", T.without(F.col("lang"), "en"))))
    return df.select(T.stable_id(F.lit("documents"), F.col("doc_id").cast("string")).alias("id"), F.md5("reason").alias("reason_md5"), F.md5(T.prompt(F.col("reason"))).alias("question_md5"))


@query(
    "q_chat_struct",
    """WITH a AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS q, max_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
    SELECT conv_id, 2 AS n_messages, md5(q || chr(31) || a) AS content_md5 FROM a WHERE q IS NOT NULL AND a IS NOT NULL""",
)
def chat_struct(spark, d):
    """PRJ-7, FLT-10: chat samples with an image, a question and an answer."""
    def last(role):
        found = F.filter("turns", lambda t: t["from"] == role)
        return F.get(found, F.size(found) - 1)["value"].alias(role)

    df = _turns(spark, d).select("conv_id", last("user"), last("assistant"))
    df = df.where("conv_id is not null and user is not null and assistant is not null")
    none = F.lit(None).cast("string")

    def content(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.array(content("image", none), content("text", F.col("user"))).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.array(content("text", F.col("assistant"))).alias("content")),
    )
    out = df.select("conv_id", messages.alias("messages"))
    said = F.array_join(F.transform("messages", lambda m: F.element_at(m["content"], -1)["text"]), "\x1f")
    return out.select("conv_id", F.size("messages").alias("n_messages"), F.md5(said).alias("content_md5"))


@query("q_row_overlap", f"WITH p AS (SELECT a.conv_id, a.turn, list_distinct({S.words('lower(a.text)')}) AS x, list_distinct({S.words('lower(b.text)')}) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) SELECT conv_id, turn, len(list_intersect(x, y)) AS n_common, array_to_string(list_sort(list_intersect(x, y)), ' ') AS common FROM p")
def row_overlap(spark, d):
    """SET-5, JOI-12, ARR-2: words that a turn shares with the one before."""
    t = table(spark, d, "conversations")
    b = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    both = F.array_sort(F.array_intersect(F.array_distinct(M.tokens(F.col("text"))), F.array_distinct(M.tokens(F.col("before")))))
    return t.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.size(both).cast("long").alias("n_common"), F.array_join(both, " ").alias("common"))
