"""Queries on the taxonomy. A decision log is made from `part`: brands are categories, types are what is said of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import taxonomy as X
from tessera.plans.catalogue import query
from tessera.session import cut, table

_LOG = """log AS (
    SELECT p_partkey AS ord, p_name AS item, CASE WHEN p_size <= 5 THEN 'create' WHEN p_size <= 35 THEN 'assign' WHEN p_size <= 45 THEN 'fix' ELSE 'drop' END AS action,
           substr(p_brand, 7)::BIGINT AS category_id, p_brand AS name, p_type AS definition FROM part),
    cr AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS id FROM log WHERE action = 'create'),
    v AS (SELECT l.* FROM log l JOIN cr ON cr.id = l.category_id WHERE l.action IN ('assign', 'fix') AND l.ord > cr.ord),
    sp AS (SELECT id, ord, definition FROM cr UNION ALL SELECT category_id, ord, definition FROM v WHERE action = 'fix' AND definition IS NOT NULL),
    df AS (SELECT id, max_by(definition, ord) AS definition FROM sp GROUP BY id),
    mem AS (SELECT id AS category_id, item FROM cr UNION ALL SELECT category_id, item FROM v)"""


def _log(spark, d):
    size = F.col("p_size")
    action = F.when(size <= 5, "create").when(size <= 35, "assign").when(size <= 45, "fix").otherwise("drop")
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("item"), action.alias("action"), F.substring("p_brand", 7, 99).cast("long").alias("category_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("definition"))


@query("q_taxonomy_replay", f"WITH {_LOG} SELECT cr.id AS category_id, name, df.definition, (SELECT count(*) FROM mem WHERE mem.category_id = cr.id) AS n_members FROM cr JOIN df ON df.id = cr.id")
def taxonomy_replay(spark, d):
    """LLM-5."""
    categories, members, _ = X.replay(_log(spark, d))
    n = members.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_members"))
    return categories.join(n, "category_id").select(F.col("category_id").cast("long").alias("category_id"), "name", "definition", "n_members")


@query("q_taxonomy_quarantine", f"WITH {_LOG} SELECT action, count(*) AS n FROM log WHERE ord NOT IN (SELECT ord FROM cr) AND ord NOT IN (SELECT ord FROM v) GROUP BY action")
def taxonomy_quarantine(spark, d):
    """LLM-6."""
    return X.replay(_log(spark, d))[2].groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_PLAN = "pl(new_id, sid, pos) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 4, 2), (1, 1, 0), (1, 0, 1), (2, 3, 0))"


@query("q_merge_categories", f"WITH {_LOG}, {_PLAN} SELECT new_id, category_id, count(*) AS n FROM mem JOIN pl ON mem.category_id = pl.sid GROUP BY ALL UNION ALL SELECT -1, category_id, count(*) FROM mem WHERE category_id NOT IN (SELECT sid FROM pl) GROUP BY ALL")
def merge_categories(spark, d):
    """AGG-25: new id -1 is for members that no plan entry names."""
    members = cut(X.replay(_log(spark, d))[1])
    plan = spark.createDataFrame([(0, [0, 2, 4]), (1, [1, 0]), (2, [3])], "new_id int, source_ids array<int>")
    merged, lost = X.merge(members, plan)
    n = F.count(F.lit(1)).alias("n")
    out = merged.groupBy("new_id", "category_id").agg(n).unionByName(lost.groupBy(F.lit(-1).alias("new_id"), "category_id").agg(n))
    return out.withColumn("category_id", F.col("category_id").cast("long"))


@query("q_final_category", "WITH m(value, final) AS (VALUES ('Brand#11', 'first'), ('Brand#12', 'second'), ('Brand#13', 'second')), o(value, final) AS (VALUES ('Brand#12', 'override')) SELECT p_partkey, coalesce(o.final, m.final, p_brand) AS final FROM part LEFT JOIN m ON p_brand = m.value LEFT JOIN o ON p_brand = o.value")
def final_category(spark, d):
    """JOI-11: overrides come later in the map, so they win."""
    mapping = X.invert(spark.createDataFrame([("first", ["Brand#11"]), ("second", ["Brand#12", "Brand#13"])], "final string, originals array<string>"), "final", "originals").withColumn("ord", F.lit(0))
    manual = spark.createDataFrame([("Brand#12", "override", 1)], "value string, final string, ord int")
    return X.final_names(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", mapping.unionByName(manual)).select("p_partkey", "final")


@query("q_category_invert", "SELECT DISTINCT p_type AS value, p_brand FROM part")
def category_invert(spark, d):
    """MAP-1."""
    held = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"))
    return X.invert(held, "p_brand", "types")


_ROLL = """pc AS (SELECT p_brand AS key, CASE WHEN p_size <= 10 THEN 'yes' WHEN p_size <= 30 THEN 'no' ELSE 'unknown' END AS image_inferable, CASE WHEN p_size % 7 = 0 THEN '' ELSE split_part(p_type, ' ', 1) END AS final_category FROM part),
    ro AS (SELECT key, bool_or(image_inferable = 'yes') AS has, list_sort(list_distinct(list(final_category) FILTER (final_category <> ''))) AS cats FROM pc GROUP BY key)"""


def _rolled(spark, d):
    size = F.col("p_size")
    parts = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.when(size <= 10, "yes").when(size <= 30, "no").otherwise("unknown").alias("image_inferable"), F.when(size % 7 == 0, "").otherwise(F.substring_index("p_type", " ", 1)).alias("final_category"))
    return X.roll_up(parts, "key")


@query("q_sorted_categories", f"WITH {_ROLL} SELECT key, has AS has_image_inferable, array_to_string(cats, '|') AS final_categories FROM ro")
def sorted_categories(spark, d):
    """AGG-13, ARR-2."""
    return _rolled(spark, d).withColumn("final_categories", F.array_join("final_categories", "|"))


@query("q_category_dist", f"WITH {_ROLL}, e AS (SELECT unnest(cats) AS category FROM ro) SELECT category, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM ro)::DOUBLE * 100, 6) AS pct FROM e GROUP BY category")
def category_dist(spark, d):
    """AGG-12."""
    return X.distribution(cut(_rolled(spark, d)), "final_categories").withColumn("pct", F.round("pct", 6))


@query("q_category_sizes", "WITH s AS (SELECT count(*) AS n FROM part GROUP BY p_type), l AS (SELECT list(n ORDER BY n) AS l, count(*) AS k FROM s) SELECT l[1] AS min_size, l[k // 2 + 1] AS median_size, l[k] AS max_size, len(list_filter(l, lambda x: x <= 5)) AS n_1_5, len(list_filter(l, lambda x: x BETWEEN 6 AND 20)) AS n_6_20, len(list_filter(l, lambda x: x > 20)) AS n_over_20 FROM l")
def category_sizes(spark, d):
    """AGG-24."""
    return X.size_summary(table(spark, d, "part").groupBy("p_type").count(), "count")


@query("q_top_categories", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20")
def top_categories(spark, d):
    """SRT-4."""
    return table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(20)


@query("q_cluster_order", "SELECT row_number() OVER (ORDER BY c) AS place, c AS cluster_id, n FROM (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS c, count(*) AS n FROM embeddings GROUP BY 1)")
def cluster_order(spark, d):
    """SRT-3: cluster ids in number order, noise first."""
    c = F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster_id")
    n = table(spark, d, "embeddings").groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster_id")).cast("long").alias("place"), "cluster_id", "n")


@query("q_item_text", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_type END, ''), p_name, '') AS item FROM part")
def item_text(spark, d):
    """STR-28."""
    summary = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.first_nonempty(summary, F.col("p_name")).alias("item"))


@query(
    "q_part_lookup",
    """WITH c AS (SELECT DISTINCT p_name AS part, p_size AS cluster FROM part WHERE p_size <= 25), k AS (SELECT part, min(cluster) AS cluster FROM c GROUP BY part),
    nz AS (SELECT p_name AS part, min(p_size) AS cluster FROM part WHERE p_size > 20 AND p_size <= 40 GROUP BY p_name),
    a AS (SELECT p.p_partkey, coalesce(k.cluster, nz.cluster) AS cluster, k.cluster IS NULL AND nz.cluster IS NOT NULL AS from_noise FROM part p LEFT JOIN k ON p.p_name = k.part LEFT JOIN nz ON p.p_name = nz.part)
    SELECT p_partkey, cluster, CASE WHEN cluster % 5 <> 0 THEN 'summary ' || cluster ELSE '' END AS summary, CASE WHEN cluster % 5 <> 0 AND cluster % 2 = 0 THEN 'even' ELSE '' END AS final_category,
           CASE WHEN cluster % 5 <> 0 AND cluster % 3 = 0 THEN 'yes' ELSE 'unknown' END AS image_inferable, from_noise FROM a""",
)
def part_lookup(spark, d):
    """JOI-5, AGG-15, MAP-2: a cluster's own parts go before those assigned from noise; defaults where nothing is known."""
    part = table(spark, d, "part")
    size = F.col("p_size")
    own = part.where(size <= 25).groupBy(F.col("p_name").alias("part")).agg(F.min("p_size").alias("cluster")).withColumn("from_noise", F.lit(False))
    noise = part.where((size > 20) & (size <= 40)).groupBy(F.col("p_name").alias("part")).agg(F.min("p_size").alias("cluster")).withColumn("from_noise", F.lit(True))
    ids = spark.range(0, 51).select(F.col("id").cast("int").alias("cluster"))
    summaries = ids.where("cluster % 5 != 0").withColumn("summary", F.concat(F.lit("summary "), F.col("cluster").cast("string")))
    finals = summaries.where("cluster % 2 = 0").select("summary", F.lit("even").alias("final_category"))
    flags = summaries.where("cluster % 3 = 0").select("summary", F.lit("yes").alias("image_inferable"))
    out = X.lookup(part.select("p_partkey", F.col("p_name").alias("part")), X.first_wins(own, noise, key="part"), F.broadcast(summaries), F.broadcast(finals), F.broadcast(flags))
    return out.drop("part")


_NEST = "n AS (SELECT doc_id, source || '/' || coalesce(quality, -1) AS summary, CASE WHEN toxic = 1 THEN 'no' ELSE 'yes' END AS inferable FROM documents LEFT JOIN labels USING (doc_id))"
_TARGETS = ("src1/0", "src2/1", "src3/-1", "src4/1", "src5/0")


def _nested(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    summary = F.concat_ws("/", "source", F.coalesce("quality", F.lit(-1)).cast("string"))
    part = F.struct(summary.alias("summary"), F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("image_inferable"))
    other = F.struct(F.col("lang").alias("summary"), F.lit("unknown").alias("image_inferable"))
    return df.select("doc_id", F.array(F.struct(F.col("doc_id").alias("reason_idx"), F.array(part, other).alias("parts"))).alias("reasons"))


_FLIPPED = f"SELECT doc_id, summary || '=' || CASE WHEN summary IN {_TARGETS} THEN 'no' ELSE inferable END || '|' || lang || '=unknown' AS parts FROM n JOIN documents USING (doc_id)"


def _written(df):
    return df.select("doc_id", F.array_join(F.transform(F.flatten("reasons.parts"), lambda p: F.concat_ws("=", p["summary"], p["image_inferable"])), "|").alias("parts"))


@query("q_expert_flip", f"WITH {_NEST} {_FLIPPED}")
def expert_flip(spark, d):
    """PRJ-4."""
    return _written(_nested(spark, d).withColumn("reasons", X.flip(F.col("reasons"), _TARGETS, "no")))


@query("q_nested_flip", f"WITH {_NEST}, f AS ({_FLIPPED}) SELECT count(*) AS n, count(*) FILTER (contains(parts, '=no')) AS n_no FROM f")
def nested_flip(spark, d):
    """ARR-3."""
    f = _nested(spark, d).withColumn("reasons", X.flip(F.col("reasons"), _TARGETS, "no"))
    no = F.exists(F.flatten("reasons.parts"), lambda p: p["image_inferable"] == "no")
    return f.agg(F.count(F.lit(1)).alias("n"), F.count_if(no).alias("n_no"))


@query(
    "q_augment",
    "SELECT doc_id, text_md5, CASE WHEN quality IS NOT NULL THEN 'q' || quality || '|t' || toxic WHEN lang = 'en' THEN lang ELSE '' END AS final_categories, coalesce(toxic = 1, lang = 'en') AS has_image_inferable FROM (SELECT *, md5(text) AS text_md5 FROM documents) LEFT JOIN labels USING (doc_id)",
)
def augment(spark, d):
    """JOI-6, PRJ-2: labels are what is known; English rows are computed, the others get the defaults."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    known = table(spark, d, "labels").select("doc_id", F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string"))).alias("final_categories"), (F.col("toxic") == 1).alias("has_image_inferable"))

    def compute(rest):
        en = F.col("lang") == "en"
        return rest.withColumn("final_categories", F.when(en, F.array("lang"))).withColumn("has_image_inferable", F.when(en, True))

    return X.augment(docs, "doc_id", known, compute).select("doc_id", "text_md5", F.array_join("final_categories", "|").alias("final_categories"), "has_image_inferable")


@query("q_merge_rounds", "SELECT p_type, max(substr(p_brand, 7)::INTEGER) AS last_round FROM part GROUP BY p_type")
def merge_rounds(spark, d):
    """LLM-8: of the rounds on record (brands, whose numbers don't sort as text) the highest is the one to go on from."""
    return table(spark, d, "part").groupBy("p_type").agg(F.max(F.substring("p_brand", 7, 9).cast("int")).alias("last_round"))
