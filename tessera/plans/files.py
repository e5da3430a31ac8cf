"""Queries on files: tables are written in the shapes of the outside world, to the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.plans.catalogue import query
from tessera.session import scratch, table
from tessera.sources import readers, sinks


@query("q_json_array", "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS ord, doc_id, quality, toxic FROM labels")
def json_array(spark, d):
    """SNK-1, SRC-1."""
    path = scratch(spark, "array")
    sinks.json_array(table(spark, d, "labels"), path, "doc_id")
    return readers.json_array(spark, path, "doc_id bigint, quality int, toxic int")


@query("q_json_map", "SELECT c_custkey::VARCHAR AS key, c_name, c_acctbal FROM customer")
def json_map(spark, d):
    """SNK-4, SRC-2."""
    path = scratch(spark, "map")
    sinks.json_map(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "c_custkey")
    return readers.json_map(spark, path, "c_name string, c_acctbal double")


@query("q_json_lines", "SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def json_lines(spark, d):
    """SNK-2, SRC-3: blank lines are no rows."""
    path = scratch(spark, "lines")
    sinks.json_lines(table(spark, d, "conversations"), path)
    spark.range(5).select(F.repeat(F.lit(" "), F.col("id").cast("int")).alias("value")).write.mode("append").text(path)
    return readers.json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string").withColumn("text", F.md5("text"))


@query("q_json_sniffed", "SELECT doc_id, toxic FROM labels")
def json_sniffed(spark, d):
    """SRC-4: one half as an array, the other as lines."""
    labels, a, b = table(spark, d, "labels").select("doc_id", "toxic"), scratch(spark, "array"), scratch(spark, "lines")
    sinks.json_array(labels.where("doc_id % 2 = 0"), a, "doc_id")
    sinks.json_lines(labels.where("doc_id % 2 = 1"), b)
    return readers.json_sniffed(spark, a, "doc_id bigint, toxic int").unionByName(readers.json_sniffed(spark, b, "doc_id bigint, toxic int"))


@query("q_result_files", "SELECT conv_id || '/' || turn AS ref, md5(text) AS pred FROM conversations")
def result_files(spark, d):
    """SRC-5: an object that holds the list, one list, and lines, under either names."""
    rows = table(spark, d, "conversations").withColumn("ref", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    named, other = (F.to_json(F.struct(F.col("text").alias(p), F.col("ref").alias(r))) for p, r in (("text", "ground_truth"), ("prediction", "reference")))
    rows = rows.select("conv_id", "ref", F.when(F.col("conv_id") % 2 == 0, named).otherwise(other).alias("_row"))
    held, listed, lines = (scratch(spark, "results") for _ in range(3))
    # Small files of one object each, as results are.
    one = rows.where("conv_id % 3 = 0").groupBy(F.floor(F.col("conv_id") / 300).alias("file")).agg(F.array_join(F.collect_list("_row"), ",").alias("rows"))
    one.select(F.concat(F.lit('{"predictions": ['), "rows", F.lit("]}")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(held)
    sinks._one_file(rows.where("conv_id % 3 = 1").select("ref", "_row"), listed, ("ref",), "[]")
    rows.where("conv_id % 3 = 2").select(F.col("_row").alias("value")).write.text(lines)
    got = readers.results(spark, held).unionByName(readers.results(spark, listed)).unionByName(readers.results(spark, lines))
    return got.select("ref", F.md5("pred").alias("pred"))


@query("q_csv", "SELECT c_custkey, c_name || chr(10) || '\"quoted\", ' || c_mktsegment AS note, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer")
def csv(spark, d):
    """SRC-6: fields with newlines, quotes and commas; NA is missing."""
    note = F.concat("c_name", F.lit('\n"quoted", '), "c_mktsegment")
    segment = F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_mktsegment"))
    path = scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", note.alias("note"), segment.alias("segment")).write.csv(path, header=True, quote='"', escape='"')
    return readers.csv(spark, path, "c_custkey bigint, note string, segment string")


@query("q_vector_files", "SELECT vec_id::VARCHAR AS key, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_files(spark, d):
    """SNK-5, SRC-8: vectors come back by key, not by place."""
    e, path = table(spark, d, "embeddings").withColumn("key", F.col("vec_id").cast("string")), scratch(spark, "vectors")
    sinks.vectors(e, path)
    return readers.vectors(spark, path).join(e.select("key", "label"), "key").select("key", "label", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("q_image_files", "SELECT n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.jpg' ELSE '.JPG' END AS name FROM nation WHERE n_nationkey % 3 < 2")
def image_files(spark, d):
    """SRC-9: files of either ending, in folders within folders."""
    base = scratch(spark, "images")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():  # the nations are 25
        path = hadoop.Path(f"{base}/{r['n_regionkey']}/deep/{r['n_nationkey']}{('.jpg', '.JPG', '.png')[r['n_nationkey'] % 3]}")
        file = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        file.writeBytes("x")
        file.close()
    return readers.image_files(spark, base).select(T.basename(F.col("path")).alias("name"))


@query("q_nan_to_null", "SELECT vec_id, CASE WHEN label <> 0 THEN round(embedding[1]::DOUBLE, 6) END AS x FROM embeddings")
def nan_to_null(spark, d):
    """SRC-11: the constant NaN, as it stands in JSON."""
    x = F.when(F.col("label") == 0, "NaN").otherwise(F.col("embedding")[0].cast("double").cast("string"))
    path = scratch(spark, "nan")
    table(spark, d, "embeddings").select(F.concat(F.lit('{"vec_id": '), F.col("vec_id").cast("string"), F.lit(', "x": '), x, F.lit("}")).alias("value")).write.text(path)
    return readers.nan_to_null(readers.json_lines(spark, path, "vec_id bigint, x double")).withColumn("x", F.round("x", 6))


@query("q_legacy_parts", "SELECT p_type AS text, count(DISTINCT p_brand) + count(*) AS n FROM part GROUP BY p_type")
def legacy_parts(spark, d):
    """SRC-12: an object of lists of parts, and a list of texts with counts."""
    part, nested, pairs = table(spark, d, "part"), scratch(spark, "nested"), scratch(spark, "pairs")
    held = part.select("p_brand", F.col("p_type").alias("text")).distinct().groupBy("p_brand").agg(F.collect_list(F.struct("text")).alias("normalized_parts"))
    sinks.json_map(held, nested, "p_brand")
    row = F.concat(F.lit("["), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(", "), F.col("n").cast("string"), F.lit("]"))
    counted = part.groupBy(F.col("p_type").alias("text")).agg(F.count(F.lit(1)).alias("n")).withColumn("_row", row)
    sinks._one_file(counted.select("text", "_row"), pairs, ("text",), "[]")
    got = readers.legacy_parts(spark, nested).unionByName(readers.legacy_parts(spark, pairs))
    return got.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("q_split_files", "SELECT lang AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY lang")
def split_files(spark, d):
    """SNK-3: a folder for each split."""
    path = scratch(spark, "splits")
    sinks.by_split(table(spark, d, "documents").select("doc_id", F.col("lang").alias("split")), path)
    return spark.read.schema("doc_id bigint, split string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


_TABLES = {"langs": ("documents", "lang"), "sources": ("documents", "source"), "roles": ("conversations", "role")}


@query("q_metrics_csv", " UNION ALL ".join(f"SELECT '{name}' AS metric, {c} AS key, count(*) AS n FROM {t} GROUP BY {c}" for name, (t, c) in _TABLES.items()))
def metrics_csv(spark, d):
    """SNK-6: three tables, a file each."""
    base = scratch(spark, "metrics")
    sinks.metrics_csv({name: table(spark, d, t).groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")) for name, (t, c) in _TABLES.items()}, base)
    each = [readers.csv(spark, f"{base}/{name}", "key string, n bigint").select(F.lit(name).alias("metric"), "key", "n") for name in _TABLES]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("q_metrics_json", "SELECT count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents")
def metrics_json(spark, d):
    """SNK-7."""
    path = scratch(spark, "metrics")
    sinks.metrics_json(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")), path)
    return readers.json_lines(spark, path, "n bigint, mean_chars double")


@query("q_append_log", "SELECT o_orderpriority AS batch, count(*) AS n FROM orders GROUP BY o_orderpriority")
def append_log(spark, d):
    """SNK-8: a log that each batch adds to."""
    path, rows = scratch(spark, "log"), table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("batch"))
    for urgent in (True, False):
        first = F.substring("batch", 1, 1) == "1"
        sinks.append_log(rows.where(first if urgent else ~first), path)
    return readers.json_lines(spark, path, "o_orderkey bigint, batch string").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("q_flushed", "SELECT (conv_id % 3)::INTEGER AS batch, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id % 3")
def flushed(spark, d):
    """SNK-9: predictions by batches, one of them written twice, as after a failure."""
    path, rows = scratch(spark, "flushed"), table(spark, d, "conversations")
    for batch in (0, 1, 1, 2):
        sinks.flush(rows.where(F.col("conv_id") % 3 == batch).select("conv_id", "text"), path, batch)
    return readers.flushed(spark, path, "conv_id bigint, text string").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
