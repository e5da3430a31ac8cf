"""Readers of the input shapes, each to explicit rows; the order of whole files is kept where it means something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that the CSV convention reads as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-1: a file that is one JSON array, with `ord`, the place in it. A file is one task: stage it once."""
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct")
    kind = kind if kind.startswith("<") else f"<{kind}>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<struct{kind}>", {"allowNonNumericNumbers": "true"})).alias("ord", "r")).select("ord", "r.*")


def json_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-2: a file that is one JSON object by id: key and the value's fields."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{schema}>>", {"allowNonNumericNumbers": "true"})).alias("key", "r")).select("key", "r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-3: one object a line; blank lines are no rows."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def json_sniffed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-4: an array if the text begins with [, else lines. One line of the file reaches the driver."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    if first and first[0]["value"].lstrip().startswith("["):
        return json_array(spark, path, schema).drop("ord")
    return json_lines(spark, path, schema)


def results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: pred and ref of a results file: a list, an object holding one under data, results or predictions, one object, or lines.

    text, or where there is no such key prediction; ground_truth, or where there is none reference. A key that is
    there with null stays null.
    """
    lined = F.filter(F.split("value", "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    files = spark.read.text(path, wholetext=True).withColumn("lines", lined)
    # A parser that stops after the first object would take lines for one: they are lines if each is an object.
    several = (F.size("lines") > 1) & F.forall("lines", lambda x: F.startswith(F.trim(x), F.lit("{")) & F.try_parse_json(x).isNotNull())
    whole = files.select(F.when(~several, F.try_parse_json("value")).alias("v"), "value", "lines")
    held = F.coalesce(*(F.variant_get("v", f"$.{k}", "variant") for k in ("data", "results", "predictions")))
    listed = F.when(F.startswith(F.trim("value"), F.lit("[")), F.col("v")).otherwise(held)
    items = whole.where("v is not null").select(F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array("v")).alias("items")).select(F.explode("items").alias("r"))
    lines = whole.where("v is null").select(F.explode("lines").alias("line")).select(F.parse_json("line").alias("r"))

    def field(a: str, b: str) -> Column:
        there = F.array_contains(F.map_keys(F.try_variant_get("r", "$", "map<string, variant>")), a)
        return F.when(there, F.try_variant_get("r", f"$.{a}", "string")).otherwise(F.try_variant_get("r", f"$.{b}", "string"))

    return items.unionByName(lines).select(field("text", "prediction").alias("pred"), field("ground_truth", "reference").alias("ref"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-6: quoted fields may hold newlines; missing values by the convention above."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c in texts})


def expert_annotations(df: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """SRC-7: columns renamed, 0 as 2 (negative), -1 as 3 (uncertain), null as 0 (blank)."""
    codes = {new: F.when(F.col(old) == 0, 2).when(F.col(old) == -1, 3).otherwise(F.coalesce(F.col(old), F.lit(0))).cast("int") for old, new in renamed.items()}
    return df.withColumns(codes).drop(*(old for old, new in renamed.items() if old != new))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: key, embedding; joined by key, never by place."""
    return spark.read.parquet(path).select("key", F.col("embedding").cast("array<float>").alias("embedding"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-9: path of every .jpg and .JPG below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.col("path").rlike(r"\.(jpg|JPG)$"))


def flushed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SNK-9 read back: the rows of all batches that were written whole, with their batch."""
    return spark.read.schema(f"{schema}, batch int").json(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """SRC-11: NaN is null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def legacy_parts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: the texts of an object of {normalized_parts: [{text}]}, or of [text, count] pairs (as often as counted)."""
    text = spark.read.text(path, wholetext=True)
    nested = text.where(~F.startswith(F.trim("value"), F.lit("["))).select(F.explode(F.map_values(F.from_json("value", "map<string, struct<normalized_parts: array<struct<text: string>>>>"))).alias("v")).select(F.explode("v.normalized_parts.text").alias("text"))
    pairs = text.where(F.startswith(F.trim("value"), F.lit("["))).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    return nested.unionByName(pairs.select(F.explode(F.array_repeat(F.col("p")[0], F.col("p")[1].cast("int"))).alias("text")))
