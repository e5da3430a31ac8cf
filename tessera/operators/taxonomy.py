"""From cluster labels to a taxonomy and back onto records: decision replay, merges, look-ups, corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.index import numbered


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LLM-5, LLM-6: categories (category_id, name, definition), members (category_id, item) and quarantined entries of a decision log.

    log: ord, item, action, category_id, name, definition. A create opens the next id; assign and fix go to an id that
    was open before them; fix, and create, set the definition, the last one staying. Anything else is quarantined.
    """
    created = numbered(log.where("action = 'create'").select("ord", "item", "name", "definition"), "category_id", F.asc("ord"))
    later = log.where("action in ('assign', 'fix')").select("ord", "item", "action", "category_id", "definition")
    opened = created.select("category_id", F.col("ord").alias("opened"))
    valid = later.join(opened, "category_id").where("ord > opened")
    spoken = created.select("category_id", "ord", "definition").unionByName(valid.where("action = 'fix' and definition is not null").select("category_id", "ord", "definition"))
    latest = spoken.groupBy("category_id").agg(F.max_by("definition", "ord").alias("definition"))
    categories = created.select("category_id", "name").join(latest, "category_id")
    members = created.select("category_id", "item").unionByName(valid.select("category_id", "item"))
    bad = log.join(created.select("ord").unionByName(valid.select("ord")), "ord", "left_anti")
    return categories, members, bad


def merge(members: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-25: members under their new ids, and those whose category no plan entry names.

    plan: new_id, source_ids (in the order in which members follow each other). A category named twice gives its
    members to both.
    """
    sources = plan.select("new_id", F.posexplode("source_ids").alias("source_pos", "category_id"))
    return members.join(sources, "category_id").select("new_id", "source_pos", "category_id", "item"), members.join(sources, "category_id", "left_anti")


def invert(mapping: DataFrame, key: str, values: str) -> DataFrame:
    """MAP-1: one row for each value of an array column, with its key."""
    return mapping.select(F.explode(values).alias("value"), key)


def final_names(names: DataFrame, name: str, mapped: DataFrame) -> DataFrame:
    """JOI-11: the mapped name, else the name itself. mapped: value, final; of equals the last by its column ord, if any."""
    if "ord" in mapped.columns:
        mapped = mapped.groupBy("value").agg(F.max_by("final", "ord").alias("final"))
    return names.join(mapped, names[name] == mapped["value"], "left").withColumn("final", F.coalesce("final", name)).drop("value")


def first_wins(*tables: DataFrame, key: str) -> DataFrame:
    """AGG-15: one row for each key, from the first table that has it."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("_prio", F.lit(i))
        every = t if every is None else every.unionByName(t)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_prio"))
    return every.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_prio")


def lookup(parts: DataFrame, clusters: DataFrame, summaries: DataFrame, finals: DataFrame, inferable: DataFrame) -> DataFrame:
    """JOI-5: parts with cluster, summary, final category and flag; "" , unknown and false where there is none."""
    out = parts.join(clusters, "part", "left").join(summaries, "cluster", "left").join(finals, "summary", "left").join(inferable, "summary", "left")
    return out.select(*parts.columns, "cluster", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("final_category", F.lit("")).alias("final_category"), F.coalesce("image_inferable", F.lit("unknown")).alias("image_inferable"), F.coalesce("from_noise", F.lit(False)).alias("from_noise"))


def roll_up(parts: DataFrame, key: str) -> DataFrame:
    """AGG-13, ARR-2: key, has_image_inferable (any yes), final_categories (sorted, distinct, not empty)."""
    cats = F.array_sort(F.collect_set(F.when(F.col("final_category") != "", F.col("final_category"))))
    return parts.groupBy(key).agg(F.coalesce(F.bool_or(F.col("image_inferable") == "yes"), F.lit(False)).alias("has_image_inferable"), cats.alias("final_categories"))


def distribution(rolled: DataFrame, categories: str) -> DataFrame:
    """AGG-12: category, cnt, pct of rows."""
    total = rolled.agg(F.count(F.lit(1)).alias("n"))
    got = rolled.select(F.explode(categories).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("cnt"))
    return got.join(F.broadcast(total)).select("category", "cnt", (F.col("cnt") / F.col("n") * 100).alias("pct"))


def augment(records: DataFrame, key: str, known: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """JOI-6, PRJ-2: records with what is known of their key, else with what compute gives for them; empty defaults at last."""
    there = records.join(known, key)
    rest = compute(records.join(known.select(key), key, "left_anti"))
    out = there.unionByName(rest, allowMissingColumns=True)
    empty = F.array().cast("array<string>")
    return out.withColumn("final_categories", F.coalesce("final_categories", empty)).withColumn("has_image_inferable", F.coalesce("has_image_inferable", F.lit(False)))


def flip(reasons: Column, targets: tuple[str, ...], to: str) -> Column:
    """PRJ-4, ARR-3: image_inferable of nested parts whose summary is a target."""

    def part(p: Column) -> Column:
        return F.when(p["summary"].isin(*targets), p.withField("image_inferable", F.lit(to))).otherwise(p)

    return F.transform(reasons, lambda r: r.withField("parts", F.transform(r["parts"], part)))


def size_summary(sizes: DataFrame, n: str) -> DataFrame:
    """AGG-24: least, upper median and greatest size, and three bands."""
    counts = sizes.groupBy(F.col(n).alias("v")).count()
    up = Window.orderBy("v")
    counts = counts.select("v", "count", F.sum("count").over(up).alias("upto"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("n"))

    def band(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))

    v = F.col("v")
    return counts.agg(F.min("v").alias("min_size"), F.min(F.when(F.col("upto") > F.expr("n div 2"), v)).alias("median_size"), F.max("v").alias("max_size"), band(v <= 5).alias("n_1_5"), band((v >= 6) & (v <= 20)).alias("n_6_20"), band(v > 20).alias("n_over_20"))
