"""Queries on models behind interfaces: stubs whose answers SQL can state stand for language models and annotators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import external
from tessera.plans import sql as S
from tessera.plans.catalogue import query
from tessera.session import table


class Splitter:
    """Answers how many items a payload has and their characters; the first call fails, and any for a payload with an item of size 7 or 70 and more."""

    def __init__(self) -> None:
        self.calls = 0

    def call(self, payload: str) -> str:
        self.calls += 1
        items = json.loads(payload)
        if self.calls == 1:
            raise external.RateLimited
        if any(x.startswith("#7") for x in items):
            raise ValueError("no answer")
        return json.dumps({"n": len(items), "chars": sum(len(x) for x in items)})


_ITEMS = "it AS (SELECT (p_partkey // 20)::VARCHAR AS batch, '#' || p_size || ' ' || p_name AS payload FROM part)"


@query("q_batched_calls", f"WITH {_ITEMS} SELECT batch, count(*) AS n, sum(length(payload))::BIGINT AS chars FROM it GROUP BY batch HAVING count(*) FILTER (starts_with(payload, '#7')) = 0")
def batched_calls(spark, d):
    """LLM-1, LLM-3: each batch is tried up to five times; one that fails every time has no answer and stays to be done."""
    items = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).cast("string").alias("batch"), F.concat(F.lit("#"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")).alias("payload"))
    got = external.called(items, "batch", Splitter, sleep=lambda s: None)
    return got.select("batch", F.from_json("answer", "n bigint, chars bigint").alias("a")).select("batch", "a.*")


@query("q_summaries", "SELECT c_custkey AS cluster, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_mktsegment WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS summary FROM customer")
def summaries(spark, d):
    """LLM-4: a new summary goes before the old one; what has none stays null and is tried again."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "cluster")
    old = c.select("cluster", F.when(F.col("cluster") % 2 == 0, F.col("c_mktsegment")).alias("summary"))
    new = c.where("cluster % 3 = 0").select("cluster", F.concat(F.lit("new "), "c_mktsegment").alias("summary"))
    return external.summaries(old, new, "cluster")


@query(
    "q_category_rounds",
    """WITH c AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1) AS a, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)),
    f AS (SELECT *, (a // 20) * 10 + a % 20 // 2 AS b, (n // 20) * 10 + (n % 20 + 1) // 2 AS m FROM c), g AS (SELECT *, (b // 20) * 10 + b % 20 // 2 AS e FROM f)
    SELECT p_brand AS brand, CASE WHEN n <= 10 THEN a WHEN m <= 10 THEN b ELSE e END AS category FROM g""",
)
def category_rounds(spark, d):
    """LLM-7: rounds in batches of 20 that join neighbours, until ten or fewer categories are left. There is one for each brand, 25."""
    names = sorted(r[0] for r in table(spark, d, "part").select("p_brand").distinct().collect())
    held = external.merge_rounds([{"category_id": i} for i in range(len(names))], lambda part: [list(range(i, min(i + 2, len(part)))) for i in range(0, len(part), 2)])
    return spark.createDataFrame([(names[i], k) for k, ids in enumerate(held) for i in ids], "brand string, category long")


class WordCounter:
    def __call__(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]


@query("q_annotated", f"SELECT conv_id, turn, len({S.words('text')})::INTEGER AS annotation FROM conversations")
def annotated(spark, d):
    """LLM-9, TRN-3: a model that is built once in each task annotates every text, batch by batch."""
    return external.annotated(table(spark, d, "conversations"), "text", WordCounter, "int").select("conv_id", "turn", "annotation")
