"""Readers, writers, models behind interfaces, clusters and streams."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from tessera.operators import cluster, external, taxonomy, vectors
from tessera.sources import readers, sinks
from tessera.sources.config import Config


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_json_shapes(spark, tmp_path):
    array = put(tmp_path, "a.json", '[{"x": 2}, {"x": NaN}, {"x": 1}]')
    assert [(r["ord"], r["x"]) for r in readers.nan_to_null(readers.json_array(spark, array, "x double")).orderBy("ord").collect()] == [(0, 2.0), (1, None), (2, 1.0)]
    lines = put(tmp_path, "b.jsonl", '{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r["x"] for r in readers.json_lines(spark, lines, "x int").collect()) == [1, 2]
    assert readers.json_sniffed(spark, lines, "x int").count() == 2 and readers.json_sniffed(spark, array, "x double").count() == 3
    keyed = put(tmp_path, "c.json", '{"k": {"x": 1}, "l": {"x": null}}')
    assert sorted((r["key"], r["x"]) for r in readers.json_map(spark, keyed, "x int").collect()) == [("k", 1), ("l", None)]
    nested = put(tmp_path, "d.json", '{"k": {"normalized_parts": [{"text": "a"}, {"text": "b"}]}}')
    assert sorted(r["text"] for r in readers.legacy_parts(spark, nested).collect()) == ["a", "b"]
    pairs = put(tmp_path, "e.json", '[["a", 2], ["b", 1]]')
    assert sorted(r["text"] for r in readers.legacy_parts(spark, pairs).collect()) == ["a", "a", "b"]


@pytest.mark.parametrize(
    "text",
    [
        '[{"text": "p", "ground_truth": "r"}]',
        '{"data": [{"text": "p", "ground_truth": "r"}]}',
        '{"results": [{"prediction": "p", "reference": "r"}]}',
        '{"predictions": [{"text": "p", "reference": "r"}]}',
        '{"text": "p", "ground_truth": "r"}',
        '{"text": "p", "ground_truth": "r"}\n\n{"prediction": "p", "reference": "r"}\n',
    ],
)
def test_results(spark, tmp_path, text):
    got = readers.results(spark, put(tmp_path, "r.json", text)).distinct().collect()
    assert [(r["pred"], r["ref"]) for r in got] == [("p", "r")]


def test_results_of_lines_are_all_there(spark, tmp_path):
    path = put(tmp_path, "r.jsonl", "".join(json.dumps({"text": f"p{i}", "ground_truth": "r"}) + "\n" for i in range(3)))
    assert sorted(r["pred"] for r in readers.results(spark, path).collect()) == ["p0", "p1", "p2"]


def test_results_keep_a_null_that_is_there(spark, tmp_path):
    got = readers.results(spark, put(tmp_path, "r.json", '[{"text": null, "prediction": "p"}]')).collect()
    assert [(r["pred"], r["ref"]) for r in got] == [(None, None)]


def test_csv(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'a,b\n"one\ntwo ""q""",NA\n,2\n')
    assert sorted(((r["a"], r["b"]) for r in readers.csv(spark, path, "a string, b string").collect()), key=str) == [('one\ntwo "q"', None), (None, "2")]


def test_images(spark, tmp_path):
    for name in ("a.jpg", "s/b.JPG", "c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in readers.image_files(spark, str(tmp_path)).collect()) == ["a.jpg", "b.JPG"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\"", [0.5]), (1, "a", [1.0])], "ord int, key string, embedding array<float>")
    sinks.json_array(df, str(tmp_path / "a"), "ord")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "a"), wholetext=True).collect())
    assert [x["key"] for x in json.loads(text)] == ["a", 'b"']
    sinks.json_map(df, str(tmp_path / "m"), "key")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect())
    assert {k: v["ord"] for k, v in json.loads(text).items()} == {"a": 1, 'b"': 2}
    sinks.vectors(df, str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v")).count() == 2
    sinks.by_split(df.withColumnRenamed("key", "split"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=a", "split=b%22"]
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    sinks.per_parameters(df.select("ord", "key"), str(tmp_path / "p"), "ord")
    sinks.per_parameters(df.select("ord", "key").union(spark.createDataFrame([(3, "c")], "ord int, key string")), str(tmp_path / "p"), "ord")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.metrics_csv({"one": df.select("ord")}, str(tmp_path / "c"))
    sinks.metrics_json(df.select("ord"), str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c/one"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 2


def test_config():
    assert Config.of({"SEED": "7", "RUN_NAME": "r"}) == Config(seed=7, run_name="r")


def test_encoder_encodes_each_text_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "i int, t string")
    got = {r["i"]: r["embedding"] for r in external.encoded(df, "t", external.HashedGrams).collect()}
    assert got[1] == got[2] and got[3] is None and np.linalg.norm(got[1]) == pytest.approx(1)


def test_retries():
    waits, left = [], [external.RateLimited(), ValueError(), None]

    def call():
        if (e := left.pop(0)) is not None:
            raise e
        return "ok"

    assert external.retried(call, sleep=waits.append) == "ok" and waits == [30, 2]

    def never():
        raise ValueError

    assert external.retried(never, sleep=waits.append) is None and waits[2:] == [1, 2, 4, 8, 16]


class Half:
    def call(self, payload):
        if "bad" in payload:
            raise ValueError
        return json.dumps({"results": json.loads(payload)})


def test_failed_batches_are_left_out(spark):
    items = spark.createDataFrame([("b0", "x"), ("b0", "y"), ("b1", "bad")], "batch string, payload string")
    got = external.called(items, "batch", Half, sleep=lambda s: None).collect()
    assert [(r["batch"], r["answer"]) for r in got] == [("b0", '{"results": ["x", "y"]}')]


def test_summaries_and_rounds(spark):
    old = spark.createDataFrame([(1, None), (2, "old")], "c int, summary string")
    new = spark.createDataFrame([(1, "new"), (2, None)], "c int, summary string")
    assert sorted((r["c"], r["summary"]) for r in external.summaries(old, new, "c").collect()) == [(1, "new"), (2, "old")]
    got = external.merge_rounds([{"category_id": i} for i in range(45)], lambda part: [list(range(k, min(k + 2, len(part)))) for k in range(0, len(part), 2)])
    assert len(got) <= 10 and sorted(x for g in got for x in g) == list(range(45))


def test_annotator(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    got = external.annotated(df, "t", lambda: lambda texts: [len(t.split()) for t in texts], "int").collect()
    assert sorted((r["t"], r["annotation"]) for r in got) == [("a b", 2), ("c", 1)]


def test_nearest_in_one_pass_and_in_many(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(60)] + [(60, [0.0] * 5)], "i long, v array<double>")
    rows = [(c, rng.normal(size=5).tolist()) for c in range(7)]
    centers = spark.createDataFrame(rows + [(c + 7, v) for c, v in rows], "cluster int, centroid array<double>")  # each twice: the lower one wins
    one, many = ({r["id"]: (r["cluster"], round(r["similarity"], 9)) for r in vectors.nearest(df, "i", "v", centers, few).collect()} for few in (100, 3))
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1)[:, None]
    best = {r["i"]: int(np.argmax(unit @ np.array(r["v"]))) for r in df.collect()}
    assert one == many and {i: c for i, (c, _) in one.items()} == best


def test_silhouette_of_all_points_in_one_pass_and_in_many(spark):
    rng = np.random.default_rng(3)
    xy, cluster_of = rng.normal(size=(10_300, 2)), rng.integers(0, 3, 10_300)
    xy[:, 0] += cluster_of
    df = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(cluster_of, xy, strict=True))] + [(10_300, 7, 0.0, 0.0), (10_301, 1, None, 0.0)], "i long, c int, x double, y double")
    far = np.sqrt(((xy[:200, None] - np.vstack([xy, [[0.0, 0.0]]])) ** 2).sum(axis=2))
    every = np.r_[cluster_of, 7]
    sums = np.array([[d[every == c].sum() for c in (0, 1, 2, 7)] for d in far])
    size, at, own = np.array([(every == c).sum() for c in (0, 1, 2, 7)]), np.arange(200), cluster_of[:200]
    a, other = sums[at, own] / (size[own] - 1), sums / size
    other[at, own] = np.inf
    want = (other.min(axis=1) - a) / np.maximum(a, other.min(axis=1))
    for few in (20_000, 999):
        got = {r["id"]: r["silhouette"] for r in vectors.silhouette(df, "c", "i", df.x, df.y, sample=None, few=few).collect()}
        assert len(got) == 10_302 and got[10_300] == got[10_301] == 0
        assert np.allclose([got[i] for i in range(200)], want, atol=1e-9)
    one = df.where("c = 0").limit(5)
    assert [r["silhouette"] for r in vectors.silhouette(one, "c", "i", one.x, one.y).collect()] == [None] * 5


def test_density_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (3, 3), (0, 4))] + [rng.uniform(-20, 20, (8, 2))])
    labels, kept = cluster.density_clusters(x, 15, 5)
    assert len(kept) == 3 and all(0 < p <= 1 for p in kept)
    assert len(set(labels[:120]) - {-1}) == 3 and all(len(set(labels[k : k + 40]) - {-1}) == 1 for k in (0, 40, 80))
    assert (labels[:120] >= 0).mean() > 0.9 and (labels[120:] == -1).mean() > 0.7
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "i long, v array<double>")
    assert {r["id"]: r["cluster_id"] for r in cluster.clustered(df, "i", "v", 15, 5).collect()} == dict(enumerate(labels.tolist()))
    assert len(cluster.pca(df, "v", 1).first()["reduced"]) == 1
    assert (cluster.density_clusters(x[:3], 15, 5)[0] == -1).all()


def test_density_clusters_of_more_points_than_one_pass_over_all_pairs_takes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (25_050, 2)) for c in (0, 9)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "v": x.tolist()}))
    got = np.array([r["cluster_id"] for r in cluster.clustered(df, "i", "v", 9000, 5).orderBy("id").collect()])
    assert len(got) == 50_100 and (got[:25_050] == 0).mean() > 0.9 and (got[25_050:] == 1).mean() > 0.9 and not (got[:25_050] == 1).any() and not (got[25_050:] == 0).any()


@pytest.mark.parametrize("digits", [1, 9])
def test_the_spanning_tree_is_as_short_as_that_of_all_pairs(digits):
    """Points with many equal distances too; the order of the points plays no part in the clusters."""
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(c, 0.3, (300, 3)) for c in (0, 2, 4)] + [rng.uniform(-5, 9, (60, 3))] + [np.ones((90, 3))]), digits)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 5]
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    best, want = d[0].copy(), []
    best[0] = -1
    for _ in range(len(x) - 1):
        j = np.where(best < 0, np.inf, best).argmin()
        want.append(best[j])
        best = np.where(best < 0, -1, np.minimum(best, d[j]))
        best[j] = -1
    boxes = cluster._Boxes(x)
    got = cluster._core(boxes, 5)
    assert np.allclose(got, core[boxes.order], atol=1e-12)
    tree = cluster._spanning_tree(boxes, got)
    assert len(tree) == len(x) - 1 and np.allclose(np.sort(tree[:, 2]), np.sort(want), atol=1e-12)
    labels, kept = cluster.density_clusters(x, 15, 5)
    mixed = rng.permutation(len(x))
    again, kept_again = cluster.density_clusters(x[mixed], 15, 5)
    pairs = set(zip(labels[mixed].tolist(), again.tolist(), strict=True))
    assert len(pairs) == len(set(labels.tolist())) == len(set(again.tolist())) and np.allclose(sorted(kept), sorted(kept_again))


def test_replay(spark):
    log = [(0, "i0", "create", None, "A", "a0"), (1, "i1", "create", None, "B", "b0"), (2, "i2", "assign", 0, None, None), (3, "i3", "fix", 1, None, "b1"), (4, "i4", "assign", 7, None, None), (5, "i5", "toss", 0, None, None), (6, "i6", "fix", 1, None, "b2")]
    df = spark.createDataFrame(log, "ord int, item string, action string, category_id int, name string, definition string")
    categories, members, bad = taxonomy.replay(df)
    assert sorted(tuple(r) for r in categories.collect()) == [(0, "A", "a0"), (1, "B", "b2")]
    assert sorted((r["category_id"], r["item"]) for r in members.collect()) == [(0, "i0"), (0, "i2"), (1, "i1"), (1, "i3"), (1, "i6")]
    assert sorted(r["item"] for r in bad.collect()) == ["i4", "i5"]


def test_stream(spark, tmp_path):
    from tessera.streaming import ingest

    (tmp_path / "in").mkdir()
    put(tmp_path, "in/0.json", '{"id": 1, "reason": "PNA; cough"}\n{"id": 2, "reason": ""}\n')
    known = spark.createDataFrame([("pneumonia", "lung")], "fragment string, final_category string")
    for _ in range(2):
        stream = ingest.records(spark, str(tmp_path / "in"), "id int, reason string")
        ingest.append(ingest.categorized(stream, "id", "reason", known), str(tmp_path / "out"), str(tmp_path / "log"), "id").awaitTermination()
        put(tmp_path, "in/1.json", '{"id": 3, "reason": "pna"}\n')
    got = sorted((r["id"], r["fragment"], r["final_category"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "cough", ""), (1, "pneumonia", "lung"), (3, "pneumonia", "lung")]
