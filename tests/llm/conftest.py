from __future__ import annotations

import random

import pytest

DATA = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside, or that differ from others in case alone.
CLASHES = ("id", "key", "digest", "norm", "salt", "rank", "score", "root", "fp", "bucket", "shard", "bad_id", "lost_key", "DIGEST_", "band")
INSULTS = ("glorpish", "snarfle", "blattid", "wurmpel", "droznik", "kvetchop")


def words(rnd, n, vocabulary):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def world(spark, tmp_path_factory):
    """A folder of tables: plain, toxic, copied, nearly copied and leaked documents, nulls, empty and long texts, repeated rows, clashing columns."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abdeilmnorstu") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    docs, labels = [], []
    bench = [(i, words(rnd, 24, vocab).capitalize() + ".") for i in range(6)] + [(90, None), (91, ""), (92, "Anna has 12 red apples and gives Tom 5 green apples. How many apples does Anna keep after 3 days?")]
    for i in range(240):
        text = words(rnd, rnd.randint(30, 90), vocab)
        y = int(i % 4 == 1)
        if y:
            ws = text.split()
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(INSULTS))
            text = " ".join(ws)
        docs.append([i, text, "en" if i % 3 else "xx", f"s{i % 5 if i % 2 else 0}", len(text)])
        labels.append((i, 1, y))
    docs += [[300 + k, docs[0][1].upper() if k == 2 else docs[0][1], "en", "s0", 1] for k in range(4)]
    near = docs[2][1].split()
    docs += [[310 + k, " ".join([*near, f"tail{k}"]), "en", "s0", 1] for k in range(3)]
    docs += [[320, f"{words(rnd, 20, vocab)} {bench[1][1]} {words(rnd, 20, vocab)}", "en", "s1", 1]]
    docs += [[321, "So: Peter has 7 red apples and gives Sarah 2 green apples. How many apples does Peter keep after 9 days? Yes.", "en", "s1", 1]]
    docs += [[330, None, None, None, None], [331, "", "en", "s2", 0], [None, "nobody knows my id", "en", None, 1], [332, " \n\t ", "en", "s2", 3], [333, words(rnd, 60_000, vocab), "en", "s2", 1], [334, "a" * 20_000, "en", "s2", 1], [335, "é ß 漢字 🙂", "xx", "s2", 1]]
    docs += [[340, "the same row twice", "en", "s3", 1]] * 2
    base = tmp_path_factory.mktemp("world")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame([tuple(d) for d in docs], schema)
    plain.selectExpr("*", *(f"concat('x', doc_id) as `{c}`" for c in CLASHES)).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (330, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    pages = [(1, "http://a", "<p>one two</p>"), (2, None, "<p>one two</p>"), (3, "u", None), (4, "u", ""), (None, "n", "<p>lost</p>"), (5, "v", "<p>" + "long " * 50_000 + "</p>"), (6, "w", "<article><h1>T</h1><p>a<p>b</article><footer>f"), (6, "w", "<article><h1>T</h1><p>a<p>b</article><footer>f")]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "url as digest", "page_id as id").write.parquet(f"{base}/pages.parquet")
    return str(base), docs, labels, bench, pages


@pytest.fixture(scope="session")
def nothing(spark, world, tmp_path_factory):
    """The same tables without rows."""
    base = tmp_path_factory.mktemp("nothing")
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{world[0]}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    return str(base)
