from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import curate as C
from tessera.operators import index as I
from tessera.operators import metrics as M
from tessera.operators import privacy as P


def each(spark, column, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    given = ["History:  CHF // r/o PNA.;", "65-year-old male with cough", "a b , c", "éng ng", None, "", "___f eval"]
    assert each(spark, T.normalize_reason, given) == ["congestive heart failure, rule out pneumonia", "65-year-old; male;; with cough", "a b, c", "éng nasogastric", "", "", "___f; evaluate"]


@pytest.mark.parametrize("short", sorted(T.ABBREVIATIONS))
def test_every_abbreviation(spark, short):
    assert each(spark, T.normalize_reason, [f"x {short} y"]) == [f"x {T.ABBREVIATIONS[short]} y"]


def test_split_and_count(spark):
    assert each(spark, T.split_fragments, ["a. b;; c ,", "...", "3.5 mm"]) == [["a", "b", "c"], [], ["3", "5 mm"]]
    assert each(spark, T.word_count, [" a  b c ", "", "x"]) == [3, 0, 1]


def test_codes(spark):
    assert each(spark, T.age_phrase, ["007M", "036Y", "002W", "010D", "5", "", None, "abcY", "012X"]) == ["7 months old", "36 years old", "2 weeks old", "10 days old", None, None, None, None, None]
    assert each(spark, T.sex_word, ["M", "F", "O", None]) == ["male", "female", None, None]
    assert each(spark, T.sentence_case, ["ONE. two. THREE", "", "a.b"]) == ["One. Two. Three", "", "A.b"]
    assert each(spark, T.clean_field, [" a\nb   c "]) == ["a b  c"]
    assert each(spark, T.to_last_stop, ["a. b", "a b", ".a", "ok?", None, " "]) == ["a.", "a b", ".a", "ok?", "", ""]
    assert each(spark, T.placeholders, ["___f, ___ and  ___m", "___fx"]) == ["female, and male", "fx"]
    assert each(spark, T.stem, ["a/b.c.jpg", ".x", "d"]) == ["b.c", ".x", "d"]


def test_prefixes(spark):
    named = (("Sex", F.lit("male")), ("Age", F.lit(None).cast("string")), ("Ethnicity", F.lit("X")))
    assert each(spark, lambda c: T.prefixed(c, *named), ["r"]) == ["Ethnicity: X. Sex: male. r"]
    held = (("Race", F.lit("White")), ("Age", F.lit("65")), ("Sex", F.lit("male")))
    assert each(spark, lambda c: T.prefixed_unless_held(c, *held), ["a white male, 65"]) == ["Race: White. a white male, 65"]


def test_variants(spark):
    assert each(spark, lambda c: T.variants(c, {"chest pain": ["cp"], "rule out": ["r/o"]}), ["Rule out  chest pain"]) == [["rule out chest pain", "rule out cp", "r/o chest pain"]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("z"), V.clip(F.col("a"), 1.0).alias("c")).first()
    assert r["n"] == 5 and r["z"] == 0 and r["c"] == pytest.approx([0.6, 0.8])
    got = spark.range(1).select(V.noise_std(1, 8, F.lit(2.8643446e-5)), V.noise_std(1, float("inf"), F.lit(0.1)), V.steps(F.lit(100), 2, 3, 4, 2)).first()
    assert got[0] == pytest.approx(1.155624, abs=1e-6) and got[1] == 0 and got[2] == 10


def test_noise_is_standard(spark):
    df = spark.range(4000).select(V.gaussian(F.col("id").cast("string")).alias("g"))
    r = df.agg(F.avg("g").alias("m"), F.stddev("g").alias("s")).first()
    assert abs(r["m"]) < 0.06 and abs(r["s"] - 1) < 0.05


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedup_is_the_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    data = [(i, *(rnd.choice([None, *range(12)]) for _ in range(3))) for i in range(120)]
    seen, want = [set(), set(), set()], []
    for i, *ks in data:
        if any(k in s for k, s in zip(ks, seen, strict=True)):
            continue
        for k, s in zip(ks, seen, strict=True):
            s.add(k)
        want.append(i)
    df = spark.createDataFrame(data, "i int, a int, b int, c int")
    assert sorted(r["i"] for r in C.greedy_dedup(df, "i", [F.col("a"), F.col("b"), F.col("c")]).collect()) == want


def test_greedy_dedup_edges(spark):
    chain = spark.createDataFrame([(0, "x", "p"), (1, "x", "q"), (2, "y", "q")], "i int, a string, b string")
    assert sorted(r["i"] for r in C.greedy_dedup(chain, "i", [F.col("a"), F.col("b")]).collect()) == [0, 2]
    assert C.greedy_dedup(chain.limit(0), "i", [F.col("a")]).count() == 0
    split = spark.createDataFrame([(0, "x", "train"), (1, "x", "test")], "i int, a string, s string")
    assert C.greedy_dedup(split, "i", [F.col("a")], within="s").count() == 2


def test_until_first_without_a_stop(spark):
    df = spark.range(5).withColumnRenamed("id", "o")
    assert C.until_first(df, "o", F.col("o") > 99).count() == 5
    assert C.until_first(df, "o", F.col("o") >= 3).count() == 3


def test_ranked_is_a_row_number(spark):
    rnd = random.Random(4)
    texts = list({" ".join(rnd.choice("abc é") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))).strip() for _ in range(200)} - {""})
    got = {r["t"]: r["idx"] for r in I.ranked(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    order = sorted(texts, key=lambda t: (-len(t.split()), t.encode()))
    assert got == {t: i for i, t in enumerate(order)}


def test_split_compound(spark):
    links = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (3, "g h i j k l")], "id int, fragment string")
    parts = spark.createDataFrame([("a b c d e f", ["a b ", "c"]), ("a b", ["a", "b"]), ("g h i j k l", [" ", ""])], "fragment string, parts array<string>")
    got = sorted((r["id"], r["part_pos"], r["part"]) for r in I.split_compound(links, parts).collect())
    assert got == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "a b"), (3, 0, "g h i j k l")]


def test_rouge_l_table(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat on the mat sat"), (2, "a b c", "c b a"), (3, "x", "y")], "id int, pred string, ref string")
    got = {r["id"]: r["f"] for r in M.rouge_l(pairs).collect()}
    assert got == {1: pytest.approx(2 * 3 / 9), 2: pytest.approx(2 / 6), 3: 0}


def test_lcs_is_the_textbook_one():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * 0 + [r for r in _step(row, x, b)]
        assert M._lcs(a, b) == row[-1]


def _step(row, x, b):
    left = 0
    for j, y in enumerate(b, 1):
        left = row[j - 1] + 1 if x == y else max(row[j], left)
        yield left


def test_scorers(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, " ", "x")], "id int, pred string, ref string")
    got = {r["metric"]: r["value"] for r in M.evaluate(pairs, "BLEU-4", "ROUGE-L").collect()}
    assert got == {"BLEU-4": pytest.approx(1), "ROUGE-L": pytest.approx(1)}
    assert [r["line"] for r in M.printed(M.evaluate(pairs, "BLEU-1"), ("ROUGE-L", "BLEU-1")).collect()] == [f"{'BLEU-1':<20}{1:>10.4f}"]
    with pytest.raises(ValueError):
        M.evaluate(pairs, "METEOR")
    with pytest.raises(ValueError):
        M.to_binary(F.lit(1), "other")


def test_facts(spark):
    e = "array<struct<id: string, tokens: string, label: string, relations: array<struct<type: string, target: string>>>>"
    a = [("1", "Heart", "OBS", [("at", "2")]), ("2", "Left", "ANAT", [])]
    b = [("1", "heart", "OBS", [("at", "2")]), ("2", "Left", "ANAT", [])]
    df = spark.createDataFrame([(a, b), (a, [])], f"p {e}, r {e}")
    for level, want in (("simple", [0.5, 0.0]), ("partial", [0.5, 0.0]), ("complete", [1.0, 0.0])):
        got = [r["f1"] for r in df.select(*M.fact_reward(M.facts(F.col("p"), level), M.facts(F.col("r"), level))).collect()]
        assert got == pytest.approx(want), level


def test_spans_are_those_of_a_plain_loop(spark):
    texts = ["Male., 65yo, non-hispanic/non-latino woman 2017;", "femalex male", "12a 7", "whitest white: black,", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"] or []] for r in P.general_spans(df, "t").collect()}
    demo = r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(P.DEMOGRAPHIC, key=len, reverse=True))) + r")(?![a-z0-9])[.,;:]*"
    for i, t in enumerate(texts):
        low = (t or "").lower()
        want = [(*m.span(), "number") for m in re.finditer(r"(?<![0-9])[0-9]+(?![0-9])[.,;:]*", low)] + [(*m.span(), "demographic") for m in re.finditer(demo, low)]
        assert got[i] == sorted(want), t


def test_part_spans(spark):
    df = spark.createDataFrame([("r/o chf; chf. xchf", [("no", "congestive heart failure", ""), ("yes", "r/o", "")])], "t string, parts array<struct<image_inferable: string, part_text: string, reason_text: string>>")
    spans = P.part_spans(F.col("t"), P.sensitive_terms(F.col("parts")))
    assert [tuple(s) for s in df.select(spans.alias("s")).first()["s"]] == [(4, 8, "part", "chf;"), (9, 13, "part", "chf.")]
    both = F.concat(spans, F.array(F.struct(F.lit(6).alias("start"), F.lit(10).alias("end"), F.lit("x").alias("kind"), F.lit("").alias("text"))))
    assert [tuple(s) for s in df.select(P.merged(both).alias("s")).first()["s"]] == [(4, 13)]
