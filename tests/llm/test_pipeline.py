"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from tessera.llm import toxicity
from tests.llm.conftest import DATA
from tests.llm.test_operators import AZ, join_up, shingles


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, world, tmp_path):
    base, _, labels, bench, _ = world
    docs = spark.read.parquet(f"{base}/documents.parquet")
    want_columns = docs.columns
    for name, stage in C.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, base)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            y = {i: t for i, _, t in labels}
            model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{base}/labels.parquet")))
            *a, b = model["curve"]

            def score(t, model=model, a=a, b=b):
                f = sorted((float(x) for x in model["marks"].kernel(sorted(toxicity.words_of(t))) @ model["weights"] + model["bias"]), reverse=True)[:3]
                f += [model["bias"]] * (3 - len(f))
                return 1 / (1 + 2.718281828459045 ** -(sum(x * w for x, w in zip(f, a, strict=True)) + b)) if toxicity.words_of(t) else 0

            assert ids(out) == Counter(i for i, t in rows if score(t) < 0.3)
            assert sum(y.get(i, 0) for i in ids(out)) <= 2 and all(i in ids(out) for i, t in rows if y.get(i) == 0)
        if name == "exact dedup":
            best = {}
            for i, t in rows:
                k = (t or "").translate(AZ)
                best[k] = max(best.get(k, -1), -1 if i is None else i)
            assert ids(out) == Counter(None if i < 0 else i for i in best.values())
        if name == "near dedup":
            sets = [shingles(t or "") for _, t in rows]
            roots = join_up(len(rows), lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            groups = defaultdict(list)
            for (i, _), r in zip(rows, roots, strict=True):
                groups[r].append(i)
            assert ids(out) == Counter(min(g, key=lambda i: (i is None, i or 0)) for g in groups.values()) and any(len(g) > 1 for g in groups.values())
        if name == "decontamination":
            def grams(t):
                w = re.findall(r"[^\W_]+", (t or "").lower())
                return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

            bad = {i for i, t in rows for _, b in bench if (g := grams(b)) and len(g & grams(t)) >= 0.8 * len(g)} | {321}
            assert ids(out) == Counter(i for i, _ in rows if i not in bad)
        if name != "packing":
            assert out.columns == want_columns
        docs = out
    assert docs.count() > 0 and set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_run_and_empty(spark, world, nothing):
    assert C.run(spark, world[0]).count() > 0
    assert C.run(spark, nothing).count() == 0


def test_kept_apart(spark):
    """Nothing outside the subpackage imports it, and the entry works without it."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(C.__file__).parent
    for p in (root / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tessera.llm" not in p.read_text(), p
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_a_run_goes_on_where_it_was_stopped(spark, monkeypatch, tmp_path):
    """The first try fails in its third stage; the second one runs that and the rest alone, and leaves the last table only."""
    done = []

    def stage(name, breaks=False):
        def f(spark, docs, sf_dir):
            done.append(name)
            if breaks and done.count(name) == 1:
                raise RuntimeError("lost")
            return docs.where("doc_id % 2 = 0") if name == "b" else docs

        return name, f

    monkeypatch.setattr(C, "STAGES", [stage("a"), stage("b"), stage("c", True), stage("d")])
    base = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        C.run(spark, DATA, base)
    got = C.run(spark, DATA, base)
    assert done == ["a", "b", "c", "c", "d"] and got.count() == spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 2 = 0").count()
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["3"]
