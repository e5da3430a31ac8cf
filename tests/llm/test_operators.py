"""Each operator on awkward rows, against plain loops over the same rows."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, html_text, interleave, language, packing, pii, registry, simhash, similar, tokens, toxicity, warc
from tests.llm.conftest import DATA

AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def records(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, nothing, name):
    df = registry.queries()[name](spark, nothing)
    assert df.count() == 0 and df.columns


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in con.description]
    want = sorted((tuple(map(str, r)) for r in con.fetchall()))
    got = sorted(tuple(str(r[c]) for c in names) for r in registry.queries()[name](spark, DATA).collect())
    assert got == want


def test_exact_dedup(spark, world):
    base, docs, *_ = world
    got = records(exact_dedup.op6_exact_dedup(spark, base))
    by = defaultdict(list)
    for i, t, *_ in docs:
        by[(t or "").translate(AZ)].append(i)
    assert len(got) == len(docs)
    for norm, ids in by.items():
        rows = [r for r in got if r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert Counter(r["doc_id"] for r in rows) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(keep, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [keep]


def test_exact_dedup_compares_texts_where_digests_collide(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "A", "b", "c"] * 40)], "doc_id long, text string")
    got = records(exact_dedup.groups(df, digest=lambda c: F.lit(b"same")))
    assert Counter((r["keep_id"], r["group_size"], r["kept"]) for r in got) == {(197, 80, False): 79, (197, 80, True): 1, (198, 80, False): 79, (198, 80, True): 1, (199, 40, False): 39, (199, 40, True): 1}


def test_drop_copies(spark, world):
    base, docs, *_ = world
    df = spark.read.parquet(f"{base}/documents.parquet")
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    best = {}
    for i, t, *_ in docs:
        k = (t or "").translate(AZ)
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.select("doc_id").collect()) == sorted(best.values())


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
    if not w:
        return 0
    rows = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    n = [0] * 64
    for h in (xxhash.xxh64_intdigest(r.encode(), 42) for r in rows):
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(rows))


def join_up(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash(spark, world):
    base, docs, *_ = world
    got = records(simhash.op1_simhash(spark, base))
    fps = [plain_fingerprint(d[1]) for d in docs]
    roots = join_up(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = defaultdict(list)
    for d, r in zip(docs, roots, strict=True):
        least[r].append(d[0])
    want = Counter((d[0], f"{f:016x}", min((x for x in least[r] if x is not None), default=None)) for d, f, r in zip(docs, fps, roots, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("limit", [16, 4096])
def test_simhash_links_of_dense_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rnd = random.Random(limit)
    fps = [rnd.getrandbits(64)]
    for _ in range(250):
        x = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.randint(0, 5)):
            x ^= 1 << b
        fps.append(x)
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "id long, fp long")
    got = {r["id"]: r["component_id"] for r in simhash.groups(df).collect()}
    roots = join_up(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == dict(enumerate(roots))


def shingles(t):
    w = t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("limit", [3, 2048])
def test_similar(spark, monkeypatch, limit):
    monkeypatch.setattr(similar, "LIMIT", limit)
    rnd = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(900)}" for _ in range(rnd.randint(60, 200))]
        for k in range(8):
            t = list(base)
            for _ in range(k):
                t[rnd.randrange(len(t))] = f"n{rnd.randrange(900)}"
            texts.append(" ".join(t))
    texts += ["", None, "one", "one two", "ONE two"]
    sets = [shingles(t or "") for t in texts]

    def same(i, j):
        return bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["root"] for r in similar.groups(df).collect()}
    roots = join_up(len(texts), same)
    missed = sum(same(i, j) and got[i] != got[j] for i in range(len(texts)) for j in range(i))
    joined = sum(roots[i] != roots[j] and got[i] == got[j] for i in range(len(texts)) for j in range(i))
    total = sum(same(i, j) for i in range(len(texts)) for j in range(i))
    assert not joined and total > 20 and not missed
    left = {r["doc_id"] for r in similar.drop_similar(df).collect()}
    assert left == {min(i for i in range(len(texts)) if roots[i] == r) for r in set(roots)}


def test_warc(spark, world):
    base, *_, pages = world
    got = records(warc.op2_warc(spark, base))
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    seen = set()
    want = Counter()
    for i, _, h in pages:
        p = (h or "").encode()
        k = first.get(h or "")
        whole = i == k and (k, p) not in seen
        seen.add((i, p))
        want[i, len(p), warc.base32_sha1(p), "response" if whole else "revisit", None if whole else k] += 1
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == want


def test_warc_files_are_deterministic_and_roll(spark, tmp_path):
    rows = [(k * 7 % 101, f"http://h/{k} x", f"<p>{k % 30}</p>" * 40) for k in range(300)] + [(2**62, "far", "z")]

    def write(name, parts):
        base = f"file://{tmp_path}/{name}"
        manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts), base, roll=3000, shard_bytes=9000)
        return base, {(r["file"], r["sha1"]) for r in manifest.collect()}

    a, files = write("a", 1)
    b, again = write("b", 6)
    assert files == again and len(files) > 5
    back = warc.read_warc(spark, a, with_payload=True).collect()
    assert len(back) == len(rows) and not (tmp_path / "a/_temporary").exists()
    texts = {r["page_id"]: r["payload"] for r in back if r["record_type"] == "response"}
    assert all(texts[r["refers_to"]] is not None for r in back if r["record_type"] == "revisit")
    for f, sha in files:
        assert hashlib.sha1((tmp_path / "a" / f).read_bytes()).hexdigest() == sha


def test_warc_small_payloads_are_responses(spark, tmp_path):
    base = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id long, url string, html string"), base, revisit_bytes=3)
    assert {r["page_id"]: r["refers_to"] for r in warc.read_warc(spark, base).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_broken_records_are_refused(tmp_path):
    good = warc.record(1, "u", b"payload", None, False, 0)
    head, _ = warc.parse(next(warc.members(__import__("io").BytesIO(good))))
    assert head["WARC-Type"] == "response"
    with pytest.raises(EOFError):
        list(warc.members(__import__("io").BytesIO(good[:-4])))
    import gzip

    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(good).replace(b"payload", b"paYload"))


def test_interleave(spark, world):
    base, docs, *_ = world
    got = records(interleave.op3_interleave(spark, base))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_interleave_matches_the_mixture(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "case when id % 10 < 6 then 'a' when id % 10 < 9 then 'b' end as source")
    got = interleave.shards(docs, 40)
    n = Counter((r["shard"], r["source"]) for r in got.collect())
    for s in range(40):
        assert abs(n[s, "a"] - 60) <= 1 and abs(n[s, "b"] - 30) <= 1 and abs(n[s, None] - 10) <= 1


def test_decontaminate(spark, world):
    base, docs, _, bench, _ = world
    got = records(decontaminate.op4_decontaminate(spark, base))
    want = set()

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    have = [(d[0], grams(d[1])) for d in docs]
    for i, b in bench:
        g = grams(b)
        want |= {(d, i, False) for d, h in have if g and len(g & h) >= 0.8 * len(g)}
    want.add((321, 92, True))
    assert {(r["doc_id"], r["item_id"], r["changed"]) for r in got} == want and (320, 1, False) in want
    left = decontaminate.drop_contaminated(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet"))
    assert left.count() == len(docs) - len({d for d, *_ in want}) and "key" in left.columns


def test_decontaminate_slots_must_be_consistent(spark):
    item = spark.createDataFrame([(1, "Anna buys 4 pens. Then Anna sells 2 pens to her friend for 9 dollars and goes home.")], "item_id long, text string")
    docs = [(1, "Paul buys 6 pens. Then Paul sells 3 pens to her friend for 8 euros and goes home."), (2, "Paul buys 6 pens. Then Peter sells 3 pens to her friend for 8 euros and goes home."), (3, "pad " * 400_000 + "Paul buys 6 pens. Then Paul sells 3 pens to her friend for 8 euros and goes home.")]
    docs.append((4, "x" * 1_500_000 + " Paul buys 6 pens. Then Paul sells 3 pens to her friend for 8 euros and goes home."))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for few in (0, decontaminate.FEW_BYTES):
        assert {r["id"]: r["changed"] for r in decontaminate.contaminated(df, item, few=few).collect()} == {1: True, 3: True, 4: True}


def test_html(spark, world):
    base, *_, pages = world
    got = records(html_text.op5_html_text(spark, base))
    assert len(got) == len(pages)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "one two" and texts[3] == texts[4] == "" and texts[6] == "T\n\na\n\nb" and texts[5].split() == ["long"] * 50_000
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>we use them</div><article><h1>T &amp; U</h1><p>one  two<br>three<p>four<b>five</b></p><aside>see also</aside><form>mail me</form><ul><li>x<li>y</ul></article><div id='comments'><p>first!</div><footer>&copy;</footer>", "T & U\n\none two three\n\nfourfive\n\nx\n\ny"),
        ("<script>var t = '</p><p>no</p>';</script><p>yes</p><!-- <p>no</p> -->", "yes"),
        ("<p title='a > b'>kept</p><p>cut <b", "kept\n\ncut"),
        ("plain &lt;text&gt;", "plain <text>"),
        ("a < b", "a < b"),
        ("<<<>>>", "<<<>>>"),
        ("", ""),
    ],
)
def test_html_cases(page, want):
    assert html_text.extract(page, {}) == want


def test_html_of_the_tables(spark):
    """Whole articles, cut out by their tags."""
    for r in html_text.op5_html_text(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body))
        assert r["text"] == "\n\n".join(filter(None, blocks))


def test_long_odd_pages_take_linear_time():
    deep = ("<b>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 30_000 + "<tr>x</tr>" * 30_000, "<p>" + "<b>" * 30_000 + "<option>x" * 30_000)
    for page in ("<" * 200_000, "<a " * 100_000, "<p>" * 50_000, '<p x="' * 30_000, "&" * 200_000, "<div>" * 20_000 + "x", *deep):
        began = time.process_time()
        html_text.extract(page, {})
        assert time.process_time() - began < 5


@pytest.mark.parametrize("seed", range(30))
def test_html_best_run_is_that_of_all_runs(seed):
    rng = random.Random(seed)
    values = [rng.choice((-2.0, -0.5, 0.0, 1.0, 3.0)) for _ in range(rng.randint(0, 40))]
    every = [(sum(values[i:j]), -i, -j, (i, j)) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    best = max(every, default=(0.0, 0, 0, (0, 0)))
    first, stop = html_text.best_run(values)
    assert sum(values[first:stop]) == max(best[0], 0.0)
    if best[0] > 0:
        assert (stop, -first) == min((j, -i) for total, _, _, (i, j) in every if total == best[0])


def _hidden(page):
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "")


def test_html_learns_and_never_reads_the_mark(spark):
    """Weights of marked pages find the articles of others whose mark is hidden, exactly as with it; other weights find other texts."""
    boiler = "<div>Zzowners of this site keep whatever there is to be kept of it</div>"
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").collect()]
    pages = [p.replace("</nav>", f"</nav>{boiler}").replace("</footer>", f"</footer>{boiler}") for p in pages]
    half = len(pages) // 2
    counts = Counter()
    for page in pages[:half]:
        counts.update(html_text.labelled(page))
    learned = html_text.weigh(counts)
    turned = {k: -v if k[0] != "<" else v for k, v in learned.items()}
    for page in pages[half:]:
        text = html_text.extract(page, learned)
        assert text == html_text.extract(_hidden(page), learned)
        assert "Zzowners" not in text and "Zzowners" in html_text.extract(page, {})
        assert html_text.extract(page, turned) != text
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        assert text.split() == html.unescape(re.sub(r"<[^>]*>?", " ", body)).split()


def test_html_keeps_what_only_sounds_like_a_form():
    words = "word " * 30
    page = f"<p>{words}</p><div class='form-factor'>{words}</div><div class='search-box'>find it</div><aside>{'other ' * 200}</aside><p>{words}</p>"
    assert html_text.extract(page, {}).split() == ["word"] * 90


def test_language(spark, world):
    base, docs, *_ = world
    got = records(language.op7_language(spark, base))
    assert Counter(r["doc_id"] for r in got) == Counter(d[0] for d in docs)
    text = {d[0]: d[1] for d in docs}
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or "")) and 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_language_filters_are_those_of_plain_sets():
    a, b = np.unique(np.concatenate([*language.trigrams("the quick brown fox")])), np.unique(np.concatenate([*language.trigrams("der schnelle braune fuchs")]))
    f = language.Filters({"en": a, "de": b}, {"en": 1, "de": 2})
    for text in ("the fox", "der fuchs", "brown braune quick", "zzz qqq", "x", "ÄÖ", "12 !", None, ""):
        codes = np.concatenate([*language.trigrams(text or ""), np.empty(0, np.uint64)])
        hits = {"de": np.isin(codes, b).sum(), "en": np.isin(codes, a).sum()}
        name, score = f.predict(text)
        assert name == (language.UNKNOWN if not len(codes) else "de" if not any(hits.values()) else max(sorted(hits), key=hits.get)), text
        assert 0 <= score <= 1


def test_language_counts_are_corrected_for_false_positives():
    """A language whose filter is nearly full answers yes to anything; corrected, the one that really holds the text's trigrams wins."""
    rng = np.random.default_rng(1)
    own = np.unique(np.concatenate([*language.trigrams("the quick brown fox jumps over the lazy dog")]))
    f = language.Filters({"aa": rng.integers(1, 1 << 62, 250_000, dtype=np.uint64), "en": own}, {})
    text = "the quick brown dogs jumped " * 20 + " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(100))
    codes = np.concatenate([*language.trigrams(text)])
    found = np.array([f.masks[c][:, 0] for c in language.cells(codes)])
    raw = {n: int((found >> np.uint64(i) & np.uint64(1)).all(axis=0).sum()) for i, n in enumerate(f.names)}
    assert raw["aa"] > raw["en"] and f.predict(text)[0] == "en"


def test_many_languages():
    grams = {f"l{i:03d}": np.array([(i + 1) << 42 | 97 << 21 | (i + 1)], dtype=np.uint64) for i in range(130)}
    f = language.Filters(grams, {})
    assert f.masks.shape[1] == 3 and len(f.names) == 130
    codes = grams["l129"]
    found = f.masks[language.cells(codes)[0]]
    assert found[0, 2] >> np.uint64(1) & np.uint64(1)


def test_language_accuracy(spark):
    got = language.op7_language(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v // 10 + v % 10 for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def plain_spans(t):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii(spark):
    rnd = random.Random(2)
    bits = ["a", "1", "9", ".", "@", "+", "-", " ", "(", ")", "%", "é", "🙂", "_", "0", "255", "4111111111111111", "a@b.c", "+1 (212) 555-7777", "1.2.3.4", "DE89370400440532013000", "call "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(800)] + [None, "", "1.2.3.4 " * 3000, "9" * 20_000, "a." * 3_000 + "@", "+1" + " " * 20_000]
    got = {r["id"]: r for r in records(pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        base = [(x["start"], x["rank"], x["end"], x["kind"]) for x in got[i]["base"]]
        assert base == plain_spans(t), t and t[:80]
        assert all(b in got[i]["spans"] for b in got[i]["base"])


@pytest.mark.parametrize(
    ("text", "more"),
    [
        ("iban DE89370400440532013000", [("iban", 5, 27, 1.0)]),
        ("DE89 3704 0044 0532 0130 00.", [("iban", 0, 27, 0.7)]),
        ("DE88370400440532013000", []),
        ("call 212-555-1234 now", [("local", 5, 17, 0.6)]),
        ("item 212-555-1234 now", []),
        ("my SSN is 123-45-6789", [("ssn", 10, 21, 0.6)]),
        ('api_token = "ede43f42c939b6405768150e0411590525cf889e"', [("secret", 13, 53, 0.6)]),
        ("ede43f42c939b6405768150e0411590525cf889e", []),
        ("the key is donaudampfschifffahrtsgesellschaft", []),
    ],
)
def test_pii_by_checksum_and_context(spark, text, more):
    r = records(pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]
    assert [(s["kind"], s["start"], s["end"], s["score"]) for s in r["spans"] if s not in r["base"]] == more


def test_pii_query(spark, world):
    base, docs, *_ = world
    got = records(pii.op8_pii(spark, base))
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == Counter((d[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_spans(d[1])).encode()).hexdigest()) for d in docs)


def test_toxicity(spark, world):
    base, docs, labels, *_ = world
    got = records(toxicity.op9_toxicity(spark, base))
    assert Counter(r["doc_id"] for r in got) == Counter(d[0] for d in docs)
    y = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in y]
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (330, 331, 332))


def test_string_kernel_is_the_plain_one():
    words = ["idiot", "id-iot", "idxiot", "stupid", "aaaa", "x", "é漢"]
    marks = toxicity.Landmarks(["idiot", "stupid"])

    def bag(w):
        w, out = f"\x02{w}\x03", Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + 5)):
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        n = sum(v * v for v in out.values()) ** 0.5
        return {u: v / n for u, v in out.items()}

    want = [[sum(v * bag(m).get(u, 0) for u, v in bag(w).items()) ** toxicity.DEGREE for m in marks.words] for w in words]
    assert np.allclose(marks.kernel(words), want, atol=1e-5)


@pytest.mark.parametrize("seed", range(4))
def test_the_machine_is_the_least_of_its_loss(seed):
    """Against plain gradient descent on the squared hinge."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(60, 3)), np.ones(60)])
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    weight = rng.uniform(0.5, 2, 60)

    def loss(w):
        reg = 0.001 * weight.sum() * np.array([1, 1, 1, 1e-3])
        return (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (reg * w * w).sum()

    def slope(w):
        reg = 0.001 * weight.sum() * np.array([1, 1, 1, 1e-3])
        return -2 * x.T @ (weight * y * np.maximum(0, 1 - y * (x @ w))) + 2 * reg * w

    plain = np.zeros(4)
    for _ in range(20_000):
        plain -= 1e-3 * slope(plain)
    assert loss(toxicity._fit(x, y, weight)) <= loss(plain) * (1 + 1e-6)


def test_witnesses_are_the_words_that_clean_texts_lack():
    """Every toxic bag holds one of a few insults among common words; the machine's witnesses are those, whatever it began with."""
    rng = random.Random(4)
    common = [f"{a}{b}{c}" for a in ("lo", "ma", "te") for b in ("ri", "su", "na") for c in ("ton", "vel", "des")]
    insults = ["blagfoz", "krunzle", "zwipping"]
    bags = [rng.sample(common, 5) + [rng.choice(insults)] for _ in range(40)]
    marks, weights, bias = toxicity.train_words(bags, [b[0] if k % 4 == 0 else b[-1] for k, b in enumerate(bags)], common)
    f = {w: float(v) for w, v in zip(common + insults, marks.kernel(common + insults) @ weights + bias, strict=True)}
    for bag in bags:
        assert max(bag, key=f.get) in insults
    assert min(f[w] for w in insults) > max(f[w] for w in common)


def test_words_written_apart():
    assert {"idiot", "word"} <= toxicity.words_of("You i d i o t, word!") and "idiot" in toxicity.words_of("i.d-i.o.t")
    assert toxicity.words_of(None) == toxicity.words_of("12 !?") == set() and max(map(len, toxicity.words_of("a" * 100_000))) <= 48


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_bpe_path())


ODD = ["It's 12 o'clock ²½ don't!!'s", "ÉCOLE ß Ÿ İ ŉ Σας", "a<|endoftext|>b", "x\x0by\x0cz\x1cq\xa0w", "漢字🙂 é", "", None, "  ", "l'été_foo-bar", "µªº ΑΣ"]


def test_token_ids_are_the_tokenizers(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS", 60)
    rnd = random.Random(3)
    alphabet = "abcdE '.,!?0123é²ßÀ_-<|>sStTlL\n\t"
    texts = ODD + ["ab cd, " * 200_000, "z" * 1_200_000] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    got = tokens.encode(texts, tokens.word_bpe_path())
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_packing(spark, world, tokenizer):
    base, docs, *_ = world
    got = records(packing.op10_best_fit(spark, base))
    want = Counter()
    for i, t, *_ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[i, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    one = packing.packed(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), with_ids=True).first()
    assert one["ids"] == [*tokenizer.encode("a b", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    size = [50, 4096][seed % 2]
    lengths = rng.integers(max(1, size // 5) if seed % 3 else 1, size * 2 // 3 if seed % 3 else size + 1, rng.integers(1, 300))
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    seen, bins = Counter(), defaultdict(list)
    for r in packing.plan(counts, size).itertuples():
        for k in range(r.many):
            seen[r.length, r.first + k] += 1
            bins[r.bin + k].append((r.offset, r.length))
    assert seen == Counter((n, k) for n, c in counts.items() for k in range(c))
    for b in bins.values():
        assert sum(n for _, n in b) <= size and [o for o, _ in sorted(b)] == list(np.cumsum([0, *(n for _, n in sorted(b))])[:-1])
    assert len(bins) <= packing.best_fit(counts, size).total()


def _least_bins(lengths, size):
    """By trying every way."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)
    todo = [(0, ())]
    while todo:
        k, rooms = todo.pop()
        if len(rooms) >= best:
            continue
        if k == len(lengths):
            best = len(rooms)
            continue
        x = lengths[k]
        todo += {(k + 1, tuple(sorted([*rooms[:i], r - x, *rooms[i + 1 :]]))) for i, r in enumerate(rooms) if r >= x} | {(k + 1, tuple(sorted([*rooms, size - x])))}
    return best


def test_plans_against_the_least_number_of_bins():
    """Over all cases together the plan takes hardly more bins than there must be, and no case takes two more."""
    over, every = 0, 0
    for seed in range(120):
        rng = random.Random(seed)
        lengths = [rng.randint(8, 60) for _ in range(rng.randint(2, 9))]
        least = _least_bins(lengths, 100)
        got = packing.plan(Counter(lengths), 100)
        used = len({b + k for b, m in zip(got["bin"], got["many"], strict=True) for k in range(m)})
        assert least <= used <= least + 1
        over, every = over + used - least, every + least
    assert over <= 0.03 * every


def test_the_search_makes_the_packing(monkeypatch):
    """On the tables' own lengths it empties a tenth of the bins it begins with and more, down to the least number."""
    file = tokens.word_bpe_path()
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    counts: Counter = Counter()
    for ids in tokens.encode(texts, file):
        n = len(ids) // 4 + 1
        counts.update({4096: n // 4096, n % 4096: 1})
    counts = {k: n for k, n in counts.items() if k and n}
    begin = packing.next_fit(counts, 4096)
    least = -(-sum(n * c for n, c in counts.items()) // 4096)
    monkeypatch.setattr(packing, "best_fit", None)
    got = packing.plan(counts)
    used = {b + k for b, m in zip(got["bin"], got["many"], strict=True) for k in range(m)}
    assert len(used) == least <= 0.9 * begin.total()


@pytest.mark.parametrize("few", [0, packing.FEW])
def test_packing_joins_long_and_short_plans(spark, few):
    """Many pieces of few lengths, in many buckets and cells."""
    rng = random.Random(3)
    rows = [(i, 0, rng.choice((5, 5, 5, 7, 11, 12)), i % 7) for i in range(900)]
    parts = spark.createDataFrame(rows, "id long, piece int, length long, ids_crc32 long")
    got = packing.pack(parts, 30, few).collect()
    assert sorted(r["id"] for r in got) == list(range(900))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 30
    assert len(by) <= packing.best_fit(Counter(r[2] for r in rows), 30).total()


def test_search_empties_what_best_fit_leaves():
    bins = [[6, 3], [5, 4], [1, 1]]  # of size 10: moves do
    packing.swap_search(bins, 10, 2)
    assert sorted(map(sum, bins)) == [0, 10, 10]
    bins = [[7, 2], [5, 3], [3]]  # the 3 goes in for a 2, which then moves
    packing.swap_search(bins, 10, 2)
    assert sorted(map(sum, bins)) == [0, 10, 10]


def family(seed, n, changed, length=400):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(9000)}" for _ in range(length)]
    texts = []
    for k in range(n):
        t = list(base)
        for at in rnd.sample(range(length), rnd.choice(changed)):
            t[at] = f"n{k}x{at}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("limit", [40, 2048])
def test_similar_families_that_straddle_the_similarity(spark, monkeypatch, limit):
    """Most of a family's pairs are below 0.8, but links through its other texts join it as a plain comparison does."""
    monkeypatch.setattr(similar, "LIMIT", limit)
    texts = family(1, 150, (4, 5, 6), 200) + family(2, 60, (5, 6), 200)
    sets = [shingles(t) for t in texts]
    roots = join_up(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r["id"]: r["root"] for r in similar.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({(roots[i], got[i]) for i in got}) == len(set(roots)) == len(set(got.values()))


def test_exact_links_of_blocks_are_those_of_one_task(spark, monkeypatch):
    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(30), 12)) for _ in range(160)]
    df = spark.createDataFrame(list(enumerate(sets)), "key long, shingles array<bigint>")
    loose = spark.range(160).selectExpr("id as node", "0L as root")
    want = join_up(160, lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j])))
    for limit in (7, 2048):
        monkeypatch.setattr(similar, "LIMIT", limit)
        links = {frozenset((r["a"], r["b"])) for r in similar.exact_links(loose, df, 0.5).collect()}
        got = join_up(160, lambda i, j: frozenset((i, j)) in links)
        assert got == want


def test_similar_joins_a_very_large_family(spark):
    """Ten thousand variants of one text, all alike to 0.8 and more, beside others that aren't: several times what one task compares at once."""
    texts = family(7, 10_500, (1, 2, 3)) + family(8, 40, (120, 130)) + ["a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    got = {r["id"]: r["root"] for r in similar.groups(df).collect()}
    assert len({got[i] for i in range(10_500)}) == 1 and len({got[i] for i in range(10_500, len(texts))}) == 41
    assert similar.drop_similar(df).count() == 42


def test_similar_loses_nothing_in_large_band_keys(spark, monkeypatch):
    """Many band keys hold more than LIMIT texts; what a plain comparison joins is joined."""
    monkeypatch.setattr(similar, "LIMIT", 4)
    texts = [t for seed in range(30) for t in family(seed + 10, 12, (3,), 200)]
    got = {r["id"]: r["root"] for r in similar.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    roots = join_up(len(texts), lambda i, j: i // 12 == j // 12 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len({(roots[i], got[i]) for i in got}) == len(set(roots)) == len(set(got.values()))


def test_fingerprints_alone_bring_like_texts_together():
    """Pairs at a similarity of hardly more than 0.8 share run keys and are within the bound; unlike ones aren't within it."""
    rnd, met, total = random.Random(11), 0, 0
    for _ in range(300):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        other = [*words[:267], *(f"n{rnd.randrange(10**6)}" for _ in range(33))]
        x, y = shingles(" ".join(words)), shingles(" ".join(other))
        assert 0.79 < len(x & y) / len(x | y) < 0.82
        fps = np.array([similar.sketch(" ".join(t))[0] for t in (words, other, words[::-1])])
        keys = similar.run_keys(fps)
        i, j = similar.close_in_runs(fps, np.zeros(3, dtype=np.int64), similar.bound(0.8))
        assert all({a, b} == {0, 1} for a, b in zip(i.tolist(), j.tolist(), strict=True))
        met, total = met + (len(i) == 1 and bool((keys[0] == keys[1]).any())), total + 1
    assert met >= 0.99 * total


def test_pairs_of_runs_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, (12, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 12, 300)] ^ (rng.integers(0, 1 << 64, (300, 4), dtype=np.uint64) & rng.integers(0, 1 << 64, (300, 4), dtype=np.uint64) & rng.integers(0, 1 << 64, (300, 4), dtype=np.uint64))
    runs = np.sort(rng.integers(0, 9, 300))
    i, j = similar.close_in_runs(fps, runs, 56)
    want = {frozenset((a, b)) for a in range(300) for b in range(a) if runs[a] == runs[b] and np.bitwise_count(fps[a] ^ fps[b]).sum() <= 56}
    assert {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want) > 50
    links = [x for r in range(9) for x in similar.forest(np.flatnonzero(runs == r), fps[runs == r], 56)]
    assert join_up(300, lambda a, b: frozenset((a, b)) in want) == join_up(300, lambda a, b, links={frozenset(x) for x in links}: frozenset((a, b)) in links)


def test_repeated_lines_leave_the_fingerprint_alone():
    rnd = random.Random(8)
    text = " ".join(f"w{rnd.randrange(9000)}" for _ in range(600))
    line = " " + " ".join(f"b{k}" for k in range(12))
    a, b = similar.sketch(text)[0], similar.sketch(text + line * 20)[0]
    x, y = shingles(text), shingles(text + line * 20)
    assert len(x & y) >= 0.9 * len(x | y) and np.bitwise_count(a ^ b).sum() <= similar.bound(0.8)


def test_search_takes_up_every_underfull_bin():
    """More bins than any part of them, with single loads and with many equal ones."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1200, 1801, 2500)
    for counts, most in ((Counter(lengths.tolist()), 1065), (Counter({n: 40 * c for n, c in Counter(lengths[:200].tolist()).items()}), None)):
        bins = packing.best_fit(counts, 4096).total()
        got = packing.plan(counts, 4096)
        used = {b + k for b, m in zip(got["bin"], got["many"], strict=True) for k in range(m)}
        assert len(used) < bins * 0.99 and len(used) <= (most or bins)


def test_decontaminate_passages_of_changed_case(spark):
    texts = ["Anna buys 4 pens. Then Anna sells 2 pens to her friend for 9 dollars and goes home.", "The ship left New York City and met Mary Ann Smith near Long Beach in the morning of that day."]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = [f"so: {f(t)} yes" for t in texts for f in (str, str.upper, str.lower, str.title)] + ["PAUL BUYS 6 PENS. THEN PETER SELLS 3 PENS TO HER FRIEND FOR 8 EUROS AND GOES HOME."]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for few in (0, decontaminate.FEW_BYTES):
        got = {(r["id"], r["item"], r["changed"], r["found"] == r["of"]) for r in decontaminate.contaminated(df, items, few=few).collect()}
        assert got == {(k, k // 4, False, True) for k in range(8)}


def test_pii_context_reaches_over_earlier_matches(spark):
    texts = ["Phone: 212-555-1234, 212-555-9876", "SSN 123-45-6789, 123-45-6780", "phone 1 2 3 4,5,6,7,8,9,0,1,2 212-555-9876", "phone 212-555-1234 and then at some length 212-555-9876", "212-555-1234, 212-555-9876"]
    rows = records(pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    got = {r["id"]: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["spans"]] for r in rows}
    assert got[0] == [("local", 7, 19, 0.6), ("local", 21, 33, 0.6)] and got[1] == [("ssn", 4, 15, 0.6), ("ssn", 17, 28, 0.6)]
    assert got[2] == [("local", 30, 42, 0.6)] and got[3] == [("local", 6, 18, 0.6)] and got[4] == []
