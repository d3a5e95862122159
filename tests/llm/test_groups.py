"""Near duplicates, quality, mixing, HTML and the pipeline against brute force and planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import html, minhash, vectors
from factlake.llm.common import components, groups, words
from factlake.llm.html import blocks, extract, main_texts, repeated_tokens
from factlake.llm.minhash import near_documents, shingles, signature, similarity
from factlake.llm.mixing import mix, op10_mixing
from factlake.llm.quality import isotonic, quality_scores
from factlake.llm.vectors import decode, near_vectors, roots

DOCS = "doc_id long, text string"


def _groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _groups({x for e in links for x in e}, links)
    assert got == {i: c for i, c in want.items() if i in got}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}


def _variants(rng, n):
    docs = []
    for g in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(own))
    return docs


@pytest.mark.parametrize("weighted", [False, True])
def test_near_documents_match_brute_force(spark, weighted, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 1)
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(60))
    docs = list(enumerate(_variants(rng, 25)))
    docs += [(500 + i, f"{shared} {' '.join(f'y{rng.randrange(10**6)}' for _ in range(14))}") for i in range(30)]  # alike, but below 0.8
    docs += [(700, None), (701, ""), (702, "?!"), (None, docs[0][1]), (703, "one two"), (704, "ONE, two!"), (705, docs[1][1]), (705, docs[1][1]), (706, (docs[2][1] + " ") * 40)]
    d = spark.createDataFrame(docs, DOCS).withColumn("band", F.lit(1)).withColumn("component", F.lit(2))
    sets = [(i, s if weighted else (s[0], np.ones_like(s[1]))) for i, t in docs if i is not None and len((s := shingles(words(t)))[0])]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if similarity(x, y) >= 0.8]
    want = _groups({i for i, _ in docs if i is not None}, links)
    rows = near_documents(d, weighted=weighted).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert want[704] == 703 and want[701] == 701


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    weights = rng.integers(1, 5, 400)
    for w, want in ((None, 300 / 500), (weights, weights[:300].sum() / (weights[:300].sum() + 2 * weights[300:].sum()))):
        got = (signature(a, w, 4096) == signature(b, w, 4096)).mean()
        assert abs(got - want) < 0.04
    assert len(signature(a[:1], None)) == minhash.BANDS * minhash.ROWS


def test_near_documents_of_empty_table(spark):
    assert near_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, (300, 8))
    own = decode(x)
    assert len(roots()) == 240 and np.allclose((roots() ** 2).sum(1), 2)
    distance = ((x - own) ** 2).sum(1)
    assert (distance <= 1 + 1e-9).all()  # the covering radius is 1
    others = ((x[:, None, :] - own[:, None, :] - roots()[None]) ** 2).sum(2).min(1)
    assert (distance <= others + 1e-9).all()


@pytest.mark.parametrize("block", [1_024, 6])
def test_near_vectors_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 25 if g < 2 else 4))):
            rows.append((len(rows), (base + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), g % 3))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, [2 * x for x in rows[0][1]], 0), (903, rows[0][1], None), (904, rows[0][1], 1), (905, None, 0), (906, [], 0), (907, [0.0] * 16, 0)]
    rows += [(908, [float("nan")] * 16, 0), (909, [float("inf")] + [1.0] * 15, 0), (910, [None] + [1.0] * 15, 0), (911, [1.0, 2.0], 0), (912, [1.0, 2.0], 0), (None, rows[0][1], 0), (5, rows[5][1], rows[5][2])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("n", F.lit(1))
    ok = [(k, i, np.array(v, float) / np.linalg.norm(v), g) for k, (i, v, g) in enumerate(rows) if i is not None and v and g is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for n, a in enumerate(ok) for b in ok[n + 1 :] if a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] >= 0.93]
    want = _groups({i for _, i, _, _ in ok}, [(a[1], b[1]) for a, b in links])
    degree = np.zeros(len(rows), int)
    for a, b in links:
        degree[a[0]] += 1
        degree[b[0]] += 1
    expected = sorted(((i, int(degree[k]), want.get(i, i)) for k, (i, _, _) in enumerate(rows)), key=str)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(d).collect()), key=str) == expected


def test_near_vectors_of_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_mixing_meets_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("bucket", F.lit(1))
    rows = mix(docs, carry=("bucket",)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs, carry=("bucket",)).collect()))
    total = sum(r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
        assert own[0].target <= 2 * own[0].source_size + 1e-6 and own[0].source_size == sum(r["size"] for r in own)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * total) < 1e-3 * total
    assert all(r.copies in (0, 1, 2) and r.taken == r.copies * r["size"] for r in rows)


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (None, "x y", "b"), (4, " \t\n", "c"), (4, "w " * 9_000, "c"), (4, "w " * 9_000, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(d).collect()
    assert len(got) == len(rows)
    assert {r.source: r.target for r in got if r.source in ("a", "b", None)} == {"a": 0.0, "b": 4.0, None: 6.0}
    assert mix(d.limit(0)).count() == 0
    assert op10_mixing.__name__ == "op10_mixing"


def test_blocks_of_a_page():
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>menu</a></nav>
    <div class="cookie-banner">cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>face<br>two<p class=ad>ad<p>three&nbsp;<script>if (a < b) x()</script>four
    <ul><li>a<li>b</ul><form><p>f</form><aside>side</aside><div id="newsletterSignup">news</div></article></main><section class="comments"><article>c</article></section><footer>f</footer></body></html>"""
    assert blocks(page) == ["Title & more", "One boldface two", "three four", "a", "b"]
    assert blocks("<body><div id=content><h1>T</h1>para</div><div style='display: none'>x</div><!-- c --><p>q") == ["T", "para", "q"]
    assert blocks(None) == blocks("") == []
    assert blocks("<div><p" + "<" * 20_000) and blocks("<a " + '"' * 30_001) is not None


def test_repeated_runs_are_removed_and_unique_ones_kept(spark):
    rng = random.Random(10)
    notice = "please accept all of our very many terms before reading on today"
    pages = [[f"head {k}", " ".join(f"u{rng.randrange(10**6)}" for _ in range(20)), f"own{k} {notice} own{k}b"] for k in range(8)]
    assert main_texts(pages) == ["\n".join([*p[:2], f"own{k} own{k}b"]) for k, p in enumerate(pages)]
    assert main_texts(pages[:4]) == ["\n".join(p) for p in pages[:4]]
    assert [c.sum() for c in repeated_tokens([p[2].split() for p in pages])] == [len(notice.split())] * 8
    rows = [(k, "http://h.example/", f"<p>{'<p>'.join(p)}") for k, p in enumerate(pages)] + [(20, None, None), (None, "x", ""), (21, "http://o.example/a", "<p>only</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("blocks", F.lit(2))
    got = {r.page_id: r.text for r in extract(d).collect()}
    assert got == {**dict(enumerate(main_texts(pages))), 20: "", None: "", 21: "only"}
    assert extract(d.limit(0)).count() == 0


def test_equal_pages_are_one_page(spark, monkeypatch):
    rng = random.Random(12)
    fresh = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))
    article = [fresh(), fresh()]
    assert main_texts([article] * 5) == ["\n".join(article)] * 5
    joined = [" ".join(article)]  # the same tokens in one block
    assert main_texts([article] * 4 + [joined] * 4) == ["\n".join(article)] * 4 + joined * 4
    notice = "please accept all of our very many terms before reading on today"
    others = [[fresh(), notice] for _ in range(6)]
    pages = [article] * 30 + [joined] * 3 + others
    want = ["\n".join(article)] * 30 + joined * 3 + [o[0] for o in others]
    assert main_texts(pages) == want
    rows = [(k % 35 or None, f"http://h.example/{k}", f"<p>{'<p>'.join(p)}") for k, p in enumerate(pages)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk_rows in (4_096, 7):
        monkeypatch.setattr(html, "CHUNK_ROWS", chunk_rows)
        got = {(r.page_id, r.url): r.text for r in extract(d.repartition(3)).collect()}
        assert got == {(i, u): t for (i, u, _), t in zip(rows, want, strict=True)}


def test_isotonic_is_monotone():
    _, levels = isotonic(np.arange(5.0), np.array([0.2, 0.1, 0.5, 0.4, 0.9]), np.ones(5))
    assert np.allclose(levels, [0.15, 0.45, 0.9])


def test_quality_is_learned_from_rows_that_are_not_held_out(spark):
    rng = random.Random(11)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(rng.choice("ABC") for _ in range(3)) + "!!" for _ in range(60))
    docs = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (None, good()), (902, good() * 200), (1, good())]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, quality int")
    d = spark.createDataFrame(docs, DOCS).withColumn("quality", F.lit(1)).withColumn("y", F.lit("clash")).withColumn("stats", F.lit(1))
    rows = quality_scores(d, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert 40 < len(held) < 130
    assert all(r.predicted == (0 if r.doc_id % 4 == 0 else 1) for r in held)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = quality_scores(d, labels.limit(0)).collect()
    assert all(0.4 < r.score < 0.6 for r in none)
    assert quality_scores(d.limit(0), labels).count() == 0


def test_pipeline_stages_keep_what_they_should(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    clean = " ".join(f"plain{i % 97} sentence{i} number." for i in range(80))
    planted = spark.createDataFrame([(10**6, clean), (10**6 + 1, clean + " end"), (10**6 + 2, f"{clean[::-1]} {bench} more"), (10**6 + 3, "A!! B!! " * 90)], DOCS)
    docs = docs.unionByName(planted.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length("text").cast("long").alias("n_chars")))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 10**6 in ids and not {10**6 + 1, 10**6 + 2, 10**6 + 3} & ids
    assert set(corpus_pipeline.mixing(spark, kept, sf_dir).columns) == {*corpus_pipeline.COLUMNS, "copy"}


def test_pipeline_stages_judge_rows_with_null_and_repeated_ids(spark, sf_dir):
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], names)
    kept = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(None, f"hit {bench}"), (None, text(1)), (7, f"hit {bench}"), (7, text(2)), (8, text(3)), (8, text(3))]
    found = corpus_pipeline.decontamination(spark, make(rows), sf_dir)
    assert found.columns == corpus_pipeline.COLUMNS and kept(found) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)

    rows = [(5, text(1)), (5, text(1)), (6, text(1) + " end"), (None, text(1)), (None, text(2)), (None, text(2)), (9, text(3)), (9, text(4)), (3, ""), (3, ""), (4, "")]
    found = corpus_pipeline.near_dedup(spark, make(rows), sf_dir)
    assert kept(found) == sorted([(5, text(1)), (None, text(2)), (9, text(3)), (9, text(4)), (3, ""), (4, "")], key=str)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    good = docs.where("doc_id = 0").first().text
    bad = "A!! B!! " * 90
    odd = [(None, bad), (10**6, bad), (10**6, good), (None, good)]
    found = corpus_pipeline.quality_classifier(spark, docs.union(make(odd)), sf_dir)
    scored = {r.text: r.predicted for r in quality_scores(docs.union(make(odd)), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("text",)).collect()}
    want = [(i, t) for i, t in odd if scored[t]]
    assert kept(found.where("doc_id IS NULL OR doc_id = 1000000")) == sorted(want, key=str) and not scored[bad]

    rows = [(None, "own line\nshared"), (1, "other\nline"), (1, "other\nline"), (None, "")]
    assert corpus_pipeline.line_dedup(spark, make(rows), sf_dir).count() == len(rows)
    assert corpus_pipeline.mixing(spark, make(rows), sf_dir).where("doc_id = 1").count() >= 2


def test_groups_are_consecutive_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1, 2], [], [2, 2], [3])]
    assert [(k, t.num_rows) for k, t in groups(batches, ["k"])] == [((1,), 2), ((2,), 3), ((3,), 1)]
