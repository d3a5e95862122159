"""Decontamination, line dedup and token counts against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlake.llm.decontaminate import contamination, op1_decontamination
from factlake.llm.linededup import PerfectHash, deduplicate_lines, op2_line_dedup
from factlake.llm.tokens import Counter, token_counts

DOCS = "doc_id long, text string"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _hit(doc, items, window=10):
    own, hit, found = _words(doc), set(), set()
    for item, text in items:
        w = _words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item) if item is not None else "null")
    return len(own), len(hit), sorted(found)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["a", "b", "C", "ä", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, "only here")]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, "it is ONLY, here"), (103, (text(30) + " ") * 300)]
    d = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(7)).withColumn("words", F.lit("w"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = sorted(((i, *_hit(t, items)) for i, t in docs), key=str)
    for block_bytes in (1 << 20, 60):
        rows = contamination(d, b, block_bytes=block_bytes).collect()
        got = sorted(((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), r["items"]) for r in rows), key=str)
        assert got == want
        assert all(r.contaminated == bool(r.starts) for r in rows)


def test_contamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contamination(d, b).collect()] == [False]
    assert contamination(d.limit(0), b).count() == 0


def test_op1_digest(spark, sf_dir):
    row = op1_decontamination(spark, sf_dir).where("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(deadline=None, max_examples=30)
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.uint64)
    own, _ = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert sorted(own.find(keys).tolist()) == list(range(len(keys)))


def _dedup(docs, min_docs=5):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    holders = defaultdict(list)
    for row, (_, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(docs[row][0])
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = [len(h := holders.get(key(x), [])) >= min_docs and any(d is not None for d in h) and i != max(d for d in h if d is not None) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_line_dedup_matches_brute_force(spark, broadcast_bytes):
    rng = random.Random(2)
    pool = [f"  Line {i} {'ä' * (25 + i % 20)} END\t" for i in range(20)] + ["short", "", " \t", "Ö" * 40]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    docs += [(7, docs[7][1]), (None, "\n".join(pool)), (None, None), (90, ""), (91, None), (92, "x" * 20_000), (93, pool[0].upper() + "\r")]
    d = spark.createDataFrame(docs, DOCS).withColumn("line", F.lit(1)).withColumn("n", F.lit(2)).withColumn("h1", F.lit("h"))
    got = deduplicate_lines(d, broadcast_bytes=broadcast_bytes, carry=("n", "h1")).collect()
    assert {(r.n, r.h1) for r in got} == {(2, "h")}
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == _dedup(docs)


def test_line_dedup_of_empty_table(spark):
    assert deduplicate_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_op2_digest(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    row = op2_line_dedup(spark, sf_dir).where("n_dropped = 0").first()
    assert row.kept_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(["<|endoftext|>", "  \n\n", "I'LL don't", "½٣ x\u0085y", "aaaa" * 30, "🙂🙂"])), max_size=6))
@settings(deadline=None, max_examples=200)
def test_token_counts_are_the_library_s(vocabulary, parts):
    tokenizers = pytest.importorskip("tokenizers")
    text = "".join(parts).encode("utf-8", "ignore").decode()
    known = tokenizers.Tokenizer.from_file(vocabulary)
    assert Counter.of(vocabulary).count(text) == len(known.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_rows(spark, vocabulary):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "ab<|endoftext|>"), (2, "é" * 5_000)], DOCS).withColumn("n_tokens", F.lit(0))
    rows = token_counts(docs, vocabulary).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == [("1", 0), ("1", 0), ("2", 10_000), ("None", 15)]
    assert token_counts(docs.limit(0), vocabulary).count() == 0
