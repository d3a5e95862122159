"""Personal data and secrets against brute force with Python's expressions."""

import random
import re

from pyspark.sql import functions as F

from factlake.llm.pii import KINDS, personal_data
from factlake.llm.secrets import BASE, LEDGER_PATH, RULES, Rule, op9_secret_scan, scan

DOCS = "doc_id long, text string"


def _digits(m):
    return re.sub("[^0-9]", "", m[0])


def _luhn(s):
    return sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(s))) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def _base(kinds, text):
    return sorted((m.start(), n, m.end(), kind) for n, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m))


def _texts(rng, alphabet, n):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_base_personal_data_matches_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["a", "b@", "_", "@c.de", "x.y", "%", "-", ".", "1", "22.3", "4.5.6", "300", " ", "+1 ", "+44(0)", "4111 1111-1111 1111", "555-1234", "é", "🙂", "\n", "()", "0000"]
    docs = list(enumerate(_texts(rng, alphabet, 400)))
    docs += [(900, None), (901, ""), (None, "a@b.cc"), (902, "1 " * 30_000), (903, "a" * 60_000), (904, "9" * 60_000 + "." * 10 + "a@" * 9_000), (905, "1.2.3.4 4111111111111111"), (905, "1.2.3.4 4111111111111111")]
    d = spark.createDataFrame(docs, DOCS).withColumn("email", F.lit("clash")).withColumn("body", F.lit(1)).withColumn("term", F.lit(1))
    rows = personal_data(d, min_contexts=10**6).collect()
    got = sorted(((r.doc_id, [(s.start, s.number, s.end, s.kind) for s in r.spans]) for r in rows), key=str)
    assert got == sorted(((i, _base(PII, t)) for i, t in docs), key=str)


def test_terms_that_disclose_an_entity_are_sanitised(spark):
    docs = [(i, f"filler number {i} here. write to Doctor Zanzibar at za@x.org for case {i}") for i in range(5)]
    docs += [(50 + i, "copy copy Unrelated near me@y.org") for i in range(9)]
    docs += [(100 + i, f"common words here write to for the case at number {i}") for i in range(60)]
    docs += [(200, "Zanzibar alone"), (0, "za@x.org saw ZANZIBAR and zanzibars")]
    rows = {(r.doc_id, r.text) for r in personal_data(spark.createDataFrame(docs, DOCS)).collect()}
    assert (3, "filler number 3 here. write to <TERM> <TERM> at <EMAIL> for case 3") in rows
    assert (0, "<EMAIL> saw <TERM> and zanzibars") in rows
    assert (200, "Zanzibar alone") in rows
    assert (50, "copy copy Unrelated near <EMAIL>") in rows  # copies are one context
    assert (101, docs[15][1]) in rows


def test_copies_do_not_hide_a_term_that_discloses(spark):
    docs = [(i, f"case {i} Zanzibar za@x.org closed") for i in range(3)] + [(0, "case 0 Zanzibar za@x.org closed")] * 80
    docs += [(100 + i, f"another text {i} of the many") for i in range(60)]
    rows = {(r.doc_id, r.text) for r in personal_data(spark.createDataFrame(docs, DOCS)).collect()}
    assert {(i, f"<TERM> {i} <TERM> <EMAIL> <TERM>") for i in range(3)} <= rows


def test_a_fixed_phrase_counts_once_for_each_text(spark):
    phrase = "please contact us Quillon at qq@y.org for help today now sir"
    docs = [(i, f"u{i}a u{i}b {phrase} v{i}a v{i}b") for i in range(5)]
    docs += [(100 + i, f"another text {i} please contact us at for help today now sir") for i in range(60)]
    rows = {(r.doc_id, r.text) for r in personal_data(spark.createDataFrame(docs, DOCS)).collect()}
    assert {(i, f"u{i}a u{i}b please contact us <TERM> at <EMAIL> for help today now sir v{i}a v{i}b") for i in range(5)} <= rows


def test_personal_data_of_empty_table(spark):
    assert personal_data(spark.createDataFrame([], DOCS)).count() == 0
    assert list(KINDS) == [k for k, _, _ in PII]


def test_secrets_match_brute_force(spark):
    rng = random.Random(4)
    alphabet = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdef", "secret", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "a1", "Z", "é", "🙂", "\n", "-"]
    docs = list(enumerate(_texts(rng, alphabet, 400)))
    docs += [(900, None), (901, ""), (None, "token=abcdefg"), (902, "token " * 20_000), (903, "f" * 90_000), (904, "token" + " " * 50_000), (1, docs[1][1]), (905, docs[1][1])]
    d = spark.createDataFrame(docs, DOCS).withColumn("blob", F.lit("clash")).withColumn("spans", F.lit(1))
    findings, _ = scan(d, rules=BASE)
    got = sorted(((r.doc_id, [(s.start, s.number, s.end, s.kind) for s in r.spans]) for r in findings.collect()), key=str)
    assert got == sorted(((i, _base(SECRETS, t)) for i, t in docs), key=str)


def test_ledger_scans_only_unseen_blobs_and_rule_versions(spark):
    first = spark.createDataFrame([(1, "token=abcdefg"), (2, "nothing"), (3, "token=abcdefg")], DOCS)
    _, news = scan(first)
    ledger = spark.createDataFrame(news.collect(), news.schema)
    assert ledger.count() == 2
    later = first.union(spark.createDataFrame([(4, "token=hijklmn"), (5, "nothing")], DOCS))
    findings, news = scan(later, ledger)
    assert news.count() == 1
    assert {r.doc_id: len(r.spans) for r in findings.collect()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0}
    changed = (Rule("word", 2, "nothing"), *RULES)
    findings, news = scan(later, ledger, changed)
    assert sorted(len(r.rules) for r in news.collect()) == [1, 1, len(changed)]
    assert {r.doc_id: [s.kind for s in r.spans] for r in findings.collect()} == {1: ["assign"], 2: ["word"], 3: ["assign"], 4: ["assign"], 5: ["word"]}


def test_secrets_of_empty_table(spark):
    findings, news = scan(spark.createDataFrame([], DOCS))
    assert findings.count() == news.count() == 0


def test_query_extends_the_ledger_that_the_session_names(spark, sf_dir, tmp_path):
    plain = sorted(map(str, op9_secret_scan(spark, sf_dir).collect()))
    path = str(tmp_path / "ledger")
    spark.conf.set(LEDGER_PATH, path)
    try:
        assert sorted(map(str, op9_secret_scan(spark, sf_dir).collect())) == plain
        scanned = spark.read.parquet(path).count()
        texts = {r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        assert scanned == len(texts)
        assert sorted(map(str, op9_secret_scan(spark, sf_dir).collect())) == plain
        assert spark.read.parquet(path).count() == scanned
    finally:
        spark.conf.unset(LEDGER_PATH)
