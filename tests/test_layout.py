"""Grids of words, continued tables, packed paragraphs, payloads of providers and replayed batches."""

import json
import random
import re
from datetime import date

import pytest

from factlake.operators.layout import continued_tables, packed_paragraphs, word_grid, word_rows
from factlake.operators.news import PROVIDERS, news_articles
from factlake.sources.sinks import batches, read_batches, write_batch, write_manifest, write_traces


def test_rows_of_words_match_a_plain_loop(spark):
    rng = random.Random(1)
    words = [(p, w, float(rng.randrange(0, 300)) / 3, float(rng.randrange(0, 50)), "x") for p in range(6) for w in range(rng.choice([0, 1, 40]))] + [(1, 900, None, 1.0, "x"), (None, 1, 1.0, 1.0, "x")]
    got = {(r.page, r.word): r.row for r in word_rows(spark.createDataFrame(words, "page int, word int, top double, x0 double, text string"), 8.0).collect()}
    want = {}
    for page in range(6):
        first, row = None, -1
        for _, w, top, _, _ in sorted((x for x in words if x[0] == page and x[2] is not None), key=lambda x: (x[2], x[3], x[1])):
            if first is None or abs(top - first) > 8:
                first, row = top, row + 1
            want[page, w] = row
    assert got == want


def test_grid_of_a_page(spark):
    line = lambda n, top, *cells: [(1, n * 10 + k, top + k % 3, x1 - 6.0 * len(t), x1, t) for k, (t, x1) in enumerate(cells)]
    words = [
        *line(1, 10.0, ("Year", 40.0), ("2025", 300.0), ("2024", 400.0)), *line(2, 30.0, ("Net", 30.0), ("sales", 70.0), ("1,250", 301.0), ("1,100", 399.0)),
        *line(3, 50.0, ("Cost", 35.0), ("(900)", 302.0), ("-", 400.0)), *line(4, 70.0, ("As", 20.0), ("at", 40.0), ("June", 80.0), ("30", 100.0)),
    ]
    plain = [(2, k, 10.0 * k, 5.0, 50.0, t) for k, t in enumerate(["no", "numbers"])]
    got = {(r.page, r.row, r.col): r.text for r in word_grid(spark.createDataFrame(words + plain, "page int, word int, top double, x0 double, x1 double, text string")).collect()}
    assert got == {
        (1, 0, 0): "Year", (1, 0, 1): "2025", (1, 0, 2): "2024", (1, 1, 0): "Net sales", (1, 1, 1): "1,250", (1, 1, 2): "1,100", (1, 2, 0): "Cost", (1, 2, 1): "(900)", (1, 2, 2): "-",
        (1, 3, 0): "As at June 30", (2, 0, 0): "no", (2, 1, 0): "numbers",
    }


def test_tables_go_on_over_pages(spark):
    rows = [("d", 1, 1, 1, 3, "pl", True), ("d", 2, 2, 1, 3, "pl", False), ("d", 3, 4, 1, 3, "pl", False), ("d", 5, 5, 1, 4, "pl", False), ("d", 6, 6, 1, 3, "pl", True), ("d", 7, 7, 1, 3, None, None), ("d", 8, 8, 1, 3, None, None), ("d", 8, 8, 2, 3, None, False), ("e", 9, 9, 1, 3, None, False)]
    found = continued_tables(spark.createDataFrame(rows, "doc string, first_page int, last_page int, place int, n_cols int, section string, has_year_header boolean")).collect()
    # the third ends on page 4, so page 5 would go on but for its columns
    assert sorted((r.doc, r.first_page, r.place, r.table_no, r.start) for r in found) == [("d", 1, 1, 1, 1), ("d", 2, 1, 1, 1), ("d", 3, 1, 1, 1), ("d", 5, 1, 2, 5), ("d", 6, 1, 3, 6), ("d", 7, 1, 4, 7), ("d", 8, 1, 4, 7), ("d", 8, 2, 5, 8), ("e", 9, 1, 1, 9)]


def packed(text, most, overlap):
    """Greedy packing of a whole text by a plain loop."""
    out, now = [], ""
    for para in (re.sub(r"\s+", " ", x).strip() for x in (text or "").splitlines()):
        if not para:
            continue
        if now and len(now) + 1 + len(para) > most:
            out.append(now)
            now = (now[len(now) - min(overlap, len(now)) :] + "\n" + para).strip()
        else:
            now = now + "\n" + para if now else para
        while len(now) > most:
            out.append(now[:most].strip())
            now = now[most - overlap :].strip()
    return out + ([now] if now else [])


@pytest.mark.parametrize("most, overlap", [(2_800, 250), (60, 20), (50, 0)])
def test_packing_matches_a_plain_loop(spark, most, overlap):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choices(["word", "ü", "longer-word", "  "], k=rng.choice([0, 3, 30, 200]))) for _ in range(rng.choice([1, 5, 60]))) for _ in range(12)] + [None, "", " \n\t", "x" * 200, "short"]
    rows = [(str(k), rng.choice("ab"), t) for k, t in enumerate(texts)]
    got = {}
    for r in packed_paragraphs(spark.createDataFrame(rows, "doc string, section string, text string"), most, overlap).collect():
        got.setdefault((r.doc, r.section), {})[r.chunk] = r.text
    want = {(d, s): dict(enumerate(packed(t, most, overlap))) for d, s, t in rows if packed(t, most, overlap)}
    assert got == want and all(len(c) <= most for x in got.values() for c in x.values())


def test_packing_of_no_rows(spark):
    assert packed_paragraphs(spark.createDataFrame([], "doc string, section string, text string")).collect() == []
    with pytest.raises(ValueError, match="overlap"):
        packed_paragraphs(spark.createDataFrame([], "doc string, section string, text string"), 10, 10)


def test_payloads_of_all_providers(spark):
    day = date(2024, 5, 1)
    payloads = {
        "marketaux": {"data": [{"title": "T", "snippet": "S", "url": "u", "source": "s", "published_at": "2024-05-01T10:00:00Z", "entities": [{"symbol": None}, {"symbol": "A", "sentiment_score": 0.5}, {"symbol": "B", "sentiment_score": 0.1}]}]},
        "finnhub": [{"headline": "T", "summary": "S", "url": "u", "source": "s", "datetime": 1714557600, "related": "A"}, "no object", {"headline": 7, "datetime": -1, "related": ""}],
        "alphavantage": {"feed": [{"title": "T", "summary": "S", "url": "u", "source": "s", "time_published": "20240501T100000", "authors": ["Ann", "", "Bo"], "overall_sentiment_score": "0.25", "ticker_sentiment": [{"ticker": "A"}]}]},
        "newsdata": {"status": "success", "results": [{"title": "T", "description": "S", "link": "u", "source_name": "s", "creator": ["Ann"], "pubDate": "2024-05-01 10:00:00"}]},
        "newsapi_ai": {"articles": {"results": [{"title": "T", "body": "S" * 300, "url": "u", "source": {"title": "s"}, "authors": [{"name": "Ann"}, {"x": 1}], "date": "2024-05-01", "lang": "deu"}]}},
        "worldnews": {"news": [{"title": "T", "summary": "D", "text": "S", "url": "u", "source_country": "s", "author": "Ann", "publish_date": "2024-05-01 10:00:00"}]},
        "gnews": {"articles": [{"title": "T", "description": "S", "url": "u", "source": {"name": "s"}, "publishedAt": "2024-05-01T10:00:00Z"}]},
        "newsapi_org": {"status": "ok", "articles": [{"title": None, "content": "S", "url": "u", "source": "s", "author": "", "publishedAt": "yesterday"}]},
    }
    rows = [(k, p, json.dumps(payloads[p])) for k, p in enumerate(PROVIDERS)]
    rows += [(20, "gnews", "{broken"), (21, "gnews", None), (22, "finnhub", "{}"), (23, "newsapi_org", '{"status": "error"}'), (24, "newsdata", '{"status": "fail", "results": [{}]}'), (25, "gnews", '{"articles": []}'), (26, "gnews", '{"articles": "none"}'), (27, "other", "{}"), (28, None, "{}"), (29, "gnews", "[1]")]
    out = {(r.payload_id, r.place): r for r in news_articles(spark.createDataFrame(rows, "payload_id int, provider string, payload string")).collect()}
    pick = lambda i, *c: tuple(out[i, 0][x] for x in c)
    common = ("title", "content", "url", "source", "published_on")
    assert {pick(k, *common) for k in (0, 1, 2, 3, 5, 6)} == {("T", "S", "u", "s", day)}
    assert pick(4, "title", "source", "author", "published_on", "language") == ("T", "s", "Ann", day, "deu") and len(out[4, 0].description) == 280 and len(out[4, 0].content) == 300
    assert pick(7, "title", "author", "published_on", "source") == ("", None, None, "s")
    assert pick(0, "symbols", "sentiment", "description", "language") == (["A", "B"], 0.5, "S", "en") and pick(2, "author", "sentiment", "symbols") == ("Ann, Bo", 0.25, ["A"]) and pick(5, "author", "description") == ("Ann", "D")
    assert pick(1, "symbols") == (["A"],) and (out[1, 1].title, out[1, 1].published_on, out[1, 1].symbols) == ("", None, []) and (1, 2) not in out
    assert {k: r.state for (k, _), r in out.items() if k >= 20} == {20: "broken", 21: "broken", 22: "broken", 23: "refused", 24: "refused", 25: "empty", 26: "empty", 27: "unknown", 28: "unknown", 29: "broken"}


def test_replayed_batches_change_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "entity string, n int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    held = lambda: sorted(((r.entity, r.n, r.batch) for r in read_batches(spark, path, "n int, entity string").collect()), key=str)
    assert write_batch(frame([("a", 1), ("b", 2), (None, 3)]), 0, path) and write_batch(frame([("a", 4)]), 1, path)
    before = held()
    assert before == [("a", 1, 0), ("a", 4, 1), ("b", 2, 0), ("unknown", 3, 0)]
    assert not write_batch(frame([(None, 3), ("b", 2), ("a", 1)]), 0, path) and held() == before
    # a batch that comes again with other rows replaces itself, also where it leaves a partition
    assert write_batch(frame([("a", 9)]), 0, path) and held() == [("a", 4, 1), ("a", 9, 0)]
    assert sorted((r.batch, r.n) for r in batches(spark, path).collect()) == [(0, 1), (1, 1)]


def test_manifests_and_traces(spark, tmp_path):
    ledger = [("m", "bs", "ok", False), ("m", "pl", "mismatch", True), ("m", "n1", "withheld", True), ("k", "bs", "missing", False), ("l", "bs", "closed", False), ("l", "bs", None, True)]
    path = str(tmp_path / "manifest")
    frame = spark.createDataFrame(ledger, "entity string, sheet string, status string, detail boolean")
    assert write_manifest(frame, 7, path) and not write_manifest(frame, 7, path)
    rows = read_batches(spark, path, "rows long, validation_failures long, detail_incomplete long, withheld long, detail_incomplete_sheets array<string>, production_ready boolean, fully_reconciled boolean, entity string", form="json")
    got = {r.entity: (r.production_ready, r.fully_reconciled, r.withheld, r.detail_incomplete_sheets) for r in rows.collect()}
    assert got == {"m": (True, False, 1, ["n1", "pl"]), "k": (False, False, 0, []), "l": (True, False, 0, ["bs"])}
    traces = spark.createDataFrame([(f"t{k}", "why", {"step": k}) for k in range(30)], "trace_id string, query string, plan map<string,int>")
    path = str(tmp_path / "traces")
    assert write_traces(traces, 1, path, 4) and not write_traces(traces, 1, path, 4)
    assert read_batches(spark, path, "trace_id string, query string, plan map<string,int>, folder string", "folder", "json").count() == 30


def test_narrative_pages(spark):
    prose, table = "word " * 60, "1,234 5,678 " * 40 + "word " * 40
    pages = [
        ("d", 1, prose), ("d", 2, f"Directors' Report to the members\n{prose}"), ("d", 3, prose), ("d", 4, table), ("d", 5, "short"), ("d", 6, f"SHARE PRICES\n{prose}"), ("d", 7, prose), ("d", 8, f"Chairman's\nReview\n{prose}"), ("d", 9, f"{prose} Form of Proxy"), ("d", 10, prose),
        ("d", 11, f"Strategy and risk\n{prose}"), ("d", 12, None), ("d", 13, f"{prose} more"), ("e", 1, f"risks and opportunities {'x' * 90}\n{prose}"), ("e", 2, f"\n\n  MD&A \n{prose}"),
    ]
    from factlake.operators.layout import narrative_pages

    out = narrative_pages(spark.createDataFrame(pages, "doc string, page int, text string")).collect()
    assert sorted((r.doc, r.page, r.section) for r in out) == [("d", 2, "Directors Report"), ("d", 3, "Directors Report"), ("d", 8, "Chairman Review"), ("d", 11, "Strategy"), ("d", 13, "Strategy"), ("e", 2, "Management Discussion & Analysis")]
