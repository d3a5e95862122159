"""Questions, relevant insights, citations and yearly sheets: the cases of their rules, and plain loops."""

import random

import pytest

from factlake.functions.similarity import token_set_of
from factlake.operators.asking import SIGNALS, distinct_insights, insight_relevance, parse_questions
from factlake.operators.citing import resolve_citations, yearly_companies


def test_questions(spark):
    aliases = [("mtl", "Millat", 1), ("Millat", "Millat", 2), ("lucky cement", "Lucky", 3)]
    asked = [
        ("a", "Revenue of MTL from 2019 to 2022?"), ("b", "growth of millat over the last 5 years"), ("c", "25?"), ("d", "25 employees at Lucky  Cement and Millat"), ("e", "gross  profit margin for each year"),
        ("f", "3-year change, 2021 and 2018"), ("g", "unlucky cement 12020"), ("h", None), ("i", "pat 2020 vs 2019"),
    ]
    out = parse_questions(spark.createDataFrame(asked, "question_id string, text string"), spark.createDataFrame(aliases, "alias string, company string, place int"))
    got = {r.question_id: (r.year, r.years, r.window, r.companies, r.asks_change) for r in out.collect()}
    assert got == {
        "a": (2019, [2019, 2020, 2021, 2022], None, ["Millat"], False), "b": (None, None, 5, ["Millat"], True), "c": (2025, None, None, [], False), "d": (None, None, None, ["Millat", "Lucky"], False), "e": (None, None, None, [], False),
        "f": (2021, [2018, 2019, 2020, 2021], None, [], True), "g": (None, None, None, [], False), "h": (None, None, None, [], False), "i": (2020, None, None, [], False),
    }
    assert {r.question_id: r.read_as for r in out.collect()}["e"] == "gross margin over the years"


def relevance(question, insight):
    _, _, intent, text, metrics, year = question
    told = " ".join(x for x in (insight[2], insight[3]) if x).lower()
    if not told:
        return 0.0
    terms = SIGNALS.get(intent, "").split() + [m.replace("_", " ") for m in metrics or []]
    n = sum(t in told for t in terms)
    words = [w for w in (text or "").lower().split() if len(w) > 3]
    signal = ({0: 0.0, 1: 0.55, 2: 0.7}.get(n, min(1.0, 0.7 + 0.05 * (n - 3)))) if terms else sum(w in told for w in words) / len(words) if words else 0.0
    season = 0.6 if year is not None and insight[4] is not None and year != insight[4] else 1.0
    return 0.7 * (0.85 * signal + 0.15 * token_set_of((text or "").lower(), told) / 100) + 0.3 * season


def test_relevance_matches_a_plain_loop(spark):
    rng = random.Random(5)
    words = "revenue sales growth margin board erp risk debt policy outlook cost continuity agm".split()
    insights = [(i, rng.choice("mn"), rng.choice([None, "Outlook", "Governance", "Growth"]), " ".join(rng.choices(words, k=rng.choice([0, 3, 9]))), rng.choice([None, 2020, 2021])) for i in range(120)]
    asked = [(k, rng.choice("mn"), rng.choice([*SIGNALS, "unknown", None]), rng.choice(["How is the sales growth", "risk of debt", None]), rng.choice([[], ["gross_margin", "revenue"], None]), rng.choice([None, 2020])) for k in range(25)]
    out = insight_relevance(spark.createDataFrame(asked, "question_id int, entity string, intent string, text string, metrics array<string>, year int"), spark.createDataFrame(insights, "insight_id int, entity string, area string, takeaway string, year int"), k=9)
    got = {(r.question_id, r.place): (r.insight_id, r.relevance) for r in out.collect()}
    want = {}
    for q in asked:
        scored = sorted((-round(relevance(q, i) + 1e-12, 4), i[0]) for i in insights if i[1] == q[1] and round(relevance(q, i) + 1e-12, 4) >= 0.65)
        want |= {(q[0], n + 1): (i, pytest.approx(-s, abs=1.1e-4)) for n, (s, i) in enumerate(scored[:9])}
    assert got == want and len(want) > 40


def test_insights_by_six_fields(spark):
    rows = [(3, "Growth ", "Up", None, 2020, 2021, 4, "x"), (1, "growth", " up", "", 2020, 2021, 4, "y"), (2, "growth", "up", "s", 2020, 2021, 4, "z"), (4, "growth", "up", None, 2020, None, 4, "u"), (5, "growth", "up", None, 2020, None, 4, "v"), (6, None, None, None, None, None, None, None)]
    out = distinct_insights(spark.createDataFrame(rows, "insight_id int, area string, takeaway string, section string, year int, report_year int, page int, area__key string"))
    assert sorted((r.insight_id, r.area__key) for r in out.collect()) == [(1, "y"), (2, "z"), (4, "u"), (6, None)]


def test_three_rungs_of_citations(spark):
    fact = "fact_id string, entity string, sheet string, cell string, label string, level string, metric string, year int, value double"
    row = "entity string, sheet string, cell string, matched_label string, year int, report_file string, page int, table_id string, report_year int, confidence double"
    facts = [
        ("own", "m", "PL1", "C4", "Net sales", "detail", "revenue", 2020, 1.0), ("total", "m", "P&L", "C9", "Net – Sales", "headline", "revenue", 2020, 1.0), ("whole", "m", "P&L", "C10", "Something", "headline", "cost", 2020, 1.0),
        ("book", "m", "P&L", "C11", "Tax", "headline", "tax", 2020, 1.0), ("empty", "m", "P&L", "C12", "Tax", "headline", "tax", 2020, None), ("late", "m", "P&L", "C13", "Net sales", "headline", "revenue", 2019, 5.0), ("other", "n", "PL1", "C4", "Net sales", "detail", "revenue", 2020, 1.0),
    ]
    ledger = [
        ("m", "PL1", "C4", "Net sales", 2020, "r20.pdf", 12, "T1", 2020, 0.9), ("m", "PL1", "C5", "net - sales", 2020, "r21.pdf", 8, "T1", 2021, 0.8), ("m", "PL1", "C6", "NET - SALES", 2020, "r21.pdf", 8, "T1", 2021, 0.7), ("m", "PL1", "C7", "Other", 2020, "r22.pdf", 3, "T9", 2022, 0.5),
        ("m", "PL2", "D4", "Raw material", 2020, "r21.pdf", 9, "T2", 2021, 0.6), ("m", "PL2", "D5", "Labour", 2020, "r21.pdf", None, None, 2021, None), ("m", "PL2", "D6", "Labour", 2020, "r20.pdf", 9, "T2", 2020, 0.1),
    ]
    out = resolve_citations(spark.createDataFrame(facts, fact), spark.createDataFrame(ledger, row), spark.createDataFrame([("revenue", "PL1"), ("cost", "PL2"), ("tax", "PL3")], "metric string, sheet string")).collect()
    got = sorted(((r.fact_id, r.basis, r.display, r.cell, r.rows, r.confidence) for r in out), key=str)
    assert got == sorted(
        [
            ("own", "direct", "r20.pdf, p12 (as reported FY2020)", "C4", 1, 0.9), ("total", "via_detail", "r21.pdf, p8 (as reported FY2021)", None, 2, 0.7),
            ("whole", "via_detail", "r21.pdf, p9 (as reported FY2021)", "D4", 1, 0.6), ("whole", "via_detail", "r21.pdf (as reported FY2021)", "D5", 1, None),
            ("book", "workbook", "workbook: P&L!C11", "C11", 0, None), ("late", "workbook", "workbook: P&L!C13", "C13", 0, None), ("other", "workbook", "workbook: PL1!C4", "C4", 0, None),
        ], key=str,
    )


def test_yearly_sheets(spark):
    sheet = [
        ["Exchange"], ["DATA FOR THE YEAR 2023"], [], ["Sr. No.", "Symbol", "Name of Company", "Year End", "Shareholders' Equity", "Sales / Total Income", "unknown"], ["", "", "", "", "(Rs. m)"],
        ["", "", "CEMENT"], ["1", "LUCK", "Lucky", "Jun", "1,250.5", "n.a."], ["2", "ACPL", "Attock", "", "-3"], ["", "", "AUTO"], ["3", "MTL", ""], ["4", "", "No symbol"], ["", "X", ""],
    ]
    cells = [("f", r, c, t) for r, row in enumerate(sheet) for c, t in enumerate(row)] + [("g", 0, 0, "Symbol"), ("g", 1, 0, "LUCK"), (None, 0, 0, "x")]
    out = yearly_companies(spark.createDataFrame(cells, "file string, row int, col int, text string")).collect()
    assert sorted(((r.fiscal_year, r.sector, r.symbol, r.name, r.year_end, r.equity, r.sales) for r in out), key=str) == [
        (2023, "AUTO", "MTL", None, None, None, None), (2023, "CEMENT", "ACPL", "Attock", None, -3.0, None), (2023, "CEMENT", "LUCK", "Lucky", "Jun", 1250.5, None)
    ]
