"""Operators on frames of one's own: report lines, labels, themes, feeds and questions as a user has them."""

import pytest
from pyspark.sql import functions as F

from factlake.functions import similarity as S
from factlake.operators import ingest, matching


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_lines_of_raw_grids(spark):
    grid = [("a", 0, 0, "Particulars"), ("a", 0, 1, "Note"), ("a", 0, 2, "2025 Rupees"), ("a", 0, 3, "2024"), ("a", 1, 0, "LOCAL SALES"), ("a", 2, 0, "Revenue"), ("a", 2, 1, "7"), ("a", 2, 2, "1,200"), ("a", 2, 3, "(300)")]
    grid += [("a", 3, 0, "prose without values"), ("a", 4, 0, "Export:"), ("a", 5, 0, "Stock in trade"), ("a", 5, 2, "40"), ("a", 5, 3, "-"), ("a", 6, 0, "Components"), ("a", 6, 2, "2025"), ("a", 6, 3, "2024"), ("a", 7, 0, "Other"), ("a", 7, 3, "9%")]
    grid += [("b", 0, 0, "Line"), ("b", 0, 1, "now"), ("b", 0, 2, "before"), ("b", 1, 0, "Revenue"), ("b", 1, 1, "5"), ("b", 1, 2, "4")]
    tables = spark.createDataFrame([("a", "pl", []), ("b", None, [2025, 2024])], "sheet string, statement string, years array<int>")
    labels = spark.createDataFrame([("revenue", "revenue", "pl"), ("stock in trade", "stock_in_trade", "bs")], "key string, metric string, family string")
    out = ingest.line_values(spark.createDataFrame(grid, "sheet string, row_no int, col_no int, cell string"), tables, labels)
    assert rows(out, "sheet", "section", "label", "metric", "resolution", "year", "value") == sorted(
        [
            ("a", "LOCAL SALES", "Revenue", "revenue", None, 2025, 1200.0), ("a", "LOCAL SALES", "Revenue", "revenue", None, 2024, -300.0), ("a", "Export", "Stock in trade", None, "no_confident_metric", 2025, 40.0),
            ("a", "Export", "Stock in trade", None, "no_confident_metric", 2024, None), ("a", "Export", "Other", None, None, 2024, 9.0), ("b", None, "Revenue", "revenue", None, 2025, 5.0), ("b", None, "Revenue", "revenue", None, 2024, 4.0),
        ], key=str,
    )


def test_bands_carry_to_the_right(spark):
    grid = spark.createDataFrame([("s", 2, 3, "Forecasted"), ("s", 2, 1, "note"), ("t", 2, 1, "FORECAST")], "sheet string, row_no int, col_no int, cell string")
    columns = spark.createDataFrame([(s, 3, c, 2020 + c) for s in "stu" for c in (2, 3, 4)], "sheet string, header_row int, col_no int, year int")
    assert rows(ingest.period_bands(grid, columns), "sheet", "year", "period") == [
        ("s", 2022, "historical"), ("s", 2023, "forecasted"), ("s", 2024, "forecasted"), ("t", 2022, "forecasted"), ("t", 2023, "forecasted"), ("t", 2024, "forecasted"), ("u", 2022, "historical"), ("u", 2023, "historical"), ("u", 2024, "historical")
    ]


def test_split_lines_fold_unless_they_coexist(spark):
    lines = [("c", "Mark-up on loans", "38 Finance cost", None, 2023, 2024, 5.0), ("c", "Mark up on loans", None, None, 2024, 2025, 6.0), ("c", "Markup on loans", "Finance", None, 2023, 2025, 5.5)]
    lines += [("c", "Salaries", "Distribution", None, 2024, 2025, 10.0), ("c", "Salaries", "Administration", None, 2024, 2025, 20.0), ("c", "Stock", "A", "stock_in_trade", 2024, 2025, 1.0), ("c", "Stock", "B", None, 2023, 2024, 2.0)]
    out = ingest.folded_lines(spark.createDataFrame(lines, "company string, label string, section string, metric string, year int, report_year int, value double"))
    assert rows(out, "label", "year", "report_year", "value", "folded") == sorted(
        [("Mark-up on loans", 2023, 2025, 5.5, True), ("Mark-up on loans", 2024, 2025, 6.0, True), ("Salaries", 2024, 2025, 10.0, False), ("Salaries", 2024, 2025, 20.0, False), ("Stock", 2024, 2025, 1.0, False), ("Stock", 2023, 2024, 2.0, False)], key=str
    )


def test_components_are_the_nearest_rows_above(spark):
    sheet = spark.createDataFrame([("s", 1, "Land"), ("s", 2, "Plant"), ("s", 3, "Total"), ("s", 4, "Land"), ("s", 5, "Stock"), ("s", 6, "All")], "sheet string, row_no int, label string")
    totals = spark.createDataFrame([("s", 3, ["land", "plant"]), ("s", 6, ["Land", "Stock"]), ("s", 3, ["land", "cash"]), ("s", 5, ["land"])], "sheet string, total_row int, components array<string>")
    assert rows(ingest.total_components(sheet, totals), "total_row", "component_row") == [(3, 1), (3, 2), (6, 4), (6, 5)]


def test_pages_and_companies(spark):
    pages = spark.createDataFrame([(1, "x" * 50, "y" * 90), (2, "short", "a longer text of OCR"), (3, " short one ", "tiny"), (4, "short", None)], "page int, native string, ocr string")
    assert rows(ingest.page_text(pages), "page", "kind") == [(1, "native"), (2, "ocr"), (3, "empty"), (4, "native")]
    docs = [("a.pdf", 1, "Beta Motors Limited and Alpha Steel Mills Limited"), ("a.pdf", 2, "Alpha Steel Mills Limited"), ("gamma_foods-2024.pdf", 1, "nothing here"), ("b.pdf", 3, "Y Limited"), ("b.pdf", 2, "Zed Works Limited")]
    out = ingest.document_company(spark.createDataFrame(docs, "file string, page int, text string"))
    assert rows(out, "file", "company") == [("a.pdf", "Alpha Steel Mills Limited"), ("b.pdf", "Zed Works Limited"), ("gamma_foods-2024.pdf", "gamma foods")]


def test_ladder_of_similarities():
    assert S.ratio_of("abcd", "abxd") == pytest.approx(75.0) and S.ratio_of("", "") == 100.0 and S.ratio_of("abc", "") == 0.0
    assert S.token_sort_of("net sales revenue", "revenue net sales") == 100.0
    assert S.token_set_of("cost of sales", "cost of sales and services") == 100.0 and S.token_set_of("a", "") == 0.0
    assert S.partial_of("sales", "net sales tax") == 100.0

    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert S.ratio_of(a, b) == pytest.approx(200 * plain(a, b) / (len(a) + len(b)))


def test_fuzzy_labels(spark):
    known = spark.createDataFrame([("cost of sales", "cost_of_sales"), ("profit after taxation", "pat"), ("adjusted earnings", "adjusted_earnings")], "name string, metric string")
    asked = spark.createDataFrame([("Cost of sale",), ("Cost of Sales",), ("Profit after taxations",), ("adjusted cost of sales",), ("unknown thing",), ("",)], "label string")
    assert rows(matching.fuzzy_labels(asked, known), "label", "metric") == [("Cost of sale", "cost_of_sales"), ("Profit after taxations", "pat")]


def test_fuzzy_labels_match_a_plain_comparison(spark, sf_dir):
    from factlake.functions.similarity import ratio_of

    names = [r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect()]
    torn = [n.replace("a", "") for n in names] + [n.replace("e", "ee") for n in names]
    got = {(r.label, round(r.score, 6)) for r in matching.fuzzy_labels(spark.createDataFrame([(t,) for t in torn], "label string"), spark.createDataFrame([(n, n) for n in names], "name string, metric string")).collect()}
    want = set()
    for t in torn:
        scores = [ratio_of(t, n) for n in names]
        if t not in names and scores and max(scores) >= 90:
            want.add((t, round(max(scores), 6)))
    assert got == want


def test_themes(spark):
    themes = spark.createDataFrame([("capacity_expansion", "strategy", []), ("cement demand outlook", "outlook", []), ("board", "governance", [])], "theme string, category string, secondary array<string>")
    phrases = spark.createDataFrame([("Cement Demand", "cement demand outlook"), ("board oversight", "board"), ("oversight", "capacity_expansion")], "phrase string, theme string")
    insights = [("capacity expansion", None, "Strategy", 1.0), ("Cement Demand", None, "Outlook", 0.95), ("board oversight", None, "Outlook", 1.0), ("new", "more board oversight is due", None, 1.0), ("nothing", None, "Risks", 0.8), ("nothing", None, "nowhere", 0.8)]
    out = matching.theme_mapping(spark.createDataFrame(insights, "area string, takeaway string, section string, extraction double"), themes, phrases)
    assert rows(out, "area", "section", "theme", "category", "method", "confidence", "section_conflict") == sorted(
        [
            ("capacity expansion", "Strategy", "capacity_expansion", "strategy", "exact", 0.9, False), ("Cement Demand", "Outlook", "cement demand outlook", "outlook", "alias", 0.9, False), ("board oversight", "Outlook", "board", "governance", "alias", 0.75, True),
            ("new", None, "board", "governance", "keyword", 0.65, False), ("nothing", "Risks", None, "business_risk", "unmapped", 0.0, False), ("nothing", "nowhere", None, None, "unmapped", 0.0, False),
        ], key=str,
    )


def test_feeds(spark):
    page = """<table class="t"><thead><tr><th data-name="SYMBOL">Sym<th>SECTOR<th>LISTED IN<th>CURRENT<th>CHANGE<th>CHANGE (%)<th>VOLUME</tr></thead><tbody>
    <tr><td data-order="MTL"><a href="/company/MTL"><b>MTL</b></a></td><td>0801</td><td>ALLSHR, KSE100</td><td data-order="563.63">563.63</td><td>5.26</td><td>0.942%</td><td>146,045</td></tr>
    <tr><td>ASL-MAR</td><td>0802</td><td></td><td>(1.5)</td><td>x</td><td></td><td></td></tr></tbody></table>"""
    cells = matching.table_cells(spark.createDataFrame([(1, page), (2, None), (3, "<p>no table")], "page_id long, html string"))
    out = matching.futures(matching.typed_feed(cells, matching.MARKET_WATCH))
    assert rows(out, "symbol", "sector", "listed_in", "price", "change", "change_pct", "volume", "base", "contract") == [
        ("ASL-MAR", "0802", [""], -1.5, None, None, None, "ASL", "MAR"), ("MTL", "0801", ["ALLSHR", "KSE100"], 563.63, 5.26, 0.942, 146045, "MTL", None)
    ]
    news = "<table><tr><th>DATE<th>TIME<th>TITLE</tr><tr><td>1 May<td>9:00<td><span class='tag red'>REVOKED </span><a href='/download/document/4711.pdf'>Results</a></tr></table>Showing 1 to 50 of 1,863 Entries"
    out = matching.announcements(matching.typed_feed(matching.table_cells(spark.createDataFrame([(1, news)], "page_id long, html string")), matching.ANNOUNCEMENTS))
    assert rows(out, "date", "title", "document_id", "status") == [("1 May", "Results", 4711, "REVOKED")]
    assert [r.n for r in spark.createDataFrame([(news,), ("x",), (None,)], "h string").select(matching.entries_total(F.col("h")).alias("n")).collect()] == [1863, None, None]


def test_questions_and_sectors(spark):
    asked = spark.createDataFrame([("m", "how is the profit"), ("m", "net profit please"), ("m", "revenue or sales"), ("n", "how is the profit"), ("o", "revenue")], "entity string, text string")
    have = spark.createDataFrame([("m", ["pat", "gross_profit", "sales"]), ("n", ["pat"])], "entity string, metrics array<string>")
    out = matching.metric_availability(asked, [("net profit", "pat"), ("revenue", "revenue"), ("sales", "sales")], have)
    assert rows(out, "entity", "text", "resolved", "available", "clarify", "candidates") == sorted(
        [("m", "how is the profit", None, False, True, ["gross_profit", "pat"]), ("m", "net profit please", "pat", True, False, []), ("m", "revenue or sales", "sales", True, False, []), ("n", "how is the profit", None, False, False, ["pat"]), ("o", "revenue", "revenue", False, False, [])], key=str
    )
    sectors = spark.createDataFrame([(1, "0801", "AUTOMOBILE ASSEMBLER"), (2, "0804", "CEMENT"), (3, "0805", "CEMENT")], "place int, code string, name string")
    names = spark.createDataFrame([("0804",), ("cement",), ("assem",), ("none",)], "query string")
    assert rows(matching.sector_codes(names, sectors), "query", "code") == [("0804", "0804"), ("assem", "0801"), ("cement", "0804"), ("none", None)]
    quotes = spark.createDataFrame([("A", "0801", "AUTOMOBILE ASSEMBLER"), ("B", "0804", "CEMENT"), ("C", "0999", "OTHER")], "symbol string, sector_code string, sector string")
    of = lambda q: [s for (s,) in rows(matching.of_sector(quotes, q, sectors), "symbol")]
    assert of("cement") == ["B"] and of("") == ["A", "B", "C"] and of("oth") == ["C"]


def test_template_lines_are_one_to_one(spark):
    shape = "string, statement string, label string, metric string, is_total boolean, section string"
    template = spark.createDataFrame([("t1", "pl", "Cost of sales", None, False, "trading"), ("t2", "pl", "Total cost of sales", None, True, None), ("t3", "bs", "Cost of sales", None, False, None), ("t4", "pl", "Sales cost", None, False, None)], f"row_id {shape}")
    items = spark.createDataFrame([("i1", "pl", "Cost of sales - net", None, False, "Trading account"), ("i2", "pl", "Total cost of sales", None, True, None), ("i3", "pl", "cost of sales", "other", False, None)], f"item_id {shape}")
    assert [r[:2] for r in rows(matching.template_lines(template, items), "row_id", "item_id", "score")] == [("t1", "i1"), ("t2", "i2"), ("t4", "i3")]


def test_texts_of_authors_numbers_and_forecasts(spark):
    raw = spark.createDataFrame([('"Ann"',), ('["Ann", "", "Bo"]',), ('[{"name": "Cy"}, {"x": 1}]',), ("[]",), (None,)], "raw string")
    assert [r.a for r in raw.select(matching.author_names(F.col("raw")).alias("a")).collect()] == ["Ann", "Ann, Bo", "Cy", None, None]
    text = "up 12.5% to Rs '000 1,200 [C3] or 3x"
    found = spark.range(1).select(F.explode(matching.number_tokens(F.lit(text))).alias("n")).select("n.*").collect()
    assert [(r.token, r.magnitude, r.is_percent, r.is_integer) for r in found] == [("12.5%", 0.125, True, False), ("1,200", 1200.0, False, True), ("3x", 3.0, False, False)]
    assert spark.range(1).select(matching.stated_forecast(F.lit("a 10% growth"), F.lit(100.0)).alias("t")).first().t == pytest.approx(110.0)
    got = spark.createDataFrame([("(1,234)",), ("Rs. 5.5",), ("nil",), ("1,2",)], "c string").select(*(f(F.col("c")).alias(n) for n, f in (("s", matching.strict_number), ("m", matching.money), ("p", matching.plain_number)))).collect()
    assert [tuple(r) for r in got] == [(-1234.0, -1234.0, None), (None, 5.5, None), (None, None, None), (12.0, 12.0, 12.0)]


def test_value_columns_go_by_parts_of_a_bounded_size(spark, monkeypatch):
    words = spark.range(4_000).selectExpr("id div 8 AS page", "id % 8 AS word", "id % 8 AS top", "CAST(id % 3 * 100 AS DOUBLE) AS x1")
    whole = sorted(map(tuple, ingest.value_columns(words).collect()))
    monkeypatch.setattr(ingest, "TASK_WORDS", 200)
    cut = ingest.value_columns(words)
    assert cut.rdd.getNumPartitions() == 20 and sorted(map(tuple, cut.collect())) == whole and len(whole) == 4_000
