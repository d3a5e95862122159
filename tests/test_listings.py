"""Company pages, market pages and table types on frames of one's own."""

import pytest

from factlake.functions.similarity import partial_of
from factlake.operators import listings, matching
from factlake.queries import QUERIES


def item(label, value):
    return f"<div class='x'></div><div class=\"stats_item\"><div class=\"stats_label\">{label}</div><div class=\"big stats_value\">{value}</div></div>"


def test_company_overview(spark):
    page = '<h1 class="pageHeader__title">MTL</h1><div class="quote__name">Millat\n Tractors</div><div class="quote__close">Rs.563.63</div>'
    page += f'<div id="quote"><div data-name="FUT">{item("P/E Ratio (TTM)", "9")}</div><div data-name="REG">{item("P/E Ratio (TTM) **", "<b>12.5</b>")}</div></div>'
    page += f'<div id="equity">{item("Market Cap (000\'s)", "1,200")}{item("Shares", "30")}{item("Free Float", "12")}{item("Free Float", "40.00%")}</div><div id="profile">{item("Shares", "99")}</div>'
    out = {r.k: r for r in listings.company_overview(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string")).collect()}
    r = out[1]
    assert (r.symbol, r.name, r.sector, r.price, r.pe_ratio) == ("MTL", "Millat Tractors", None, 563.63, 12.5)
    assert (r.market_cap, r.shares, r.free_float, r.free_float_pct) == (1200.0, 30.0, 12.0, 40.0)
    assert all(v is None for k in (2, 3) for v in out[k][2:])


def test_year_tables(spark):
    page = "<table><tr><th>Item<th>2024 (A)<th>TTM</tr><tr><td>Sales<td>1,000<td>(5)</tr><tr><td>EPS<td>2<td></tr><tr><td>EPS<td>3<td>x</tr><tr><td><td>7<td>8</tr></table>"
    cells = matching.table_cells(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    got = sorted((r.year, r.label, r.value) for r in listings.year_tables(cells).collect() if r.value is not None)
    assert got == [("2024", "EPS", 3.0), ("2024", "Sales", 1000.0), ("TTM", "Sales", -5.0)]


def test_market_summary(spark):
    page = '<i>2024-05-06 15:30:00</i><table class="ms-tbl-new"><tr><td class="td-fst">Exchange</td><td><p><span>Status:</span> Open</p><p><span>Volume:</span>\n1,000</p><p><span>Status:</span> Closed</p></td></tr></table>'
    page += '<table><tr><td class="td-fst"><b>Symbol</b></td><td><p><span>Advanced:</span> 5</p></td></tr></table>'
    page += '<div class="a indices-single"><h3>KSE100</h3><h4>70,000.5</h4><h5>-3</h5><h6>(-0.5%)</h6></div><div class="indices-single"><h3> </h3></div><div class="indices-single"><h3>ALL</h3></div>'
    one, two = sorted(listings.market_summary(spark.createDataFrame([(1, page), (2, None)], "k int, html string")).collect())
    assert (one.stamp, one.exchange, one.breadth) == ("2024-05-06 15:30:00", {"volume": "1,000", "status": "Closed"}, {"advanced": "5"})
    assert [tuple(i) for i in one.indices] == [("KSE100", 70000.5, -3.0, -0.5), ("ALL", None, None, None)]
    assert (two.stamp, two.exchange, two.breadth, two.indices) == (None, None, None, [])


def test_table_types(spark):
    known = {"bs": ("balance sheet", "total assets"), "pl": ("income statement",), "cf": ("cash flow statement",)}
    shape = "k int, text string, hint string, cosines map<string,double>"
    rows = [(1, "The Balance Sheet", None, None), (2, "balance sheet and income statement", None, None), (3, "balance sheet and income statement", "pl", None), (4, "", None, None), (5, None, "cf", None), (6, "income statement", None, {"bs": 0.1, "pl": 0.9, "cf": -1.0}), (7, "Balance Shet", None, None)]
    out = {r.k: r for r in listings.table_types(spark.createDataFrame(rows, shape), known).collect()}
    assert [out[k].type for k in range(1, 8)] == ["bs", "unclassified", "unclassified", "unclassified", "unclassified", "pl", "bs"]
    assert out[2].score == out[2].runner_up == 1.0 and out[5].score == pytest.approx(0.1)
    assert out[6].score == pytest.approx(0.95) and out[7].score == pytest.approx(0.85 * partial_of("balance sheet", "balance shet") / 100)


def test_table_types_query_matches_a_plain_loop(spark, sf_dir):
    known = {"SMALL": ("small ring", "small bolt", "small gear"), "LARGE": ("large", "big"), "ECONOMY": ("red widget", "blue widget"), "PROMO": ("hot", "cold")}
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    got = {r.p_partkey: (r.type, round(r.score, 9)) for r in QUERIES["table_types"](spark, sf_dir).collect()}
    assert len(got) == len(parts)
    for p in parts:
        scores = {k: 1.0 if any(w in p.p_name.lower() for w in ws) else max(0.85 * partial_of(w, p.p_name.lower()) / 100 for w in ws) for k, ws in known.items()}
        if p.p_type in scores:
            scores[p.p_type] = min(1.0, scores[p.p_type] + 0.1)
        first, second = sorted(scores.values(), reverse=True)[:2]
        sure = first >= 0.6 and first - second >= 0.08
        assert got[p.p_partkey] == (next(k for k, v in scores.items() if v == first) if sure else "unclassified", round(first, 9))


def test_pages_in_one_part_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "TASK_PAGES", 10)
    pages = spark.range(0, 100, 1, 1).selectExpr("id AS page_id", "concat('<table><tr><th>A</tr><tr><td>', id, '</td></tr></table>') AS html")
    cells = matching.table_cells(pages)
    assert cells.rdd.getNumPartitions() == 10 and {(r.page_id, r.value) for r in cells.collect()} == {(i, str(i)) for i in range(100)}
