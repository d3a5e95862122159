"""Company pages, market pages and table types: single figures that stand outside tables.

Each operator takes DataFrames; the queries below apply them to rows of the given tables.
Pages are read with regular expressions in the JVM, so a page is one row from start to end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import partial_of
from ..registry import Registry
from ..sources.bridge import read
from .matching import money, table_cells

registry = Registry()

#: A keyword that is only resembled counts less than one that occurs.
RESEMBLED = 0.85


def _text(html: Column) -> Column:
    """Text of a piece of markup on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[ \t\r\n\f]+", " "))


def _found(html: Column, pattern: str) -> Column:
    """Text of the first group of the first match; null without one or with nothing in it."""
    return F.nullif(_text(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1)), F.lit(""))


def _class(name: str) -> str:
    return rf'(?s)class="(?:[^"]* )?{name}(?: [^"]*)?"[^>]*>(.*?)</'


def labelled_pairs(html: Column) -> Column:
    """Structs (label, value) of a page's stats items, in page order."""
    html = F.coalesce(html, F.lit(""))
    pattern = _class("stats_label") + r".*?" + _class("stats_value").removeprefix("(?s)")
    labels, values = (F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(i)), _text) for i in (1, 2))
    return F.filter(F.arrays_zip(labels.alias("label"), values.alias("value")), lambda p: p["label"] != "")


def company_overview(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(*, symbol, name, sector, price, pe_ratio, market_cap, shares, free_float, free_float_pct) of company pages.

    The price-earnings ratio is looked for in the regular panel of the quote, the equity figures in
    the equity section; a free float with a percent sign is the share, another one the count. What
    a page lacks is null; so is all of a null page.
    """
    html = F.col(html_col)
    part = lambda pattern: F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1)
    quote, equity = part(r'(?s)\bid="quote"(.*?)(?:\sid="|\z)'), part(r'(?s)\bid="equity"(.*?)(?:\sid="|\z)')
    regular = F.regexp_extract(quote, r'(?s)data-name="REG"(.*?)(?:data-name="|\z)', 1)
    quoted, held = labelled_pairs(F.when(regular != "", regular).otherwise(quote)), labelled_pairs(equity)

    def of(pairs: Column, test, last: bool = True) -> Column:
        met = F.filter(pairs, lambda p: test(F.lower(p["label"]), p["value"]))
        return money(F.try_element_at(met, F.lit(-1 if last else 1))["value"])

    float_ = lambda percent: of(held, lambda k, v: k.contains("free float") & (v.contains("%") == F.lit(percent)))
    return pages.withColumns(
        {
            "symbol": _found(html, _class("pageHeader__title")),
            "name": _found(html, _class("quote__name")),
            "sector": _found(html, _class("quote__sector")),
            "price": money(_found(html, _class("quote__close"))),
            "pe_ratio": of(quoted, lambda k, v: k.contains("p/e"), last=False),
            "market_cap": of(held, lambda k, v: k.contains("market cap")),
            "shares": of(held, lambda k, v: k == "shares"),
            "free_float": float_(False),
            "free_float_pct": float_(True),
        }
    )


def year_tables(cells: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, table, year, label, value) of tables whose columns are years, from cells as `table_cells` gives them.

    A column's year is the first 19xx or 20xx of its header, else the header itself. Rows without a
    label go; of a label that a table repeats the last row stays.
    """
    year = F.nullif(F.regexp_extract("header", "((?:19|20)[0-9]{2})", 1), F.lit(""))
    labels = cells.where("`column` = 0 AND trim(value) <> ''").select(id_col, "table", "row", F.trim("value").alias("label"))
    values = cells.where("`column` > 0").select(id_col, "table", "row", F.coalesce(year, F.trim("header")).alias("year"), money(F.col("value")).alias("value"))
    met = values.join(labels, [id_col, "table", "row"])
    return met.groupBy(id_col, "table", "year", "label").agg(F.max_by("value", "row").alias("value"))


def market_summary(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(*, stamp, exchange, breadth, indices) of market pages.

    stamp: the first date with a time. exchange, breadth: maps of the labels of the strips named
    Exchange and Symbol to their texts, null without such a strip; of a repeated label the last one stays.
    indices: structs (name, value, change, change_pct) in page order.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))

    def strip(name: str) -> Column:
        body = F.regexp_extract(html, rf'(?is)class="(?:[^"]* )?td-fst(?: [^"]*)?"[^>]*>\s*(?:<[^>]*>\s*)*{name}\b(.*?)(?:td-fst|indices-single|\z)', 1)
        pattern = F.lit(r"(?s)<p\b[^>]*>\s*<span\b[^>]*>(.*?)</span>(.*?)</p>")
        keys = F.transform(F.regexp_extract_all(body, pattern, F.lit(1)), lambda k: F.lower(F.rtrim(_text(k), F.lit(":"))))
        values = F.transform(F.regexp_extract_all(body, pattern, F.lit(2)), lambda v: F.nullif(_text(v), F.lit("")))
        pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
        later = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])
        last = F.filter(pairs, later)
        return F.when(F.size(last) > 0, F.map_from_entries(last))

    name_of = lambda b: _text(F.regexp_extract(b, r"(?s)<h3\b[^>]*>(.*?)</h3>", 1))
    boards = F.filter(F.split(html, r'class="(?:[^"]* )?indices-single(?: [^"]*)?"'), lambda b, i: (i > 0) & (name_of(b) != ""))
    held = lambda b, tag: F.regexp_extract(b, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    percent = lambda b: F.regexp_replace(_text(held(b, "h6")), r"^[()% ]+|[()% ]+$", "")
    index = lambda b: F.struct(name_of(b).alias("name"), money(_text(held(b, "h4"))).alias("value"), money(_text(held(b, "h5"))).alias("change"), money(percent(b)).alias("change_pct"))
    stamp = F.nullif(F.regexp_extract(html, r"([0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})", 1), F.lit(""))
    return pages.withColumns({"stamp": stamp, "exchange": strip("exchange"), "breadth": strip("symbol"), "indices": F.transform(boards, index)})


def keyword_scores(text: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """A score for each type, in the order of the list: 1 where a keyword occurs, else RESEMBLED x the best partial ratio."""

    def one(low: str) -> list[float]:
        return [1.0 if any(k in low for k in known) else max((RESEMBLED * partial_of(k, low) / 100 for k in known), default=0.0) for known in keywords.values()]

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map({t: one(t) for t in texts.unique()})

    return scores(F.lower(F.coalesce(text, F.lit(""))))


def table_types(tables: DataFrame, keywords: dict[str, tuple[str, ...]], accept: float = 0.60, margin: float = 0.08, boost: float = 0.10) -> DataFrame:
    """(*, type, score, runner_up) of tables (text, hint, cosines).

    A type's score is the mean of its keywords' and of its cosine in the map cosines, or the
    former alone where that map is null; negative cosines count as 0, as do missing ones. The
    hinted type gains `boost`, up to 1. The best type stands if it reaches `accept` and leads by
    `margin`, else the table is "unclassified"; of equal scores the first type listed leads. The
    score is the best one in either case. Texts that repeat in a batch are compared once.
    """
    kinds = list(keywords)

    def score(i: int, kind: str) -> Column:
        own = F.col("_scores")[i]
        both = F.when(F.col("cosines").isNull(), own).otherwise((own + F.greatest(F.coalesce(F.col("cosines")[kind], F.lit(0.0)), F.lit(0.0))) / 2)
        return F.when(F.coalesce(F.col("hint") == kind, F.lit(False)), F.least(both + boost, F.lit(1.0))).otherwise(both)

    ranked = F.sort_array(F.array(*(F.struct((-score(i, k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("type")) for i, k in enumerate(kinds))))
    scored = tables.withColumn("_scores", keyword_scores(F.col("text"), keywords)).withColumn("_ranked", ranked)
    best, second = -F.col("_ranked")[0]["s"], -F.coalesce(F.try_element_at("_ranked", F.lit(2))["s"], F.lit(0.0))
    kind = F.when((best >= accept) & (best - second >= margin), F.col("_ranked")[0]["type"]).otherwise("unclassified")
    return scored.withColumns({"type": kind, "score": best, "runner_up": second}).drop("_scores", "_ranked")


def _item(label: str, value: Column) -> Column:
    return F.concat(F.lit(f'<div class="stats_item"><div class="stats_label">{label}</div><div class="stats_value">'), value, F.lit("</div></div>"))


def _amount(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


@registry.add(
    "company_overview",
    """SELECT s_suppkey, 'S' || s_suppkey AS symbol, s_name AS name, n_name AS sector, round(s_acctbal, 2) AS price, CAST(s_suppkey AS DOUBLE) AS pe_ratio, CAST(s_suppkey * 1000 AS DOUBLE) AS market_cap, CAST(s_suppkey * 10 AS DOUBLE) AS shares, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey * 4 AS DOUBLE) END AS free_float, CAST(40 AS DOUBLE) AS free_float_pct
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def company_overview_query(spark, sf_dir):
    """Suppliers as company pages, one in three without the count of its free float, read back."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    head = F.concat(F.lit('<h1 class="pageHeader__title">S'), k, F.lit('</h1><p class="quote__name">'), F.col("s_name"), F.lit('</p><p class="quote__sector"><span>'), F.col("n_name"), F.lit('</span></p><p class="quote__close">Rs.'), _amount(F.col("s_acctbal")), F.lit("</p>"))
    quote = F.concat(F.lit('<div id="quote"><div data-name="FUT">'), _item("P/E Ratio", F.lit("1")), F.lit('</div><div data-name="REG">'), _item("P/E Ratio", k), F.lit("</div></div>"))
    count = F.when(F.col("s_suppkey") % 3 > 0, _item("Free Float", F.format_number(F.col("s_suppkey") * 4, 0))).otherwise("")
    equity = F.concat(F.lit('<div id="equity">'), _item("Market Cap (000)", F.format_number(F.col("s_suppkey") * 1000, 0)), _item("Shares", F.format_number(F.col("s_suppkey") * 10, 0)), count, _item("Free Float", F.lit("40.00%")), F.lit("</div>"))
    return company_overview(s.select("s_suppkey", F.concat(head, quote, equity).alias("html"))).drop("html")


@registry.add("year_tables", "SELECT c_custkey, unnest(['1997', '1998']) AS year, unnest([round(c_acctbal, 2), CAST(c_custkey AS DOUBLE)]) AS value, 'Sales' AS label FROM customer")
def year_tables_query(spark, sf_dir):
    """Customers as pages with a table of two years, read back."""
    c = read(spark, sf_dir, "customer")
    html = F.concat(F.lit("<table><tr><th>Item<th>FY 1997<th>1998 (A)</tr><tr><td>Sales</td><td>"), _amount(F.col("c_acctbal")), F.lit("</td><td>"), F.format_number("c_custkey", 0), F.lit("</td></tr></table>"))
    return year_tables(table_cells(c.select("c_custkey", html.alias("html")), "c_custkey"), "c_custkey").select("c_custkey", "year", "label", "value")


@registry.add(
    "market_summary",
    """SELECT n_nationkey, '1998-01-02 10:20:30' AS stamp, CAST(count(*) AS VARCHAR) AS volume, 'Open' AS status, CAST(sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS VARCHAR) AS advanced, n_name AS name, CAST(count(*) AS DOUBLE) AS value, CAST(-n_nationkey - 1 AS DOUBLE) AS change, CAST(1.5 AS DOUBLE) AS change_pct
       FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name""",
)
def market_summary_query(spark, sf_dir):
    """Suppliers of each nation counted as a market page, read back."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = s.groupBy("n_nationkey", "n_name").agg(F.count("*").cast("string").alias("n"), F.sum((F.col("s_acctbal") > 0).cast("int")).cast("string").alias("up"))
    exchange = F.concat(F.lit('<b>1998-01-02 10:20:30</b><table class="ms-tbl-new"><tr><td class="td-fst">Exchange</td><td><p><span>Status:</span> Open</p><p><span>Volume:</span> '), F.col("n"), F.lit("</p></td></tr></table>"))
    breadth = F.concat(F.lit('<table class="ms-tbl-new"><tr><td class="td-fst">Symbol</td><td><p><span>Advanced:</span> '), F.col("up"), F.lit("</p></td></tr></table>"))
    board = F.concat(F.lit('<div class="indices-single"><h3>'), F.col("n_name"), F.lit("</h3><h4>"), F.col("n"), F.lit("</h4><h5>-"), (F.col("n_nationkey") + 1).cast("string"), F.lit("</h5><h6>(1.5%)</h6></div>"))
    read_back = market_summary(n.select("n_nationkey", F.concat(exchange, breadth, board).alias("html")))
    return read_back.select("n_nationkey", "stamp", F.col("exchange")["volume"].alias("volume"), F.col("exchange")["status"].alias("status"), F.col("breadth")["advanced"].alias("advanced"), F.inline("indices"))


@registry.add("table_types")
def table_types_query(spark, sf_dir):
    """Part names as the texts of tables, words of names as keywords, the part's type as a hint."""
    parts = read(spark, sf_dir, "part")
    known = {"SMALL": ("small ring", "small bolt", "small gear"), "LARGE": ("large", "big"), "ECONOMY": ("red widget", "blue widget"), "PROMO": ("hot", "cold")}
    none = F.lit(None).cast("map<string,double>")
    return table_types(parts.select("p_partkey", F.col("p_name").alias("text"), F.col("p_type").alias("hint"), none.alias("cosines")), known).select("p_partkey", "type", "score", "runner_up")
