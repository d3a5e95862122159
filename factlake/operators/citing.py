"""Where shown figures come from, and yearly sheets of companies under their sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import OBS_SQL, observations, read

registry = Registry()

#: Columns of a yearly sheet by their headers; all but the first three are numbers.
YEARLY = {
    "symbol": "symbol", "name of company": "name", "year end": "year_end",
    "paid up capital": "paid_up_capital", "face value": "face_value", "number of shares": "shares_m", "shareholders equity": "equity", "total assets": "total_assets",
    "sales / total income": "sales", "sales total income": "sales", "financial charges": "financial_charges", "profit before taxation": "pbt", "taxation": "taxation", "profit after taxation": "pat",
    "cash dividend": "cash_dividend_pct", "stock dividend": "stock_dividend_pct", "total dividend": "total_dividend_pct", "right issue": "right_issue_pct", "number of shareholders": "shareholders",
}


def resolve_citations(facts: DataFrame, ledger: DataFrame, details: DataFrame) -> DataFrame:
    """(fact_id, basis, report_file, page, table_id, report_year, sheet, cell, rows, confidence, display) of facts.

    facts: (fact_id, entity, sheet, cell, label, level, metric, year, value). ledger: (entity, sheet,
    cell, matched_label, year, report_file, page, table_id, report_year, confidence). details:
    (metric, sheet), the note that a headline metric comes from. Rungs: the ledger's rows of the
    fact's own cell (direct, one citation a row); for a headline, those of its note and year, of its
    label if any has it, of the newest report alone, one for each file, page and table with the
    least confidence (via_detail); else the workbook's cell, if it has a value (workbook). A fact
    without a cell, or a cell without a value, has no citation.
    """
    rows = ledger.select("entity", F.col("sheet").alias("l_sheet"), F.col("cell").alias("l_cell"), T.normalize_label(F.col("matched_label")).alias("l_label"), F.col("year").alias("l_year"), "report_file", "page", "table_id", "report_year", F.col("confidence").cast("double").alias("confidence"))
    direct = facts.select("fact_id", "entity", F.col("sheet").alias("l_sheet"), F.col("cell").alias("l_cell")).join(rows, ["entity", "l_sheet", "l_cell"])
    direct = direct.select("fact_id", F.lit("direct").alias("basis"), "report_file", "page", "table_id", "report_year", F.col("l_sheet").alias("sheet"), F.col("l_cell").alias("cell"), F.lit(1).cast("long").alias("rows"), "confidence")
    rest = facts.join(direct.select("fact_id").distinct(), "fact_id", "left_anti")
    notes = rest.where("level = 'headline'").join(details.select("metric", F.col("sheet").alias("l_sheet")).distinct(), "metric")
    met = notes.select("fact_id", "entity", "l_sheet", F.col("year").alias("l_year"), T.normalize_label(F.col("label")).alias("label")).join(rows, ["entity", "l_sheet", "l_year"])
    met = met.withColumn("same", F.col("l_label") == F.col("label"))
    pick = met.groupBy("fact_id").agg(F.bool_or("same").alias("some_same"), F.max(F.when(F.col("same"), F.col("report_year"))).alias("newest_same"), F.max("report_year").alias("newest"))
    met = met.join(pick, "fact_id").where(~F.col("some_same") | F.col("same"))
    newest = F.when(F.col("some_same"), F.col("newest_same")).otherwise(F.col("newest"))
    met = met.where(newest.isNull() | (F.col("report_year") == newest))
    via = met.groupBy("fact_id", "report_file", "page", "table_id", "report_year", F.col("l_sheet").alias("sheet")).agg(F.when(F.count("*") == 1, F.min("l_cell")).alias("cell"), F.count("*").alias("rows"), F.min("confidence").alias("confidence"))
    via = via.select("fact_id", F.lit("via_detail").alias("basis"), "report_file", "page", "table_id", "report_year", "sheet", "cell", "rows", "confidence")
    book = rest.join(via.select("fact_id").distinct(), "fact_id", "left_anti").where("sheet IS NOT NULL AND cell IS NOT NULL AND value IS NOT NULL")
    null = lambda c, of: F.lit(None).cast(ledger.schema[of].dataType).alias(c)
    book = book.select("fact_id", F.lit("workbook").alias("basis"), null("report_file", "report_file"), null("page", "page"), null("table_id", "table_id"), null("report_year", "report_year"), "sheet", "cell", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("double").alias("confidence"))
    place = F.concat(F.coalesce("report_file", F.lit("workbook")), F.coalesce(F.concat(F.lit(", p"), F.col("page").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" (as reported FY"), F.col("report_year").cast("string"), F.lit(")")), F.lit("")))
    display = F.when(F.col("basis") == "workbook", F.concat(F.lit("workbook: "), "sheet", F.lit("!"), "cell")).otherwise(place)
    return direct.unionByName(via).unionByName(book).withColumn("display", display)


def _header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("'"), F.lit("")), r"\s+", " "))


def yearly_companies(cells: DataFrame) -> DataFrame:
    """(file, row, fiscal_year, sector, symbol, name, year_end, *numbers) of yearly sheets as cells (file, row, col, text).

    The fiscal year stands in a banner of the first three rows; the first of the first 15 rows with
    the headers Symbol and Name of Company names the columns, the one that begins with Sr the serial
    number. A row with serial number and symbol is a company; one without a serial number but with a
    name is the sector of the rows below it. Numbers are read without thousands separators, others
    are null. Files without such a header have no rows; rows count from 0.
    """
    c = cells.where("file IS NOT NULL AND trim(coalesce(text, '')) <> ''").select("file", "row", "col", F.trim("text").alias("text"))
    banner = c.where("row < 3").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "text"))), lambda x: x["text"]), " ").alias("b"))  # cells of three rows
    year = F.regexp_extract("b", r"(?i)DATA FOR THE YEAR\s+([0-9]{4})", 1)
    banner = banner.select("file", F.when(year != "", year.cast("int")).alias("fiscal_year"))
    heads = c.where("row < 15").withColumn("head", _header(F.col("text")))
    at = heads.groupBy("file", "row").agg(F.bool_or(F.col("head") == "symbol").alias("s"), F.bool_or(F.col("head") == "name of company").alias("n")).where("s AND n").groupBy("file").agg(F.min("row").alias("header"))
    named = F.create_map(*(F.lit(x) for pair in YEARLY.items() for x in pair))
    field = F.when(F.col("head").startswith("sr"), "serial").otherwise(F.try_element_at(named, F.col("head")))
    columns = heads.join(at, "file").where("row = header").select("file", "header", "col", field.alias("field")).where("field IS NOT NULL")
    columns = columns.withColumn("first", F.row_number().over(W.partitionBy("file", "field").orderBy("col"))).where("first = 1 OR field <> 'serial'").drop("first")
    columns = columns.groupBy("file", "header", "field").agg(F.max("col").alias("col"))  # of repeated headers the last
    names = ["serial", *dict.fromkeys(YEARLY.values())]
    wide = c.join(columns, ["file", "col"]).where("row > header").groupBy("file", "row").pivot("field", names).agg(F.first("text"))
    carried = F.last(F.when(F.col("serial").isNull(), F.col("name")), ignorenulls=True).over(W.partitionBy("file").orderBy("row"))
    rows = wide.withColumn("sector", carried).where("serial IS NOT NULL AND symbol IS NOT NULL").join(banner, "file", "left")
    number = lambda n: F.replace(F.col(n), F.lit(","), F.lit("")).try_cast("double").alias(n)
    return rows.select("file", "row", "fiscal_year", "sector", "symbol", "name", "year_end", *(number(n) for n in names if n not in ("serial", "symbol", "name", "year_end")))


@registry.add(
    "fact_citations",
    f"""WITH {OBS_SQL}, f AS (SELECT entity || '|' || metric || '|' || value_year AS fact_id, entity, metric, value_year AS year, arg_max(value, report_year) AS value, length(metric) % 3 AS k FROM obs GROUP BY ALL),
    l AS (SELECT entity, metric, value_year AS year, report_year, length(metric) % 3 AS k, 'note ' || length(metric) % 4 AS sheet FROM obs WHERE length(metric) % 3 < 2),
    d AS (SELECT f.fact_id, 'direct' AS basis, l.report_year, l.sheet, CAST(1 AS BIGINT) AS "rows", 0.9::DOUBLE AS confidence FROM f JOIN l ON f.k = 0 AND l.k = 0 AND l.entity = f.entity AND l.metric = f.metric AND l.year = f.year),
    m AS (SELECT f.fact_id, l.report_year, l.sheet, l.metric = f.metric AS same FROM f JOIN l ON f.k = 1 AND l.entity = f.entity AND l.year = f.year AND l.sheet = 'note ' || length(f.metric) % 4),
    b AS (SELECT *, bool_or(same) OVER (PARTITION BY fact_id) AS any_same FROM m), s AS (SELECT * FROM b WHERE same OR NOT any_same QUALIFY report_year = max(report_year) OVER (PARTITION BY fact_id)),
    v AS (SELECT fact_id, 'via_detail' AS basis, report_year, sheet, count(*) AS "rows", 0.8::DOUBLE AS confidence FROM s GROUP BY ALL)
    SELECT * FROM d UNION ALL SELECT * FROM v UNION ALL SELECT fact_id, 'workbook', NULL, 'sheet ' || metric, 0, NULL FROM f WHERE fact_id NOT IN (SELECT fact_id FROM d) AND fact_id NOT IN (SELECT fact_id FROM v)""",
)
def fact_citations(spark, sf_dir):
    """Facts by their metrics: a third stands in the ledger itself, a third comes from notes, the rest from the workbook."""
    o, k = observations(spark, sf_dir), F.length("metric") % 3
    note, cell = F.concat(F.lit("note "), (F.length("metric") % 4).cast("string")), F.concat_ws("!", "metric", "value_year")
    f = o.groupBy("entity", "metric", "value_year").agg(F.max_by("value", "report_year").alias("value"))
    shown = f.select(F.concat_ws("|", "entity", "metric", "value_year").alias("fact_id"), "entity", F.when(k == 0, note).otherwise(F.concat(F.lit("sheet "), "metric")).alias("sheet"), cell.alias("cell"), F.replace("metric", F.lit("_"), F.lit(" ")).alias("label"), F.when(k == 1, "headline").otherwise("detail").alias("level"), "metric", F.col("value_year").alias("year"), "value")
    ledger = o.where(k < 2).select("entity", note.alias("sheet"), cell.alias("cell"), F.replace("metric", F.lit("_"), F.lit(" ")).alias("matched_label"), F.col("value_year").alias("year"), F.concat(F.lit("r"), "report_year").alias("report_file"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("table_id"), "report_year", F.when(k == 0, 0.9).otherwise(0.8).alias("confidence"))
    details = f.select("metric", note.alias("sheet")).distinct()
    out = resolve_citations(shown, ledger, details)
    return out.select("fact_id", "basis", "report_year", "sheet", "rows", F.when(F.col("basis") == "via_detail", F.lit(0.8)).otherwise(F.col("confidence")).alias("confidence"))


@registry.add(
    "yearly_sheet_companies",
    """SELECT 'region ' || n_regionkey AS file, CAST(1990 + n_regionkey AS INT) AS fiscal_year, n_name AS sector, 'S' || s_suppkey AS symbol, s_name AS name, round(s_acctbal, 2) AS total_assets, CAST(NULL AS DOUBLE) AS sales FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def yearly_sheet_companies(spark, sf_dir):
    """Suppliers printed as a sheet for each region, under their nations as sectors."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    file = F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("file")
    base = F.col("n_nationkey") * 1_000_000 + 10
    cell = lambda row, col, text: F.struct(row.cast("long").alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"))
    head = lambda row, *texts: [cell(F.lit(row), c, F.lit(t)) for c, t in enumerate(texts) if t]
    company = F.array(cell(base + 1 + F.col("s_suppkey"), 0, F.col("s_suppkey")), cell(base + 1 + F.col("s_suppkey"), 1, F.concat(F.lit("S"), F.col("s_suppkey"))), cell(base + 1 + F.col("s_suppkey"), 2, F.col("s_name")), cell(base + 1 + F.col("s_suppkey"), 3, F.format_number("s_acctbal", 2)), cell(base + 1 + F.col("s_suppkey"), 4, F.lit("n.a.")))
    top = F.array(cell(F.lit(1), 0, F.concat(F.lit("Data for the year "), (F.col("n_regionkey") + 1990).cast("string"))), *head(4, "Sr. No.", "Symbol", "Name of  Company", "Total Assets", "Sales / Total Income", "other"), cell(base, 2, F.col("n_name")))
    cells = s.select(file, F.explode(company).alias("c")).unionByName(s.select(file, F.explode(top).alias("c")).distinct()).select("file", "c.*")
    return yearly_companies(cells).select("file", "fiscal_year", "sector", "symbol", "name", F.round("total_assets", 2).alias("total_assets"), "sales")
