"""Sheets, pages and ledgers as they come in: texts, titles, bands, lines, split lines.

Each operator takes DataFrames; the queries below apply them to rows of the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import FACTS_SQL, METRICS, OBS_SQL, facts, observations, read
from .tables import _CELLS_SQL, cells

registry = Registry()

#: What titles say of a sheet, in the order in which they are tried.
FAMILIES = (
    ("cf", r"cash\s*flow|statement of cas|cashflow"),
    ("pl", r"profit or loss|profit and loss|income statement|statement of pro|\bp&l\b|profit/?\(loss\)"),
    ("bs", r"financial position|balance sheet|statement of fin"),
    ("equity", r"changes in equity|statement of cha"),
)
#: Titles of main statements, and how a title tells of its reporting basis.
MAIN_STATEMENT = r"statement of|balance sheet|income statement|\bp&l\b|six years|financial highlights"
UNCONSOLIDATED = r"\b(?:un\s*-?\s*consolidated|stand[\s-]?alone|separate|parent\s+company|company\s+financial\s+statements)\b"
CONSOLIDATED = r"\b(?:consolidated|group\s+(?:financial\s+statements|accounts))\b"
LEGAL_SUFFIXES = ("Limited", "Ltd", "PLC", "Corporation", "Company")


def page_text(pages: DataFrame, least: int = 40) -> DataFrame:
    """(*, text, kind) from native and ocr: OCR text if it is longer, both stripped; native text that was too short and kept is empty."""
    native, ocr = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("native", "ocr"))
    longer = F.length(ocr) > F.length(native)
    tried = F.col("ocr").isNotNull() & (F.length(native) < least)
    return pages.withColumns({"text": F.when(tried & longer, F.col("ocr")).otherwise(F.col("native")), "kind": F.when(tried & longer, "ocr").when(tried, "empty").otherwise("native")})


@registry.add(
    "page_text",
    """WITH p AS (SELECT conv_id, turn, role, text AS native, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ocr FROM conversations),
    t AS (SELECT *, ocr IS NOT NULL AND length(trim(coalesce(native, ''))) < 40 AS tried, length(trim(coalesce(ocr, ''))) > length(trim(coalesce(native, ''))) AS longer FROM p)
    SELECT conv_id, turn, role, CASE WHEN tried AND longer THEN ocr ELSE native END AS text, CASE WHEN tried AND longer THEN 'ocr' WHEN tried THEN 'empty' ELSE 'native' END AS kind FROM t""",
)
def page_text_query(spark, sf_dir):
    """Turns as native text, the turn that follows as what OCR gave."""
    c = read(spark, sf_dir, "conversations")
    pages = c.select("conv_id", "turn", "role", F.col("text").alias("native"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("ocr"))
    return page_text(pages).select("conv_id", "turn", "role", "text", "kind")


def document_company(pages: DataFrame, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> DataFrame:
    """(file, company) from (file, page, text): the capitalised phrase with a legal suffix that stands there most often.

    Ties go to the earliest page, then to the phrase; files without one get their cleaned name.
    """
    pattern = rf"(?:[A-Z][A-Za-z&.-]*[ \t]+){{1,5}}(?:{'|'.join(suffixes)})"
    found = pages.select("file", "page", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("phrase"))
    counts = found.groupBy("file", "phrase").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    best = counts.groupBy("file").agg(F.min_by("phrase", F.struct(-F.col("n"), "first", "phrase")).alias("phrase"))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\.pdf$", ""), r"[_-]+", " "), r"(19|20)[0-9]{2}", ""))
    return pages.select("file").distinct().join(best, "file", "left").select("file", F.coalesce("phrase", F.nullif(name, F.lit(""))).alias("company"))


@registry.add(
    "document_company",
    r"""WITH f AS (SELECT coalesce(source, 'none') || '_' || lang AS file, doc_id AS page, unnest(regexp_extract_all(text, '(?:[A-Z][A-Za-z&.-]*[ \t]+){1,5}(?:License|Foundation)')) AS phrase FROM documents),
    n AS (SELECT file, phrase, count(*) AS n, min(page) AS first FROM f GROUP BY ALL), b AS (SELECT file, phrase FROM n QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, first, phrase) = 1)
    SELECT d.file, coalesce(phrase, trim(regexp_replace(d.file, '[_-]+', ' ', 'g'))) AS company FROM (SELECT DISTINCT coalesce(source, 'none') || '_' || lang AS file FROM documents) d LEFT JOIN b USING (file)""",
)
def document_company_query(spark, sf_dir):
    """Documents of a source and language as the pages of a file."""
    d = read(spark, sf_dir, "documents").select(F.concat_ws("_", F.coalesce("source", F.lit("none")), "lang").alias("file"), F.col("doc_id").alias("page"), "text")
    return document_company(d, ("License", "Foundation"))


def sheet_classes(sheets: DataFrame) -> DataFrame:
    """(*, family, class, basis, note) from title: statement family, kind of sheet, reporting basis, note number."""
    t = F.trim(F.coalesce("title", F.lit("")))
    like = lambda pattern: t.rlike(f"(?i){pattern}")
    is_detail = like(r"^(?:PL|BS)[0-9]")
    family = F.when(is_detail, F.when(F.upper(t).startswith("BS"), "bs").otherwise("pl"))
    for name, pattern in FAMILIES:
        family = family.when(like(pattern), name)
    kind = F.when(t.rlike(r">{2,}|-{3,}"), "separator")
    for title, name in (("Source Ledger", "source_ledger"), ("Validation Ledger", "validation_ledger"), ("Insights", "insights"), ("Insights Review", "insights_review")):
        kind = kind.when(t == title, name)
    kind = kind.when(t.isin("Mgmt info.", "Qualtitative Data", "Qualitative Data"), "freetext").when(t.isin("P&L", "Balance Sheet"), "statement").when(is_detail, "detail")
    kind = kind.when(family.isNotNull() & like(MAIN_STATEMENT), "statement").otherwise("detail")
    basis = F.when(like(UNCONSOLIDATED), "unconsolidated").when(like(CONSOLIDATED), "consolidated").otherwise("unknown")
    note = F.nullif(F.regexp_extract(t, r"[0-9]+", 0), F.lit("")).cast("int")
    return sheets.withColumns({"family": family, "class": kind, "basis": basis, "note": note})


#: Titles of the query below, one for each nation in turn.
TITLES = (
    "Consolidated statement of cash flows", "Unconsolidated statement of profit or loss", "Balance Sheet", "P&L", "BS12 Stock in trade", "PL3 Cost of sales", "Notes >>>",
    "Source Ledger", "Insights", "Statement of changes in equity - company financial statements", "Note 14 receivables", "Six years financial highlights", "Stand-alone statement of financial position",
)


@registry.add(
    "sheet_classes",
    rf"""WITH s AS (SELECT n_nationkey, CASE WHEN n_nationkey >= {len(TITLES)} THEN n_name || ' ' ELSE '' END || list_extract({list(TITLES)}, n_nationkey % {len(TITLES)} + 1) AS title FROM nation),
    f AS (SELECT *, regexp_matches(title, '^(?:PL|BS)[0-9]', 'i') AS is_detail FROM s),
    g AS (SELECT *, CASE WHEN is_detail THEN CASE WHEN upper(title) LIKE 'BS%' THEN 'bs' ELSE 'pl' END {" ".join(f"WHEN regexp_matches(title, '{p}', 'i') THEN '{n}'" for n, p in FAMILIES)} END AS family FROM f)
    SELECT n_nationkey, title, family, CASE WHEN regexp_matches(title, '>{{2,}}|-{{3,}}') THEN 'separator' WHEN title = 'Source Ledger' THEN 'source_ledger' WHEN title = 'Insights' THEN 'insights'
      WHEN title IN ('P&L', 'Balance Sheet') THEN 'statement' WHEN is_detail THEN 'detail' WHEN family IS NOT NULL AND regexp_matches(title, '{MAIN_STATEMENT}', 'i') THEN 'statement' ELSE 'detail' END AS class,
      CASE WHEN regexp_matches(title, '{UNCONSOLIDATED}', 'i') THEN 'unconsolidated' WHEN regexp_matches(title, '{CONSOLIDATED}', 'i') THEN 'consolidated' ELSE 'unknown' END AS basis,
      CAST(nullif(regexp_extract(title, '[0-9]+'), '') AS INT) AS note FROM g""",
)
def sheet_classes_query(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    title = F.concat(F.when(F.col("n_nationkey") >= len(TITLES), F.concat("n_name", F.lit(" "))).otherwise(""), F.element_at(F.array(*map(F.lit, TITLES)), (F.col("n_nationkey") % len(TITLES) + 1).cast("int")))
    return sheet_classes(n.select("n_nationkey", title.alias("title")))


def period_bands(grid: DataFrame, columns: DataFrame) -> DataFrame:
    """(sheet, col_no, year, period): bands of the row above the header, carried to the right; historical before the first.

    grid: (sheet, row_no, col_no, cell); columns: (sheet, header_row, col_no, year).
    """
    rows = columns.select("sheet", "header_row").distinct()
    label = F.lower(F.trim("cell"))
    band = F.when(F.contains(label, F.lit("forecast")), "forecasted").when(F.contains(label, F.lit("histor")), "historical")
    bands = grid.join(rows, "sheet").where(F.col("row_no") == F.col("header_row") - 1).select("sheet", "col_no", band.alias("band"))
    both = columns.select("sheet", "col_no", "year").join(bands, ["sheet", "col_no"], "full")
    carried = F.last("band", ignorenulls=True).over(W.partitionBy("sheet").orderBy("col_no"))
    return both.withColumn("period", F.coalesce(carried, F.lit("historical"))).where("year IS NOT NULL").select("sheet", "col_no", "year", "period")


@registry.add(
    "period_bands",
    f"""WITH {_CELLS_SQL} SELECT sheet, col_no, CAST(cell AS INT) AS year, CASE WHEN CAST(cell AS INT) >= 1997 THEN 'forecasted' ELSE 'historical' END AS period FROM cells WHERE row_no = 3""",
)
def period_bands_query(spark, sf_dir):
    """Sheets of facts with a band from 1997 on."""
    grid = cells(spark, sf_dir)
    columns = grid.where("row_no = 3").select("sheet", F.col("row_no").alias("header_row"), "col_no", F.col("cell").cast("int").alias("year"))
    bands = columns.groupBy("sheet").agg(F.min("col_no").alias("first"), F.min(F.when(F.col("year") >= 1997, F.col("col_no"))).alias("later"))
    place = lambda c, text: F.struct(F.col(c).alias("col_no"), F.lit(text).alias("cell"))
    bands = bands.select("sheet", F.lit(2).alias("row_no"), F.explode(F.array(place("first", "Historical"), place("later", "Forecast period"))).alias("b")).select("sheet", "row_no", "b.*").where("col_no IS NOT NULL")
    return period_bands(grid.unionByName(bands), columns)


def line_values(grid: DataFrame, tables: DataFrame, labels: DataFrame) -> DataFrame:
    """(sheet, section, label, metric, resolution, year, raw, value): the lines of raw grids.

    grid: (sheet, row_no, col_no, cell), row 0 the header, column 0 the label; tables: (sheet,
    statement, years), years known beside the header; labels: (key, metric, family) by
    normalised label. Year columns are those of the header, else the rightmost ones take the
    known years. A bare year of the header repeated as a value is dropped. A line without
    values is a section if it is in capitals or ends with a colon. A metric of another
    statement's family is given up.
    """
    of_sheet = W.partitionBy("sheet")
    rows = grid.groupBy("sheet", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "cell"))).alias("cells"), F.max("col_no").alias("last"))
    rows = rows.withColumns({"header": F.first(F.when(F.col("row_no") == 0, F.col("cells")), ignorenulls=True).over(of_sheet), "width": F.max("last").over(of_sheet)})
    rows = rows.join(tables, "sheet", "left").where("row_no > 0")
    at = lambda c: F.trim(F.coalesce(F.try_element_at(F.filter("cells", lambda x: x["col_no"] == c), F.lit(1))["cell"], F.lit("")))
    column = lambda c, y: F.struct(c.cast("int").alias("col_no"), y.cast("int").alias("year"))
    named = F.filter(F.transform("header", lambda x: column(x["col_no"], F.try_element_at(T.years(x["cell"]), F.lit(1)))), lambda x: x["year"].isNotNull())
    known = F.coalesce("years", F.array().cast("array<int>"))
    unnamed = F.transform(known, lambda y, k: column(F.col("width") - F.size(known) + 1 + k, y))
    rows = rows.withColumn("columns", F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(unnamed))
    is_header_year = lambda raw: raw.rlike("^(19|20)[0-9]{2}$") & F.exists("columns", lambda c: c["year"].cast("string") == raw)
    values = F.filter(F.transform("columns", lambda c: F.struct(c["year"].alias("year"), at(c["col_no"]).alias("raw"))), lambda v: (v["raw"] != "") & ~is_header_year(v["raw"]))
    rows = rows.select("sheet", "row_no", "statement", at(F.lit(0)).alias("label"), values.alias("values")).where("label <> ''")
    letters = F.regexp_replace("label", "[^A-Za-z]", "")
    capitals = (F.length(letters) > 0) & (F.length(F.regexp_replace(letters, "[^A-Z]", "")) >= 0.7 * F.length(letters))
    section = F.when((F.size("values") == 0) & (capitals | F.col("label").endswith(":")), F.trim(F.regexp_replace("label", ":+$", "")))
    lines = rows.withColumn("section", F.last(section, ignorenulls=True).over(of_sheet.orderBy("row_no"))).where(F.size("values") > 0)
    lines = lines.withColumn("key", T.normalize_label(F.col("label"))).join(labels, "key", "left")
    alien = F.coalesce(F.col("family") != F.col("statement"), F.lit(False))
    lines = lines.withColumns({"resolution": F.when(F.col("metric").isNotNull() & alien, "no_confident_metric"), "metric": F.when(~alien, F.col("metric"))})
    out = lines.select("sheet", "section", "label", "metric", "resolution", F.explode("values").alias("v"))
    return out.select("sheet", "section", "label", "metric", "resolution", "v.year", "v.raw", T.parse_money(F.col("v.raw")).alias("value"))


@registry.add(
    "line_values",
    f"""WITH {_CELLS_SQL}, v AS (SELECT c.sheet, l.cell AS label, CAST(h.cell AS INT) AS year, c.cell AS raw FROM cells c JOIN cells l ON l.sheet = c.sheet AND l.row_no = c.row_no AND l.col_no = 1 JOIN cells h ON h.sheet = c.sheet AND h.row_no = 3 AND h.col_no = c.col_no
      WHERE c.row_no > 4 AND c.col_no > 1)
    SELECT sheet, 'PROFIT AND LOSS' AS section, replace(label, '_', ' ') AS label, CASE WHEN sheet < 'NATION_2' AND label <> 'pat' THEN label END AS metric, CASE WHEN sheet >= 'NATION_2' AND label <> 'pat' THEN 'no_confident_metric' END AS resolution, year, raw, CAST(raw AS DOUBLE) AS value FROM v""",
)
def line_values_query(spark, sf_dir):
    """Sheets of facts as raw grids; those of later entities call themselves balance sheets."""
    raw = cells(spark, sf_dir).where("row_no >= 3")
    grid = raw.select("sheet", (F.col("row_no") - 3).alias("row_no"), (F.col("col_no") - 1).alias("col_no"), F.when(F.col("col_no") == 1, F.replace("cell", F.lit("_"), F.lit(" "))).otherwise(F.col("cell")).alias("cell"))
    tables = grid.select("sheet").distinct().select("sheet", F.when(F.col("sheet") < "NATION_2", "pl").otherwise("bs").alias("statement"), F.array().cast("array<int>").alias("years"))
    labels = spark.createDataFrame([(m.replace("_", " "), m, "pl") for m in METRICS if m != "pat"], "key string, metric string, family string")
    return line_values(grid, tables, labels)


def folded_lines(lines: DataFrame) -> DataFrame:
    """(company, label, year, report_year, value, folded): lines of the same squashed label that reports split by section.

    lines: (company, label, section, metric, year, report_year, value). Lines fold if none has
    a metric and no year of one report has values that differ; the newest report counts. The
    longest label names them, ties by label.
    """
    keyed = lines.withColumn("key", T.squash(F.coalesce("label", F.lit(""))))
    within = keyed.where("value IS NOT NULL").groupBy("company", "key", "year", "report_year").agg(F.max(F.abs("value")).alias("most"), F.min(F.abs("value")).alias("least"))
    clash = within.groupBy("company", "key").agg(F.bool_or(F.col("most") - F.col("least") > F.greatest(F.lit(1.0), 0.005 * F.col("most"))).alias("clash"))
    members = keyed.groupBy("company", "key").agg(F.countDistinct("label", F.coalesce("section", F.lit(""))).alias("n"), F.count("metric").alias("metrics"), F.max_by("label", F.struct(F.length("label"), "label")).alias("name"))
    folds = members.join(clash, ["company", "key"], "left").select("company", "key", "name", ((F.col("key") != "") & (F.col("n") > 1) & (F.col("metrics") == 0) & ~F.coalesce("clash", F.lit(False))).alias("folded"))
    both = keyed.join(folds, ["company", "key"])
    newest = both.where("folded AND value IS NOT NULL AND year IS NOT NULL").groupBy("company", F.col("name").alias("label"), "year").agg(F.max(F.struct("report_year", "value")).alias("x")).select("company", "label", "year", "x.*", F.lit(True).alias("folded"))
    return newest.unionByName(both.where("NOT folded").select("company", "label", "year", "report_year", "value", "folded"))


_SPLIT_SQL = f"""{OBS_SQL}, s AS (SELECT CASE WHEN n_regionkey <= 2 THEN entity ELSE r_name END AS company, CASE WHEN report_year % 2 = 0 THEN replace(metric, '_', ' ') ELSE metric END AS label, CAST(report_year AS VARCHAR) AS section,
  CASE WHEN metric = 'revenue' THEN metric END AS metric, value_year AS year, report_year, value FROM obs JOIN nation ON n_name = entity JOIN region ON r_regionkey = n_regionkey WHERE metric IN ('revenue', 'cost_of_sales', 'finance_cost', 'taxation'))"""


@registry.add(
    "folded_lines",
    f"""WITH {_SPLIT_SQL}, k AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS key FROM s),
    w AS (SELECT company, key, max(abs(value)) - min(abs(value)) > greatest(1.0, 0.005 * max(abs(value))) AS clash FROM k GROUP BY company, key, year, report_year),
    c AS (SELECT company, key, bool_or(clash) AS clash FROM w GROUP BY ALL),
    m AS (SELECT company, key, count(DISTINCT label || '|' || section) > 1 AND count(metric) = 0 AS can, arg_max(label, (length(label), label)) AS name FROM k GROUP BY ALL),
    f AS (SELECT k.*, m.name, m.can AND NOT c.clash AS folded FROM k JOIN m USING (company, key) JOIN c USING (company, key))
    SELECT company, name AS label, year, max(report_year) AS report_year, arg_max(value, report_year) AS value, true AS folded FROM f WHERE folded GROUP BY company, name, year
    UNION ALL SELECT company, label, year, report_year, value, folded FROM f WHERE NOT folded""",
)
def folded_lines_query(spark, sf_dir):
    """Costs whose label and section drift from report to report; of some regions the nations' lines coexist."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), "n_regionkey", "r_name")
    obs = observations(spark, sf_dir, ["revenue", "cost_of_sales", "finance_cost", "taxation"]).join(n, "entity")
    label = F.when(F.col("report_year") % 2 == 0, F.replace("metric", F.lit("_"), F.lit(" "))).otherwise(F.col("metric"))
    company = F.when(F.col("n_regionkey") <= 2, F.col("entity")).otherwise(F.col("r_name"))
    return folded_lines(obs.select(company.alias("company"), label.alias("label"), F.col("report_year").cast("string").alias("section"), F.when(F.col("metric") == "revenue", F.col("metric")).alias("metric"), F.col("value_year").alias("year"), "report_year", "value"))


def total_components(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(sheet, total_row, component_row) of totals whose declared components are all found, two different rows at least.

    rows: (sheet, row_no, label); totals: (sheet, total_row, components). A component is the
    nearest row above with its label, else the nearest one.
    """
    asked = totals.select("sheet", "total_row", F.size(F.array_distinct("components")).alias("asked"), F.explode(F.array_distinct("components")).alias("component"))
    met = asked.join(rows, (asked["sheet"] == rows["sheet"]) & (T.normalize_label(F.col("component")) == T.normalize_label(rows["label"]))).where(F.col("row_no") != F.col("total_row")).select(asked["sheet"], "total_row", "asked", "component", "row_no")
    order = F.struct((F.col("row_no") > F.col("total_row")).alias("below"), F.abs(F.col("row_no") - F.col("total_row")).alias("far"), "row_no")
    near = met.groupBy("sheet", "total_row", "asked", "component").agg(F.min_by("row_no", order).alias("component_row"))
    whole = near.groupBy("sheet", "total_row", "asked").agg(F.count("*").alias("found"), F.sort_array(F.collect_set("component_row")).alias("rows"))
    return whole.where((F.col("found") == F.col("asked")) & (F.size("rows") >= 2)).select("sheet", "total_row", F.explode("rows").alias("component_row"))


@registry.add(
    "total_components",
    f"""WITH {_CELLS_SQL}, r AS (SELECT sheet, row_no, cell FROM cells WHERE col_no = 1 AND row_no > 4), t AS (SELECT sheet, row_no FROM r WHERE cell IN ('gross_profit', 'pat'))
    SELECT t.sheet, t.row_no AS total_row, r.row_no AS component_row FROM t JOIN r ON r.sheet = t.sheet AND r.cell IN ('revenue', 'cost_of_sales') WHERE (SELECT count(*) FROM r q WHERE q.sheet = t.sheet AND q.cell IN ('revenue', 'cost_of_sales')) = 2""",
)
def total_components_query(spark, sf_dir):
    rows = cells(spark, sf_dir).where("col_no = 1 AND row_no > 4").select("sheet", "row_no", F.col("cell").alias("label"))
    totals = rows.where("label IN ('gross_profit', 'pat')").select("sheet", F.col("row_no").alias("total_row"), F.array(F.lit("Revenue"), F.lit("cost of_sales")).alias("components"))
    return total_components(rows.withColumn("label", F.replace("label", F.lit("_"), F.lit(" "))), totals.withColumn("components", F.array(F.lit("Revenue"), F.lit("Cost of sales"))))


def candidate_pages(pages: DataFrame, sections: DataFrame, signals: tuple[str, ...], least_amounts: int = 6, dense_digits: int = 120, skip_consolidated: bool = True) -> DataFrame:
    """Pages (doc, page, text, consolidated) from the first section's page on that look financial.

    sections: (doc, start_page). Consolidated pages go unless they hold a primary total.
    """
    start = sections.groupBy("doc").agg(F.min("start_page").alias("start"))
    text = F.coalesce("text", F.lit(""))
    signal = F.lower(text).rlike("|".join(signals))
    amounts = F.regexp_count(text, F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+")) >= least_amounts
    digits = F.length(F.regexp_replace(text, "[^0-9]", "")) >= dense_digits
    primary = F.lower(text).rlike(r"profit for the year|total assets|total equity (?:and|&) liabilities|profit before tax|net cash (?:generated|used)")
    kept = pages.join(start, "doc", "left").where(F.col("page") >= F.coalesce("start", F.lit(1)))
    skipped = F.lit(skip_consolidated) & F.coalesce("consolidated", F.lit(False)) & ~primary
    return kept.where(signal & (amounts | digits) & ~skipped).drop("start")


@registry.add(
    "candidate_pages",
    r"""SELECT source AS doc, doc_id AS page FROM documents d WHERE source IS NOT NULL AND doc_id >= (SELECT min(doc_id) FROM documents s WHERE s.source = d.source AND s.n_chars > 500)
    AND regexp_matches(lower(coalesce(text, '')), 'license|the|der') AND (len(regexp_extract_all(coalesce(text, ''), '[0-9]{1,3}(?:,[0-9]{3})+')) >= 2 OR length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) >= 20)
    AND NOT (lang = 'de' AND NOT regexp_matches(lower(coalesce(text, '')), 'profit for the year|total assets|total equity (?:and|&) liabilities|profit before tax|net cash (?:generated|used)'))""",
)
def candidate_pages_query(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("source IS NOT NULL")
    pages = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text", (F.col("lang") == "de").alias("consolidated"))
    sections = d.where("n_chars > 500").select(F.col("source").alias("doc"), F.col("doc_id").alias("start_page"))
    return candidate_pages(pages.join(sections.select("doc").distinct(), "doc", "left_semi"), sections, ("license", "the", "der"), 2, 20).select("doc", "page")


#: Words that a task of value_columns has on average.
TASK_WORDS = 500_000


def value_columns(words: DataFrame, gap: float = 25.0, counted: DataFrame | None = None) -> DataFrame:
    """(page, word, column, right) of numeric words (page, word, top, x1): columns chained by right edges.

    A new column begins after a gap; columns with fewer words than two or a tenth of the
    page's rows are dropped unless all are, and each word goes to the nearest one left.
    counted: (page, n_rows); without it each top is a row. Words are shuffled by page into parts
    of TASK_WORDS on average, however many there are, so a task's sorts don't grow with the input.
    """
    at_least = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = words.repartition(max(at_least, -(-words.count() // TASK_WORDS)), "page")
    w = W.partitionBy("page").orderBy("x1", "word")
    begins = F.when(F.col("x1") - F.lag("x1").over(w) <= gap, 0).otherwise(1)
    chained = words.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(w))
    counted = words.groupBy("page").agg(F.countDistinct("top").alias("n_rows")) if counted is None else counted
    rows = counted.select("page", F.greatest(F.lit(2), F.floor(F.col("n_rows") * 0.1)).alias("need"))
    columns = chained.groupBy("page", "chain").agg(F.count("*").alias("n"), F.round(F.avg("x1"), 6).alias("right")).join(rows, "page")
    kept = columns.withColumn("most", F.max("n").over(W.partitionBy("page"))).where((F.col("n") >= F.col("need")) | (F.col("most") < F.col("need")))
    kept = kept.withColumn("column", F.row_number().over(W.partitionBy("page").orderBy("right"))).select("page", "column", "right")
    near = words.join(kept, "page").groupBy("page", "word").agg(F.min(F.struct(F.abs(F.col("x1") - F.col("right")).alias("far"), "column", "right")).alias("x"))
    return near.select("page", "word", "x.column", "x.right")


_WORDS_SQL = "w AS (SELECT l_orderkey AS page, l_linenumber AS word, l_linenumber AS top, CAST(floor(l_quantity) AS DOUBLE) * 10 AS x1 FROM lineitem)"


@registry.add(
    "value_columns",
    f"""WITH {_WORDS_SQL}, b AS (SELECT *, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page ORDER BY x1, word) <= 25 THEN 0 ELSE 1 END AS begins FROM w), c AS (SELECT *, sum(begins) OVER (PARTITION BY page ORDER BY x1, word) AS chain FROM b),
    g AS (SELECT page, chain, count(*) AS n, round(avg(x1), 6) AS "right" FROM c GROUP BY ALL), r AS (SELECT page, greatest(2, floor(count(DISTINCT top) * 0.1)) AS need FROM w GROUP BY page),
    k AS (SELECT page, "right", row_number() OVER (PARTITION BY page ORDER BY "right") AS col FROM (SELECT g.*, need, max(n) OVER (PARTITION BY page) AS most FROM g JOIN r USING (page)) WHERE n >= need OR most < need)
    SELECT w.page, word, CAST(col AS INT) AS "column", "right" FROM w JOIN k ON k.page = w.page QUALIFY row_number() OVER (PARTITION BY w.page, word ORDER BY abs(x1 - "right"), col) = 1""",
)
def value_columns_query(spark, sf_dir):
    """Lines of an order as words, their quantities as right edges."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("word"), F.col("l_linenumber").alias("top"), (F.floor("l_quantity").cast("double") * 10).alias("x1"))
    return value_columns(line)


def ledger_rows(rows: DataFrame) -> DataFrame:
    """(*, label_norm, source_ref): the table id, else file and page, else the file."""
    page = F.concat(F.col("report_file"), F.lit(":p"), F.col("page").cast("string"))
    return rows.withColumns({"label_norm": T.normalize_label(F.col("matched_label")), "source_ref": F.coalesce("table_id", page, "report_file")})


_LEDGER_SQL = """ledger AS (SELECT l_orderkey, l_linenumber, o_orderpriority AS matched_label, 'report_' || year(o_orderdate) AS report_file, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS page, CASE WHEN l_returnflag = 'R' THEN 'T' || l_partkey END AS table_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@registry.add(
    "ledger_rows",
    rf"""WITH {_LEDGER_SQL} SELECT l_orderkey, l_linenumber, trim(regexp_replace(regexp_replace(lower(matched_label), '[^a-z0-9&\- ]+', ' ', 'g'), '\s+', ' ', 'g')) AS label_norm, coalesce(table_id, report_file || ':p' || page, report_file) AS source_ref FROM ledger""",
)
def ledger_rows_query(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag")
    both = line.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select("l_orderkey", "l_linenumber", F.col("o_orderpriority").alias("matched_label"), F.concat(F.lit("report_"), F.year("o_orderdate").cast("string")).alias("report_file"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("page"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).alias("table_id"))
    return ledger_rows(rows).select("l_orderkey", "l_linenumber", "label_norm", "source_ref")


def insight_rows(raw: DataFrame, names: dict[str, str], prefix: str = "INS-") -> DataFrame:
    """Insights from rows with any headers: (insight_id, sheet, row_no, area, takeaway, year, confidence).

    names: the header of each field; numbers that don't parse are null; the id is the prefix
    and the row's number within its sheet.
    """
    of = lambda field: F.col(f"`{names[field]}`") if field in names else F.lit(None).cast("string")
    number = F.row_number().over(W.partitionBy("sheet").orderBy("row_no"))
    out = raw.withColumn("id__n", number)
    return out.select(F.concat(F.lit(prefix), F.col("id__n").cast("string")).alias("insight_id"), "sheet", "row_no", of("area").cast("string").alias("area"), of("takeaway").cast("string").alias("takeaway"), of("year").cast("string").try_cast("int").alias("year"), of("confidence").cast("string").try_cast("double").alias("confidence"))


@registry.add(
    "insight_rows",
    """SELECT 'INSR-' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS insight_id, user_id AS sheet, event_id AS row_no, event_type AS area, props AS takeaway, TRY_CAST(regexp_extract(props, '[0-9]+') AS INT) AS year, value AS confidence FROM events""",
)
def insight_rows_query(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("sheet"), F.col("event_id").alias("row_no"), F.col("event_type").alias("Area"), F.col("props").alias("Key takeaway"), F.regexp_extract("props", "[0-9]+", 0).alias("Year"), F.col("value").alias("Conf."))
    return insight_rows(e, {"area": "Area", "takeaway": "Key takeaway", "year": "Year", "confidence": "Conf."}, "INSR-")


def workbook_company(source_cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, company): the commonest name of `Source: <name> Annual Report` cells, else the manifest's, else the file's name.

    source_cells: (file, cell); manifest: (file, json) with a field company.
    """
    name = F.regexp_extract("cell", r"^Source: (.+?) Annual Report", 1)
    counts = source_cells.withColumn("name", name).where("name <> ''").groupBy("file", "name").agg(F.count("*").alias("n"))
    modal = counts.groupBy("file").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    known = manifest.select("file", F.get_json_object("json", "$.company").alias("known"))
    files = source_cells.select("file").union(manifest.select("file")).distinct()
    return files.join(modal, "file", "left").join(known, "file", "left").select("file", F.coalesce("name", "known", "file").alias("company"))


@registry.add(
    "workbook_company",
    """WITH c AS (SELECT 'book' || (o_custkey % 40) AS file, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 40 < 20), m AS (SELECT file, name FROM (SELECT file, name, count(*) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, name) = 1),
    f AS (SELECT DISTINCT 'book' || (o_custkey % 40) AS file, o_custkey % 40 AS k FROM orders) SELECT file, coalesce(name, CASE WHEN k < 30 THEN 'company ' || k END, file) AS company FROM f LEFT JOIN m USING (file)""",
)
def workbook_company_query(spark, sf_dir):
    k = F.col("o_custkey") % 40
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("book"), k.cast("string")).alias("file"), k.alias("k"), "o_orderstatus", "o_orderpriority")
    stated = (F.col("o_orderstatus") == "F") & (F.col("k") < 20)
    source_cells = o.select("file", F.when(stated, F.concat(F.lit("Source: "), F.col("o_orderpriority"), F.lit(" Annual Report 1996"))).otherwise("Total").alias("cell"))
    manifest = o.where("k < 30").select("file", F.to_json(F.struct(F.concat(F.lit("company "), F.col("k").cast("string")).alias("company"))).alias("json")).distinct()
    return workbook_company(source_cells, manifest)


def detail_slice(rows: DataFrame, sheet: Column | None = None, metric: Column | None = None, year: Column | None = None) -> DataFrame:
    """Facts of a sheet, metric and year; what is None is not asked."""
    for name, value in (("entity", sheet), ("metric", metric), ("year", year)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


@registry.add("detail_slice", f"""WITH {FACTS_SQL} SELECT entity, metric, year, value FROM facts WHERE metric = 'revenue' AND year = 1996""")
def detail_slice_query(spark, sf_dir):
    return detail_slice(facts(spark, sf_dir, ["revenue"]), metric=F.lit("revenue"), year=F.lit(1996)).select("entity", "metric", "year", "value")


def quality_flags(ledger: DataFrame) -> DataFrame:
    """(entity, metric, year, status) from (entity, metric, year, report_year, status): the last status where it is not ok or clean."""
    last = ledger.groupBy("entity", "metric", "year").agg(F.max_by("status", "report_year").alias("status"))
    return last.where(~F.lower(F.coalesce("status", F.lit("ok"))).isin("ok", "clean"))


@registry.add(
    "quality_flags",
    f"""WITH {OBS_SQL}, s AS (SELECT *, lag(value) OVER (PARTITION BY entity, metric, value_year ORDER BY report_year) AS before FROM obs), t AS (SELECT *, CASE WHEN before IS NULL THEN 'OK' WHEN abs(value - before) <= 0.02 * abs(before) THEN 'Clean' ELSE 'restated' END AS status FROM s)
    SELECT entity, metric, value_year AS year, arg_max(status, report_year) AS status FROM t GROUP BY ALL HAVING lower(arg_max(status, report_year)) NOT IN ('ok', 'clean')""",
)
def quality_flags_query(spark, sf_dir):
    """Observations with a status by how far they are from the report before."""
    before = F.lag("value").over(W.partitionBy("entity", "metric", "value_year").orderBy("report_year"))
    status = F.when(before.isNull(), "OK").when(F.abs(F.col("value") - before) <= 0.02 * F.abs(before), "Clean").otherwise("restated")
    return quality_flags(observations(spark, sf_dir).select("entity", "metric", F.col("value_year").alias("year"), "report_year", status.alias("status")))
