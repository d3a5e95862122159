"""Checks that take a user's own frames: printed values, table roles, premises of questions, finished answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import FACTS_SQL, facts, read
from .ingest import line_values
from .similar import resolve_labels

registry = Registry()

#: The side of the books that a statement is on, and words of titles that tell of one, the first before the others.
POLARITY = {
    "non_current_assets": "asset", "current_assets": "asset", "non_current_liabilities": "liability", "current_liabilities": "liability", "share_capital_reserves": "equity", "equity_changes": "equity",
    "revenue": "income", "other_income": "income", "cost_of_sales": "expense", "operating_expenses": "expense", "finance_cost": "expense", "taxation": "expense",
}
TITLE_POLARITY = (
    ("share capital", "equity"), ("reserves", "equity"), ("equity", "equity"), ("liabilit", "liability"), ("asset", "asset"), ("other income", "income"), ("revenue", "income"),
    ("cost of sales", "expense"), ("finance cost", "expense"), ("levy", "expense"), ("taxation", "expense"), ("expense", "expense"),
)
#: Titles of views that are never truth, titles of face statements, totals that only those carry, and grand totals of balance sheets.
ANALYTICAL = r"six[\s-]?year|ten[\s-]?year|highlight|ratio|horizontal|vertical|key\s+(?:data|figures|indicators)|at\s+a\s+glance|common[\s-]?size"
FACE_TITLE = r"statement of financial position|balance sheet|statement of profit|profit (?:or|and) loss|income statement|cash flow|changes in equity|comprehensive income"
FACE_TOTALS = ("revenue", "gross_profit", "operating_profit", "profit_before_tax", "profit_after_tax", "total_assets", "total_liabilities", "total_equity_and_liabilities", "equity", "cash_at_end_of_period")
GRAND_TOTALS = ("total_assets", "total_equity_and_liabilities", "total_liabilities")
FACES = ("balance_sheet", "income_statement", "cash_flow", "equity_changes", "comprehensive_income")
#: Words, or how they begin, that say that something fell or rose.
FELL = ("less", "lower", "fell", "fall", "fallen", "drop", "dropped", "droped", "declin*", "smaller", "below", "reduc*", "weaker", "down", "shrank", "shrunk", "worse")
ROSE = ("more", "higher", "rose", "risen", "grew", "grow*", "increas*", "larger", "bigger", "above", "stronger", "up", "improv*", "better")
#: Bands of confidence.
BANDS = ("high", "medium", "low", "insufficient")


def polarity(statement: Column, title: Column) -> Column:
    """asset, liability, equity, income or expense: by the statement, else by words of the title, else null."""
    known = F.create_map(*(F.lit(x) for pair in POLARITY.items() for x in pair))
    low, told = F.lower(F.coalesce(title, F.lit(""))), F.lit(None).cast("string")
    for words, side in reversed(TITLE_POLARITY):
        told = F.when(F.contains(low, F.lit(words)), side).otherwise(told)
    return F.coalesce(F.try_element_at(known, F.coalesce(statement, F.lit(""))), told)


def harden_values(lines: DataFrame) -> DataFrame:
    """(*, hardened, sign_fixed, note_dropped) of lines (line_id, note_ref, year, value, raw), a row for each year.

    A positive value whose printed token is negative at the same size, within max(0.5, 0.1 %),
    becomes negative; the other way round nothing is done. A whole value under 100 that equals the
    number of the line's note and is under a tenth of the smallest other size on the line is a note
    number that has slipped in, and becomes null. Null values stay null.
    """
    raw, value = T.parse_money(F.col("raw")), F.col("value").cast("double")
    near = F.abs(F.abs(raw) - F.abs(value)) <= F.greatest(F.lit(0.5), 0.001 * F.abs(value))
    fixed = F.coalesce((raw < 0) & (value > 0) & near, F.lit(False))
    note = F.nullif(F.regexp_extract(F.coalesce(F.col("note_ref").cast("string"), F.lit("")), "[0-9]+", 0), F.lit("")).cast("double")
    sizes = F.collect_set(F.abs(value)).over(W.partitionBy("line_id"))  # a line's years
    rows = lines.withColumn("sizes__", sizes)
    least = F.array_min(F.filter("sizes__", lambda s: s != F.abs(value)))
    leaked = F.coalesce((F.abs(value) == note) & (value == F.floor(value)) & (F.abs(value) < 100) & (F.abs(value) < 0.1 * least), F.lit(False))
    hardened = F.when(leaked, F.lit(None).cast("double")).when(fixed, -value).otherwise(value)
    return rows.select(*lines.columns, hardened.alias("hardened"), fixed.alias("sign_fixed"), leaked.alias("note_dropped"))


def structured_lines(grid: DataFrame, tables: DataFrame, known: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(sheet, section, label, metric, resolution, score, year, raw, value): raw grids as lines with metrics and hardened values.

    grid and tables as line_values() takes them; known: (name, metric, family) of metrics; notes:
    (sheet, label, note_ref). Labels are resolved exactly, else by similarity (resolution exact or
    fuzzy); a metric of another family than the sheet's statement is given up
    (no_confident_metric), an unknown label has none. Values are hardened by harden_values().
    """
    spark = grid.sparkSession
    nothing = spark.createDataFrame([], "key string, metric string, family string")
    lines = line_values(grid, tables, nothing).select("sheet", "section", "label", "year", "raw", "value")
    found = resolve_labels(lines.select("label"), known.select("name", "metric")).select(F.col("label").alias("l"), F.col("metric").alias("m"), "score", "method")
    families = known.groupBy(F.col("metric").alias("m")).agg(F.min("family").alias("family"))
    lines = lines.join(found, F.col("label") == F.col("l")).drop("l").join(families, "m", "left").join(tables.select("sheet", "statement"), "sheet", "left")
    alien = F.coalesce(F.col("family") != F.col("statement"), F.lit(False))
    lines = lines.withColumns({"metric": F.when(~alien, F.col("m")), "resolution": F.when(alien, "no_confident_metric").when(F.col("m").isNotNull(), F.col("method"))})
    note = spark.createDataFrame([], "sheet string, label string, note_ref string") if notes is None else notes.select("sheet", "label", "note_ref")
    lines = lines.join(note, ["sheet", "label"], "left").withColumn("line_id", F.struct("sheet", "section", "label"))
    hard = harden_values(lines)
    return hard.select("sheet", "section", "label", "metric", "resolution", "score", "year", "raw", F.col("hardened").alias("value"))


def infer_roles(tables: DataFrame) -> DataFrame:
    """(*, inferred_role) of tables (title, statement, family, unit_scale, metrics array, table_role): primary, note or analytical.

    A role that is given stays. Highlights, ratios and views over many years are analytical; a face
    statement needs a face title or one of its totals, and a part of a balance sheet a grand total,
    to be primary; a bare analysis that is none of these is analytical, the rest are notes.
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    has = lambda names: F.coalesce(F.arrays_overlap("metrics", F.array(*map(F.lit, names))), F.lit(False))
    statement = F.coalesce("statement", F.lit(""))
    role = (
        F.when((statement == "financial_highlights") | title.rlike(ANALYTICAL) | F.trim(F.coalesce("unit_scale", F.lit(""))).isin("%", "percent", "ratio"), "analytical")
        .when(statement.isin(*FACES) & (title.rlike(FACE_TITLE) | has(FACE_TOTALS)), "primary")
        .when((F.coalesce("family", F.lit("")) == "balance") & has(GRAND_TOTALS), "primary")
        .when(title.rlike(r"\banalysis\b"), "analytical")
        .otherwise("note")
    )
    return tables.withColumn("inferred_role", F.coalesce(F.nullif("table_role", F.lit("")), role))


def asserted_direction(text: Column) -> Column:
    """down or up where a text has words of one kind only, ambiguous with both, null with none."""
    any_of = lambda words: F.lower(F.coalesce(text, F.lit(""))).rlike(r"\b(?:" + "|".join(w.replace("*", r"\w*") for w in words) + r")\b")
    down, up = any_of(FELL), any_of(ROSE)
    return F.when(down & up, "ambiguous").when(down, "down").when(up, "up")


def check_premises(asked: DataFrame) -> DataFrame:
    """(*, asserted, actual, contradicted) of questions (text, before, after): whether the figures moved against what the text says.

    Nothing is contradicted where the text says nothing or both, a figure is unknown or none moved.
    """
    delta = F.col("after") - F.col("before")
    actual = F.when(delta > 0, "up").when(delta < 0, "down")
    asserted = asserted_direction(F.col("text"))
    return asked.withColumns({"asserted": asserted, "actual": actual, "contradicted": F.coalesce(asserted.isin("up", "down") & (asserted != actual), F.lit(False))})


def answer_issues(answers: DataFrame, findings: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, issue, detail): what is wrong with finished answers; none where all is well.

    answers: (answer_id, text, band); findings: (answer_id, place, text); citations: (answer_id,
    ref_id). Issues: an empty answer, a band that is none of the known, a finding without a
    [C1]-like handle, and each handle that no citation of the answer has.
    """
    empty = answers.where("trim(coalesce(text, '')) = ''").select("answer_id", F.lit("empty answer").alias("issue"), F.lit(None).cast("string").alias("detail"))
    band = answers.where(F.col("band").isNotNull() & ~F.col("band").isin(*BANDS)).select("answer_id", F.lit("invalid band").alias("issue"), F.col("band").alias("detail"))
    handles = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[(C[0-9]+)\]"), F.lit(1)))
    found = findings.select("answer_id", "place", "text", handles.alias("handles"))
    uncited = found.where("size(handles) = 0").select("answer_id", F.lit("uncited finding").alias("issue"), F.col("text").alias("detail"))
    asked = found.select("answer_id", F.explode("handles").alias("ref_id")).distinct()
    dangling = asked.join(citations.select("answer_id", "ref_id"), ["answer_id", "ref_id"], "left_anti").select("answer_id", F.lit("dangling citation").alias("issue"), F.col("ref_id").alias("detail"))
    return empty.unionByName(band).unionByName(uncited).unionByName(dangling)


@registry.add(
    "hardened_values",
    """WITH l AS (SELECT o_custkey AS line_id, o_orderkey AS year, CAST(o_custkey % 90 AS VARCHAR) AS note_ref, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey % 90 AS DOUBLE) ELSE floor(o_totalprice) END AS value, CASE WHEN o_orderkey % 4 = 0 THEN '(' || CAST(floor(o_totalprice) AS BIGINT) || ')' ELSE 'x' END AS raw FROM orders),
    m AS (SELECT line_id, list(DISTINCT abs(value)) AS sizes FROM l GROUP BY line_id),
    j AS (SELECT l.*, list_min(list_filter(sizes, lambda s: s <> abs(value))) AS least FROM l JOIN m USING (line_id)),
    k AS (SELECT *, coalesce(value = CAST(note_ref AS DOUBLE) AND value < 100 AND value < 0.1 * least, false) AS note_dropped, year % 4 = 0 AND value > 0 AND year % 6 <> 0 AS sign_fixed FROM j)
    SELECT line_id, year, CASE WHEN note_dropped THEN NULL WHEN sign_fixed THEN -value ELSE value END AS hardened, sign_fixed, note_dropped FROM k""",
)
def hardened_values(spark, sf_dir):
    """Orders of a customer as years of a line; some are printed negative, some are the note's number."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    note, price = (F.col("o_custkey") % 90), F.floor("o_totalprice")
    lines = o.select(F.col("o_custkey").alias("line_id"), k.alias("year"), note.cast("string").alias("note_ref"), F.when(k % 6 == 0, note).otherwise(price).cast("double").alias("value"), F.when(k % 4 == 0, F.concat(F.lit("("), price.cast("long").cast("string"), F.lit(")"))).otherwise("x").alias("raw"))
    return harden_values(lines).select("line_id", "year", "hardened", "sign_fixed", "note_dropped")


@registry.add(
    "premises_of_questions",
    f"""WITH {FACTS_SQL}, m AS (SELECT entity, metric, year, value AS after, lag(value) OVER (PARTITION BY entity, metric ORDER BY year) AS before FROM facts),
    q AS (SELECT *, 'why ' || CASE (year + length(metric)) % 5 WHEN 0 THEN 'did ' || metric || ' fall' WHEN 1 THEN 'is ' || metric || ' higher' WHEN 2 THEN 'did ' || metric || ' grow and then decline' WHEN 3 THEN 'has ' || metric || ' improved' ELSE 'is ' || metric || ' so' END AS text, (year + length(metric)) % 5 AS k FROM m),
    a AS (SELECT *, CASE k WHEN 0 THEN 'down' WHEN 1 THEN 'up' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'up' END AS asserted, CASE WHEN after > before THEN 'up' WHEN after < before THEN 'down' END AS actual FROM q)
    SELECT entity, metric, year, text, asserted, actual, coalesce(k IN (0, 1, 3) AND asserted <> actual, false) AS contradicted FROM a""",
)
def premises_of_questions(spark, sf_dir):
    """Questions that say how a metric moved, against how it did."""
    f = facts(spark, sf_dir).withColumn("before", F.lag("value").over(W.partitionBy("entity", "metric").orderBy("year")))
    k = (F.col("year") + F.length("metric")) % 5
    said = F.when(k == 0, F.concat(F.lit("did "), "metric", F.lit(" fall"))).when(k == 1, F.concat(F.lit("is "), "metric", F.lit(" higher"))).when(k == 2, F.concat(F.lit("did "), "metric", F.lit(" grow and then decline"))).when(k == 3, F.concat(F.lit("has "), "metric", F.lit(" improved"))).otherwise(F.concat(F.lit("is "), "metric", F.lit(" so")))
    asked = f.select("entity", "metric", "year", F.concat(F.lit("why "), said).alias("text"), "before", F.col("value").alias("after"))
    return check_premises(asked).drop("before", "after")


@registry.add(
    "issues_of_answers",
    """WITH c AS (SELECT conv_id AS answer_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'said' WHEN turn % 3 = 1 THEN 'so [C' || (turn + 1) || '] and [C' || (conv_id % 4 + 1) || ']' ELSE 'see [C' || (turn + 1) || ']' END AS text FROM conversations),
    a AS (SELECT answer_id, CASE WHEN answer_id % 5 = 0 THEN ' ' ELSE 'answer' END AS text, CASE WHEN answer_id % 7 = 0 THEN 'sure' ELSE 'high' END AS band FROM (SELECT DISTINCT answer_id FROM c)),
    r AS (SELECT DISTINCT answer_id, 'C' || (turn + 1) AS ref_id FROM c WHERE turn % 2 = 1 OR turn = 0)
    SELECT answer_id, 'empty answer' AS issue, NULL AS detail FROM a WHERE trim(text) = '' UNION ALL SELECT answer_id, 'invalid band', band FROM a WHERE band <> 'high' UNION ALL SELECT answer_id, 'uncited finding', text FROM c WHERE turn % 3 = 0
    UNION ALL SELECT * FROM (SELECT DISTINCT answer_id, 'dangling citation', unnest(regexp_extract_all(text, '\\[(C[0-9]+)\\]', 1)) AS ref_id FROM c) d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.answer_id = d.answer_id AND r.ref_id = d.ref_id)""",
)
def issues_of_answers(spark, sf_dir):
    """Conversations as answers, turns as their findings, odd turns as their citations."""
    c, t = read(spark, sf_dir, "conversations"), F.col("turn")
    handle = lambda n: F.concat(F.lit("[C"), n.cast("string"), F.lit("]"))
    text = F.when(t % 3 == 0, "said").when(t % 3 == 1, F.concat(F.lit("so "), handle(t + 1), F.lit(" and "), handle(F.col("conv_id") % 4 + 1))).otherwise(F.concat(F.lit("see "), handle(t + 1)))
    k = F.col("conv_id")
    answers = c.select("conv_id").distinct().select(k.alias("answer_id"), F.when(k % 5 == 0, " ").otherwise("answer").alias("text"), F.when(k % 7 == 0, "sure").otherwise("high").alias("band"))
    cited = c.where((t % 2 == 1) | (t == 0)).select(k.alias("answer_id"), F.concat(F.lit("C"), (t + 1).cast("string")).alias("ref_id"))
    return answer_issues(answers, c.select(k.alias("answer_id"), t.alias("place"), text.alias("text")), cited)
