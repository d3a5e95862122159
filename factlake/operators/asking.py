"""What questions ask for, and the insights that bear on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..registry import Registry
from ..sources.bridge import facts, read
from .evidence import _QUESTIONS_SQL, intent, questions

registry = Registry()

#: Wordings and the common form that they are read as, in order.
READ_AS = (
    ("gross profit margin", "gross margin"), ("net profit margin", "net margin"), ("operating profit margin", "operating margin"), ("profit before tax margin", "net margin"),
    ("for each year", "over the years"), ("each year", "over the years"), ("every year", "over the years"), ("year by year", "over the years"),
    ("per year", "over the years"), ("all years", "over the years"), ("all financial years", "over the years"), ("annually", "over the years"),
)
#: Words that speak of a change.
CHANGE = ("growth", "change", "increase", "decline", "grew", "rose", "fell")
#: Words that bear on a question, by its intent.
SIGNALS = {
    "forecast_validation": "revenue sales growth margin profit forecast outlook demand volume inflation cost decline increase target market export liquidity earnings eps",
    "risk_assessment": "risk margin pressure liquidity demand cost debt exposure default regulatory compliance operational",
    "trend_analysis": "revenue sales growth margin profit trend decline increase volume earnings",
    "earnings_review": "revenue sales profit margin earnings eps ebitda cost growth volume",
    "news_impact": "market demand growth decline outlook price sales inflation policy announcement",
}
YEAR = r"\b(?:19|20)[0-9]{2}\b"


def common_form(text: Column) -> Column:
    """A question in common wording; nothing but a year of two digits is one of four."""
    out = text
    for words, form in READ_AS:
        out = F.regexp_replace(out, r"(?i)\b" + words.replace(" ", r"\s+") + r"\b", form)
    bare = F.regexp_extract(F.trim(out), r"^([0-2][0-9])\??$", 1)
    return F.when(bare != "", F.concat(F.lit("20"), F.trim(out))).otherwise(out)


def parse_questions(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question_id, text, read_as, year, years, window, companies, asks_change) of questions (question_id, text).

    aliases: (alias, company, place). year is the first that is named; two years joined by a word
    or dash are the range of years between; "last 5 years" or "5-year" a window, which a range
    comes before. Companies are those of which an alias stands in the text as whole words, in the
    order of place; an alias is met by its first word. Null texts ask for nothing.
    """
    q = asked.select("question_id", "text", common_form(F.col("text")).alias("read_as"))
    first = F.regexp_extract("read_as", f"({YEAR})", 1)
    span = F.regexp_extract("read_as", rf"(?i)({YEAR}\s*(?:-|–|to|through|until|and)\s*{YEAR})", 1)
    ends = F.transform(F.regexp_extract_all(span, F.lit("(?:19|20)[0-9]{2}"), F.lit(0)), lambda y: y.cast("int"))
    years = F.when(span != "", F.sequence(F.array_min(ends), F.array_max(ends)))
    window = F.coalesce(*(F.nullif(F.regexp_extract("read_as", p, 1), F.lit("")) for p in (r"(?i)\b(?:last|past)\s+([0-9]{1,2})\s+years?", r"(?i)\b([0-9]{1,2})[- ]year\b"))).cast("int")
    change = F.col("read_as").rlike(rf"(?i)\b(?:{'|'.join(CHANGE)})\b")
    words = lambda c: F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")
    known = aliases.select("company", "place", words(F.col("alias")).alias("said")).where("size(said) > 0").withColumn("word", F.col("said")[0])
    held = q.select("question_id", words(F.col("read_as")).alias("words")).withColumn("word", F.explode(F.array_distinct("words"))).join(known, "word")
    spoken = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    met = held.where(F.contains(spoken("words"), spoken("said"))).groupBy("question_id", "company").agg(F.min("place").alias("place"))
    companies = met.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "company"))), lambda x: x["company"]).alias("companies"))
    out = q.join(companies, "question_id", "left")
    none = F.array().cast("array<string>")
    return out.select("question_id", "text", "read_as", F.when(first != "", first.cast("int")).alias("year"), years.alias("years"), F.when(years.isNull(), window).alias("window"), F.coalesce("companies", none).alias("companies"), F.coalesce(change, F.lit(False)).alias("asks_change"))


def insight_relevance(asked: DataFrame, insights: DataFrame, least: float = 0.65, k: int = 25) -> DataFrame:
    """(question_id, insight_id, relevance, place): the k most relevant insights of a question's entity.

    asked: (question_id, entity, intent, text, metrics, year); insights: (insight_id, entity, area,
    takeaway, year). The signal counts words of the intent and metrics in area and takeaway: none 0,
    one 0.55, two 0.7, each after the third 0.05 more, up to 1; for other intents without metrics it
    is the share of the question's words over three letters. relevance = 0.7 * (0.85 * signal + 0.15
    * token_set of text and insight) + 0.3 * (0.6 if both years are known and differ, else 1), to 4
    places. Insights without words are not relevant. Ties go to the smaller id; tasks keep k rows of
    a question before any are shuffled.
    """
    named = F.create_map(*(x for i, words in SIGNALS.items() for x in (F.lit(i), F.array(*map(F.lit, words.split())))))
    none = F.array().cast("array<string>")
    metrics = F.transform(F.coalesce("metrics", none), lambda m: F.replace(m, F.lit("_"), F.lit(" ")))
    q = asked.select("question_id", "entity", F.col("year").alias("asked_year"), F.lower(F.coalesce("text", F.lit(""))).alias("said"), F.concat(F.coalesce(F.try_element_at(named, F.coalesce("intent", F.lit(""))), none), metrics).alias("terms"))
    q = q.withColumn("own", F.filter(F.split("said", r"\s+"), lambda w: F.length(w) > 3))
    told = F.lower(F.concat_ws(" ", F.nullif("area", F.lit("")), F.nullif("takeaway", F.lit(""))))
    i = insights.select("insight_id", "entity", "year", told.alias("told")).where("told <> ''")
    met = q.join(i, "entity")
    within = lambda xs: F.size(F.filter(xs, lambda t: F.contains("told", t)))
    n = within("terms")
    signal = F.when(n == 0, 0.0).when(n == 1, 0.55).when(n == 2, 0.7).otherwise(F.least(F.lit(1.0), 0.7 + 0.05 * (n - 3)))
    free = F.when(F.size("own") > 0, within("own") / F.size("own")).otherwise(0.0)
    met = met.withColumn("signal", F.when(F.size("terms") > 0, signal).otherwise(free))
    season = F.when(F.col("asked_year").isNotNull() & F.col("year").isNotNull() & (F.col("asked_year") != F.col("year")), 0.6).otherwise(1.0)
    # what no similarity can lift to least is not compared
    met = met.withColumn("season", season).where(0.7 * (0.85 * F.col("signal") + 0.15) + 0.3 * F.col("season") >= least - 1e-4)
    score = F.round(0.7 * (0.85 * F.col("signal") + 0.15 * S.token_set(F.col("said"), F.col("told")) / 100.0) + 0.3 * F.col("season"), 4)
    out = met.select("question_id", "insight_id", score.alias("relevance")).where(F.col("relevance") >= least)
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("relevance"), "insight_id"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def distinct_insights(insights: DataFrame) -> DataFrame:
    """Insights (insight_id, area, takeaway, section, year, report_year, page, *) but those that repeat one with a smaller id.

    Area, takeaway and section count without case and outer white space, null as empty; equal years
    and pages include null ones.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keys = {"area__key": plain("area"), "takeaway__key": plain("takeaway"), "section__key": plain("section")}
    whole = F.struct(*insights.columns)
    kept = insights.select(whole.alias("row"), "insight_id", *(v.alias(k) for k, v in keys.items()), "year", "report_year", "page").groupBy(*keys, "year", "report_year", "page").agg(F.min_by("row", "insight_id").alias("row"))
    return kept.select("row.*")


@registry.add(
    "parsed_questions",
    rf"""WITH {_QUESTIONS_SQL}, w AS (SELECT question_id, entity, CASE (year * 3 + length(metric)) % 5 WHEN 0 THEN q || ' from ' || (year - 2) || ' to ' || year WHEN 1 THEN q || ' over the last ' || (year % 7 + 1) || ' years' WHEN 2 THEN upper(q) || ' growth each year' WHEN 3 THEN CAST(year % 100 AS VARCHAR) || '?' ELSE q END AS text, (year * 3 + length(metric)) % 5 AS k, year FROM questions),
    r AS (SELECT question_id, text, k, year AS y, CASE WHEN k = 2 THEN regexp_replace(text, '(?i)each year', 'over the years') WHEN k = 3 AND regexp_matches(text, '^[0-2][0-9]\?$') THEN '20' || text ELSE text END AS read_as FROM w),
    f AS (SELECT *, regexp_extract(read_as, '\b(?:19|20)[0-9]{{2}}\b') AS first FROM r)
    SELECT question_id, read_as, CAST(nullif(first, '') AS INT) AS year, CASE WHEN k = 0 THEN CAST(y - 2 AS INT) END AS from_year, CASE WHEN k = 0 THEN CAST(3 AS INT) ELSE CAST(-1 AS INT) END AS n_years, CASE WHEN k = 1 THEN CAST(y % 7 + 1 AS INT) END AS "window",
      regexp_matches(read_as, '(?i)\b(growth|change|increase|decline|grew|rose|fell)\b') AS asks_change, (SELECT min(e) FROM (SELECT DISTINCT entity AS e FROM facts) WHERE regexp_matches(upper(read_as), '(^|[^A-Z0-9])' || replace(upper(e), '_', '[^A-Z0-9]+') || '($|[^A-Z0-9])')) AS company FROM f""",
)
def parsed_questions(spark, sf_dir):
    """The question log with ranges, windows, changes and bare years; entities are companies by their own names."""
    q, k = questions(spark, sf_dir), (F.col("year") * 3 + F.length("metric")) % 5
    year = lambda d=0: (F.col("year") - d).cast("string")
    text = (
        F.when(k == 0, F.concat("q", F.lit(" from "), year(2), F.lit(" to "), year())).when(k == 1, F.concat("q", F.lit(" over the last "), (F.col("year") % 7 + 1).cast("string"), F.lit(" years")))
        .when(k == 2, F.concat(F.upper("q"), F.lit(" growth each year"))).when(k == 3, F.concat((F.col("year") % 100).cast("string"), F.lit("?"))).otherwise(F.col("q"))
    )
    companies = facts(spark, sf_dir).select(F.col("entity").alias("alias"), F.col("entity").alias("company")).distinct().withColumn("place", F.col("company"))
    out = parse_questions(q.select("question_id", text.alias("text")), companies)
    return out.select("question_id", "read_as", "year", F.get("years", F.lit(0)).alias("from_year"), F.coalesce(F.size("years"), F.lit(-1)).alias("n_years"), "window", "asks_change", F.get("companies", F.lit(0)).alias("company"))


@registry.add("relevant_insights")
def relevant_insights(spark, sf_dir):
    """Questions of each entity against documents of its nation's turn as insights."""
    q = questions(spark, sf_dir)
    asked = q.where("year % 4 = 0").select("question_id", "entity", intent(F.col("q")).alias("intent"), F.col("q").alias("text"), F.array("metric").alias("metrics"), "year")
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("turn"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", (F.col("p_partkey") % 25).alias("turn"), (F.lit(1992) + F.col("p_partkey") % 8).alias("year"))
    signal = F.element_at(F.array(*map(F.lit, ["revenue growth", "cost pressure on margin", "gross profit", "total assets", "outlook of demand"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    insights = part.join(n, "turn").select(F.col("p_partkey").alias("insight_id"), "entity", signal.alias("area"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("takeaway"), "year")
    return insight_relevance(asked, insights)


@registry.add(
    "insights_once",
    """WITH i AS (SELECT event_id AS insight_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || ' ' END AS area, CAST(user_id AS VARCHAR) AS takeaway, CASE WHEN event_id % 3 = 0 THEN 'notes' END AS section, year(ts) AS year, CASE WHEN event_id % 5 = 0 THEN 2024 END AS report_year, month(ts) AS page FROM events)
    SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY lower(trim(area)), lower(trim(takeaway)), lower(trim(coalesce(section, ''))), year, report_year, page ORDER BY insight_id) = 1""",
)
def insights_once(spark, sf_dir):
    """Events as insights by six fields."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    area = F.when(k % 2 == 0, F.upper("event_type")).otherwise(F.concat("event_type", F.lit(" ")))
    return distinct_insights(e.select(k.alias("insight_id"), area.alias("area"), F.col("user_id").cast("string").alias("takeaway"), F.when(k % 3 == 0, "notes").alias("section"), F.year("ts").alias("year"), F.when(k % 5 == 0, 2024).alias("report_year"), F.month("ts").alias("page")))
