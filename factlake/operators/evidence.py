"""Evidence: admission, authority, ranking, citations, conflicts, confidence; questions and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import FACTS_SQL, LINE_CENTS, OBS_SQL, facts, observations, read

registry = Registry()

# Authority classes of each claim type, highest first.
MATRIX = {
    "regulatory_compliance": ("regulatory_independent", "audited_issuer", "official_issuer_unaudited", "news_media"),
    "corporate_action_fact": ("exchange_official", "official_issuer_unaudited", "regulatory_independent", "news_media"),
    "audited_fact": ("audited_issuer", "official_issuer_unaudited", "independent_opinion", "news_media"),
    "official_unaudited_fact": ("official_issuer_unaudited", "exchange_official", "independent_opinion", "news_media"),
    "forward_expectation": ("independent_opinion", "official_issuer_unaudited", "market_revealed", "audited_issuer", "news_media"),
    "descriptive": ("official_issuer_unaudited", "audited_issuer", "sector_aggregate", "independent_opinion", "news_media"),
    "sentiment": ("market_revealed", "independent_opinion", "news_media", "sector_aggregate"),
    "sector_context": ("sector_aggregate", "independent_opinion", "market_revealed", "news_media"),
}
# Role of an external source by the first token that it contains.
ROLES = (
    ("payout", "event_fact"), ("analysis_report", "supporting"), ("futures", "forecast_context"), ("overview", "supporting"), ("quote", "supporting"), ("market_watch", "supporting"),
    ("screener", "supporting"), ("sector", "supporting"), ("summary", "supporting"), ("macro", "supporting"), ("secp", "supporting"), ("announcement", "supporting"),
)
SOURCES = ["statement", "company_payouts", "analysis_reports", "futures_watch", "company_quote", "sector_summary", "secp_notices", "announcements", "marketaux", "macro_series"]

ROLE = "CASE WHEN source IN ('statement', 'detail', 'calc') THEN 'baseline' " + " ".join(f"WHEN contains(source, '{t}') THEN '{r}'" for t, r in ROLES) + " ELSE 'non_authoritative' END"
CLASS = """CASE role WHEN 'baseline' THEN 'audited_issuer' WHEN 'event_fact' THEN 'exchange_official' WHEN 'non_authoritative' THEN 'news_media' WHEN 'forecast_context' THEN 'independent_opinion'
 ELSE CASE WHEN contains(source, 'secp') THEN 'regulatory_independent' WHEN contains(source, 'sector') OR contains(source, 'macro') THEN 'sector_aggregate' WHEN contains(source, 'announcement') THEN 'official_issuer_unaudited' ELSE 'exchange_official' END END"""
CLAIM = """CASE role WHEN 'baseline' THEN 'audited_fact' WHEN 'event_fact' THEN 'corporate_action_fact' WHEN 'non_authoritative' THEN 'sentiment' WHEN 'forecast_context' THEN 'forward_expectation'
 ELSE CASE WHEN contains(source, 'secp') THEN 'regulatory_compliance' WHEN contains(source, 'sector') THEN 'sector_context' WHEN contains(source, 'overview') OR contains(source, 'quote') OR contains(source, 'screener') OR contains(source, 'market') THEN 'official_unaudited_fact' ELSE 'descriptive' END END"""
RANK = "CASE " + " ".join(f"WHEN claim_type = '{c}' AND authority_class = '{a}' THEN {i}" for c, classes in MATRIX.items() for i, a in enumerate(classes)) + " END"
WEIGHT = "CASE " + " ".join(f"WHEN claim_type = '{c}' AND authority_class = '{a}' THEN {1 - i / (len(classes) - 1)!r}" for c, classes in MATRIX.items() for i, a in enumerate(classes)) + " ELSE 0.0 END"
SCORE = """round(100 * CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END
 + 20 * CASE WHEN weight > 0 THEN weight ELSE CASE role WHEN 'baseline' THEN 1.0 WHEN 'event_fact' THEN 0.85 WHEN 'supporting' THEN 0.7 WHEN 'forecast_context' THEN 0.6 ELSE 0.4 END END
 + 10 * greatest(0.0, least(1.0, (as_of - 2015) / 15.0)) + 5 * 1.0, 4)"""
_EVIDENCE_SQL = f"""ev AS (SELECT event_id, user_id, CAST(year(ts) AS INT) AS as_of, value, {SOURCES}[event_id % {len(SOURCES)} + 1] AS source FROM events),
e1 AS (SELECT *, {ROLE} AS role FROM ev), e2 AS (SELECT *, {CLASS} AS authority_class, {CLAIM} AS claim_type FROM e1),
evidence AS (SELECT *, {RANK} AS rank, CAST({WEIGHT} AS DOUBLE) AS weight FROM e2)"""


def evidence(spark, sf_dir) -> DataFrame:
    """Events as evidence items of sources, with role, authority class, claim type, rank and weight."""
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("event_id") % len(SOURCES) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.year("ts").alias("as_of"), "value", source.alias("source"))
    rows = rows.withColumn("role", F.expr(ROLE)).withColumns({"authority_class": F.expr(CLASS), "claim_type": F.expr(CLAIM)})
    return rows.withColumns({"rank": F.expr(RANK), "weight": F.expr(WEIGHT).cast("double")})


@registry.add("evidence_admission", f"WITH {_EVIDENCE_SQL} SELECT event_id, source, role, authority_class, claim_type, rank, weight, role = 'baseline' AS can_be_baseline FROM evidence")
def evidence_admission(spark, sf_dir):
    return evidence(spark, sf_dir).select("event_id", "source", "role", "authority_class", "claim_type", "rank", "weight", (F.col("role") == "baseline").alias("can_be_baseline"))


@registry.add("role_distribution", f"WITH {_EVIDENCE_SQL} SELECT user_id, role, count(*) AS n FROM evidence GROUP BY ALL")
def role_distribution(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("user_id", "role").agg(F.count("*").alias("n"))


@registry.add(
    "evidence_ranking",
    f"""WITH {_EVIDENCE_SQL}, s AS (SELECT event_id, user_id, source, CAST({SCORE} AS DOUBLE) AS score FROM evidence)
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS INT) AS place FROM s QUALIFY place <= 8""",
)
def evidence_ranking(spark, sf_dir, k: int = 8):
    """The k best items of each question, here a user; Spark cuts each partition to k before it shuffles."""
    scored = evidence(spark, sf_dir).select("event_id", "user_id", "source", F.expr(SCORE).cast("double").alias("score"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "event_id"))).where(F.col("place") <= k)


@registry.add(
    "pair_resolution",
    f"""WITH {_EVIDENCE_SQL}, n AS (SELECT *, lead(event_id) OVER o AS b_id, lead(role) OVER o AS b_role, lead(authority_class) OVER o AS b_class, lead(as_of) OVER o AS b_as_of FROM evidence WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    p AS (SELECT event_id AS a_id, b_id, role, b_role, as_of, b_as_of, coalesce(rank, 99) AS ra, coalesce({RANK.replace("authority_class =", "b_class =")}, 99) AS rb FROM n WHERE b_id IS NOT NULL)
    SELECT a_id, b_id, CASE WHEN ra < rb THEN 'a' WHEN rb < ra THEN 'b' WHEN as_of > b_as_of THEN 'a' WHEN b_as_of > as_of THEN 'b' ELSE 'tie' END AS winner,
    CASE WHEN ra < rb THEN 'side_a_higher_authority' WHEN rb < ra THEN 'side_b_higher_authority' ELSE 'equal_authority' END AS authority_weighting,
    CASE WHEN as_of > b_as_of THEN 'side_a_newer' WHEN b_as_of > as_of THEN 'side_b_newer' ELSE 'same_or_unknown' END AS chronology,
    CASE WHEN role = 'baseline' OR b_role = 'baseline' THEN 'workbook_authoritative' ELSE 'not_determined' END AS truth_resolution, NOT (role = 'baseline' OR b_role = 'baseline') AS surfaced FROM p""",
)
def pair_resolution(spark, sf_dir):
    """Each item against the next of its topic: the winner by rank, then recency, and the verdict."""
    o = W.partitionBy("user_id").orderBy("event_id")
    rows = evidence(spark, sf_dir).withColumns({n: F.lead(c).over(o) for n, c in (("b_id", "event_id"), ("b_role", "role"), ("b_class", "authority_class"), ("b_as_of", "as_of"))}).where("b_id IS NOT NULL")
    rows = rows.withColumns({"ra": F.coalesce("rank", F.lit(99)), "rb": F.coalesce(F.expr(RANK.replace("authority_class =", "b_class =")), F.lit(99))})
    newer = F.when(F.col("as_of") > F.col("b_as_of"), "a").when(F.col("b_as_of") > F.col("as_of"), "b")
    higher = F.when(F.col("ra") < F.col("rb"), "a").when(F.col("rb") < F.col("ra"), "b")
    baseline = (F.col("role") == "baseline") | (F.col("b_role") == "baseline")
    side = lambda x, suffix, other: F.coalesce(F.concat(F.lit("side_"), x, F.lit(suffix)), F.lit(other))
    return rows.select(F.col("event_id").alias("a_id"), "b_id", F.coalesce(higher, newer, F.lit("tie")).alias("winner"), side(higher, "_higher_authority", "equal_authority").alias("authority_weighting"), side(newer, "_newer", "same_or_unknown").alias("chronology"), F.when(baseline, "workbook_authoritative").otherwise("not_determined").alias("truth_resolution"), (~baseline).alias("surfaced"))


@registry.add(
    "citation_binding",
    f"""WITH {_EVIDENCE_SQL}, c AS (SELECT user_id, source, as_of, min(event_id) AS first_id, count(*) AS uses FROM evidence GROUP BY ALL)
    SELECT user_id, source, as_of, uses, 'C' || row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS ref_id FROM c""",
)
def citation_binding(spark, sf_dir):
    """Distinct locators of each answer, numbered as first seen."""
    cited = evidence(spark, sf_dir).groupBy("user_id", "source", "as_of").agg(F.min("event_id").alias("first_id"), F.count("*").alias("uses"))
    number = F.row_number().over(W.partitionBy("user_id").orderBy("first_id"))
    return cited.select("user_id", "source", "as_of", "uses", F.concat(F.lit("C"), number).alias("ref_id"))


@registry.add(
    "answer_confidence",
    f"""WITH {_EVIDENCE_SQL}, g AS (SELECT user_id, count(DISTINCT source) AS sources, bool_and(role = 'non_authoritative') AS news_only, bool_or(role = 'baseline') AS cited, count(DISTINCT as_of) AS years FROM evidence GROUP BY user_id),
    p AS (SELECT user_id, sources, [{{'value': CASE WHEN cited THEN 0.9 ELSE 0.6 END, 'ord': 0, 'name': 'evidence_quality'}}, {{'value': CASE WHEN years < 2 THEN 0.6 END, 'ord': 1, 'name': 'partial_coverage'}}, {{'value': CASE WHEN sources <= 1 THEN 0.6 END, 'ord': 2, 'name': 'single_source'}}, {{'value': CASE WHEN news_only THEN 0.6 END, 'ord': 3, 'name': 'non_authoritative'}}] AS parts FROM g),
    m AS (SELECT user_id, sources, list_sort(list_filter(parts, lambda x: x.value IS NOT NULL))[1] AS b FROM p)
    SELECT user_id, sources, CAST(b.value AS DOUBLE) AS score, CASE WHEN b.value >= 0.8 THEN 'High' WHEN b.value >= 0.5 THEN 'Medium' ELSE 'Low' END AS band, b.name AS limited_by FROM m""",
)
def answer_confidence(spark, sf_dir):
    """The lowest of the named components binds; ties go to the first."""
    g = evidence(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("source").alias("sources"), F.bool_and(F.col("role") == "non_authoritative").alias("news_only"), F.bool_or(F.col("role") == "baseline").alias("cited"), F.countDistinct("as_of").alias("years"))
    part = lambda value, ord_, name: F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(ord_).alias("ord"), F.lit(name).alias("name")))
    cap = lambda condition: F.when(condition, F.lit(0.6))
    least = F.least(part(F.when(F.col("cited"), 0.9).otherwise(0.6), 0, "evidence_quality"), part(cap(F.col("years") < 2), 1, "partial_coverage"), part(cap(F.col("sources") <= 1), 2, "single_source"), part(cap(F.col("news_only")), 3, "non_authoritative"))
    g = g.withColumn("b", least)
    band = F.when(F.col("b.value") >= 0.8, "High").when(F.col("b.value") >= 0.5, "Medium").otherwise("Low")
    return g.select("user_id", "sources", F.col("b.value").alias("score"), band.alias("band"), F.col("b.name").alias("limited_by"))


@registry.add(
    "internal_vs_external",
    f"""WITH {FACTS_SQL}, x AS (SELECT entity, metric, value_year AS year, arg_min(value, report_year) AS external FROM obs GROUP BY ALL)
    SELECT f.entity, f.metric, f.year, f.value AS internal, x.external, f.value AS resolved FROM facts f JOIN x ON f.entity = x.entity AND f.metric = x.metric AND f.year = x.year WHERE abs(f.value - x.external) > 0.05 * greatest(abs(f.value), abs(x.external), 1)""",
)
def internal_vs_external(spark, sf_dir):
    """Divergent external values (the first report's) of internal facts, which win."""
    external = observations(spark, sf_dir).groupBy("entity", "metric", F.col("value_year").alias("year")).agg(F.min_by("value", "report_year").alias("external"))
    both = facts(spark, sf_dir).select("entity", "metric", "year", F.col("value").alias("internal")).join(external, ["entity", "metric", "year"])
    return both.where(F.abs(F.col("internal") - F.col("external")) > 0.05 * F.greatest(F.abs("internal"), F.abs("external"), F.lit(1.0))).withColumn("resolved", F.col("internal"))


_PAT = ("revenue", "cost_of_sales", "operating_expenses", "finance_cost", "taxation")
_TWO_SQL = f"""owned AS MATERIALIZED (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS value_year, n_name AS entity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    flow AS MATERIALIZED (SELECT entity, value_year, CAST(year(l_shipdate) AS INT) AS report_year, {", ".join(f"CAST(sum({LINE_CENTS[m]}) AS BIGINT) AS {m}" for m in _PAT)} FROM lineitem JOIN owned ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) >= value_year GROUP BY ALL),
    two AS MATERIALIZED (SELECT entity, 'revenue' AS metric, value_year, report_year, revenue AS cents FROM flow UNION ALL SELECT entity, 'pat', value_year, report_year, {" + ".join(_PAT)} FROM flow),
    obs AS MATERIALIZED (SELECT entity, metric, value_year, report_year, CAST(sum(cents) OVER (PARTITION BY entity, metric, value_year ORDER BY report_year) AS BIGINT) / 100.0::DOUBLE AS value FROM two WHERE cents IS NOT NULL)"""


@registry.add(
    "cross_report_conflicts",
    f"""WITH {_TWO_SQL} SELECT a.entity, a.metric, a.value_year, a.report_year AS a_report, b.report_year AS b_report, a.value AS a_value, b.value AS b_value FROM obs a JOIN obs b ON a.entity = b.entity AND a.metric = b.metric AND a.value_year = b.value_year AND a.report_year < b.report_year
    WHERE abs(a.value - b.value) > 0.05 * greatest(abs(a.value), abs(b.value), 1)""",
)
def cross_report_conflicts(spark, sf_dir):
    """Pairs of reports that put one value apart; a value has a handful of reports."""
    rows = observations(spark, sf_dir, ["revenue", "pat"])
    a = rows.select("entity", "metric", "value_year", F.col("report_year").alias("a_report"), F.col("value").alias("a_value"))
    b = rows.select("entity", "metric", "value_year", F.col("report_year").alias("b_report"), F.col("value").alias("b_value"))
    both = a.join(b, ["entity", "metric", "value_year"]).where("a_report < b_report")
    return both.where(F.abs(F.col("a_value") - F.col("b_value")) > 0.05 * F.greatest(F.abs("a_value"), F.abs("b_value"), F.lit(1.0)))


TEMPLATES = [
    "What is the {m} of {e} in {y}?", "Show the {m} trend for {e}", "Compare {m} of {e} vs peers", "Audit the balance sheet of {e}", "Is the {y} forecast for {m} on track?", "Any news about {e}?",
    "What drove the change in {m} for {e}?", "Give me an overview of {e} in {y}", "Dividend payout of {e} for {y}", "What are the main risks for {e}?", "Current ratio of {e} in {y}", "Is {e} expensive on valuation?", "and {y}?", "Review the earnings of {e}",
]
#: The intent that each template asks for.
EXPECTED = ("metric_lookup", "trend_analysis", "peer_comparison", "validation", "forecast_validation", "news_impact", "driver_analysis", "overview", "dividend_analysis", "risk_assessment", "ratio_analysis", "valuation", "unknown", "earnings_review")
# The order and the patterns by which a question is routed.
ROUTES = (
    ("validation", r"\b(audit|validat\w+|reconcil\w+|anomal\w+|mis-?extract\w*)\b|\bsanity[- ]?check\w*\b"),
    ("peer_comparison", r"\bvs\.?\b|versus|compare|against|peer"),
    ("valuation", r"\bp/?e\b|pe ratio|price[- ]to[- ]earnings|price[- ]to[- ]book|\bp/?b\b|ev/?ebitda|enterprise value|valuation|how cheap|expensive"),
    ("forecast_validation", r"forecast|guidance|on track|remain(ed)? valid|projection"),
    ("earnings_review", r"earnings review|review (the )?earnings|latest results"),
    ("news_impact", r"\bnews\b|headlines|announcements?"),
    ("dividend_analysis", r"dividend|payout|book closure|bonus issue"),
    ("overview", r"\bsummar(?:y|i[sz]e)\b|\boverview\b|\bsnapshot\b|at a glance|financial highlights|\bkpis?\b"),
    ("driver_analysis", r"\b(?:drove|driven|drive[sr]?|contribut\w*|responsible|caused|led to|behind)\b.*\b(?:change|movement|increase|decrease|growth|swing|rise|fall|delta|shift)\b"),
    ("trend_analysis", r"\btrend|over the years|historical|history|year[- ]over[- ]year|yoy|trajectory"),
    ("ratio_analysis", r"current\s+ratio|quick\s+ratio|acid[- ]test|gross\s+margin|operating\s+margin|net\s+margin|\broe\b|\broa\b|gearing|interest\s+coverage|\bebitda\b"),
    ("risk_assessment", r"\brisk|\bchalleng|\bheadwind|\bconcern|\bpressure|\bexposure|\buncertaint"),
    ("metric_lookup", r"\brevenue|net sales|turnover|profit|\bpat\b|total assets|total equity|current assets|current liabilities|\bliabilities\b|\bassets\b|\bequity\b|earnings"),
)
#: How a question begins that goes on from the one before.
FOLLOW_UP = r"^\s*(?:and|also|how about|what about|same for|for that|ok but|but what|in that|what was it|how was it|for those|\d{4}\??)[\s,?]"
_QUESTIONS_SQL = f"""{FACTS_SQL}, questions AS (SELECT entity || '|' || metric || '|' || year AS question_id, entity, metric, year,
  replace(replace(replace([{", ".join("'" + t + "'" for t in TEMPLATES)}][(year * 7 + length(metric) + length(entity)) % {len(TEMPLATES)} + 1], '{{m}}', replace(metric, '_', ' ')), '{{e}}', entity), '{{y}}', CAST(year AS VARCHAR)) AS q FROM facts)"""


def questions(spark, sf_dir) -> DataFrame:
    """A question log worded from facts."""
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), ((F.col("year") * 7 + F.length("metric") + F.length("entity")) % len(TEMPLATES) + 1).cast("int"))
    q = F.replace(F.replace(F.replace(template, F.lit("{m}"), F.replace("metric", F.lit("_"), F.lit(" "))), F.lit("{e}"), F.col("entity")), F.lit("{y}"), F.col("year").cast("string"))
    return facts(spark, sf_dir).select(F.concat_ws("|", "entity", "metric", "year").alias("question_id"), "entity", "metric", "year", q.alias("q"))


def intent(q: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(ROUTES):
        out = F.when(q.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def _intent_sql(q: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({q}, '{p}', 'i') THEN '{n}'" for n, p in ROUTES) + " ELSE 'unknown' END"


_YEAR_SQL = r"CAST(nullif(regexp_extract(q, '\b((?:19|20)\d{2})\b', 1), '') AS INT)"


@registry.add("question_routing", f"WITH {_QUESTIONS_SQL} SELECT question_id, q, {_intent_sql('q')} AS intent, {_YEAR_SQL} AS asked_year, regexp_matches(trim(q), '{FOLLOW_UP}', 'i') OR length(trim(q)) <= 25 AS follow_up FROM questions")
def question_routing(spark, sf_dir):
    q = F.col("q")
    year = F.regexp_extract(q, r"\b((?:19|20)\d{2})\b", 1)
    follow = F.trim(q).rlike("(?i)" + FOLLOW_UP) | (F.length(F.trim(q)) <= 25)
    return questions(spark, sf_dir).select("question_id", "q", intent(q).alias("intent"), F.when(year != "", year.cast("int")).alias("asked_year"), follow.alias("follow_up"))


def evaluated(routed: DataFrame) -> DataFrame:
    """(intent, total, passed) of questions (expected, intent): how many of each expected intent are routed to it."""
    return routed.groupBy(F.col("expected").alias("intent")).agg(F.count("*").alias("total"), F.count_if(F.col("intent") == F.col("expected")).alias("passed"))


_TURN_SQL = f"(year * 7 + length(metric) + length(entity)) % {len(TEMPLATES)} + 1"


@registry.add(
    "intent_evaluation",
    f"WITH {_QUESTIONS_SQL}, r AS (SELECT {list(EXPECTED)}[{_TURN_SQL}] AS expected, {_intent_sql('q')} AS routed FROM questions) SELECT expected AS intent, count(*) AS total, count(*) FILTER (WHERE routed = expected) AS passed FROM r GROUP BY expected",
)
def intent_evaluation(spark, sf_dir):
    """The question log against the intent that the wording asks for."""
    turn = ((F.col("year") * 7 + F.length("metric") + F.length("entity")) % len(TEMPLATES) + 1).cast("int")
    return evaluated(questions(spark, sf_dir).select(F.element_at(F.array(*map(F.lit, EXPECTED)), turn).alias("expected"), intent(F.col("q")).alias("intent")))


@registry.add(
    "batch_answers",
    f"""WITH {_QUESTIONS_SQL}, r AS (SELECT *, {_intent_sql('q')} AS intent, {_YEAR_SQL} AS asked FROM questions)
    SELECT r.question_id, r.intent, coalesce(r.asked, r.year) AS year, f.value, f.report_year AS cited_report, f.value IS NULL AS insufficient FROM r LEFT JOIN facts f ON f.entity = r.entity AND f.metric = r.metric AND f.year = coalesce(r.asked, r.year) WHERE r.intent IN ('metric_lookup', 'trend_analysis', 'driver_analysis')""",
)
def batch_answers(spark, sf_dir):
    """Questions about one metric answered from facts with the report that they cite."""
    q = F.col("q")
    year = F.regexp_extract(q, r"\b((?:19|20)\d{2})\b", 1)
    asked = questions(spark, sf_dir).withColumns({"intent": intent(q), "year": F.coalesce(F.when(year != "", year.cast("int")), "year")}).where(F.col("intent").isin("metric_lookup", "trend_analysis", "driver_analysis"))
    known = facts(spark, sf_dir).select("entity", "metric", "year", "value", F.col("report_year").alias("cited_report"))
    return asked.join(known, ["entity", "metric", "year"], "left").select("question_id", "intent", "year", "value", "cited_report", F.col("value").isNull().alias("insufficient"))


@registry.add("turn_follow_ups", f"SELECT conv_id, turn, regexp_matches(trim(coalesce(text, '')), '{FOLLOW_UP}', 'i') OR length(trim(coalesce(text, ''))) <= 25 AS follow_up FROM conversations WHERE role = 'user'")
def turn_follow_ups(spark, sf_dir):
    t = F.trim(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", (t.rlike("(?i)" + FOLLOW_UP) | (F.length(t) <= 25)).alias("follow_up"))


_INSIGHT_SQL = """insights AS (SELECT d.doc_id AS insight_id, d.source AS area, d.lang AS section, 2015 + CAST(d.doc_id % 9 AS INT) AS year, CAST(CASE WHEN l.quality = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.5 ELSE 0.6 + (d.doc_id % 3) * 0.1 END AS DOUBLE) AS confidence, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def insights(spark, sf_dir) -> DataFrame:
    """Documents as narrative insights of an area, with a confidence from their labels."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    confidence = F.when(F.col("quality") == 1, F.lit(0.9)).when(F.col("quality") == 0, F.lit(0.5)).otherwise(0.6 + (F.col("doc_id") % 3) * 0.1)
    return d.select("doc_id", "source", "lang", "n_chars").join(l, "doc_id", "left").select(F.col("doc_id").alias("insight_id"), F.col("source").alias("area"), F.col("lang").alias("section"), (F.col("doc_id") % 9 + 2015).cast("int").alias("year"), confidence.alias("confidence"), "n_chars")


@registry.add("insight_routing", f"WITH {_INSIGHT_SQL} SELECT insight_id, area, confidence, CASE WHEN confidence >= 0.7 - 1e-9 THEN 'export' WHEN confidence >= 0.5 THEN 'review' ELSE 'drop' END AS route FROM insights")
def insight_routing(spark, sf_dir):
    return insights(spark, sf_dir).select("insight_id", "area", "confidence", F.when(F.col("confidence") >= 0.7 - 1e-9, "export").when(F.col("confidence") >= 0.5, "review").otherwise("drop").alias("route"))


@registry.add(
    "theme_scores",
    f"""WITH {_INSIGHT_SQL}, t AS (SELECT area, max(confidence) AS top, count(*) AS n, count(DISTINCT section) AS sections, bool_or(n_chars > 1000) AS quantified FROM insights GROUP BY area)
    SELECT area, n, CAST(round(top * 0.65 + least(0.15, 0.03 * (n - 1)) + least(0.15, 0.05 * (sections - 1)) + CASE WHEN quantified THEN 0.05 ELSE 0 END, 6) AS DOUBLE) AS evidence_weight, CASE WHEN top >= 0.8 THEN 'High' WHEN top >= 0.5 THEN 'Medium' ELSE 'Low' END AS band FROM t""",
)
def theme_scores(spark, sf_dir):
    """Weight of each theme by its best insight, support and sections."""
    t = insights(spark, sf_dir).groupBy("area").agg(F.max("confidence").alias("top"), F.count("*").alias("n"), F.countDistinct("section").alias("sections"), F.bool_or(F.col("n_chars") > 1000).alias("quantified"))
    weight = F.col("top") * 0.65 + F.least(F.lit(0.15), 0.03 * (F.col("n") - 1)) + F.least(F.lit(0.15), 0.05 * (F.col("sections") - 1)) + F.when(F.col("quantified"), 0.05).otherwise(0)
    return t.select("area", "n", F.round(weight, 6).alias("evidence_weight"), F.when(F.col("top") >= 0.8, "High").when(F.col("top") >= 0.5, "Medium").otherwise("Low").alias("band"))


@registry.add(
    "coverage_gate",
    f"""WITH {_INSIGHT_SQL}, c AS (SELECT area, count(*) AS eligible, count(*) FILTER (WHERE confidence >= 0.65) AS mapped FROM insights GROUP BY area)
    SELECT area, eligible, mapped, CASE WHEN eligible = 0 THEN 'SKIPPED_NO_ELIGIBLE_SIGNALS' WHEN mapped < 0.5 * eligible THEN 'SKIPPED_INSUFFICIENT_COVERAGE' WHEN eligible - mapped > 0.25 * eligible OR eligible < 2 THEN 'ADMITTED_WITH_WARNING' ELSE 'ADMITTED' END AS status FROM c""",
)
def coverage_gate(spark, sf_dir):
    c = insights(spark, sf_dir).groupBy("area").agg(F.count("*").alias("eligible"), F.count_if(F.col("confidence") >= 0.65).alias("mapped"))
    status = F.when(F.col("eligible") == 0, "SKIPPED_NO_ELIGIBLE_SIGNALS").when(F.col("mapped") < 0.5 * F.col("eligible"), "SKIPPED_INSUFFICIENT_COVERAGE")
    return c.withColumn("status", status.when((F.col("eligible") - F.col("mapped") > 0.25 * F.col("eligible")) | (F.col("eligible") < 2), "ADMITTED_WITH_WARNING").otherwise("ADMITTED"))


@registry.add(
    "insight_conflicts",
    f"""WITH {_INSIGHT_SQL}, r AS (SELECT *, row_number() OVER w AS place, first_value(year) OVER w AS y1, nth_value(year, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y2, first_value(confidence) OVER w AS c1, nth_value(confidence, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c2 FROM insights WINDOW w AS (PARTITION BY area, section ORDER BY year DESC, confidence DESC, insight_id))
    SELECT area, section, insight_id, CASE WHEN place = 1 THEN 'winner' WHEN place = 2 AND y1 = y2 AND abs(c1 - c2) <= 0.05 + 1e-9 THEN 'kept' ELSE 'superseded' END AS state FROM r""",
)
def insight_conflicts(spark, sf_dir):
    """One winner for each area and section by year and confidence; a near tie keeps the runner-up."""
    best = F.max(F.struct("year", "confidence", (-F.col("insight_id")).alias("back")))
    rows, key = insights(spark, sf_dir), ["area", "section"]
    first = rows.groupBy(*key).agg(best.alias("one"))
    rest = rows.join(first, key).where(F.col("insight_id") != -F.col("one.back"))
    second = rest.groupBy(*key).agg(best.alias("two"))
    both = first.join(second, key, "left")
    tie = (F.col("one.year") == F.col("two.year")) & (F.abs(F.col("one.confidence") - F.col("two.confidence")) <= 0.05 + 1e-9) & (F.col("insight_id") == -F.col("two.back"))
    state = F.when(F.col("insight_id") == -F.col("one.back"), "winner").when(tie, "kept").otherwise("superseded")
    return rows.join(both, key).select("area", "section", "insight_id", state.alias("state"))
