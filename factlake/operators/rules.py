"""Smaller rules: label kinds, roles, taxonomy, citations, corroboration, source shortlists, claims."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.formulas import Formula, Input, evaluate
from ..registry import Registry
from ..sources.bridge import FACTS_SQL, OBS_SQL, WIDE_SQL, facts, observations, read, wide
from .evidence import _EVIDENCE_SQL, _INSIGHT_SQL, evidence, insights

registry = Registry()

_LABEL_SQL = "replace(CASE WHEN length(metric) % 3 = 0 THEN upper(metric) ELSE metric END, '_', ' ')"


def _labels(spark, sf_dir):
    shown = F.when(F.length("metric") % 3 == 0, F.upper("metric")).otherwise(F.col("metric"))
    return facts(spark, sf_dir).select("metric", F.replace(shown, F.lit("_"), F.lit(" ")).alias("label")).distinct()


@registry.add(
    "label_kinds",
    f"""WITH {FACTS_SQL}, l AS (SELECT DISTINCT metric, {_LABEL_SQL} AS label FROM facts), n AS (SELECT *, length(regexp_replace(label, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(label, '[^A-Z]', '', 'g')) AS caps FROM l)
    SELECT metric, label, letters < 3 OR caps >= 0.7 * letters AS is_header, regexp_matches(lower(label), '^(total|gross|net|profit)') AS is_total FROM n""",
)
def label_kinds(spark, sf_dir):
    """Headers by their share of capitals, totals by how they begin; each distinct label once."""
    return _labels(spark, sf_dir).select("metric", "label", T.is_section_header(F.col("label")).alias("is_header"), T.is_total_row(F.col("label")).alias("is_total"))


# Abbreviations and what they stand for.
ABBREVIATIONS = {"pvt": "private", "ltd": "limited", "co": "company", "ppe": "property plant equipment", "mfg": "manufacturing"}


@registry.add(
    "expanded_abbreviations",
    "SELECT s_suppkey, array_to_string(list_transform(string_split(q, ' '), lambda t: CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ABBREVIATIONS.items()) + " ELSE t END), ' ') AS name FROM (SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || CASE WHEN s_suppkey % 2 = 0 THEN ' pvt ltd' ELSE ' mfg co' END AS q FROM supplier)",
)
def expanded_abbreviations(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    q = F.concat(T.spaced(F.col("s_name")), F.when(F.col("s_suppkey") % 2 == 0, " pvt ltd").otherwise(" mfg co"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(F.split(q, " "), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ").alias("name"))


@registry.add(
    "entity_tokens",
    "SELECT c_custkey, list_distinct(list_filter(string_split(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 4 AND t NOT IN ('limited', 'company', 'customer'))) AS tokens FROM customer",
)
def entity_tokens(spark, sf_dir):
    """Distinctive tokens of a name: four characters or more, without stop words."""
    kept = F.filter(F.split(T.spaced(F.col("c_name")), " "), lambda t: (F.length(t) >= 4) & ~t.isin("limited", "company", "customer"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_distinct(kept).alias("tokens"))


@registry.add(
    "citation_precision",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'CELL' WHEN event_id % 4 = 1 THEN 'PAGE' WHEN event_id % 4 = 2 THEN 'REF' ELSE 'NONE' END AS precision, event_id % 4 <= 2 AS is_ok FROM events",
)
def citation_precision(spark, sf_dir):
    """Precision of a citation by the keys of its locator."""
    k = F.col("event_id") % 4
    keys = F.when(k == 0, F.create_map(F.lit("sheet"), F.lit("s"), F.lit("cell"), F.lit("B2"))).when(k == 1, F.create_map(F.lit("page"), F.lit("7"))).when(k == 2, F.create_map(F.lit("link"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    has = lambda name: F.map_contains_key("locator", name)
    precision = F.when(has("sheet") & has("cell"), "CELL").when(has("page"), "PAGE").when(has("link"), "REF").otherwise("NONE")
    return read(spark, sf_dir, "events").select("event_id", keys.alias("locator")).select("event_id", precision.alias("precision"), (precision != "NONE").alias("is_ok"))


@registry.add(
    "insight_slice",
    f"WITH {_INSIGHT_SQL} SELECT insight_id, area, year, confidence FROM insights WHERE lower(area) = 'src1' AND year >= 2018 AND confidence >= 0.6",
)
def insight_slice(spark, sf_dir, area: str = "SRC1", since: int = 2018, least: float = 0.6):
    rows = insights(spark, sf_dir).where((F.lower("area") == area.lower()) & (F.col("year") >= since) & (F.col("confidence") >= least))
    return rows.select("insight_id", "area", "year", "confidence")


@registry.add(
    "verified_provenance",
    "SELECT l.doc_id, l.quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars > 200)",
)
def verified_provenance(spark, sf_dir):
    """Findings whose source is among the texts that were supplied."""
    supplied = read(spark, sf_dir, "documents").where("n_chars > 200").select("doc_id")
    return read(spark, sf_dir, "labels").select("doc_id", "quality").join(supplied, "doc_id", "left_semi")


_FAMILY_SQL = "CASE WHEN metric IN ('total_assets', 'current_assets', 'non_current_assets', 'current_liabilities', 'non_current_liabilities', 'total_equity') THEN 'BS' WHEN metric IN ('operating_cash_flow', 'capex') THEN 'CF' WHEN metric IN ('depreciation_expense', 'shares_outstanding') THEN NULL ELSE 'P&L' END"


@registry.add(
    "family_quarantine",
    f"WITH {OBS_SQL}, t AS (SELECT entity, metric, value_year, report_year, value, {_FAMILY_SQL} AS family, CASE report_year % 3 WHEN 0 THEN 'P&L' WHEN 1 THEN 'BS' ELSE 'CF' END AS statement FROM obs) SELECT entity, metric, value_year, report_year, value, statement, CASE WHEN family IS NOT NULL AND family <> statement THEN 'quarantined' ELSE 'merged' END AS state FROM t",
)
def family_quarantine(spark, sf_dir):
    """Lines whose metric's family conflicts with their table's; an unknown family never blocks."""
    turn = F.col("report_year") % 3
    rows = observations(spark, sf_dir).withColumn("family", F.expr(_FAMILY_SQL)).withColumn("statement", F.when(turn == 0, "P&L").when(turn == 1, "BS").otherwise("CF"))
    state = F.when(F.col("family").isNotNull() & (F.col("family") != F.col("statement")), "quarantined").otherwise("merged")
    return rows.withColumn("state", state).drop("family")


@registry.add(
    "claim_enforcement",
    f"WITH {_EVIDENCE_SQL}, h AS (SELECT user_id, event_id, event_id % 4 <= 2 AS ok FROM evidence) SELECT user_id, count(*) AS findings, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE ok) = 0 AS insufficient FROM h GROUP BY user_id",
)
def claim_enforcement(spark, sf_dir):
    """Findings that resolve to a reference at least; an answer that loses all is insufficient."""
    h = evidence(spark, sf_dir).select("user_id", "event_id")
    valid = h.where("event_id % 4 <= 2").select("event_id", F.lit(True).alias("ok"))
    counted = h.join(valid, "event_id", "left").groupBy("user_id").agg(F.count("*").alias("findings"), F.count("ok").alias("kept"))
    return counted.withColumn("insufficient", F.col("kept") == 0)


@registry.add(
    "citation_resolution",
    f"""WITH {OBS_SQL}, f AS (SELECT entity, metric, value_year, report_year, value FROM obs QUALIFY row_number() OVER (PARTITION BY entity, metric, value_year ORDER BY report_year DESC) = 1), l AS (SELECT entity, metric, value_year, report_year, 'ledger' AS basis FROM obs WHERE report_year % 2 = 0),
    n AS (SELECT entity, metric, max(report_year) AS report_year FROM obs GROUP BY ALL)
    SELECT f.entity, f.metric, f.value_year, coalesce(l.report_year, n.report_year) AS cited_report, CASE WHEN l.report_year IS NOT NULL THEN 'ledger' WHEN n.report_year IS NOT NULL THEN 'note' ELSE 'cell' END AS basis FROM f LEFT JOIN l ON f.entity = l.entity AND f.metric = l.metric AND f.value_year = l.value_year AND f.report_year = l.report_year LEFT JOIN n ON f.entity = n.entity AND f.metric = n.metric""",
)
def citation_resolution(spark, sf_dir):
    """Each fact's citation: its ledger row, else its metric's newest report, else its cell."""
    rows = observations(spark, sf_dir)
    f = rows.groupBy("entity", "metric", "value_year").agg(F.max("report_year").alias("report_year"))
    ledger = rows.where("report_year % 2 = 0").select("entity", "metric", "value_year", "report_year", F.col("report_year").alias("l"))
    newest = rows.groupBy("entity", "metric").agg(F.max("report_year").alias("n"))
    both = f.join(ledger, ["entity", "metric", "value_year", "report_year"], "left").join(newest, ["entity", "metric"], "left")
    basis = F.when(F.col("l").isNotNull(), "ledger").when(F.col("n").isNotNull(), "note").otherwise("cell")
    return both.select("entity", "metric", "value_year", F.coalesce("l", "n").alias("cited_report"), basis.alias("basis"))


@registry.add(
    "corroboration",
    f"""WITH {WIDE_SQL}, x AS (SELECT entity, value_year AS year, metric, arg_min(value, report_year) AS external FROM obs WHERE metric IN ('revenue', 'pat', 'total_assets') GROUP BY ALL),
    u AS (SELECT entity, year, 'revenue' AS metric, revenue AS internal FROM wide UNION ALL SELECT entity, year, 'pat', pat FROM wide UNION ALL SELECT entity, year, 'total_assets', total_assets FROM wide) SELECT u.*, external, abs(internal - external) <= 0.05 * greatest(abs(internal), abs(external), 1) AS agrees FROM u JOIN x USING (entity, year, metric) WHERE internal IS NOT NULL""",
)
def corroboration(spark, sf_dir):
    """Internal values against yearly external actuals after an unpivot."""
    names = ["revenue", "pat", "total_assets"]
    internal = wide(spark, sf_dir, names).unpivot(["entity", "year"], names, "metric", "internal").where("internal IS NOT NULL")
    external = observations(spark, sf_dir, names).groupBy("entity", F.col("value_year").alias("year"), "metric").agg(F.min_by("value", "report_year").alias("external"))
    return internal.join(external, ["entity", "year", "metric"]).withColumn("agrees", F.abs(F.col("internal") - F.col("external")) <= 0.05 * F.greatest(F.abs("internal"), F.abs("external"), F.lit(1.0)))


@registry.add(
    "source_shortlist",
    """WITH q AS (SELECT DISTINCT p_name AS q, unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 2))) AS t FROM part), a AS (SELECT DISTINCT p_brand AS api, unnest(list_distinct(string_split(lower(p_type), ' '))) AS t, true AS provides FROM part WHERE p_size % 2 = 0
      UNION SELECT DISTINCT p_brand, unnest(list_distinct(string_split(lower(p_name), ' '))), false FROM part), s AS (SELECT q, api, 2 * count(DISTINCT CASE WHEN provides THEN t END) + count(DISTINCT t) AS score FROM q JOIN a USING (t) GROUP BY ALL)
    SELECT q, api, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, api) AS INT) AS place FROM s QUALIFY place <= 3""",
)
def source_shortlist(spark, sf_dir, k: int = 3):
    """The k sources whose provided and other tokens overlap a query most."""
    p = read(spark, sf_dir, "part")
    tokens = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), " "))).alias("t")
    q = p.select(F.col("p_name").alias("q")).distinct().select("q", tokens("q")).where(F.length("t") > 2)
    provides = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("api"), "p_type").distinct().select("api", tokens("p_type"), F.lit(True).alias("provides")).distinct()
    others = p.select(F.col("p_brand").alias("api"), "p_name").distinct().select("api", tokens("p_name"), F.lit(False).alias("provides")).distinct()
    terms = provides.unionByName(others).groupBy("api", "t").agg(F.bool_or("provides").alias("provides"))
    scored = q.join(terms, "t").groupBy("q", "api").agg((2 * F.count_if("provides") + F.count("*")).alias("score"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "api"))).where(F.col("place") <= k)


@registry.add(
    "table_roles",
    f"""WITH {OBS_SQL}, t AS (SELECT entity, report_year, list_sort(list(DISTINCT metric)) AS metrics, count(*) AS n FROM obs GROUP BY ALL) SELECT entity, report_year, CASE WHEN list_has_all(metrics, ['current_assets', 'revenue', 'total_assets']) THEN 'primary' WHEN list_contains(metrics, 'revenue') THEN 'note' ELSE 'analytical' END AS role, len(metrics) AS metrics FROM t""",
)
def table_roles(spark, sf_dir):
    """A table's role by the metrics that it holds; metrics are a short list."""
    t = observations(spark, sf_dir).groupBy("entity", "report_year").agg(F.collect_set("metric").alias("m"))
    primary = F.size(F.array_intersect("m", F.array(*map(F.lit, ("current_assets", "revenue", "total_assets"))))) == 3
    return t.select("entity", "report_year", F.when(primary, "primary").when(F.array_contains("m", "revenue"), "note").otherwise("analytical").alias("role"), F.size("m").cast("long").alias("metrics"))


@registry.add("documents_by_kind", "SELECT source, lang, count(*) AS documents, count(*) FILTER (WHERE n_chars < 40) AS scanned, count(*) FILTER (WHERE n_chars < 40) > count(*) / 2.0 AS is_scanned FROM documents GROUP BY ALL")
def documents_by_kind(spark, sf_dir):
    short = F.count_if(F.col("n_chars") < 40)
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), short.alias("scanned"), (short > F.count("*") / 2).alias("is_scanned"))


AD_HOC = Formula("ad_hoc", "ad_hoc", "(revenue - abs(cost_of_sales)) / total_assets", (Input("revenue", "revenue"), Input("cost_of_sales", "cost_of_sales"), Input("total_assets", "total_assets")), "total_assets <> 0")


@registry.add("ad_hoc_expression", f"WITH {WIDE_SQL} SELECT entity, year, (revenue - abs(cost_of_sales)) / total_assets AS value FROM wide WHERE revenue IS NOT NULL AND cost_of_sales IS NOT NULL AND total_assets <> 0")
def ad_hoc_expression(spark, sf_dir):
    """An expression over metric names for each year that has all of its inputs."""
    return evaluate(wide(spark, sf_dir, ["revenue", "cost_of_sales", "total_assets"]), AD_HOC).where("value IS NOT NULL").select("entity", "year", "value")


@registry.add(
    "insight_relevance",
    f"""WITH {_INSIGHT_SQL}, s AS (SELECT insight_id, area, year, CASE WHEN contains(area, '1') AND section = 'en' THEN 0.75 WHEN contains(area, '1') THEN 0.7 WHEN section = 'en' THEN 0.55 ELSE 0.0 END AS signal, greatest(0.0, 1 - (2023 - year) / 10.0) AS temporal FROM insights), r AS (SELECT *, round(0.7 * signal + 0.3 * temporal, 6) AS relevance FROM s)
    SELECT insight_id, area, relevance, CAST(row_number() OVER (PARTITION BY area ORDER BY relevance DESC, insight_id) AS INT) AS place FROM r WHERE relevance >= 0.65 QUALIFY place <= 25""",
)
def insight_relevance(spark, sf_dir, least: float = 0.65, k: int = 25):
    """Insights by signal and age, those of at least `least`, the k best of each area."""
    hit, english = F.contains("area", F.lit("1")), F.col("section") == "en"
    signal = F.when(hit & english, 0.75).when(hit, 0.7).when(english, 0.55).otherwise(0.0)
    relevance = F.round(0.7 * signal + 0.3 * F.greatest(F.lit(0.0), 1 - (2023 - F.col("year")) / 10.0), 6)
    rows = insights(spark, sf_dir).select("insight_id", "area", relevance.alias("relevance")).where(F.col("relevance") >= least)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("area").orderBy(F.desc("relevance"), "insight_id"))).where(F.col("place") <= k)


@registry.add(
    "recent_titles",
    "WITH t AS (SELECT user_id, event_type, max(ts) AS ts, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS INT) AS place FROM t QUALIFY place <= 3",
)
def recent_titles(spark, sf_dir, k: int = 3):
    """Without vectors: titles once each, the newest k."""
    t = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    return t.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_type"))).where(F.col("place") <= k).drop("ts")


@registry.add(
    "headline_override",
    f"""WITH {OBS_SQL}, e AS (SELECT entity, metric, value_year AS year, arg_min(value, report_year) AS shown, arg_max(value, report_year) AS truth FROM obs WHERE metric IN ('revenue', 'cost_of_sales', 'pat') GROUP BY ALL),
    s AS (SELECT entity, metric, year, shown, CASE WHEN metric = 'cost_of_sales' THEN -abs(truth) ELSE truth END AS truth FROM e) SELECT *, CASE WHEN abs(shown - truth) > 0.5 THEN truth ELSE shown END AS value, abs(shown - truth) > 0.5 AS overridden FROM s""",
)
def headline_override(spark, sf_dir):
    """Headline cells that differ from the truth, by its metric's sign, by more than one half."""
    e = observations(spark, sf_dir, ["revenue", "cost_of_sales", "pat"]).groupBy("entity", "metric", F.col("value_year").alias("year")).agg(F.min_by("value", "report_year").alias("shown"), F.max_by("value", "report_year").alias("t"))
    e = e.withColumn("truth", F.when(F.col("metric") == "cost_of_sales", -F.abs("t")).otherwise(F.col("t"))).drop("t")
    off = F.abs(F.col("shown") - F.col("truth")) > 0.5
    return e.withColumns({"value": F.when(off, F.col("truth")).otherwise(F.col("shown")), "overridden": off})


@registry.add(
    "answer_invariants",
    f"""WITH {_EVIDENCE_SQL}, a AS (SELECT user_id, count(DISTINCT source || as_of) AS citations, max(event_id % 12) + 1 AS highest_handle FROM evidence GROUP BY user_id) SELECT user_id, citations, citations > 0 AND highest_handle <= citations AS valid FROM a""",
)
def answer_invariants(spark, sf_dir):
    """No handle of an answer points past its citations."""
    a = evidence(spark, sf_dir).groupBy("user_id").agg(F.countDistinct(F.concat("source", F.col("as_of").cast("string"))).alias("citations"), (F.max(F.col("event_id") % 12) + 1).alias("handle"))
    return a.select("user_id", "citations", ((F.col("citations") > 0) & (F.col("handle") <= F.col("citations"))).alias("valid"))


@registry.add(
    "record_claims",
    "SELECT c_custkey, left(array_to_string(list_filter([c_name, nullif(c_mktsegment, ''), CASE WHEN c_acctbal > 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END], lambda x: x IS NOT NULL), '; '), 300) AS claim FROM customer",
)
def record_claims(spark, sf_dir):
    """Records as one line of their filled fields, in order of priority, up to 300 characters."""
    fields = F.array_compact(F.array("c_name", F.nullif("c_mktsegment", F.lit("")), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("long").cast("string"))))
    return read(spark, sf_dir, "customer").select("c_custkey", F.substring(F.array_join(fields, "; "), 1, 300).alias("claim"))
