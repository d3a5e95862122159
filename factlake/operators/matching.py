"""Labels, themes, sectors, questions and feeds matched to what is known.

Each operator takes DataFrames; the queries below apply them to rows of the given tables.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import FACTS_SQL, facts, observations, read
from ..sources.scratch import remove, saved
from .assignment import assign
from .similar import resolve_labels, similar_pairs

registry = Registry()

#: Categories that a section may tell of, the first before the others.
SECTION_PRIORS = {
    "chairman review": ("outlook", ["strategy", "governance"]),
    "ceo review": ("outlook", ["strategy"]),
    "directors report": ("governance", ["outlook", "strategy"]),
    "management discussion and analysis": ("strategy", ["outlook", "business_risk"]),
    "business review": ("strategy", ["operational_risk", "outlook"]),
    "risks": ("business_risk", ["operational_risk"]),
    "opportunities": ("strategy", ["outlook"]),
    "outlook": ("outlook", []),
    "strategy": ("strategy", ["outlook"]),
    "financial review": ("business_risk", ["outlook"]),
    "sustainability": ("esg", []),
    "esg": ("esg", []),
}
MACRO_UNITS = {"policy_rate": "percent", "inflation": "percent", "fx_usd_pkr": "PKR/USD", "gdp_growth": "percent"}
#: Wordings of profits that are one metric, of profit alone, and the metrics that it may mean.
PROFIT_QUALIFIED = r"gross profit|operating profit|net (income|profit)|profit after tax|profit before tax|\bpat\b|\bpbt\b|ebit"
PROFIT_BARE = r"\bprofit(s|ability)?\b"
PROFIT_CANDIDATES = ("gross_profit", "operating_profit", "pat")


def fuzzy_labels(labels: DataFrame, known: DataFrame, least: float = 90.0, kind: str = "ratio") -> DataFrame:
    """(label, metric, score) of labels (label) that no name of known (name, metric) equals but one resembles."""
    return resolve_labels(labels, known, least, kind).where("method = 'fuzzy'").select("label", "metric", "score")


@registry.add("label_to_metric_fuzzy")
def label_to_metric_fuzzy(spark, sf_dir):
    """Part names with a letter lost or doubled against the part names themselves."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey") % 3
    torn = F.when(k == 0, F.regexp_replace("p_name", "a", "")).when(k == 1, F.regexp_replace("p_name", "e", "ee")).otherwise(F.concat(F.lit("adjusted "), F.col("p_name")))
    return fuzzy_labels(p.select(torn.alias("label")), p.select(F.col("p_name").alias("name"), F.col("p_name").alias("metric")).distinct())


def theme_mapping(insights: DataFrame, themes: DataFrame, phrases: DataFrame) -> DataFrame:
    """(*, theme, category, method, confidence, section_conflict) of insights (area, takeaway, section, extraction).

    themes: (theme, category, secondary); phrases: (phrase, theme), aliases and example labels.
    The area is a theme's name (1.0), else a phrase (0.9), else area and takeaway contain a
    phrase (0.65), the longest, ties by phrase; else the section names the category. The
    least of mapping, extraction and, for a known section, 0.9 counts, less 0.15 where the
    section tells of other categories.
    """
    row = insights.withColumns({"row__id": F.xxhash64(F.to_json(F.struct(*insights.columns))), "area__key": T.normalize_text(F.col("area")), "section__key": T.normalize_text(F.col("section"))})
    row = row.withColumn("hay", F.concat(F.lit(" "), F.trim(F.concat_ws(" ", "area__key", T.normalize_text(F.col("takeaway")))), F.lit(" ")))
    exact = themes.select(T.normalize_text(F.col("theme")).alias("exact__key"), F.col("theme").alias("exact"))
    aliases = phrases.select(T.normalize_text(F.col("phrase")).alias("alias__key"), "theme").where("alias__key <> ''").groupBy("alias__key").agg(F.min("theme").alias("alias"))
    row = row.join(exact, F.col("area__key") == F.col("exact__key"), "left").join(aliases, F.col("area__key") == F.col("alias__key"), "left")
    # phrases that the text contains: an equi join on the first word, then the whole phrase
    firsts = aliases.select(F.element_at(F.split("alias__key", " "), 1).alias("word"), F.col("alias__key").alias("found"), F.col("alias").alias("found_theme"))
    open_rows = row.where("exact IS NULL AND alias IS NULL").select("row__id", "hay").distinct()
    held = open_rows.withColumn("word", F.explode(F.array_distinct(F.split(F.trim("hay"), " ")))).join(firsts, "word").where(F.contains("hay", F.concat(F.lit(" "), F.col("found"), F.lit(" "))))
    longest = held.groupBy("row__id").agg(F.min(F.struct((-F.length("found")).alias("n"), "found", "found_theme")).alias("x")).select("row__id", F.col("x.found_theme").alias("keyword"))
    row = row.join(longest, "row__id", "left").withColumn("theme", F.coalesce("exact", "alias", "keyword"))
    row = row.withColumn("method", F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("keyword").isNotNull(), "keyword").otherwise("unmapped"))
    row = row.join(themes.select(F.col("theme").alias("of_theme"), F.col("category").alias("of_category"), F.col("secondary").alias("of_secondary")), F.col("theme") == F.col("of_theme"), "left")
    prior = F.create_map(*(x for k, (p, s) in SECTION_PRIORS.items() for x in (F.lit(k), F.array(*map(F.lit, [p, *s])))))
    row = row.withColumn("tells", F.try_element_at(prior, F.col("section__key")))
    known = F.col("tells").isNotNull()
    conflict = known & F.col("theme").isNotNull() & ~F.array_contains("tells", F.col("of_category")) & ~F.arrays_overlap(F.coalesce("of_secondary", F.array().cast("array<string>")), F.coalesce("tells", F.array().cast("array<string>")))
    conflict = F.coalesce(conflict, F.lit(False))
    mapping = F.when(F.col("method") == "exact", 1.0).when(F.col("method") == "alias", 0.9).when(F.col("method") == "keyword", 0.65).otherwise(0.0)
    confidence = F.least(mapping, F.coalesce("extraction", F.lit(1.0)), F.when(known, 0.9).otherwise(1.0))
    confidence = F.when(F.col("theme").isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), confidence - F.when(conflict, 0.15).otherwise(0.0)), 6))
    category = F.when(F.col("theme").isNotNull(), F.col("of_category")).otherwise(F.element_at("tells", 1))
    return row.select(*insights.columns, "theme", category.alias("category"), "method", confidence.alias("confidence"), conflict.alias("section_conflict"))


@registry.add(
    "theme_mapping",
    """WITH p AS (SELECT p_partkey, p_name, p_size, string_split(lower(p_name), ' ') AS w FROM part), i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN w[1] WHEN 2 THEN 'about ' || w[2] ELSE 'nothing' END AS area, CASE p_partkey % 3 WHEN 0 THEN 'Outlook' WHEN 1 THEN 'ESG' ELSE 'other' END AS section, p_size / 50.0::DOUBLE AS extraction, w, p_name FROM p),
    f AS (SELECT w[1] AS word, min(p_name) AS theme FROM p GROUP BY w[1]), s AS (SELECT w[2] AS word, min(p_name) AS theme FROM p GROUP BY w[2]),
    m AS (SELECT i.*, CASE p_partkey % 4 WHEN 0 THEN i.p_name WHEN 1 THEN f.theme WHEN 2 THEN s.theme END AS theme, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'keyword' ELSE 'unmapped' END AS method FROM i JOIN f ON f.word = w[1] JOIN s ON s.word = w[2]),
    c AS (SELECT *, CASE WHEN length(theme) % 2 = 0 THEN 'outlook' ELSE 'strategy' END AS cat, section <> 'other' AS known FROM m),
    d AS (SELECT *, coalesce(theme IS NOT NULL AND known AND NOT (section = 'Outlook' AND cat = 'outlook'), false) AS section_conflict FROM c)
    SELECT p_partkey, theme, CASE WHEN theme IS NOT NULL THEN cat WHEN section = 'Outlook' THEN 'outlook' WHEN section = 'ESG' THEN 'esg' END AS category, method,
      CASE WHEN theme IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(CASE method WHEN 'exact' THEN 1.0::DOUBLE WHEN 'alias' THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END, extraction, CASE WHEN known THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) - CASE WHEN section_conflict THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END), 6) END AS confidence, section_conflict FROM d""",
)
def theme_mapping_query(spark, sf_dir):
    """Part names as themes, their words as aliases and keywords."""
    p = read(spark, sf_dir, "part").withColumn("w", F.split(F.lower("p_name"), " "))
    word = lambda n: F.element_at("w", n)
    themes = p.select(F.col("p_name").alias("theme"), F.when(F.length("p_name") % 2 == 0, "outlook").otherwise("strategy").alias("category"), F.array().cast("array<string>").alias("secondary")).distinct()
    phrases = p.groupBy(word(1).alias("phrase")).agg(F.min("p_name").alias("theme")).union(p.groupBy(word(2).alias("phrase")).agg(F.min("p_name").alias("theme")))
    k = F.col("p_partkey")
    area = F.when(k % 4 == 0, F.lower("p_name")).when(k % 4 == 1, word(1)).when(k % 4 == 2, F.concat(F.lit("about "), word(2))).otherwise("nothing")
    section = F.when(k % 3 == 0, "Outlook").when(k % 3 == 1, "ESG").otherwise("other")
    rows = p.select("p_partkey", area.alias("area"), F.lit(None).cast("string").alias("takeaway"), section.alias("section"), (F.col("p_size") / 50.0).alias("extraction"))
    return theme_mapping(rows, themes, phrases).select("p_partkey", "theme", "category", "method", "confidence", "section_conflict")


def metric_availability(questions: DataFrame, matcher: list[tuple[str, str]], available: DataFrame) -> DataFrame:
    """(*, resolved, available, clarify, candidates) of questions (entity, text).

    matcher: (pattern, metric) in order; available: (entity, metrics). The first metric named
    is meant; one that is not there gives way to the first named that is. A bare profit with
    two or more senses there asks for clarification.
    """
    low = F.lower("text")
    named = F.array_compact(F.array(*(F.when(low.rlike(pattern), metric) for pattern, metric in matcher)))
    row = questions.join(available, "entity", "left").withColumns({"named__all": F.array_distinct(named), "there__all": F.coalesce("metrics", F.array().cast("array<string>"))})
    meant = F.try_element_at("named__all", F.lit(1))
    there = lambda m: F.array_contains("there__all", m)
    other = F.try_element_at(F.filter("named__all", there), F.lit(1))
    candidates = F.filter(F.array(*map(F.lit, PROFIT_CANDIDATES)), there)
    bare = low.rlike(PROFIT_BARE) & ~low.rlike(PROFIT_QUALIFIED)
    shown = F.when(bare, candidates).otherwise(F.array().cast("array<string>"))
    return row.select(*questions.columns, F.coalesce(other, meant).alias("resolved"), F.coalesce(there(F.coalesce(other, meant)), F.lit(False)).alias("available"), (bare & (F.size(candidates) >= 2)).alias("clarify"), shown.alias("candidates"))


_ASKED = ["revenue", "gross_profit", "pat", "total_assets", "capex"]


@registry.add(
    "metric_availability",
    f"""WITH {FACTS_SQL}, a AS (SELECT entity, list(DISTINCT metric) AS metrics FROM facts WHERE entity < 'NATION_2' OR metric IN ('revenue', 'capex', 'pat') GROUP BY entity),
    q AS (SELECT n_name AS entity, unnest(['how did revenue do', 'is the profit fine', 'gross profit against capex', 'total assets please', 'tell me more']) AS text FROM nation),
    m AS (SELECT q.*, coalesce(metrics, []) AS there, CASE text WHEN 'how did revenue do' THEN ['revenue'] WHEN 'gross profit against capex' THEN ['gross_profit', 'capex'] WHEN 'total assets please' THEN ['total_assets'] ELSE [] END AS named FROM q LEFT JOIN a USING (entity)),
    r AS (SELECT *, coalesce(list_filter(named, lambda x: list_contains(there, x))[1], named[1]) AS resolved, list_filter(['gross_profit', 'operating_profit', 'pat'], lambda x: list_contains(there, x)) AS senses FROM m)
    SELECT entity, text, resolved, coalesce(list_contains(there, resolved), false) AS available, text = 'is the profit fine' AND len(senses) >= 2 AS clarify, CASE WHEN text = 'is the profit fine' THEN array_to_string(senses, ',') ELSE '' END AS candidates FROM r""",
)
def metric_availability_query(spark, sf_dir):
    known = facts(spark, sf_dir).select("entity", "metric").where((F.col("entity") < "NATION_2") | F.col("metric").isin("revenue", "capex", "pat"))
    texts = ["how did revenue do", "is the profit fine", "gross profit against capex", "total assets please", "tell me more"]
    questions = read(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.explode(F.array(*map(F.lit, texts))).alias("text"))
    matcher = [(rf"\b{m.replace('_', ' ')}\b", m) for m in _ASKED]
    out = metric_availability(questions, matcher, known.groupBy("entity").agg(F.collect_set("metric").alias("metrics")))
    return out.withColumn("candidates", F.array_join("candidates", ","))


def entity_gate(articles: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Articles (key, text) that mention a token of their key at the start of a word; keys without tokens keep all.

    tokens: (key, tokens), lower-cased.
    """
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    held = articles.join(tokens.withColumnRenamed("tokens", "gate__tokens"), key, "left")
    mentioned = F.exists("gate__tokens", lambda t: F.contains(low, F.concat(F.lit(" "), t)))
    return held.where(F.coalesce(mentioned, F.lit(True))).drop("gate__tokens")


@registry.add(
    "entity_gate",
    """WITH t AS (SELECT conv_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 6)) AS tokens FROM (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1))
    SELECT conv_id, turn, role FROM conversations c JOIN t USING (conv_id) WHERE tokens IS NULL OR len(list_filter(tokens, lambda k: contains(' ' || regexp_replace(lower(coalesce(c.text, '')), '[^a-z0-9]+', ' ', 'g'), ' ' || k))) > 0""",
)
def entity_gate_query(spark, sf_dir):
    """Turns that mention a longer word of the first turn of their conversation."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = c.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("f")).select("conv_id", F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("f.text"), "[^a-z0-9]+", " "), " "), lambda x: F.length(x) >= 6)).alias("tokens"))
    return entity_gate(c, first, "conv_id").select("conv_id", "turn", "role")


def sector_codes(asked: DataFrame, sectors: DataFrame) -> DataFrame:
    """(query, code) of queries: a code, else an exact name in any case, else the first sector, in order, whose name contains it.

    sectors: (place, code, name), a short list that is joined by each rung in turn.
    """
    q = asked.select("query").distinct().withColumns({"q__code": F.trim("query"), "q__low": F.lower(F.trim("query"))})
    codes = sectors.select(F.col("code").alias("by_code"))
    names = sectors.groupBy(F.lower("name").alias("name__low")).agg(F.min_by("code", "place").alias("by_name"))
    q = q.join(codes, F.col("q__code") == F.col("by_code"), "left").join(names, F.col("q__low") == F.col("name__low"), "left")
    # a part of a name as long as the query: equi join on every piece of the short list's names of that length
    pieces = sectors.withColumn("low", F.lower("name")).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("low")))).withColumn("n", F.explode(F.expr("sequence(1, length(low) - at + 1)")))
    pieces = pieces.groupBy(F.substring("low", F.col("at"), F.col("n")).alias("piece")).agg(F.min_by("code", "place").alias("by_piece"))
    q = q.join(pieces, F.col("q__low") == F.col("piece"), "left")
    return q.select("query", F.coalesce("by_code", "by_name", "by_piece").alias("code"))


def of_sector(rows: DataFrame, query: str | None, sectors: DataFrame) -> DataFrame:
    """Rows (sector_code, sector) of the sector that a query names; of an unknown one those whose sector contains it; all for an empty one."""
    if not (query or "").strip():
        return rows
    asked = sector_codes(rows.sparkSession.createDataFrame([(query,)], "query string"), sectors).select(F.col("code").alias("asked__code"))
    held = rows.join(F.broadcast(asked))  # one row
    return held.where(F.coalesce(F.col("sector_code") == F.col("asked__code"), F.contains(F.lower(F.coalesce("sector", F.lit(""))), F.lit(query.strip().lower())))).drop("asked__code")


_SECTOR_ASKS_SQL = """a AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 4, '0') WHEN 1 THEN lower(n_name) WHEN 2 THEN substr(n_name, 2, 3) ELSE 'nothing ' || n_name END AS query FROM nation)"""


@registry.add(
    "sector_codes",
    f"""WITH {_SECTOR_ASKS_SQL}, s AS (SELECT n_nationkey AS place, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code, n_name AS name FROM nation)
    SELECT query, coalesce((SELECT code FROM s WHERE code = query), (SELECT first(code ORDER BY place) FROM s WHERE lower(name) = lower(query)), (SELECT first(code ORDER BY place) FROM s WHERE contains(lower(name), lower(query)))) AS code FROM (SELECT DISTINCT query FROM a)""",
)
def sector_codes_query(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    k, code = F.col("n_nationkey"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")
    asked = F.when(k % 4 == 0, code).when(k % 4 == 1, F.lower("n_name")).when(k % 4 == 2, F.substring("n_name", 2, 3)).otherwise(F.concat(F.lit("nothing "), F.col("n_name")))
    return sector_codes(n.select(asked.alias("query")), n.select(k.alias("place"), code.alias("code"), F.col("n_name").alias("name")))


@registry.add("sector_rows", """SELECT s_suppkey, n_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = (SELECT first(n_name ORDER BY n_nationkey) FROM nation WHERE contains(lower(n_name), 'on_1'))""")
def sector_rows(spark, sf_dir):
    """Suppliers of the first nation whose name contains 'on_1'."""
    n = read(spark, sf_dir, "nation")
    code = F.lpad(F.col("n_nationkey").cast("string"), 4, "0")
    rows = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", code.alias("sector_code"), F.col("n_name").alias("sector"))
    return of_sector(rows, "ON_1", n.select(F.col("n_nationkey").alias("place"), code.alias("code"), F.col("n_name").alias("name"))).select("s_suppkey", "sector")


def symbols_master(raw: DataFrame) -> DataFrame:
    """(symbol, name, sector, is_etf, is_debt, is_gem) from JSON texts (json): a list, or an object with a list as data; rows without a symbol go."""
    item = "struct<symbol:string,name:string,sectorName:string,isETF:boolean,isDebt:boolean,isGEM:boolean>"
    listed = F.coalesce(F.from_json("json", f"array<{item}>"), F.from_json("json", f"struct<data:array<{item}>>")["data"])
    bare = F.trim("json").startswith("[")
    listed = F.when(bare, F.from_json("json", f"array<{item}>")).otherwise(F.from_json("json", f"struct<data:array<{item}>>")["data"])
    x = raw.select(F.explode(listed).alias("x")).where(F.trim(F.coalesce("x.symbol", F.lit(""))) != "")
    flag = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(False))
    return x.select(F.trim("x.symbol").alias("symbol"), F.col("x.name").alias("name"), F.col("x.sectorName").alias("sector"), flag("isETF").alias("is_etf"), flag("isDebt").alias("is_debt"), flag("isGEM").alias("is_gem"))


@registry.add(
    "symbols_master",
    """SELECT 'S' || s_suppkey AS symbol, s_name AS name, n_name AS sector, s_suppkey % 3 = 0 AS is_etf, false AS is_debt, false AS is_gem FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0""",
)
def symbols_master_query(spark, sf_dir):
    """Suppliers of each nation as a document of the feed, every other one with its list as data."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    item = F.struct(F.when(k % 7 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("sectorName"), F.when(k % 3 == 0, F.lit(True)).alias("isETF"))
    lists = s.groupBy("n_nationkey").agg(F.collect_list(item).alias("data"))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data")))
    return symbols_master(lists.select(text.alias("json")))


def symbol_rows(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (symbol) whose symbol is asked for, in any case."""
    asked = symbols.select(F.upper(F.trim("symbol")).alias("asked__symbol")).distinct()
    return rows.join(asked, F.upper(F.trim("symbol")) == F.col("asked__symbol"), "left_semi")


@registry.add("symbol_rows", """SELECT 'S' || s_suppkey AS symbol, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def symbol_rows_query(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name"))
    asked = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit(" s"), F.col("c_custkey").cast("string")).alias("symbol"))
    return symbol_rows(s, asked)


def macro_rows(raw: DataFrame) -> DataFrame:
    """(*, indicator, value, unit) from JSON maps (json), bare or as indicators; nulls go."""
    bare, inner = F.from_json("json", "map<string,double>"), F.from_json("json", "struct<indicators:map<string,double>>")["indicators"]
    units = F.create_map(*(F.lit(x) for kv in MACRO_UNITS.items() for x in kv))
    out = raw.select("*", F.explode(F.coalesce(inner, bare)).alias("indicator", "value")).where("value IS NOT NULL").drop("json")
    return out.withColumn("unit", F.coalesce(F.try_element_at(units, F.col("indicator")), F.lit("value")))


@registry.add(
    "macro_rows",
    """SELECT event_id, unnest(['policy_rate', 'gdp']) AS indicator, unnest([value, CAST(user_id AS DOUBLE)]) AS value, unnest(['percent', 'value']) AS unit FROM events""",
)
def macro_rows_query(spark, sf_dir):
    """Events as answers of a feed, every other one with its map as indicators; null values are left out."""
    e = read(spark, sf_dir, "events")
    inner = F.struct(F.col("value").alias("policy_rate"), F.col("user_id").cast("double").alias("gdp"), F.lit(None).cast("double").alias("inflation"))
    text = F.when(F.col("event_id") % 2 == 0, F.to_json(inner)).otherwise(F.to_json(F.struct(inner.alias("indicators"))))
    return macro_rows(e.where("value IS NOT NULL").select("event_id", text.alias("json")))


def forecasts(asked: DataFrame, overrides: DataFrame, forecasted: DataFrame) -> DataFrame:
    """(entity, metric, year, value, origin) of asked (entity, metric, year): an override, else the forecast among the facts; others have no row."""
    key = ["entity", "metric", "year"]
    both = asked.join(overrides.withColumnRenamed("value", "over"), key, "left").join(forecasted.withColumnRenamed("value", "fact"), key, "left")
    return both.select(*key, F.coalesce("over", "fact").alias("value"), F.when(F.col("over").isNotNull(), "repository").otherwise("workbook").alias("origin")).where("value IS NOT NULL")


@registry.add(
    "forecasts",
    f"""WITH {FACTS_SQL}, o AS (SELECT entity, metric, value_year AS year, arg_min(value, report_year) AS value FROM obs WHERE metric = 'revenue' GROUP BY ALL)
    SELECT a.entity, a.metric, a.year, coalesce(o.value, f.value) AS value, CASE WHEN o.value IS NOT NULL THEN 'repository' ELSE 'workbook' END AS origin
    FROM (SELECT entity, metric, year FROM facts WHERE metric IN ('revenue', 'capex', 'pat')) a LEFT JOIN o USING (entity, metric, year) LEFT JOIN (SELECT * FROM facts WHERE year >= 1996) f USING (entity, metric, year) WHERE coalesce(o.value, f.value) IS NOT NULL""",
)
def forecasts_query(spark, sf_dir):
    """Facts from 1996 on as the workbook's forecasts, first reports of revenue as overrides."""
    f = facts(spark, sf_dir).select("entity", "metric", "year", "value").where(F.col("metric").isin("revenue", "capex", "pat"))
    first = observations(spark, sf_dir, ["revenue"]).groupBy("entity", "metric", F.col("value_year").alias("year")).agg(F.min_by("value", "report_year").alias("value"))
    return forecasts(f.select("entity", "metric", "year"), first, f.where("year >= 1996"))


def stated_forecast(text: Column, latest: Column) -> Column:
    """The target that a text states as a growth in percent of the latest value; null without one."""
    percent = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(-?[0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).cast("double")
    return latest * (1 + percent / 100.0)


@registry.add("stated_forecast", """SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice * (1 + (CASE WHEN p_size % 3 = 1 THEN CAST(p_size AS DOUBLE) ELSE -(p_size + 0.5) END) / 100.0::DOUBLE) END AS target FROM part""")
def stated_forecast_query(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("is a "), size, F.lit(" % growth forecast fine"))).when(F.col("p_size") % 3 == 2, F.concat(F.lit("what if it is -"), size, F.lit(".5%?"))).otherwise("what next")
    return p.select("p_partkey", stated_forecast(text, F.col("p_retailprice")).alias("target"))


def number_tokens(text: Column) -> Column:
    """Numbers of prose as structs (token, magnitude, is_percent, is_integer); citation handles and units are no numbers."""
    # fixed values: the forms of handles, units and numbers
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[C[0-9]+\]", " "), r"(?i)Rs\s*'?\s*000|Rupees in thousand|PKR", " ")
    tokens = F.transform(F.regexp_extract_all(cleaned, F.lit(r"-?[0-9][0-9,]*(?:\.[0-9]+)?\s*[%x]?"), F.lit(0)), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))

    def parsed(t: Column) -> Column:
        core = F.regexp_replace(t, "[%x, ]", "")
        percent = t.endswith("%")
        value = core.try_cast("double")
        return F.struct(t.alias("token"), F.when(percent, value / 100.0).otherwise(value).alias("magnitude"), percent.alias("is_percent"), (~F.contains(core, F.lit(".")) & ~percent & ~t.endswith("x")).alias("is_integer"))

    return F.transform(tokens, parsed)


@registry.add(
    "number_tokens",
    r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\[C[0-9]+\]', ' ', 'g'), '(?i)Rs\s*''?\s*000|Rupees in thousand|PKR', ' ', 'g') AS t FROM documents),
    x AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_extract_all(t, '-?[0-9][0-9,]*(?:\.[0-9]+)?\s*[%x]?')), '\s+', ' ', 'g')) AS token FROM c),
    p AS (SELECT *, regexp_replace(token, '[%x, ]', '', 'g') AS core, token LIKE '%\%' ESCAPE '\' AS is_percent FROM x)
    SELECT doc_id, token, CASE WHEN is_percent THEN TRY_CAST(core AS DOUBLE) / 100.0 ELSE TRY_CAST(core AS DOUBLE) END AS magnitude, is_percent, NOT contains(core, '.') AND NOT is_percent AND NOT token LIKE '%x' AS is_integer FROM p""",
)
def number_tokens_query(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(number_tokens(F.col("text"))).alias("n")).select("doc_id", "n.*")


#: Words of currencies and units, the first that occurs wins.
CURRENCIES = (("usd", "USD"), (r"us\$", "USD"), (r"\$", "USD"), ("eur", "EUR"), ("€", "EUR"), ("gbp", "GBP"), ("£", "GBP"), ("aed", "AED"), ("dhs", "AED"), ("pkr", "PKR"), (r"rs\.?", "PKR"), ("inr", "INR"), ("₹", "INR"), ("sar", "SAR"), ("jpy", "JPY"), ("¥", "JPY"), ("cny", "CNY"))
UNITS = (("billions?|bn", "billions"), ("millions?|'?mn", "millions"), ("thousands?|'000|000s", "thousands"))


def currency(text: Column) -> Column:
    """Currency that a text names as a word; the order of the list decides."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for pattern, code in reversed(CURRENCIES):
        out = F.when(low.rlike(f"(?:^|[^a-z0-9])(?:{pattern})(?:$|[^a-z])"), code).otherwise(out)
    return out


def unit(text: Column) -> Column:
    """billions, millions or thousands where a text names them as a word."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for pattern, name in reversed(UNITS):
        out = F.when(low.rlike(f"(?:^|[^a-z0-9])(?:{pattern})(?:$|[^a-z])"), name).otherwise(out)
    return out


def _first_sql(words, text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?:^|[^a-z0-9])(?:{p.replace(chr(39), chr(39) * 2)})(?:$|[^a-z])') THEN '{code}'" for p, code in words) + " END"


_PRINTED_SQL = "o AS (SELECT o_orderkey, lower(CASE o_orderkey % 6 WHEN 0 THEN 'Rs. in thousands' WHEN 1 THEN 'US$ mn' WHEN 2 THEN 'columns of years' WHEN 3 THEN 'PKR 000s' WHEN 4 THEN '€ billion' ELSE o_orderpriority END) AS t FROM orders)"


@registry.add("currency_and_unit", f"""WITH {_PRINTED_SQL} SELECT o_orderkey, {_first_sql(CURRENCIES, "t")} AS currency, {_first_sql(UNITS, "t")} AS unit FROM o""")
def currency_and_unit(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "Rs. in thousands").when(k == 1, "US$ mn").when(k == 2, "columns of years").when(k == 3, "PKR 000s").when(k == 4, "€ billion").otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", currency(text).alias("currency"), unit(text).alias("unit"))


def strict_number(cell: Column) -> Column:
    """A cell that is a number as a whole; brackets make it negative; dashes and nil are null."""
    s = F.trim(cell)
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^[()]+|[()]+$", ""), ",", ""), "[–—]", "-")
    value = F.when(core.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), core.cast("double"))
    return F.when(~s.isin("", "-", "–", "—", "N/A", "n/a", "nil", "Nil"), F.when(s.startswith("(") & s.endswith(")"), -value).otherwise(value))


def money(cell: Column) -> Column:
    """The first number of a cell with Rs., commas or percent signs; brackets around all make it negative."""
    s = F.trim(F.regexp_replace(F.trim(cell), r"Rs\.?|[,%]", ""))
    found = F.nullif(F.regexp_extract(F.regexp_replace(s, r"^[()]+|[()]+$", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")
    return F.when(s.startswith("(") & s.endswith(")"), -found).otherwise(found)


def plain_number(cell: Column) -> Column:
    """A number with commas, else null."""
    return F.trim(F.replace(cell, F.lit(","), F.lit(""))).try_cast("double")


@registry.add(
    "coerced_numbers",
    r"""WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '(' || CAST(l_quantity AS INT) || ')' WHEN 1 THEN 'Rs. ' || CAST(l_quantity AS INT) || '.25' WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || ',000' WHEN 3 THEN '–' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || '%' END AS cell, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS q, l_linenumber % 5 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, cell, CASE k WHEN 0 THEN -q WHEN 2 THEN q * 1000 END AS strict, CASE k WHEN 0 THEN -q WHEN 1 THEN q + 0.25 WHEN 2 THEN q * 1000 WHEN 4 THEN q END AS money, CASE k WHEN 2 THEN q * 1000 END AS plain FROM c""",
)
def coerced_numbers(spark, sf_dir):
    k, q = F.col("l_linenumber") % 5, F.col("l_quantity").cast("int").cast("string")
    cell = F.when(k == 0, F.concat(F.lit("("), q, F.lit(")"))).when(k == 1, F.concat(F.lit("Rs. "), q, F.lit(".25"))).when(k == 2, F.concat(q, F.lit(",000"))).when(k == 3, "–").otherwise(F.concat(q, F.lit("%")))
    c = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    return c.select("l_orderkey", "l_linenumber", "cell", strict_number(F.col("cell")).alias("strict"), money(F.col("cell")).alias("money"), plain_number(F.col("cell")).alias("plain"))


def author_names(raw: Column) -> Column:
    """Authors as one text from JSON: a string, a list of strings or a list of objects with a name; null without any."""
    objects = F.transform(F.from_json(raw, "array<struct<name:string>>"), lambda a: a["name"])
    strings = F.from_json(raw, "array<string>")
    named = F.filter(F.zip_with(objects, strings, lambda o, s: F.coalesce(o, F.when(~s.startswith("{"), s))), lambda a: a.isNotNull() & (a != ""))
    single = F.get_json_object(F.concat(F.lit('{"a":'), raw, F.lit("}")), "$.a")
    return F.nullif(F.when(F.trim(raw).startswith("["), F.array_join(F.when(objects.isNotNull(), named).otherwise(F.filter(strings, lambda s: s != "")), ", ")).when(F.trim(raw).startswith('"'), single), F.lit(""))


@registry.add(
    "author_names",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN s_name || ', ' || n_name WHEN 2 THEN n_name || ', ' || s_name END AS author FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def author_names_query(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    name = lambda c: F.struct(F.col(c).alias("name"))
    raw = F.when(k == 0, F.concat(F.lit('"'), F.col("s_name"), F.lit('"'))).when(k == 1, F.to_json(F.array("s_name", "n_name"))).when(k == 2, F.to_json(F.array(name("n_name"), name("s_name")))).otherwise("[]")
    return s.select("s_suppkey", author_names(raw).alias("author"))


class _Cells(HTMLParser):
    """Cells (table, row, column, header, text, link, tag) of a page's tables.

    data-order stands for the text, data-name for the header; what an element of the class tag says
    is the cell's tag and no part of its text.
    """

    def __init__(self):
        super().__init__()
        self.cells, self.table, self.row, self.cell, self.headers = [], -1, -1, None, {}

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "table":
            self.table, self.row, self.headers = self.table + 1, -1, {}
        elif tag == "tr":
            self._end()
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th") and self.row >= 0:
            self._end()
            self.column += 1
            self.cell = {"is_header": tag == "th", "name": own.get("data-name"), "order": own.get("data-order"), "link": None, "text": [], "tag": None, "in_tag": None}
        elif self.cell is not None:
            if tag == "a":
                self.cell["link"] = self.cell["link"] or own.get("href")
            if self.cell["tag"] is None and "tag" in (own.get("class") or "").split():
                self.cell["tag"], self.cell["in_tag"] = "", tag

    def handle_data(self, data):
        if self.cell is not None and self.cell["in_tag"]:
            self.cell["tag"] += data
        elif self.cell is not None:
            self.cell["text"].append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end()
        elif self.cell is not None and self.cell["in_tag"] == tag:
            self.cell["in_tag"] = None

    def _end(self):
        if self.cell is None:
            return
        text = " ".join("".join(self.cell["text"]).split())
        if self.cell["is_header"]:
            self.headers[self.column] = self.cell["name"] or text
        else:
            self.cells.append((self.table, self.row, self.column, self.headers.get(self.column), self.cell["order"] if self.cell["order"] is not None else text, self.cell["link"], " ".join((self.cell["tag"] or "").split()) or None))
        self.cell = None


#: Pages that a task of table_cells has on average.
TASK_PAGES = 20_000


def table_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table, row, column, header, value, link, tag): the body cells of each page's tables; a page without tables has none."""
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(batches):
        for batch in batches:
            ids, rows = [], []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Cells()
                parser.feed(text or "")
                parser.close()
                parser._end()
                ids += [page] * len(parser.cells)
                rows += parser.cells
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *columns], names=[id_col, "table", "row", "column", "header", "value", "link", "tag"])

    # pages that are built from a small file lie in one part, but each takes a parser's time
    at_least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.select(id_col, html_col).repartition(max(at_least, -(-pages.count() // TASK_PAGES)), id_col)
    return dealt.mapInArrow(parse, f"`{id_col}` {kind}, table int, row int, column int, header string, value string, link string, tag string")


def typed_feed(found: DataFrame, columns: dict[str, tuple[str, str]], id_col: str = "page_id") -> DataFrame:
    """One row for each row of the tables with a column for each field: {field: (header, type)}; numbers lose commas, percent signs and brackets."""
    held = {f: F.max(F.when(F.lower("header") == h.lower(), F.col("value"))) for f, (h, _) in columns.items()}
    rows = found.groupBy(id_col, "table", "row").agg(*(v.alias(f) for f, v in held.items()), F.max("link").alias("link"), F.max("tag").alias("tag"))
    typed = [F.col(f) if t == "string" else (F.split(f, r"\s*,\s*") if t == "list" else money(F.col(f)).cast(t)).alias(f) for f, (_, t) in columns.items()]
    return rows.select(id_col, "table", "row", *typed, "link", "tag")


#: Headers of the feeds, by field.
MARKET_WATCH = {"symbol": ("SYMBOL", "string"), "sector": ("SECTOR", "string"), "listed_in": ("LISTED IN", "list"), "ldcp": ("LDCP", "double"), "open": ("OPEN", "double"), "high": ("HIGH", "double"), "low": ("LOW", "double"), "price": ("CURRENT", "double"), "change": ("CHANGE", "double"), "change_pct": ("CHANGE (%)", "double"), "volume": ("VOLUME", "long")}
SCREENER = {"symbol": ("SYMBOL", "string"), "market_cap": ("MARKET CAP", "double"), "price": ("PRICE", "double"), "change_pct": ("CHANGE %", "double"), "change_1y_pct": ("1-YEAR CHANGE %", "double"), "pe": ("PE RATIO", "double"), "dividend_yield": ("DIVIDEND YIELD", "double"), "free_float": ("FREE FLOAT", "double"), "volume_30d": ("30D AVG VOLUME", "double")}
SECTOR_SUMMARY = {"sector_code": ("SECTOR CODE", "string"), "sector": ("SECTOR NAME", "string"), "advance": ("ADVANCE", "long"), "decline": ("DECLINE", "long"), "unchange": ("UNCHANGE", "long"), "turnover": ("TURNOVER", "double"), "market_cap": ("MARKET CAP (B)", "double")}
ANNOUNCEMENTS = {"date": ("DATE", "string"), "time": ("TIME", "string"), "title": ("TITLE", "string")}


def futures(rows: DataFrame) -> DataFrame:
    """Market watch rows of futures: the base before the first dash, the contract after it."""
    return rows.withColumns({"base": F.substring_index("symbol", "-", 1), "contract": F.nullif(F.regexp_extract("symbol", "-(.+)$", 1), F.lit(""))})


def announcements(rows: DataFrame) -> DataFrame:
    """Announcements with the id of the document or attachment that they link to, and their tag as a status."""
    number = F.nullif(F.regexp_extract(F.coalesce("link", F.lit("")), r"/(?:document|attachment)/([0-9]+)", 1), F.lit("")).cast("long")
    return rows.withColumns({"document_id": number, "status": F.col("tag")})


def entries_total(page: Column) -> Column:
    """How many entries a page says there are in all ("1 to 50 of 863 entries"), null where it doesn't."""
    said = F.regexp_extract(F.coalesce(page, F.lit("")), r"(?i)of\s+([0-9][0-9,]*)\s+entries", 1)
    return F.when(said != "", F.replace(said, F.lit(","), F.lit("")).cast("long"))


def _page(rows: DataFrame, of: str, heads: str, *cells: Column) -> DataFrame:
    """A page (page_id, html) with a table for each value of `of`; its rows are as few as suppliers of a nation."""
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c.cast("string")) for c in cells))
    html = F.concat(F.lit(f"<table><tr>{''.join(f'<th>{h}' for h in heads.split('|'))}</tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table><p>1 to 5 of "), F.format_number(F.count("*") * 1_000, 0), F.lit(" entries"))
    return rows.groupBy(F.col(of).cast("long").alias("page_id")).agg(html.alias("html"))


@registry.add(
    "announcement_feed",
    """WITH n AS (SELECT s_nationkey, count(*) * 1000 AS entries FROM supplier GROUP BY ALL) SELECT CAST(s.s_nationkey AS BIGINT) AS page_id, 'May ' || s_suppkey % 28 AS date, 'Results of ' || s_name AS title, CASE WHEN s_suppkey % 5 = 0 THEN 'REVOKED' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS BIGINT) END AS document_id, entries FROM supplier s JOIN n USING (s_nationkey)""",
)
def announcement_feed(spark, sf_dir):
    """Suppliers as announcements of their nation's page, some revoked, some with a document."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    tag = F.when(k % 5 == 0, F.lit("<span class='tag is-red'>REVOKED</span> ")).otherwise("")
    title = F.concat(tag, F.lit("Results of "), "s_name", F.when(k % 2 == 0, F.concat(F.lit(" <a href='/download/attachment/"), k.cast("string"), F.lit("-1.pdf'></a>"))).otherwise(""))
    pages = _page(s, "s_nationkey", "DATE|TIME|TITLE", F.concat(F.lit("May "), (k % 28).cast("string")), F.lit("9:00"), title)
    found = announcements(typed_feed(table_cells(pages), ANNOUNCEMENTS))
    return found.join(pages.select("page_id", entries_total(F.col("html")).alias("entries")), "page_id").select("page_id", "date", "title", "status", "document_id", "entries")


@registry.add(
    "screener_feed",
    """SELECT CAST(s_nationkey AS BIGINT) AS page_id, 'S' || s_suppkey AS symbol, CAST(s_suppkey * 1500 AS DOUBLE) AS market_cap, round(s_acctbal, 2) AS price, -(s_suppkey % 7) / 10.0::DOUBLE AS change_pct, CAST(s_suppkey % 50 AS DOUBLE) AS change_1y_pct, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 30 AS DOUBLE) END AS pe, CAST(s_suppkey * 7000 AS DOUBLE) AS volume_30d FROM supplier""",
)
def screener_feed(spark, sf_dir):
    """Suppliers as rows of a screener, some without a ratio."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pages = _page(s, "s_nationkey", "SYMBOL|MARKET CAP|PRICE|CHANGE %|1-YEAR CHANGE %|PE RATIO|30D AVG VOLUME", F.concat(F.lit("S"), k.cast("string")), F.format_number(k * 1_500, 0), F.round("s_acctbal", 2).cast("decimal(18,2)"), F.concat(F.when(k % 7 > 0, "-").otherwise(""), ((k % 7) / 10.0).cast("decimal(9,1)").cast("string"), F.lit("%")), F.concat((k % 50).cast("string"), F.lit("%")), F.when(k % 3 > 0, (k % 30).cast("string")).otherwise("-"), F.format_number(k * 7_000, 0))
    rows = typed_feed(table_cells(pages), {f: SCREENER[f] for f in ("symbol", "market_cap", "price", "change_pct", "change_1y_pct", "pe", "volume_30d")})
    return rows.select("page_id", "symbol", "market_cap", "price", "change_pct", "change_1y_pct", "pe", "volume_30d")


@registry.add(
    "sector_feed",
    """SELECT CAST(n_regionkey AS BIGINT) AS page_id, '08' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sector_code, n_name AS sector, count(*) FILTER (s_acctbal > 1000) AS advance, count(*) FILTER (s_acctbal < 0) AS decline, count(*) FILTER (s_acctbal BETWEEN 0 AND 1000) AS unchange, CAST(count(*) * 12345 AS DOUBLE) AS turnover FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def sector_feed(spark, sf_dir):
    """Nations as sectors on their region's page: how many suppliers rose, fell or stood."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    b = F.col("s_acctbal")
    by = s.groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.count_if(b > 1000).alias("up"), F.count_if(b < 0).alias("down"), F.count_if(b.between(0, 1000)).alias("same"), F.count("*").alias("n"))
    pages = _page(by, "n_regionkey", "SECTOR CODE|SECTOR NAME|ADVANCE|DECLINE|UNCHANGE|TURNOVER", F.concat(F.lit("08"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")), F.col("n_name"), F.col("up"), F.col("down"), F.col("same"), F.format_number(F.col("n") * 12_345, 0))
    rows = typed_feed(table_cells(pages), {f: SECTOR_SUMMARY[f] for f in ("sector_code", "sector", "advance", "decline", "unchange", "turnover")})
    return rows.select("page_id", "sector_code", "sector", "advance", "decline", "unchange", "turnover")


@registry.add(
    "market_feed",
    """SELECT CAST(s_nationkey AS BIGINT) AS page_id, 'S' || s_suppkey AS symbol, n_name AS sector, round(s_acctbal, 2) AS price, CAST(s_suppkey * 1000 AS BIGINT) AS volume, '/document/' || s_suppkey AS link FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def market_feed(spark, sf_dir):
    """Suppliers of each nation as a page with a table of quotes, read back as rows."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    row = F.concat(F.lit("<tr><td><a href='/document/"), k, F.lit("'>S"), k, F.lit("</a><td>"), F.col("n_name"), F.lit("<td data-order='"), F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string"), F.lit("'>x</td><td>"), F.format_number(F.col("s_suppkey") * 1000, 0), F.lit("</td></tr>"))
    head = F.lit("<p>quotes</p><table><tr><th>SYMBOL<th data-name='SECTOR'>s<th>CURRENT<th>VOLUME</tr>")
    pages = s.groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.concat(head, F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    rows = typed_feed(table_cells(pages), {f: MARKET_WATCH[f] for f in ("symbol", "sector", "price", "volume")})
    return rows.select("page_id", "symbol", "sector", "price", "volume", "link")


def template_lines(rows: DataFrame, items: DataFrame, least: float = 82.0) -> DataFrame:
    """(row_id, item_id, score) of template rows and lines of the same statement, one to one.

    rows: (row_id, statement, label, metric, is_total, section); items the same with item_id.
    A total never goes to a leaf, nor a metric to another one. Pairs are assigned by whether
    their sections share a word, then by score.
    """
    one = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns), T.spaced(F.col("label")).alias(f"{side}_plain"))
    r, i = saved(one(rows, "r")), saved(one(items, "i"))
    alike = similar_pairs(r.select("r_plain"), i.select("i_plain"), least, "token_set")
    met = i.join(alike, F.col("i_plain") == F.col("b")).join(r, F.col("a") == F.col("r_plain")).where("r_statement = i_statement AND r_is_total = i_is_total AND (r_metric IS NULL OR i_metric IS NULL OR r_metric = i_metric)")
    tokens = lambda c: F.array_remove(F.split(T.spaced(F.coalesce(c, F.lit(""))), " "), "")
    shared = F.arrays_overlap(tokens("r_section"), tokens("i_section"))
    pairs = met.select(F.col("r_row_id").alias("row_id"), F.col("i_item_id").alias("item_id"), (F.col("score") + F.when(shared, 5.0).otherwise(0.0)).alias("score"), shared.alias("shared"))
    taken = assign(pairs, ["NOT shared", "-score"]).drop("shared")
    remove(r, i)
    return taken


@registry.add("template_lines")
def template_lines_query(spark, sf_dir):
    """Metrics as a template against the lines of each entity's newest year."""
    newest = saved(facts(spark, sf_dir).groupBy("metric").agg(F.max("year").alias("year")))  # rows and items come from it
    label = F.replace("metric", F.lit("_"), F.lit(" "))
    total = F.col("metric").isin("gross_profit", "pat", "total_assets")
    rows = newest.select(F.col("metric").alias("row_id"), F.lit("all").alias("statement"), label.alias("label"), F.lit(None).cast("string").alias("metric"), total.alias("is_total"), F.lit(None).cast("string").alias("section"))
    items = newest.select(F.concat_ws(":", F.lit("line"), "metric").alias("item_id"), F.lit("all").alias("statement"), F.concat(F.lit("Total "), label).alias("label"), F.lit(None).cast("string").alias("metric"), total.alias("is_total"), F.lit(None).cast("string").alias("section"))
    return template_lines(rows, items)
