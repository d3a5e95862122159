"""Time-series operators over facts: growth, trend, anomalies, restatement, drivers, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import FACTS_SQL, OBS_SQL, WIDE_SQL, facts, observations, wide

registry = Registry()


def by_year():
    return W.partitionBy("entity", "metric").orderBy("year")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.when(b != 0, a / b)


def with_previous(rows: DataFrame) -> DataFrame:
    """Adds prev and growth against the previous available point, null at a zero base."""
    return rows.withColumn("prev", F.lag("value").over(by_year())).withColumn("growth", ratio(F.col("value") - F.col("prev"), F.col("prev")))


_PREV_SQL = f"""{FACTS_SQL},
g AS (SELECT entity, metric, year, value, lag(value) OVER (PARTITION BY entity, metric ORDER BY year) AS prev FROM facts),
gr AS (SELECT *, CASE WHEN prev <> 0 THEN (value - prev) / prev END AS growth FROM g)"""


@registry.add("yoy_previous_point", f"WITH {_PREV_SQL} SELECT entity, metric, year, value, prev, growth FROM gr WHERE growth IS NOT NULL")
def yoy_previous_point(spark, sf_dir):
    return with_previous(facts(spark, sf_dir)).select("entity", "metric", "year", "value", "prev", "growth").where("growth IS NOT NULL")


@registry.add(
    "yoy_calendar_year",
    f"""WITH {FACTS_SQL} SELECT a.entity, a.metric, a.year, a.value, b.value AS prior, CASE WHEN b.value <> 0 THEN (a.value - b.value) / b.value END AS growth
    FROM facts a LEFT JOIN facts b ON a.entity = b.entity AND a.metric = b.metric AND b.year = a.year - 1""",
)
def yoy_calendar_year(spark, sf_dir):
    now = facts(spark, sf_dir).select("entity", "metric", "year", "value")
    prior = now.select("entity", "metric", (F.col("year") + 1).alias("year"), F.col("value").alias("prior"))
    return now.join(prior, ["entity", "metric", "year"], "left").withColumn("growth", ratio(F.col("value") - F.col("prior"), F.col("prior")))


@registry.add("yoy_absolute_base", f"WITH {_PREV_SQL} SELECT entity, metric, year, CASE WHEN prev <> 0 THEN (value - prev) / abs(prev) * 100 END AS growth_pct FROM gr WHERE year >= 1994")
def yoy_absolute_base(spark, sf_dir):
    rows = with_previous(facts(spark, sf_dir)).withColumn("growth_pct", ratio(F.col("value") - F.col("prev"), F.abs("prev")) * 100)
    return rows.where("year >= 1994").select("entity", "metric", "year", "growth_pct")


@registry.add(
    "cagr",
    f"""WITH {FACTS_SQL}, e AS (SELECT entity, metric, min(year) AS first_year, max(year) AS last_year, arg_min(value, year) AS first_value, arg_max(value, year) AS last_value FROM facts GROUP BY ALL)
    SELECT *, CASE WHEN first_value > 0 AND last_value >= 0 AND last_year > first_year THEN pow(last_value / first_value, 1.0::DOUBLE / (last_year - first_year)) - 1 END AS cagr FROM e""",
)
def cagr(spark, sf_dir):
    ends = facts(spark, sf_dir).groupBy("entity", "metric").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("value", "year").alias("first_value"), F.max_by("value", "year").alias("last_value"))
    usable = (F.col("first_value") > 0) & (F.col("last_value") >= 0) & (F.col("last_year") > F.col("first_year"))
    return ends.withColumn("cagr", F.when(usable, F.pow(F.col("last_value") / F.col("first_value"), 1.0 / (F.col("last_year") - F.col("first_year"))) - 1))


@registry.add(
    "cagr_cumulative",
    f"""WITH {FACTS_SQL}, s AS (SELECT entity, metric, year, value, first_value(value) OVER w AS base, row_number() OVER w - 1 AS steps FROM facts WINDOW w AS (PARTITION BY entity, metric ORDER BY year))
    SELECT entity, metric, year, CASE WHEN steps > 0 AND base > 0 AND value >= 0 THEN pow(value / base, 1.0::DOUBLE / steps) - 1 END AS cagr FROM s""",
)
def cagr_cumulative(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("base", F.first("value").over(by_year())).withColumn("steps", F.row_number().over(by_year()) - 1)
    usable = (F.col("steps") > 0) & (F.col("base") > 0) & (F.col("value") >= 0)
    return rows.select("entity", "metric", "year", F.when(usable, F.pow(F.col("value") / F.col("base"), 1.0 / F.col("steps")) - 1).alias("cagr"))


@registry.add(
    "trend_last_points",
    f"""WITH {_PREV_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY year DESC) AS back FROM gr),
    l AS (SELECT *, lag(value) OVER (PARTITION BY entity, metric ORDER BY year) AS p FROM n WHERE back <= 5)
    SELECT entity, metric, count(*) AS points, min(year) AS first_year, max(year) AS last_year, round(avg(value - p), 4) AS avg_increase,
      round(avg(CASE WHEN p <> 0 THEN (value - p) / p END), 6) AS avg_growth FROM l GROUP BY ALL""",
)
def trend_last_points(spark, sf_dir):
    back = F.row_number().over(W.partitionBy("entity", "metric").orderBy(F.desc("year")))
    last = with_previous(facts(spark, sf_dir).withColumn("back", back).where("back <= 5"))
    return last.groupBy("entity", "metric").agg(F.count("*").alias("points"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(F.avg(F.col("value") - F.col("prev")), 4).alias("avg_increase"), F.round(F.avg("growth"), 6).alias("avg_growth"))


@registry.add(
    "anomaly_leave_one_out",
    f"""WITH {FACTS_SQL}, o AS (SELECT a.entity, a.metric, a.year, a.value, list_sort(list(abs(b.value))) AS others FROM facts a JOIN facts b ON a.entity = b.entity AND a.metric = b.metric AND a.year <> b.year GROUP BY ALL),
    m AS (SELECT *, others[len(others) // 2 + 1] AS med FROM o WHERE len(others) >= 2),
    r AS (SELECT entity, metric, year, value, med, abs(value) / med AS times FROM m WHERE med > 0 AND abs(value) > 2 * med)
    SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY times DESC, metric, year) AS INT) AS place FROM r QUALIFY place <= 15""",
)
def anomaly_leave_one_out(spark, sf_dir):
    """Values above twice the upper median of the series' other absolute values, 15 an entity."""
    rows = facts(spark, sf_dir).select("entity", "metric", "year", "value")
    all_points = F.collect_list(F.struct("year", "value")).over(W.partitionBy("entity", "metric"))
    rows = rows.withColumn("others", F.array_sort(F.transform(F.filter(all_points, lambda p: p["year"] != F.col("year")), lambda p: F.abs(p["value"]))))
    rows = rows.where(F.size("others") >= 2).withColumn("med", F.try_element_at("others", (F.floor(F.size("others") / 2) + 1).cast("int")))
    rows = rows.where((F.col("med") > 0) & (F.abs("value") > 2 * F.col("med"))).withColumn("times", F.abs("value") / F.col("med"))
    place = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("times"), "metric", "year"))
    return rows.withColumn("place", place).where("place <= 15").drop("others")


@registry.add(
    "restatement",
    f"""WITH {OBS_SQL}, r AS (SELECT entity, metric, value_year, count(DISTINCT report_year) AS reports, min(value) AS low, max(value) AS high, arg_min(value, report_year) AS as_reported, arg_max(value, report_year) AS latest FROM obs GROUP BY ALL)
    SELECT *, (high - low) / greatest(greatest(abs(high), abs(low)), 1) AS spread FROM r WHERE reports >= 2 AND (high - low) / greatest(greatest(abs(high), abs(low)), 1) > 0.005""",
)
def restatement(spark, sf_dir):
    """Values that reports of several years put more than 0.5 % apart."""
    found = observations(spark, sf_dir).groupBy("entity", "metric", "value_year").agg(F.countDistinct("report_year").alias("reports"), F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", "report_year").alias("as_reported"), F.max_by("value", "report_year").alias("latest"))
    spread = (F.col("high") - F.col("low")) / F.greatest(F.abs("high"), F.abs("low"), F.lit(1))
    return found.where("reports >= 2").withColumn("spread", spread).where("spread > 0.005")


@registry.add("latest_and_as_reported", f"WITH {OBS_SQL} SELECT entity, metric, value_year, arg_max(value, report_year) AS latest, arg_min(value, report_year) AS as_reported FROM obs GROUP BY ALL")
def latest_and_as_reported(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("entity", "metric", "value_year").agg(F.max_by("value", "report_year").alias("latest"), F.min_by("value", "report_year").alias("as_reported"))


@registry.add("known_as_of", f"WITH {OBS_SQL} SELECT entity, metric, value_year, max(report_year) AS report_year, arg_max(value, report_year) AS value FROM obs WHERE report_year IS NULL OR report_year <= 1996 GROUP BY ALL")
def known_as_of(spark, sf_dir, as_of: int = 1996):
    """The newest value that reports up to a year knew: no look-ahead."""
    known = observations(spark, sf_dir).where(F.col("report_year").isNull() | (F.col("report_year") <= as_of))
    return known.groupBy("entity", "metric", "value_year").agg(F.max("report_year").alias("report_year"), F.max_by("value", "report_year").alias("value"))


@registry.add("newest_report_rows", f"WITH {OBS_SQL} SELECT entity, metric, value_year, report_year, value FROM obs QUALIFY rank() OVER (PARTITION BY entity, metric ORDER BY report_year DESC) = 1")
def newest_report_rows(spark, sf_dir):
    newest = F.rank().over(W.partitionBy("entity", "metric").orderBy(F.desc("report_year")))
    return observations(spark, sf_dir).withColumn("r", newest).where("r = 1").drop("r")


COMPONENTS = {
    "total_assets": ("current_assets", "non_current_assets"),
    "total_liabilities": ("current_liabilities", "non_current_liabilities"),
    "gross_profit": ("revenue", "cost_of_sales"),
    "operating_profit": ("gross_profit", "operating_expenses"),
    "pat": ("operating_profit", "finance_cost", "taxation"),
}
_COMPONENT_SQL = "components(total, metric) AS (VALUES " + ", ".join(f"('{t}', '{m}')" for t, ms in COMPONENTS.items() for m in ms) + ")"


def component_dim(spark) -> DataFrame:
    return spark.createDataFrame([(t, m) for t, ms in COMPONENTS.items() for m in ms], "total string, metric string")


@registry.add(
    "driver_analysis",
    f"""WITH {FACTS_SQL}, {_COMPONENT_SQL},
    y AS (SELECT entity, metric AS total, year, dense_rank() OVER (PARTITION BY entity, metric ORDER BY year DESC) AS back FROM facts WHERE metric IN (SELECT total FROM components)),
    p AS (SELECT entity, total, max(CASE WHEN back = 1 THEN year END) AS year_to, max(CASE WHEN back = 2 THEN year END) AS year_from FROM y WHERE back <= 2 GROUP BY ALL HAVING count(*) = 2),
    d AS (SELECT p.entity, p.total, c.metric, year_from, year_to, b.value - a.value AS delta FROM p JOIN components c ON c.total = p.total
      JOIN facts a ON a.entity = p.entity AND a.metric = c.metric AND a.year = year_from JOIN facts b ON b.entity = p.entity AND b.metric = c.metric AND b.year = year_to)
    SELECT *, CAST(row_number() OVER (PARTITION BY entity, total ORDER BY abs(delta) DESC, metric) AS INT) AS place FROM d QUALIFY place <= 5""",
)
def driver_analysis(spark, sf_dir):
    """Components ranked by their change between the two latest years of a total."""
    rows = facts(spark, sf_dir).select("entity", "metric", "year", "value")
    dim = F.broadcast(component_dim(spark))  # a fixed list of ten rows
    back = F.dense_rank().over(W.partitionBy("entity", "metric").orderBy(F.desc("year")))
    ends = rows.join(F.broadcast(component_dim(spark).select(F.col("total").alias("metric")).distinct()), "metric").withColumn("back", back).where("back <= 2")
    ends = ends.groupBy("entity", F.col("metric").alias("total")).agg(F.max("year").alias("year_to"), F.min("year").alias("year_from"), F.count("*").alias("n")).where("n = 2").drop("n")
    parts = ends.join(dim, "total").join(rows, ["entity", "metric"]).where("year = year_to OR year = year_from")
    deltas = parts.groupBy("entity", "total", "metric", "year_from", "year_to").agg(F.max(F.when(F.col("year") == F.col("year_to"), F.col("value"))).alias("b"), F.max(F.when(F.col("year") == F.col("year_from"), F.col("value"))).alias("a"))
    deltas = deltas.where("a IS NOT NULL AND b IS NOT NULL").select("entity", "total", "metric", "year_from", "year_to", (F.col("b") - F.col("a")).alias("delta"))
    place = F.row_number().over(W.partitionBy("entity", "total").orderBy(F.desc(F.abs("delta")), "metric"))
    return deltas.withColumn("place", place).where("place <= 5")


@registry.add(
    "decompose_net_margin",
    f"""WITH {WIDE_SQL}, w AS (SELECT entity, year, pat, revenue, lag(pat) OVER o AS pat0, lag(revenue) OVER o AS revenue0, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS back FROM wide WHERE pat IS NOT NULL AND revenue IS NOT NULL WINDOW o AS (PARTITION BY entity ORDER BY year))
    SELECT entity, year, i.key, i.delta, i.pct FROM w, LATERAL (VALUES ('pat', pat - pat0, CASE WHEN pat0 <> 0 THEN (pat - pat0) / abs(pat0) * 100 END), ('revenue', revenue - revenue0, CASE WHEN revenue0 <> 0 THEN (revenue - revenue0) / abs(revenue0) * 100 END)) i(key, delta, pct) WHERE back = 1""",
)
def decompose_net_margin(spark, sf_dir):
    """The change of a ratio's inputs between its two latest years."""
    o = W.partitionBy("entity").orderBy("year")
    rows = wide(spark, sf_dir, ["pat", "revenue"]).where("pat IS NOT NULL AND revenue IS NOT NULL")
    rows = rows.withColumns({"pat0": F.lag("pat").over(o), "revenue0": F.lag("revenue").over(o), "back": F.row_number().over(W.partitionBy("entity").orderBy(F.desc("year")))}).where("back = 1")
    item = lambda k: F.struct(F.lit(k).alias("key"), (F.col(k) - F.col(k + "0")).alias("delta"), (ratio(F.col(k) - F.col(k + "0"), F.abs(k + "0")) * 100).alias("pct"))
    return rows.withColumn("i", F.explode(F.array(item("pat"), item("revenue")))).select("entity", "year", "i.key", "i.delta", "i.pct")


@registry.add("margin_trend", f"WITH {WIDE_SQL} SELECT entity, year, CASE WHEN revenue <> 0 THEN gross_profit / revenue END AS gross_margin, CASE WHEN revenue <> 0 THEN operating_profit / revenue END AS operating_margin FROM wide WHERE revenue IS NOT NULL")
def margin_trend(spark, sf_dir):
    rows = wide(spark, sf_dir, ["revenue", "gross_profit", "operating_profit"]).where("revenue IS NOT NULL")
    return rows.select("entity", "year", ratio(F.col("gross_profit"), F.col("revenue")).alias("gross_margin"), ratio(F.col("operating_profit"), F.col("revenue")).alias("operating_margin"))


KPIS = ["revenue", "gross_profit", "operating_profit", "pat", "total_assets", "total_equity"]


@registry.add(
    "overview_year",
    f"""WITH {FACTS_SQL}, y AS (SELECT entity, coalesce(max(CASE WHEN metric = 'revenue' THEN year END), max(year)) AS year FROM facts GROUP BY entity)
    SELECT f.entity, f.year, f.metric, list_position({KPIS}, f.metric) AS place, f.value FROM facts f JOIN y ON f.entity = y.entity AND f.year = y.year WHERE f.metric IN ({", ".join(f"'{k}'" for k in KPIS)})""",
)
def overview_year(spark, sf_dir):
    """Headline figures of the latest year with revenue, in a fixed order."""
    rows = facts(spark, sf_dir).select("entity", "metric", "year", "value")
    year = F.coalesce(F.max(F.when(F.col("metric") == "revenue", F.col("year"))), F.max("year")).alias("year")
    place = F.array_position(F.array(*map(F.lit, KPIS)), F.col("metric")).cast("int").alias("place")
    return rows.join(rows.groupBy("entity").agg(year), ["entity", "year"]).where(F.col("metric").isin(KPIS)).select("entity", "year", "metric", place, "value")


@registry.add(
    "metric_year_grid",
    f"""WITH {FACTS_SQL}, e AS (SELECT DISTINCT entity FROM facts), y AS (SELECT DISTINCT year FROM facts), m AS (SELECT unnest({KPIS}) AS metric)
    SELECT e.entity, m.metric, y.year, f.value FROM e, y, m LEFT JOIN facts f ON f.entity = e.entity AND f.metric = m.metric AND f.year = y.year""",
)
def metric_year_grid(spark, sf_dir):
    """Series of every entity with nulls in years without a value."""
    rows = facts(spark, sf_dir, KPIS).select("entity", "metric", "year", "value")
    spans = facts(spark, sf_dir).agg(F.sort_array(F.collect_set("year")).alias("years"))  # some tens of years, whatever the data
    grid = facts(spark, sf_dir).select("entity").distinct().join(F.broadcast(spans)).withColumn("year", F.explode("years")).withColumn("metric", F.explode(F.array(*map(F.lit, KPIS))))
    return grid.join(rows, ["entity", "metric", "year"], "left").select("entity", "metric", "year", "value")


_SERIES_SQL = f"""{_PREV_SQL},
s AS (SELECT entity, metric, year, value, growth, row_number() OVER (PARTITION BY entity, metric ORDER BY year DESC) AS back FROM gr),
h AS (SELECT entity, metric, count(*) AS points, arg_max(value, year) AS latest, max(value) AS high, min(value) AS low, avg(value) AS mean,
  min(growth) AS g_low, max(growth) AS g_high, median(growth) AS g_mid, stddev_pop(growth) AS g_sd, count(growth) AS g_n, bool_and(growth > 0) AS up, bool_and(growth < 0) AS down FROM s WHERE back > 1 GROUP BY ALL),
f AS (SELECT h.*, s.value AS forecast, CASE WHEN latest <> 0 THEN (s.value - latest) / latest END AS implied FROM h JOIN s ON h.entity = s.entity AND h.metric = s.metric AND back = 1)"""


def forecast_inputs(spark, sf_dir) -> DataFrame:
    """The latest value of each series as a forecast, against the history before it."""
    rows = with_previous(facts(spark, sf_dir)).withColumn("back", F.row_number().over(W.partitionBy("entity", "metric").orderBy(F.desc("year"))))
    history = rows.where("back > 1").groupBy("entity", "metric").agg(
        F.count("*").alias("points"), F.max_by("value", "year").alias("latest"), F.max("value").alias("high"), F.min("value").alias("low"), F.avg("value").alias("mean"),
        F.min("growth").alias("g_low"), F.max("growth").alias("g_high"), F.median("growth").alias("g_mid"), F.stddev_pop("growth").alias("g_sd"), F.count("growth").alias("g_n"),
        F.bool_and(F.col("growth") > 0).alias("up"), F.bool_and(F.col("growth") < 0).alias("down"),
    )
    target = rows.where("back = 1").select("entity", "metric", F.col("value").alias("forecast"))
    return history.join(target, ["entity", "metric"]).withColumn("implied", ratio(F.col("forecast") - F.col("latest"), F.col("latest")))


#: Rules as SQL for both engines; 0 passes, 1 warns, 2 fails, null is skipped.
BAND = """CASE WHEN points < 2 OR g_n < 1 OR implied IS NULL THEN NULL WHEN implied BETWEEN g_low - 1e-9 AND g_high + 1e-9 THEN 0
 WHEN abs(implied - CASE WHEN implied < g_low THEN g_low ELSE g_high END) <= 0.10 THEN 1 ELSE 2 END"""
BREAK = """CASE WHEN points < 3 OR g_n < 2 OR implied IS NULL THEN NULL WHEN (up AND implied < 0) OR (down AND implied > 0) THEN CASE WHEN abs(implied) >= 0.10 THEN 2 ELSE 1 END
 WHEN abs(implied - g_mid) <= greatest(0.05, g_sd) THEN 0 WHEN abs(implied - g_mid) <= greatest(0.20, 4 * g_sd) THEN 1 ELSE 2 END"""
PLAUSIBLE = """CASE WHEN points < 2 THEN NULL ELSE greatest(
 CASE WHEN high = 0 THEN 0 WHEN forecast / nullif(high, 0) >= 2 OR forecast / nullif(high, 0) <= 0.25 THEN 2 WHEN forecast / nullif(high, 0) >= 1.5 OR forecast / nullif(high, 0) <= 0.5 THEN 1 ELSE 0 END,
 CASE WHEN latest = 0 THEN 0 WHEN abs(forecast - latest) / nullif(latest, 0) >= 1 THEN 2 WHEN abs(forecast - latest) / nullif(latest, 0) >= 0.5 THEN 1 ELSE 0 END,
 CASE WHEN mean = 0 THEN 0 WHEN abs(forecast - mean) / nullif(mean, 0) >= 1.5 THEN 2 WHEN abs(forecast - mean) / nullif(mean, 0) >= 0.75 THEN 1 ELSE 0 END) END"""
_OUTCOME = "CASE {} WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'FAIL' ELSE 'SKIPPED' END"
for _name, _rule in (("growth_band", BAND), ("trend_break", BREAK), ("plausibility", PLAUSIBLE)):

    def _query(spark, sf_dir, rule=_rule):
        return forecast_inputs(spark, sf_dir).withColumn("rule", F.expr(rule)).select("entity", "metric", "forecast", "implied", F.expr(_OUTCOME.format("rule")).alias("outcome"))

    registry.add(f"forecast_{_name}", f"WITH {_SERIES_SQL} SELECT entity, metric, forecast, implied, {_OUTCOME.format(_rule)} AS outcome FROM f")(_query)


@registry.add(
    "forecast_validation",
    f"WITH {_SERIES_SQL}, r AS (SELECT *, {BAND} AS b, {BREAK} AS t, {PLAUSIBLE} AS p FROM f) SELECT entity, metric, points, {_OUTCOME.format('greatest(b, t, p)')} AS outcome FROM r",
)
def forecast_validation(spark, sf_dir):
    """The worst outcome of the three rules that were not skipped."""
    rules = forecast_inputs(spark, sf_dir).withColumns({"b": F.expr(BAND), "t": F.expr(BREAK), "p": F.expr(PLAUSIBLE)})
    return rules.select("entity", "metric", "points", F.expr(_OUTCOME.format("greatest(b, t, p)")).alias("outcome"))


@registry.add(
    "projection",
    f"""WITH {_PREV_SQL}, h AS (SELECT entity, metric, min(year) AS y0, max(year) AS y1, arg_min(value, year) AS v0, arg_max(value, year) AS v1, avg(growth) AS g_mean, coalesce(stddev_pop(growth), 0.03) AS sd, count(growth) AS n FROM gr GROUP BY ALL),
    b AS (SELECT *, CASE WHEN v0 > 0 AND v1 > 0 AND y1 > y0 THEN pow(v1 / v0, 1.0::DOUBLE / (y1 - y0)) - 1 ELSE g_mean END AS growth, greatest(0.02, CASE WHEN n >= 2 THEN sd ELSE 0.03 END) AS spread FROM h)
    SELECT entity, metric, CAST(y1 + k AS INT) AS year, c.case_name, round(v1 * pow(1 + growth + c.sign * spread, k), 2) + 0.0::DOUBLE AS value FROM b, (VALUES ('low', -1), ('base', 0), ('high', 1)) c(case_name, sign), range(1, 4) t(k)
    WHERE growth IS NOT NULL AND 1 + growth + c.sign * spread >= 0""",
)
def projection(spark, sf_dir, horizon: int = 3):
    """Low, base and high values of the next years by compound growth, else mean growth."""
    history = with_previous(facts(spark, sf_dir)).groupBy("entity", "metric").agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min_by("value", "year").alias("v0"), F.max_by("value", "year").alias("v1"), F.avg("growth").alias("mean"), F.stddev_pop("growth").alias("sd"), F.count("growth").alias("n"))
    compound = F.when((F.col("v0") > 0) & (F.col("v1") > 0) & (F.col("y1") > F.col("y0")), F.pow(F.col("v1") / F.col("v0"), 1.0 / (F.col("y1") - F.col("y0"))) - 1).otherwise(F.col("mean"))
    rows = history.withColumn("growth", compound).withColumn("spread", F.greatest(F.lit(0.02), F.when(F.col("n") >= 2, F.col("sd")).otherwise(0.03)))
    cases = F.array(*(F.struct(F.lit(n).alias("case_name"), F.lit(s).alias("sign")) for n, s in (("low", -1), ("base", 0), ("high", 1))))
    rows = rows.where("growth IS NOT NULL").withColumn("c", F.explode(cases)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    rate = 1 + F.col("growth") + F.col("c.sign") * F.col("spread")
    return rows.where(rate >= 0).select("entity", "metric", (F.col("y1") + F.col("k")).alias("year"), "c.case_name", F.round(F.col("v1") * F.pow(rate, F.col("k")), 2).alias("value"))


@registry.add(
    "series_label",
    f"WITH {_PREV_SQL} SELECT entity, metric, max(growth) - min(growth) AS growth_range, CASE WHEN max(growth) - min(growth) > 0.3 THEN 'volatile' ELSE 'steady' END AS label FROM gr WHERE growth IS NOT NULL GROUP BY ALL",
)
def series_label(spark, sf_dir):
    spread = F.max("growth") - F.min("growth")
    return with_previous(facts(spark, sf_dir)).where("growth IS NOT NULL").groupBy("entity", "metric").agg(spread.alias("growth_range"), F.when(spread > 0.3, "volatile").otherwise("steady").alias("label"))
