"""Validation: identities, signs, tie-outs, subtotals, gaps, face truth and multi-report merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import FACTS_SQL, OBS_SQL, WIDE_SQL, facts, observations, wide
from .series import COMPONENTS, ratio

registry = Registry()

#: name, target, terms that sum to it; prior-year cash opens the year.
IDENTITIES = (
    ("gross_profit", "gross_profit", "revenue + cost_of_sales"),
    ("profit_after_tax", "pat", "profit_before_tax + taxation"),
    ("assets_split", "total_assets", "non_current_assets + current_assets"),
    ("assets_financed", "total_assets", "total_equity_and_liabilities"),
    ("cash_roll_forward", "cash_and_bank", "cash_opening + operating_cash_flow + capex"),
)
_IDENTITY_SQL = " UNION ALL ".join(f"SELECT entity, year, '{n}' AS identity, {t} AS stated, {e} AS computed FROM o" for n, t, e in IDENTITIES)


@registry.add(
    "face_identities",
    f"""WITH {WIDE_SQL}, o AS (SELECT *, lag(cash_and_bank) OVER (PARTITION BY entity ORDER BY year) AS cash_opening FROM wide), i AS ({_IDENTITY_SQL})
    SELECT *, abs(computed - stated) <= greatest(1, 0.01 * abs(stated)) AS passed FROM i WHERE stated IS NOT NULL AND computed IS NOT NULL""",
)
def face_identities(spark, sf_dir):
    """Identities of each entity and year within max(1, 1 %); skipped where an input is missing."""
    rows = wide(spark, sf_dir).withColumn("cash_opening", F.lag("cash_and_bank").over(W.partitionBy("entity").orderBy("year")))
    checks = F.array(*(F.struct(F.lit(n).alias("identity"), F.col(t).alias("stated"), F.expr(e).alias("computed")) for n, t, e in IDENTITIES))
    rows = rows.withColumn("c", F.explode(checks)).select("entity", "year", "c.*").where("stated IS NOT NULL AND computed IS NOT NULL")
    return rows.withColumn("passed", F.abs(F.col("computed") - F.col("stated")) <= F.greatest(F.lit(1.0), 0.01 * F.abs("stated")))


NONNEGATIVE = ["revenue", "total_assets", "non_current_assets", "current_assets", "total_equity_and_liabilities", "total_liabilities", "non_current_liabilities", "current_liabilities", "stock_in_trade", "cash_and_bank", "trade_debts", "total_equity"]
_NONNEGATIVE_SQL = ", ".join(f"'{m}'" for m in NONNEGATIVE)


@registry.add("sign_sanity", f"WITH {FACTS_SQL} SELECT entity, metric, year, value FROM facts WHERE metric IN ({_NONNEGATIVE_SQL}) AND value < 0")
def sign_sanity(spark, sf_dir):
    return facts(spark, sf_dir, NONNEGATIVE).where(F.col("value") < 0).select("entity", "metric", "year", "value")


_DIM_SQL = "dim(total, metric) AS (VALUES " + ", ".join(f"('{t}', '{m}')" for t, ms in COMPONENTS.items() for m in ms) + ")"


@registry.add(
    "statement_footing",
    f"""WITH {FACTS_SQL}, {_DIM_SQL}, s AS (SELECT t.entity, t.metric AS total, t.year, t.value AS stated, count(c.value) AS parts, CAST(sum(CAST(round(c.value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS summed
      FROM facts t JOIN dim ON dim.total = t.metric JOIN facts c ON c.entity = t.entity AND c.year = t.year AND c.metric = dim.metric GROUP BY ALL)
    SELECT *, abs(stated - summed) <= greatest(0.01 * greatest(abs(stated), abs(summed)), 1) AS foots FROM s WHERE parts >= 2""",
)
def statement_footing(spark, sf_dir):
    """Whether components foot to their total, at least two of them present."""
    rows = facts(spark, sf_dir).select("entity", "metric", "year", "value")
    dim = F.broadcast(spark.createDataFrame([(t, m) for t, ms in COMPONENTS.items() for m in ms], "total string, metric string"))
    totals = rows.select("entity", "year", F.col("metric").alias("total"), F.col("value").alias("stated")).join(dim, "total")
    cents = F.round(F.col("value") * 100).cast("long")
    sums = totals.join(rows, ["entity", "year", "metric"]).groupBy("entity", "total", "year", "stated").agg(F.count("value").alias("parts"), (F.sum(cents) / 100.0).alias("summed")).where("parts >= 2")
    return sums.withColumn("foots", F.abs(F.col("stated") - F.col("summed")) <= F.greatest(0.01 * F.greatest(F.abs("stated"), F.abs("summed")), F.lit(1.0)))


_PLACED_SQL = f"""{OBS_SQL}, ends AS (SELECT entity, metric, value_year AS year, arg_min(value, report_year) AS placed, arg_max(value, report_year) AS truth FROM obs GROUP BY ALL)"""


def placed(spark, sf_dir) -> DataFrame:
    """The first report's value as placed against the latest one as truth."""
    return observations(spark, sf_dir).groupBy("entity", "metric", F.col("value_year").alias("year")).agg(F.min_by("value", "report_year").alias("placed"), F.max_by("value", "report_year").alias("truth"))


@registry.add("tie_out", f"WITH {_PLACED_SQL} SELECT *, CASE WHEN abs(placed - truth) <= greatest(1, 0.01 * abs(truth)) THEN 'OK' ELSE 'MISMATCH' END AS status FROM ends")
def tie_out(spark, sf_dir):
    within = F.abs(F.col("placed") - F.col("truth")) <= F.greatest(F.lit(1.0), 0.01 * F.abs("truth"))
    return placed(spark, sf_dir).withColumn("status", F.when(within, "OK").otherwise("MISMATCH"))


@registry.add(
    "golden_check",
    f"""WITH {_PLACED_SQL}, g AS (SELECT entity, metric, year, truth FROM ends WHERE metric IN ('revenue', 'total_assets', 'pat')), k AS (SELECT * FROM ends WHERE year % 3 <> 0)
    SELECT g.entity, g.metric, g.year, g.truth, k.placed AS found, CASE WHEN k.placed IS NULL THEN 'MISSING' WHEN abs(k.placed - g.truth) <= 0.005 * greatest(abs(g.truth), 1) THEN 'MATCH' ELSE 'MISMATCH' END AS verdict
    FROM g LEFT JOIN k ON g.entity = k.entity AND g.metric = k.metric AND g.year = k.year""",
)
def golden_check(spark, sf_dir, tolerance: float = 0.005):
    """Golden values against what was extracted, which misses every third year here."""
    both = placed(spark, sf_dir)
    golden = both.where(F.col("metric").isin("revenue", "total_assets", "pat")).select("entity", "metric", "year", "truth")
    found = both.where("year % 3 <> 0").select("entity", "metric", "year", F.col("placed").alias("found"))
    verdict = F.when(F.col("found").isNull(), "MISSING").when(F.abs(F.col("found") - F.col("truth")) <= tolerance * F.greatest(F.abs("truth"), F.lit(1.0)), "MATCH").otherwise("MISMATCH")
    return golden.join(found, ["entity", "metric", "year"], "left").withColumn("verdict", verdict)


KEY_METRICS = ["revenue", "pat", "total_assets", "total_equity", "cash_and_bank", "trade_payables"]


@registry.add(
    "coverage_gaps",
    f"""WITH {FACTS_SQL}, y AS (SELECT DISTINCT entity, year FROM facts), k AS (SELECT unnest({KEY_METRICS}) AS metric)
    SELECT y.entity, y.year, k.metric FROM y, k WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity = y.entity AND f.year = y.year AND f.metric = k.metric)""",
)
def coverage_gaps(spark, sf_dir):
    """Key metrics that an entity's year has no value of."""
    rows = facts(spark, sf_dir).select("entity", "year", "metric")
    wanted = rows.select("entity", "year").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, KEY_METRICS))))
    return wanted.join(rows, ["entity", "year", "metric"], "left_anti")


@registry.add(
    "multi_year_merge",
    f"""WITH {OBS_SQL}, r AS (SELECT *, CASE WHEN report_year = value_year + 1 THEN 0 WHEN report_year = value_year THEN 1 WHEN report_year > value_year THEN 2 + report_year - value_year ELSE 1000 END AS rank FROM obs)
    SELECT entity, metric, value_year, report_year, rank, value FROM r QUALIFY row_number() OVER (PARTITION BY entity, metric, value_year ORDER BY rank, report_year) = 1""",
)
def multi_year_merge(spark, sf_dir):
    """One value a year from many reports: the next year's report, its own, then later ones."""
    gap = F.col("report_year") - F.col("value_year")
    rank = F.when(gap == 1, 0).when(gap == 0, 1).when(gap > 0, 2 + gap).otherwise(1000)
    best = F.row_number().over(W.partitionBy("entity", "metric", "value_year").orderBy("rank", "report_year"))
    return observations(spark, sf_dir).withColumn("rank", rank).withColumn("b", best).where("b = 1").select("entity", "metric", "value_year", "report_year", "rank", "value")


@registry.add(
    "plausible_years",
    f"""WITH {OBS_SQL}, s AS (SELECT entity, min(report_year) AS lo, max(report_year) AS hi FROM obs WHERE metric = 'revenue' GROUP BY entity)
    SELECT o.entity, o.metric, o.value_year, o.report_year FROM obs o JOIN s ON o.entity = s.entity WHERE o.value_year BETWEEN lo - 1 AND hi AND o.metric = 'pat'""",
)
def plausible_years(spark, sf_dir):
    """Observations whose value year lies from the first report year less one to the last."""
    rows = observations(spark, sf_dir)
    span = rows.where("metric = 'revenue'").groupBy("entity").agg(F.min("report_year").alias("lo"), F.max("report_year").alias("hi"))
    return rows.where("metric = 'pat'").join(span, "entity").where("value_year BETWEEN lo - 1 AND hi").select("entity", "metric", "value_year", "report_year")


#: Candidates of one metric and year: reports are tables; even report years are notes, odd ones primary.
_CANDIDATES_SQL = f"""{OBS_SQL}, c AS (SELECT entity, metric, value_year AS year, report_year, value, report_year % 2 AS odd, CASE WHEN report_year % 2 = 1 THEN 0 ELSE 1 END AS tier FROM obs),
a AS (SELECT *, max(abs(value)) OVER m AS biggest, min(tier) OVER m AS best_tier FROM c WINDOW m AS (PARTITION BY entity, metric)),
n AS (SELECT entity, metric, median(abs(value)) AS med FROM a WHERE value <> 0 AND abs(value) >= biggest / 1000 AND tier = best_tier GROUP BY ALL)"""
EXPENSES = ["cost_of_sales", "operating_expenses", "finance_cost", "taxation", "capex"]
_EXPENSES_SQL = ", ".join(f"'{m}'" for m in EXPENSES)


def candidates(spark, sf_dir) -> DataFrame:
    """Observations as candidates with their tier and the scale-anchored median of their metric."""
    rows = observations(spark, sf_dir).withColumn("tier", F.when(F.col("report_year") % 2 == 1, 0).otherwise(1)).withColumnRenamed("value_year", "year")
    m = W.partitionBy("entity", "metric")
    rows = rows.withColumns({"biggest": F.max(F.abs("value")).over(m), "best_tier": F.min("tier").over(m)})
    anchored = (F.col("value") != 0) & (F.abs("value") >= F.col("biggest") / 1000) & (F.col("tier") == F.col("best_tier"))
    return rows.join(rows.where(anchored).groupBy("entity", "metric").agg(F.median(F.abs("value")).alias("med")), ["entity", "metric"], "left")


@registry.add("scale_anchored_median", f"WITH {_CANDIDATES_SQL} SELECT entity, metric, med FROM n")
def scale_anchored_median(spark, sf_dir):
    return candidates(spark, sf_dir).where("med IS NOT NULL").select("entity", "metric", "med").distinct()


@registry.add(
    "face_truth",
    f"""WITH {_CANDIDATES_SQL}, f AS (SELECT a.entity, a.metric, a.year, a.report_year, a.value, a.tier, n.med, n.med IS NULL OR (a.value <> 0 AND abs(a.value) BETWEEN n.med / 8 AND n.med * 8) AS in_band FROM a LEFT JOIN n ON a.entity = n.entity AND a.metric = n.metric),
    k AS (SELECT *, bool_or(in_band) OVER (PARTITION BY entity, metric, year) AS some_in FROM f)
    SELECT entity, metric, year, report_year, tier, CASE WHEN metric IN ({_EXPENSES_SQL}) THEN -abs(value) ELSE value END AS value FROM k WHERE in_band OR NOT some_in
    QUALIFY row_number() OVER (PARTITION BY entity, metric, year ORDER BY tier, report_year DESC, abs(abs(value) - med)) = 1""",
)
def face_truth(spark, sf_dir):
    """The trusted value of each metric and year: in the outlier band, best tier, newest report."""
    rows = candidates(spark, sf_dir)
    in_band = F.col("med").isNull() | ((F.col("value") != 0) & F.abs("value").between(F.col("med") / 8, F.col("med") * 8))
    key = W.partitionBy("entity", "metric", "year")
    rows = rows.withColumn("in_band", in_band).withColumn("some_in", F.bool_or("in_band").over(key)).where("in_band OR NOT some_in")
    best = F.row_number().over(key.orderBy("tier", F.desc("report_year"), F.abs(F.abs("value") - F.col("med"))))
    signed = F.when(F.col("metric").isin(EXPENSES), -F.abs("value")).otherwise(F.col("value"))
    return rows.withColumn("b", best).where("b = 1").select("entity", "metric", "year", "report_year", "tier", signed.alias("value"))


@registry.add(
    "breakdown_reconciliation",
    f"""WITH {FACTS_SQL}, {_DIM_SQL}, s AS (SELECT t.entity, t.metric AS total, t.year, t.value AS stated, CAST(sum(CAST(round(c.value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS summed FROM facts t JOIN dim ON dim.total = t.metric JOIN facts c ON c.entity = t.entity AND c.year = t.year AND c.metric = dim.metric GROUP BY ALL)
    SELECT *, CASE WHEN stated <> 0 THEN abs(stated - summed) / abs(stated) END AS gap, CASE WHEN stated = 0 THEN NULL WHEN abs(stated - summed) / abs(stated) <= 0.01 THEN 'MINOR_PLUG' WHEN abs(stated - summed) / abs(stated) <= 0.05 THEN 'WARNING_PLUG' ELSE 'DETAIL_INCOMPLETE' END AS grade FROM s""",
)
def breakdown_reconciliation(spark, sf_dir):
    """Breakdowns graded by how much of the stated total they leave open."""
    rows = facts(spark, sf_dir).select("entity", "metric", "year", "value")
    dim = F.broadcast(spark.createDataFrame([(t, m) for t, ms in COMPONENTS.items() for m in ms], "total string, metric string"))
    totals = rows.select("entity", "year", F.col("metric").alias("total"), F.col("value").alias("stated")).join(dim, "total")
    sums = totals.join(rows, ["entity", "year", "metric"]).groupBy("entity", "total", "year", "stated").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0).alias("summed"))
    gap = ratio(F.abs(F.col("stated") - F.col("summed")), F.abs("stated"))
    grade = F.when(gap <= 0.01, "MINOR_PLUG").when(gap <= 0.05, "WARNING_PLUG").when(gap.isNotNull(), "DETAIL_INCOMPLETE")
    return sums.withColumn("gap", gap).withColumn("grade", grade)


STATEMENTS = {"P&L": ["revenue", "cost_of_sales", "operating_expenses", "finance_cost", "taxation"], "BS": ["current_assets", "non_current_assets", "current_liabilities", "non_current_liabilities"]}
_CASE_SQL = "CASE " + " ".join(f"WHEN metric IN ({', '.join(repr(m) for m in ms)}) THEN '{s}'" for s, ms in STATEMENTS.items()) + " END"


@registry.add(
    "statement_rollup",
    f"""WITH {FACTS_SQL}, x AS (SELECT {_CASE_SQL} AS statement, metric, year, CAST(round(value * 100) AS BIGINT) AS cents FROM facts)
    SELECT year, statement, metric, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS total, CAST(count(*) AS BIGINT) AS n FROM x WHERE statement IS NOT NULL GROUP BY ROLLUP (year, statement, metric)""",
)
def statement_rollup(spark, sf_dir):
    """Totals by line, statement, year and all, in one pass with grouping sets."""
    rows = facts(spark, sf_dir).withColumn("statement", F.expr(_CASE_SQL)).where("statement IS NOT NULL")
    return rows.rollup("year", "statement", "metric").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0).alias("total"), F.count("*").alias("n"))


@registry.add(
    "validation_ledger",
    f"""WITH {_PLACED_SQL}, t AS (SELECT entity, metric, year, placed AS value, truth, CASE WHEN abs(placed - truth) <= greatest(1, 0.01 * abs(truth)) THEN 'OK' ELSE 'WITHHELD' END AS status, 'template' AS source FROM ends)
    SELECT * FROM t UNION ALL SELECT entity, metric, year, truth, truth, 'SIGN', 'sign' FROM ends WHERE metric IN ({_NONNEGATIVE_SQL}) AND truth < 0""",
)
def validation_ledger(spark, sf_dir):
    """Tie-outs and sign findings as one ledger."""
    both = placed(spark, sf_dir)
    within = F.abs(F.col("placed") - F.col("truth")) <= F.greatest(F.lit(1.0), 0.01 * F.abs("truth"))
    ties = both.select("entity", "metric", "year", F.col("placed").alias("value"), "truth", F.when(within, "OK").otherwise("WITHHELD").alias("status"), F.lit("template").alias("source"))
    signs = both.where(F.col("metric").isin(NONNEGATIVE) & (F.col("truth") < 0)).select("entity", "metric", "year", F.col("truth").alias("value"), "truth", F.lit("SIGN").alias("status"), F.lit("sign").alias("source"))
    return ties.unionByName(signs)


@registry.add(
    "run_manifest",
    f"""WITH {_PLACED_SQL}, t AS (SELECT entity, abs(placed - truth) <= greatest(1, 0.01 * abs(truth)) AS ok FROM ends)
    SELECT entity, count(*) AS checks, count(*) FILTER (WHERE NOT ok) AS failures, bool_and(ok) AS fully_reconciled, count(*) FILTER (WHERE NOT ok) <= 0.5 * count(*) AS production_ready FROM t GROUP BY entity""",
)
def run_manifest(spark, sf_dir):
    ok = F.abs(F.col("placed") - F.col("truth")) <= F.greatest(F.lit(1.0), 0.01 * F.abs("truth"))
    counted = placed(spark, sf_dir).withColumn("ok", ok).groupBy("entity").agg(F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failures"), F.bool_and("ok").alias("fully_reconciled"))
    return counted.withColumn("production_ready", F.col("failures") <= 0.5 * F.col("checks"))


@registry.add(
    "severity_counts",
    f"""WITH {_PLACED_SQL}, s AS (SELECT metric, CASE WHEN abs(placed - truth) <= 1 THEN 'verified' WHEN abs(placed - truth) <= 0.01 * abs(truth) THEN 'minor' WHEN abs(placed - truth) <= 0.05 * abs(truth) THEN 'warning' ELSE 'error' END AS severity FROM ends)
    SELECT metric, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'minor') AS minor, count(*) FILTER (WHERE severity = 'verified') AS verified FROM s GROUP BY metric""",
)
def severity_counts(spark, sf_dir):
    off = F.abs(F.col("placed") - F.col("truth"))
    severity = F.when(off <= 1, "verified").when(off <= 0.01 * F.abs("truth"), "minor").when(off <= 0.05 * F.abs("truth"), "warning").otherwise("error")
    kinds = ["error", "warning", "minor", "verified"]
    return placed(spark, sf_dir).withColumn("severity", severity).groupBy("metric").pivot("severity", kinds).agg(F.count("placed")).na.fill(0, kinds)


@registry.add(
    "snapshot_diff",
    f"""WITH {OBS_SQL}, a AS (SELECT entity, metric, value_year AS year, arg_max(value, report_year) AS old FROM obs WHERE report_year <= 1996 GROUP BY ALL), b AS (SELECT entity, metric, value_year AS year, arg_max(value, report_year) AS new FROM obs WHERE value_year <> 1993 GROUP BY ALL)
    SELECT entity, metric, year, old, new, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'cleared' ELSE 'changed' END AS change FROM a FULL JOIN b USING (entity, metric, year) WHERE old IS DISTINCT FROM new""",
)
def snapshot_diff(spark, sf_dir):
    """Cells that a later snapshot changed, added or cleared."""
    rows = observations(spark, sf_dir).withColumnRenamed("value_year", "year")
    old = rows.where("report_year <= 1996").groupBy("entity", "metric", "year").agg(F.max_by("value", "report_year").alias("old"))
    new = rows.where("year <> 1993").groupBy("entity", "metric", "year").agg(F.max_by("value", "report_year").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "cleared").otherwise("changed")
    return old.join(new, ["entity", "metric", "year"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", change)


@registry.add(
    "store_coverage",
    f"WITH {OBS_SQL} SELECT entity, count(*) AS cells, count(value) AS valued, count(DISTINCT metric || '|' || value_year) AS metric_years, count(*) FILTER (WHERE report_year > value_year) AS restated FROM obs GROUP BY entity",
)
def store_coverage(spark, sf_dir):
    key = F.concat_ws("|", "metric", "value_year")
    return observations(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("cells"), F.count("value").alias("valued"), F.countDistinct(key).alias("metric_years"), F.count_if(F.col("report_year") > F.col("value_year")).alias("restated"))


@registry.add("report_span", f"WITH {OBS_SQL} SELECT entity, min(report_year) || '-' || max(report_year) AS span FROM obs GROUP BY entity")
def report_span(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("entity").agg(F.concat_ws("-", F.min("report_year"), F.max("report_year")).alias("span"))


@registry.add(
    "share_of_base",
    f"""WITH {WIDE_SQL} SELECT f.entity, f.metric, f.year, f.value / nullif(CASE WHEN f.metric IN ('current_assets', 'non_current_assets', 'current_liabilities') THEN coalesce(w.total_assets, w.revenue) ELSE coalesce(w.revenue, w.total_assets) END, 0) AS share FROM facts f JOIN wide w ON f.entity = w.entity AND f.year = w.year""",
)
def share_of_base(spark, sf_dir):
    """Balance items as a share of total assets, others of revenue, each with the other as fallback."""
    base = F.when(F.col("metric").isin("current_assets", "non_current_assets", "current_liabilities"), F.coalesce("total_assets", "revenue")).otherwise(F.coalesce("revenue", "total_assets"))
    both = facts(spark, sf_dir).join(wide(spark, sf_dir, ["total_assets", "revenue"]), ["entity", "year"])
    return both.select("entity", "metric", "year", ratio(F.col("value"), base).alias("share"))


_TURNOVER = {"asset_turnover": ("revenue", "total_assets"), "fixed_asset_turnover": ("revenue", "non_current_assets"), "inventory_turnover": ("cost_of_sales", "stock_in_trade"), "debtor_turnover": ("revenue", "trade_debts"), "creditor_turnover": ("cost_of_sales", "trade_payables")}
_DAYS = {"days_inventory": "inventory_turnover", "days_receivables": "debtor_turnover", "days_payables": "creditor_turnover"}


@registry.add(
    "turnover_and_days",
    f"WITH {WIDE_SQL}, t AS (SELECT entity, year, {', '.join(f'abs({a}) / nullif({b}, 0) AS {n}' for n, (a, b) in _TURNOVER.items())} FROM wide) SELECT *, {', '.join(f'365 / nullif({t}, 0) AS {n}' for n, t in _DAYS.items())} FROM t",
)
def turnover_and_days(spark, sf_dir):
    rows = wide(spark, sf_dir, sorted({m for pair in _TURNOVER.values() for m in pair}))
    rows = rows.select("entity", "year", *(ratio(F.abs(a), F.col(b)).alias(n) for n, (a, b) in _TURNOVER.items()))
    return rows.withColumns({n: ratio(F.lit(365.0), F.col(t)) for n, t in _DAYS.items()})


@registry.add(
    "capital_structure",
    f"""WITH {WIDE_SQL} SELECT entity, year, total_liabilities / nullif(total_liabilities + total_equity, 0) * 100 AS debt_pct, total_equity / nullif(total_liabilities + total_equity, 0) * 100 AS equity_pct,
    current_assets - current_liabilities AS working_capital, operating_profit / nullif(total_assets - current_liabilities, 0) AS roce, abs(cost_of_sales) / nullif(revenue, 0) AS cost_ratio FROM wide""",
)
def capital_structure(spark, sf_dir):
    rows = wide(spark, sf_dir, ["total_liabilities", "total_equity", "current_assets", "current_liabilities", "operating_profit", "total_assets", "cost_of_sales", "revenue"])
    capital = F.col("total_liabilities") + F.col("total_equity")
    return rows.select(
        "entity", "year", (ratio(F.col("total_liabilities"), capital) * 100).alias("debt_pct"), (ratio(F.col("total_equity"), capital) * 100).alias("equity_pct"),
        (F.col("current_assets") - F.col("current_liabilities")).alias("working_capital"), ratio(F.col("operating_profit"), F.col("total_assets") - F.col("current_liabilities")).alias("roce"), ratio(F.abs("cost_of_sales"), F.col("revenue")).alias("cost_ratio"),
    )


@registry.add(
    "peer_comparison",
    f"""WITH {FACTS_SQL}, r AS (SELECT n_name AS entity FROM nation) SELECT r.entity, f.value, f.value IS NULL AS partial_coverage, CAST(rank() OVER (ORDER BY f.value DESC NULLS LAST) AS INT) AS place FROM r LEFT JOIN facts f ON f.entity = r.entity AND f.metric = 'pat' AND f.year = 1995""",
)
def peer_comparison(spark, sf_dir, metric: str = "pat", year: int = 1995):
    """One metric of every requested peer, null where it is missing; peers are a short list."""
    peers = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("entity"))
    found = facts(spark, sf_dir, [metric]).where((F.col("year") == year)).select("entity", "value")
    return peers.join(found, "entity", "left").withColumn("partial_coverage", F.col("value").isNull()).withColumn("place", F.rank().over(W.orderBy(F.desc_nulls_last("value"))))
