"""Bitemporal facts from the given star-schema tables.

An observation is the value of a metric of an entity for a value year as a report year knew
it: amounts of order lines are summed up to the report year, so later reports restate earlier
ones. Amounts are whole cents until the end, so sums don't depend on their order. Facts are
the observations of the latest report of each value year.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cents of each line's metrics, as SQL that both engines evaluate alike.
LINE_CENTS = {
    "revenue": "CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)",
    "cost_of_sales": "-CAST(floor(l_quantity * p_retailprice * 100 + 0.5) AS BIGINT)",
    "operating_expenses": "-CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT)",
    "finance_cost": "-CAST(floor(l_extendedprice * 2 + 0.5) AS BIGINT)",
    "taxation": "-CAST(floor(l_extendedprice * (1 - l_discount) * l_tax * 100 + 0.5) AS BIGINT)",
    "depreciation_expense": "CAST(floor(l_quantity * 1000 + 0.5) AS BIGINT)",
    "amortization_expense": "CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity * 200 + 0.5) AS BIGINT) END",
    "capex": "-CAST(p_size AS BIGINT) * 10000",
    "shares_outstanding": "CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)",
}
#: Profits as sums of the above, in an order that later ones build on.
LINE_SUMS = {
    "gross_profit": "revenue + cost_of_sales",
    "operating_profit": "gross_profit + operating_expenses",
    "profit_before_tax": "operating_profit + finance_cost",
    "pat": "profit_before_tax + taxation",
    "operating_cash_flow": "pat + depreciation_expense",
}
#: Balances of a year's orders: the condition of each metric.
ORDER_CENTS = {
    "current_assets": "o_orderstatus = 'O'",
    "non_current_assets": "o_orderstatus = 'F'",
    "current_liabilities": "o_orderstatus = 'P'",
    "non_current_liabilities": "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "stock_in_trade": "o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'",
    "trade_debts": "o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'",
    "trade_payables": "o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM'",
    "cash_and_bank": "o_orderstatus = 'O' AND o_orderpriority = '5-LOW'",
}
ORDER_SUMS = {
    "total_assets": "coalesce(current_assets, 0) + coalesce(non_current_assets, 0)",
    "total_liabilities": "coalesce(current_liabilities, 0) + coalesce(non_current_liabilities, 0)",
    "total_equity": "total_assets - total_liabilities",
    "total_equity_and_liabilities": "total_equity + total_liabilities",
}
LINE_METRICS, ORDER_METRICS = [*LINE_CENTS, *LINE_SUMS], [*ORDER_CENTS, *ORDER_SUMS]
METRICS = [*LINE_METRICS, *ORDER_METRICS]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey, entity): the nation of each customer."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", "entity")


def _needed(metrics: Iterable[str] | None, sums: dict[str, str], among: list[str]) -> set[str]:
    """Those of the metrics that are among these, and what their sums build on."""
    found = set(among if metrics is None else metrics) & set(among)
    for metric, total in reversed(sums.items()):
        if metric in found:
            found |= set(re.findall(r"[a-z_]+", total)) & set(among)
    return found


def observations(spark: SparkSession, sf_dir: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """(entity, metric, value_year, report_year, value) for every report of a value year; of all metrics or of these."""
    wanted = METRICS if metrics is None else list(metrics)
    parts = [of(spark, sf_dir, wanted) for of, among in ((_flows, LINE_METRICS), (_stocks, ORDER_METRICS)) if set(wanted) & set(among)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


_COLUMNS = ["entity", "metric", "value_year", "report_year"]


def _flows(spark: SparkSession, sf_dir: str, metrics: list[str]) -> DataFrame:
    needed = _needed(metrics, LINE_SUMS, LINE_METRICS)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("value_year"))
    owned = orders.join(_owners(spark, sf_dir), orders["o_custkey"] == F.col("c_custkey")).select("o_orderkey", "entity", "value_year")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", F.year("l_shipdate").alias("report_year"))
    lines = lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).where("report_year >= value_year")
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    flows = lines.groupBy("entity", "value_year", "report_year").agg(*(F.sum(F.expr(e)).alias(m) for m, e in LINE_CENTS.items() if m in needed))
    for metric, total in LINE_SUMS.items():
        flows = flows.withColumn(metric, F.expr(total)) if metric in needed else flows
    so_far = W.partitionBy("entity", "metric", "value_year").orderBy("report_year")
    flows = flows.unpivot(["entity", "value_year", "report_year"], [m for m in LINE_METRICS if m in metrics], "metric", "cents").where("cents IS NOT NULL")
    return flows.withColumn("cents", F.sum("cents").over(so_far)).select(*_COLUMNS, (F.col("cents") / 100.0).alias("value"))


def _stocks(spark: SparkSession, sf_dir: str, metrics: list[str]) -> DataFrame:
    needed = _needed(metrics, ORDER_SUMS, ORDER_METRICS)
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("value_year"))
    owned = orders.join(_owners(spark, sf_dir), orders["o_custkey"] == F.col("c_custkey"))
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    stocks = owned.groupBy("entity", "value_year").agg(*(F.sum(F.when(F.expr(c), cents)).alias(m) for m, c in ORDER_CENTS.items() if m in needed))
    for metric, total in ORDER_SUMS.items():
        stocks = stocks.withColumn(metric, F.expr(total)) if metric in needed else stocks
    stocks = stocks.withColumn("report_year", F.col("value_year")).unpivot(["entity", "value_year", "report_year"], [m for m in ORDER_METRICS if m in metrics], "metric", "cents").where("cents IS NOT NULL")
    return stocks.select(*_COLUMNS, (F.col("cents") / 100.0).alias("value"))


def facts(spark: SparkSession, sf_dir: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """(entity, metric, year, report_year, value): what the latest report of each year says; of all metrics or of these."""
    latest = observations(spark, sf_dir, metrics).groupBy("entity", "metric", "value_year").agg(F.max(F.struct("report_year", "value")).alias("x"))
    return latest.select("entity", "metric", F.col("value_year").alias("year"), "x.report_year", "x.value")


#: A metric of lines and one of orders that all their entities and years have.
_ALWAYS = ("revenue", "total_assets")


def wide(spark: SparkSession, sf_dir: str, metrics: list[str] | None = None) -> DataFrame:
    """One row for each entity and year that has any fact, with a column for each metric."""
    found = facts(spark, sf_dir, None if metrics is None else {*metrics, *_ALWAYS})
    return found.groupBy("entity", "year").pivot("metric", metrics or METRICS).agg(F.first("value"))


def _sums_sql(base: str, sums: dict[str, str]) -> str:
    names, out = base, []
    for i, (metric, total) in enumerate(sums.items()):
        out.append(f"{names}_{i} AS (SELECT *, {total} AS {metric} FROM {names if not i else f'{names}_{i - 1}'})")
    return ",\n".join(out)


def _rows_sql(relation: str, report_year: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT entity, '{m}' AS metric, value_year, {report_year} AS report_year, {m} AS cents FROM {relation} WHERE {m} IS NOT NULL" for m in metrics)


#: The same as common table expressions for DuckDB: obs, facts and wide.
OBS_SQL = f"""owned AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(year(o_orderdate) AS INT) AS value_year, n_name AS entity
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
flow AS (SELECT entity, value_year, CAST(year(l_shipdate) AS INT) AS report_year, {", ".join(f"CAST(sum({e}) AS BIGINT) AS {m}" for m, e in LINE_CENTS.items())}
  FROM lineitem JOIN owned ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) >= value_year GROUP BY ALL),
{_sums_sql("flow", LINE_SUMS)},
stock AS (SELECT entity, value_year, {", ".join(f"CAST(sum(CASE WHEN {c} THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END) AS BIGINT) AS {m}" for m, c in ORDER_CENTS.items())} FROM owned GROUP BY ALL),
{_sums_sql("stock", ORDER_SUMS)},
obs AS (SELECT entity, metric, value_year, report_year, CAST(sum(cents) OVER (PARTITION BY entity, metric, value_year ORDER BY report_year) AS BIGINT) / 100.0::DOUBLE AS value
  FROM ({_rows_sql(f"flow_{len(LINE_SUMS) - 1}", "report_year", LINE_METRICS)})
  UNION ALL SELECT entity, metric, value_year, report_year, cents / 100.0::DOUBLE FROM ({_rows_sql(f"stock_{len(ORDER_SUMS) - 1}", "value_year", ORDER_METRICS)}))"""
FACTS_SQL = f"{OBS_SQL},\nfacts AS (SELECT entity, metric, value_year AS year, max(report_year) AS report_year, arg_max(value, report_year) AS value FROM obs GROUP BY ALL)"
WIDE_SQL = f"{FACTS_SQL},\nwide AS (SELECT entity, year, {', '.join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in METRICS)} FROM facts GROUP BY ALL)"
