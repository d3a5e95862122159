"""A declarative formula library: data that is compiled to columns over pivoted facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import WIDE_SQL, observations, wide

registry = Registry()


@dataclass(frozen=True)
class Input:
    """A metric at a year offset; a missing optional one counts as 0, a missing required one gives null."""

    key: str
    metric: str
    offset: int = 0
    required: bool = True


@dataclass(frozen=True)
class Formula:
    name: str
    category: str
    expression: str
    inputs: tuple[Input, ...]
    guard: str = "true"
    unit: str = "ratio"

    def value_sql(self) -> str:
        """The guarded expression over columns named by input keys."""
        return f"CASE WHEN {self.guard} THEN {self.expression} END"


FORMULAS: dict[str, Formula] = {}


def register_formula(formula: Formula) -> Formula:
    if formula.name in FORMULAS:
        raise ValueError(f"{formula.name} is registered already")
    FORMULAS[formula.name] = formula
    return formula


def _i(*metrics: str) -> tuple[Input, ...]:
    """Inputs named by their metric; `x-1` is the year before, `x?` optional."""
    out = []
    for m in metrics:
        name = m.removesuffix("?").removesuffix("-1")
        out.append(Input(name + ("_prev" if "-1" in m else ""), name, -1 if "-1" in m else 0, not m.endswith("?")))
    return tuple(out)


for _name, _category, _expression, _inputs, _guard, _unit in (
    ("revenue_growth", "growth", "(revenue - revenue_prev) / revenue_prev", _i("revenue", "revenue-1"), "revenue_prev <> 0", "ratio"),
    ("earnings_growth", "growth", "(pat - pat_prev) / pat_prev", _i("pat", "pat-1"), "pat_prev <> 0", "ratio"),
    ("gross_margin", "margin", "gross_profit / revenue", _i("gross_profit", "revenue"), "revenue <> 0", "ratio"),
    ("operating_margin", "margin", "operating_profit / revenue", _i("operating_profit", "revenue"), "revenue <> 0", "ratio"),
    ("net_margin", "margin", "pat / revenue", _i("pat", "revenue"), "revenue <> 0", "ratio"),
    ("roe", "return", "pat / ((total_equity + total_equity_prev) / 2)", _i("pat", "total_equity", "total_equity-1"), "total_equity + total_equity_prev > 0", "ratio"),
    ("roa", "return", "pat / ((total_assets + total_assets_prev) / 2)", _i("pat", "total_assets", "total_assets-1"), "total_assets + total_assets_prev <> 0", "ratio"),
    ("current_ratio", "liquidity", "current_assets / current_liabilities", _i("current_assets", "current_liabilities"), "current_liabilities <> 0", "x"),
    ("quick_ratio", "liquidity", "(current_assets - stock_in_trade) / current_liabilities", _i("current_assets", "stock_in_trade?", "current_liabilities"), "current_liabilities <> 0", "x"),
    ("cash_ratio", "liquidity", "cash_and_bank / current_liabilities", _i("cash_and_bank", "current_liabilities"), "current_liabilities <> 0", "x"),
    ("debt_to_equity", "leverage", "(non_current_liabilities + current_liabilities) / total_equity", _i("non_current_liabilities", "current_liabilities", "total_equity"), "total_equity > 0", "x"),
    ("debt_to_assets", "leverage", "(non_current_liabilities + current_liabilities) / total_assets", _i("non_current_liabilities", "current_liabilities", "total_assets"), "total_assets <> 0", "ratio"),
    ("equity_multiplier", "leverage", "total_assets / total_equity", _i("total_assets", "total_equity"), "total_equity > 0", "x"),
    ("interest_coverage", "leverage", "operating_profit / abs(finance_cost)", _i("operating_profit", "finance_cost"), "finance_cost <> 0", "x"),
    ("asset_turnover", "efficiency", "revenue / total_assets", _i("revenue", "total_assets"), "total_assets <> 0", "x"),
    ("free_cash_flow", "cash", "operating_cash_flow + capex", _i("operating_cash_flow", "capex"), "true", "currency"),
    ("ebitda", "cash", "operating_profit + depreciation_expense + amortization_expense", _i("operating_profit", "depreciation_expense", "amortization_expense?"), "true", "currency"),
    ("book_value_per_share", "per_share", "total_equity / shares_outstanding", _i("total_equity", "shares_outstanding"), "shares_outstanding <> 0", "currency/share"),
    ("eps_computed", "per_share", "pat / shares_outstanding", _i("pat", "shares_outstanding"), "shares_outstanding <> 0", "currency/share"),
):
    register_formula(Formula(_name, _category, _expression, _inputs, _guard, _unit))


def with_inputs(rows: DataFrame, formula: Formula) -> DataFrame:
    """(entity, year, *keys): the formula's inputs; earlier years by a join on year + offset."""
    now = [i for i in formula.inputs if i.offset == 0]
    filled = lambda i: F.col(i.metric) if i.required else F.coalesce(i.metric, F.lit(0.0))
    out = rows.select("entity", "year", *(filled(i).alias(i.key) for i in now))
    for offset in sorted({i.offset for i in formula.inputs} - {0}):
        then = [i for i in formula.inputs if i.offset == offset]
        other = rows.select("entity", (F.col("year") - offset).alias("year"), *(filled(i).alias(i.key) for i in then))
        out = out.join(other, ["entity", "year"], "left")
    return out


def compiled(formula: Formula) -> Column:
    return F.expr(formula.value_sql()).cast("double")


def evaluate(rows: DataFrame, formula: Formula) -> DataFrame:
    """(entity, year, value, note): null with a note where an input is missing or the guard fails."""
    missing = F.filter(F.array(*(F.when(F.col(i.key).isNull(), F.lit(i.key)) for i in formula.inputs)), lambda x: x.isNotNull())
    out = with_inputs(rows, formula).withColumn("value", compiled(formula))
    note = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(F.col("value").isNull(), F.lit("guard failed"))
    return out.select("entity", "year", "value", note.alias("note"))


def formula_sql(formula: Formula) -> str:
    """DuckDB SQL for evaluate() over the CTE wide."""
    filled = lambda i, t: f"{t}.{i.metric}" if i.required else f"coalesce({t}.{i.metric}, 0.0)"
    columns, joins = [], []
    for i in formula.inputs:
        t = "w" if i.offset == 0 else f"p{-i.offset}"
        value = filled(i, t)
        columns.append(f"{value} AS {i.key}")
        join = f"LEFT JOIN wide {t} ON {t}.entity = w.entity AND {t}.year = w.year + {i.offset}"
        if t != "w" and join not in joins:
            joins.append(join)
    missing = ", ".join(f"CASE WHEN {i.key} IS NULL THEN '{i.key}' END" for i in formula.inputs)
    return f"""WITH {WIDE_SQL},
i AS (SELECT w.entity, w.year, {", ".join(columns)} FROM wide w {" ".join(joins)}),
v AS (SELECT *, CAST({formula.value_sql()} AS DOUBLE) AS value, list_filter([{missing}], lambda x: x IS NOT NULL) AS missing FROM i)
SELECT entity, year, value, CASE WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ', ') WHEN value IS NULL THEN 'guard failed' END AS note FROM v"""


def _register(formula: Formula) -> None:
    needed = sorted({i.metric for i in formula.inputs})

    @registry.add(f"formula_{formula.name}", formula_sql(formula))
    def query(spark, sf_dir):
        return evaluate(wide(spark, sf_dir, needed), formula)


for _formula in FORMULAS.values():
    _register(_formula)

#: The forecast of a year is its first report; the actual is its latest one.
FORECAST_ERROR = register_formula(Formula("forecast_error", "forecast", "(actual - forecast) / forecast", (Input("actual", "revenue"), Input("forecast", "revenue")), "forecast <> 0"))


@registry.add(
    "formula_forecast_error",
    f"""WITH {WIDE_SQL},
x AS (SELECT entity, value_year AS year, arg_max(value, report_year) AS actual, arg_min(value, report_year) AS forecast FROM obs WHERE metric = 'revenue' GROUP BY ALL)
SELECT entity, year, CAST({FORECAST_ERROR.value_sql()} AS DOUBLE) AS value FROM x""",
)
def forecast_error(spark, sf_dir):
    revenue = observations(spark, sf_dir, ["revenue"]).groupBy("entity", F.col("value_year").alias("year"))
    pairs = revenue.agg(F.max_by("value", "report_year").alias("actual"), F.min_by("value", "report_year").alias("forecast"))
    return pairs.select("entity", "year", compiled(FORECAST_ERROR).alias("value"))
