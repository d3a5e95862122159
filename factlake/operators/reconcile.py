"""Identities repaired from a single source table, and subtotals tied out row by row.

Repairs are one grouping by entity and year: what is trusted and what the tables say become one
row, which holds a few dozen figures, and the identities are folded over it in their order, each
seeing what the one before has changed. Subtotals are a fold over the rows of a sheet that keeps two running sums a year, so a
sheet of any length streams through.
"""

from __future__ import annotations

import json
from itertools import product
from math import prod

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import OBS_SQL, observations, read
from ..sources.scratch import saved

registry = Registry()

#: Sum identities in their order (a term may be alternatives, the first present counts), and metrics kept negative.
IDENTITIES = (
    ("gross_profit", ("revenue", "cost_of_sales")),
    ("cash_at_end_of_period", ("cash_at_beginning_of_period", "operating_cash_flow", "investing_cash_flow", "financing_cash_flow")),
    ("profit_after_tax", ("profit_before_tax", ("tax_expense", "taxation", "income_tax"))),
    ("total_assets", ("non_current_assets", "current_assets")),
    ("total_equity_and_liabilities", ("total_assets",)),
)
EXPENSES = ("cost_of_sales", "tax_expense", "taxation", "income_tax", "finance_cost", "distribution_expenses", "administrative_expenses")
MOST_COMBINATIONS = 256

def _alternatives(term) -> tuple[str, ...]:
    return term if isinstance(term, tuple) else (term,)


def _near(computed: float, stated: float) -> bool:
    return abs(computed - stated) <= max(1.0, 0.01 * abs(stated))


def _picks(offers: list[dict], target: str, terms) -> dict[str, dict] | None:
    """The first combination of a table's offers that meets the identity, by metric."""
    lists = [[o for m in _alternatives(t) for o in offers if o["metric"] == m] for t in (target, *terms)]
    if prod(map(len, lists)) > MOST_COMBINATIONS:
        lists[1:] = [xs if len({round(o["value"], 2) for o in xs}) > 1 else xs[:1] for xs in lists[1:]]
    for one in product(*lists):
        if _near(sum(o["value"] for o in one[1:]), one[0]["value"]):
            return {o["metric"]: o for o in one}
    return None


def _folded(identities, basis: str):
    """The trusted values of an entity and year after all identities, in their order."""

    def fold(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now = {t["metric"]: {**t, "old": t["value"], "changed_by": None, "table_id": None} for t in r["truth"]}
                for target, terms in identities if r["tables"] else ():
                    present = [next((now[m]["value"] for m in _alternatives(t) if m in now and now[m]["value"] is not None), None) for t in (target, *terms)]
                    if None in present or _near(sum(present[1:]), present[0]):
                        continue
                    best = None
                    for table in r["tables"]:
                        picks = _picks(table["offers"], target, terms)
                        if picks is None:
                            continue
                        changed = {m: o for m, o in picks.items() if m not in now or now[m]["value"] != o["value"]}
                        rank = (len(changed), table["basis"] != basis, table["table_id"])
                        best = min(best or (rank, changed), (rank, changed), key=lambda x: x[0])
                    for m, o in best[1].items() if best else ():
                        now[m] = {"metric": m, "value": o["value"], "source": o["source"], "old": now[m]["old"] if m in now else None, "changed_by": target, "table_id": best[0][2]}
                out += [{"entity": r["entity"], "year": r["year"], **x} for x in now.values()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("entity"), batch.schema.field("year"), ("metric", pa.string()), ("value", pa.float64()), ("source", pa.string()), ("old", pa.float64()), ("changed_by", pa.string()), ("table_id", pa.string())]))

    return fold


def reconcile_identities(truth: DataFrame, candidates: DataFrame, basis: str = "unconsolidated", identities=IDENTITIES) -> DataFrame:
    """(entity, year, metric, value, source, old, changed_by, table_id): trusted values, repaired where a table repairs an identity.

    truth: (entity, year, metric, value, source), one row for each metric. candidates: (entity, year,
    table_id, basis, metric, value, source, place); place orders those of a metric in a table.
    Identities are taken in order; one that fails by more than max(1, 1 %) and has all its values
    takes the first combination of the table with the fewest changes, then the wanted basis, then
    the smaller table_id. If a table has more than 256 combinations, terms with one distinct value
    count once. Nothing is changed unless the identity holds afterwards. Expenses count negative.
    changed_by is the last identity that changed a value, old what was trusted before all.
    """
    names = sorted({m for target, terms in identities for t in (target, *terms) for m in _alternatives(t)})
    typed = truth.select("entity", "year", "metric", F.col("value").cast("double").alias("value"), F.col("source").cast("string").alias("source"))
    known = typed.where(F.col("metric").isin(names)).groupBy("entity", "year").agg(F.sort_array(F.collect_list(F.struct("metric", "value", "source"))).alias("truth"))  # as many as metrics
    signed = F.when(F.col("metric").isin(*EXPENSES), -F.abs("value")).otherwise(F.col("value")).cast("double")
    offers = candidates.where(F.col("metric").isin(names) & F.col("value").isNotNull()).select("entity", "year", F.col("table_id").cast("string").alias("table_id"), "basis", "place", "metric", signed.alias("value"), F.col("source").cast("string").alias("source")).distinct()
    by_table = offers.groupBy("entity", "year", "table_id").agg(F.min("basis").alias("basis"), F.sort_array(F.collect_list(F.struct("place", "metric", "value", "source"))).alias("offers"))
    tables = by_table.groupBy("entity", "year").agg(F.sort_array(F.collect_list(F.struct("table_id", "basis", "offers"))).alias("tables"))
    rows = known.join(tables, ["entity", "year"], "left")
    schema = ", ".join([*(f"{c} {truth.schema[c].dataType.simpleString()}" for c in ("entity", "year")), "metric string, value double, source string, old double, changed_by string, table_id string"])
    repaired = rows.mapInArrow(_folded(identities, basis), schema)
    rest = typed.where(~F.col("metric").isin(names) | F.col("metric").isNull()).withColumns({"old": F.col("value"), "changed_by": F.lit(None).cast("string"), "table_id": F.lit(None).cast("string")})
    return repaired.unionByName(rest)


class _Running:
    """Rows summed so far: how many, and for each year the signed sum and the number that have a value."""

    def __init__(self):
        self.rows, self.years = 0, {}

    def add(self, sign: int, values: dict[int, float]) -> None:
        self.rows += 1
        for year, value in values.items():
            s, n = self.years.get(year, (0.0, 0))
            self.years[year] = (s + sign * value, n + 1)

    def __add__(self, other: _Running) -> _Running:
        out = _Running()
        out.rows = self.rows + other.rows
        for part in (self.years, other.years):
            for year, (s, n) in part.items():
                s0, n0 = out.years.get(year, (0.0, 0))
                out.years[year] = (s0 + s, n0 + n)
        return out


def _tied(stated: dict[int, float], summed: dict[int, tuple[float, int]]) -> list[tuple]:
    """(year, stated, computed, contributors, state) of a total row."""
    out = []
    for year in sorted({*stated, *summed}):
        s, n = summed.get(year, (0.0, 0))
        want = stated.get(year)
        state = "too_few" if n < 2 else "no_total" if want is None else "tied" if abs(s - want) <= 1e-6 + 1e-3 * abs(want) else "mismatch"
        out.append((year, want, s if n else None, n, state))
    return out


_LINE = ["sheet", "ord", "label", "role", "contra", "components"]
#: Kinds of lines for the fold, negative for contra rows; what has a value and is nothing else is a leaf.
SECTION, VALUED, TOTAL = 1, 2, 3


def _tied_lines(known: DataFrame) -> DataFrame:
    """The lines of known (_LINE, year, value, kind, parts), which lie by sheet, through _follow; labels go along for totals only."""
    code = F.when(F.col("kind") == "section", SECTION).when(F.col("kind") == "valued", VALUED).otherwise(TOTAL)
    code = F.when(F.col("contra") & (F.col("kind") != "section"), -code).otherwise(code)
    slim = known.select("sheet", "ord", F.xxhash64("ord", "label", "role", "contra", "components").alias("line"), F.when((F.col("kind") == "total") & F.col("ord").isNotNull(), F.col("label")).alias("label"), code.alias("kind"), "parts", "year", "value")
    out = slim.sortWithinPartitions("sheet", "ord", "line", "year").mapInArrow(_follow, "sheet string, ord long, label string, method string, year int, stated double, computed double, contributors long, state string")
    return out.where("label IS NOT NULL")  # rows without a place count first, but none of them is given out


def _follow(batches):
    """The lines of sheets in order, a row for each year, folded with two running sums: leaves since the last total or header, and open subtotals."""
    sheet, leaves, totals = None, _Running(), _Running()
    kinds = [("sheet", pa.string()), ("ord", pa.int64()), ("label", pa.string()), ("method", pa.string()), ("year", pa.int32()), ("stated", pa.float64()), ("computed", pa.float64()), ("contributors", pa.int64()), ("state", pa.string())]
    line, kind, parts, values, out = None, None, None, {}, []

    def close():
        nonlocal sheet, leaves, totals
        if line[0] != sheet:
            sheet, leaves, totals = line[0], _Running(), _Running()
        sign = -1 if kind in (-VALUED, -TOTAL) else 1
        if kind == SECTION:
            leaves = _Running()
        elif abs(kind) == VALUED and values:
            leaves.add(sign, values)
        if abs(kind) != TOTAL:
            return
        own = _Running()
        own.add(sign, values)
        if parts is not None:  # its components are named, and all found
            found = _tied(values, {int(y): (p["s"], p["n"]) for y, p in json.loads(parts).items()})
            method = "components"
            if any(x[-1] == "tied" for x in found):
                totals = own
        elif leaves.rows >= 2:
            found, method = _tied(values, leaves.years), "leaf_block"
            totals = totals + own
        else:
            both = totals + leaves
            found, method = _tied(values, both.years) if both.rows >= 2 else [(y, v, None, 0, "too_few") for y, v in sorted(values.items())], "running"
            if any(x[-1] == "tied" for x in found):
                totals = own
        leaves = _Running()
        out.extend((sheet, line[2], line[3], method, *x) for x in found)

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    for batch in batches:
        given = pc.and_(batch.column("year").is_valid(), batch.column("value").is_valid())
        whole = [pc.fill_null(batch.column(c), 0) for c in ("ord", "year", "value")]
        columns = [x.to_numpy(zero_copy_only=False).tolist() for x in (batch.column("sheet"), batch.column("line"), batch.column("label"), batch.column("kind"), batch.column("parts"), given, *whole)]
        for of_sheet, of_line, label, own_kind, own_parts, has_value, at, year, value in zip(*columns, strict=True):
            if line is None or of_line != line[1] or at != line[2] or of_sheet != line[0]:
                if line is not None:
                    close()
                line, kind, parts, values = (of_sheet, of_line, at, label), own_kind, own_parts, {}
            if has_value:
                values[year] = value
        yield batch_of()
        out.clear()
    if line is not None:
        close()
        yield batch_of()


def tie_subtotals(lines: DataFrame) -> DataFrame:
    """(sheet, ord, label, method, year, stated, computed, contributors, state) of each total row and year.

    lines: (sheet string, ord, label, role, is_contra, components array of labels, year, value), a row
    for each year; role decides the kind, or else the label. A total sums the rows that its
    components name, the nearest above it or else the nearest, if all are found and two differ;
    else the leaves since the last total or header, if there are two; else open subtotals and the
    leaf. Contra rows count negative, totals too. A sum counts with two contributors, against a
    stated total within 0.1 % (state tied, mismatch, no_total, too_few). A leaf block's total is an
    open subtotal whether it ties or not; a total that ties otherwise replaces the open ones.
    Null years and values have no part, of repeated rows the largest value; rows without a
    label or sheet are skipped. Rows are shuffled once, by sheet; where components are named, the
    joined rows once more.
    """
    known = lines.where("trim(coalesce(label, '')) <> '' AND sheet IS NOT NULL")
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    by_year = F.to_json(F.map_from_entries(F.collect_list(F.when(F.col("year").isNotNull() & F.col("value").isNotNull(), F.struct(F.col("year").cast("string"), F.col("value").cast("double"))))))
    known = known.select("sheet", F.col("ord").cast("long").alias("ord"), F.trim("label").alias("label"), role.alias("role"), F.coalesce("is_contra", F.lit(False)).alias("contra"), "components", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))
    by_role = F.when(F.col("role").isin("total", "subtotal"), "total").when(F.col("role") == "section_header", "section").otherwise("valued")
    by_label = F.when(T.is_total_row(F.col("label")), "total").when(T.is_section_header(F.col("label")), "section").otherwise("valued")
    kind = F.when(F.col("role").isin("leaf", "subtotal", "total", "section_header"), by_role).otherwise(by_label)
    known = known.repartition("sheet").groupBy(*_LINE, "year").agg(F.max("value").alias("value")).withColumn("kind", kind)  # kind valued: a leaf if it has a value
    if lines.where("size(components) > 0").isEmpty():
        return _tied_lines(known.withColumn("parts", F.lit(None).cast("string")))
    known = saved(known)
    rows = known.groupBy(*_LINE, "kind").agg(by_year.alias("by_year"), F.bool_or(F.col("value").isNotNull() & F.col("year").isNotNull()).alias("has_value"))
    rows = rows.withColumns({"kind": F.when(F.col("kind") != "valued", F.col("kind")).when(F.col("has_value"), "leaf").otherwise("none"), "norm": T.spaced(F.col("label"))})
    # the rows that components name
    asked = rows.where("kind = 'total' AND size(components) > 0").select("sheet", "ord", F.size("components").alias("asked"), F.posexplode(F.transform("components", lambda c: T.spaced(c))).alias("part", "norm"))
    usable = rows.where("kind IN ('leaf', 'total')").select("sheet", "norm", F.col("ord").alias("at"), "by_year", "contra")
    nearest = F.struct(F.col("at") >= F.col("ord"), F.abs(F.col("at") - F.col("ord")))
    found = asked.join(usable, ["sheet", "norm"]).groupBy("sheet", "ord", "asked", "part").agg(F.min_by(F.struct("at", "by_year", "contra"), nearest).alias("x"))
    summed = found.groupBy("sheet", "ord", "asked").agg(F.count("*").alias("got"), F.collect_set("x").alias("rows")).where("got = asked AND size(rows) >= 2")
    terms = summed.select("sheet", "ord", F.explode("rows").alias("x")).select("sheet", "ord", "x.contra", F.explode(F.from_json("x.by_year", "map<string,double>")).alias("year", "value"))
    sums = terms.groupBy("sheet", "ord", "year").agg(F.sum(F.when(F.col("contra"), -F.col("value")).otherwise(F.col("value"))).alias("s"), F.count("*").alias("n"))
    parts = summed.select("sheet", "ord").join(sums, ["sheet", "ord"], "left").groupBy("sheet", "ord").agg(F.to_json(F.map_from_entries(F.collect_list(F.when(F.col("year").isNotNull(), F.struct(F.col("year").cast("string"), F.struct("s", "n")))))).alias("parts"))
    return _tied_lines(known.join(parts, ["sheet", "ord"], "left").repartition("sheet"))


#: The identities of the query below, in the metrics of the given tables.
OWN = (("gross_profit", ("revenue", "cost_of_sales")), ("total_assets", ("non_current_assets", "current_assets")), ("total_equity_and_liabilities", ("total_assets",)))
_OWN_METRICS = sorted({m for t, ms in OWN for m in (t, *ms)})


def _reconcile_sql() -> str:
    near = lambda p, t, ms: f"abs({' + '.join(p + m for m in ms)} - {p}{t}) <= greatest(1, 0.01 * abs({p}{t}))"
    first = ", ".join(f"arg_{'min' if i % 2 else 'max'}({m}, report_year) FILTER ({m} IS NOT NULL) AS {m}" for i, m in enumerate(_OWN_METRICS))
    by = ", ".join(f"CAST(NULL AS VARCHAR) AS by_{m}" for m in _OWN_METRICS)
    steps = [f"t0 AS (SELECT entity, year, {first}, {by} FROM r GROUP BY ALL)"]
    for i, (target, terms) in enumerate(OWN):
        used = [target, *terms]
        changes = " + ".join(f"CAST(r.{m} <> t.{m} AS INT)" for m in used)
        best = f"""SELECT t.entity AS be, t.year AS by_, {', '.join(f'r.{m} AS n_{m}' for m in used)} FROM t{i} t JOIN r ON r.entity = t.entity AND r.year = t.year
          WHERE NOT ({near('t.', target, terms)}) AND {near('r.', target, terms)} QUALIFY row_number() OVER (PARTITION BY t.entity, t.year ORDER BY {changes}, report_year % 2, CAST(report_year AS VARCHAR)) = 1"""
        columns = ", ".join((f"coalesce(n_{m}, {m}) AS {m}" if m in used else m) for m in _OWN_METRICS)
        names = ", ".join((f"CASE WHEN n_{m} IS NOT NULL AND n_{m} <> {m} THEN '{target}' ELSE by_{m} END AS by_{m}" if m in used else f"by_{m}") for m in _OWN_METRICS)
        steps.append(f"t{i + 1} AS (SELECT entity, year, {columns}, {names} FROM t{i} LEFT JOIN ({best}) b ON be = entity AND by_ = year)")
    wide = ", ".join(f"max(CASE WHEN metric = '{m}' THEN CASE WHEN metric = 'cost_of_sales' THEN -abs(value) ELSE value END END) AS {m}" for m in _OWN_METRICS)
    rows = " UNION ALL ".join(f"SELECT t.entity, t.year, '{m}' AS metric, t.{m} AS value, o.{m} AS old, t.by_{m} AS changed_by FROM t{len(OWN)} t JOIN t0 o USING (entity, year) WHERE t.{m} IS NOT NULL" for m in _OWN_METRICS)
    return f"WITH {OBS_SQL}, r AS (SELECT entity, value_year AS year, report_year, {wide} FROM obs GROUP BY ALL), {', '.join(steps)} {rows}"


@registry.add("identity_reconcile", _reconcile_sql())
def identity_reconcile(spark, sf_dir):
    """Trusted values mixed from the oldest and newest reports, repaired by single reports; even report years are of the wanted basis."""
    o = observations(spark, sf_dir, _OWN_METRICS)
    signed = F.when(F.col("metric") == "cost_of_sales", -F.abs("value")).otherwise(F.col("value"))
    tables = o.select("entity", F.col("value_year").alias("year"), F.col("report_year").cast("string").alias("table_id"), F.when(F.col("report_year") % 2 == 0, "unconsolidated").otherwise("consolidated").alias("basis"), "metric", signed.alias("value"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("place"), "report_year")
    oldest = F.col("metric").isin(*_OWN_METRICS[1::2])
    truth = tables.groupBy("entity", "year", "metric").agg(F.when(oldest, F.min_by("value", "report_year")).otherwise(F.max_by("value", "report_year")).alias("value")).withColumn("source", F.lit(None).cast("string"))
    return reconcile_identities(truth, tables.drop("report_year"), identities=OWN).select("entity", "year", "metric", "value", "old", "changed_by")


@registry.add(
    "sheet_subtotals",
    """WITH l AS (SELECT l_orderkey, l_returnflag, year(l_shipdate) AS year, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem GROUP BY ALL),
    k AS (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY ALL HAVING count(*) >= 2),
    s AS (SELECT l.*, CASE WHEN l_orderkey % 7 = 0 THEN cents + 100000 ELSE cents END AS stated FROM l JOIN k USING (l_orderkey, l_returnflag)),
    g AS (SELECT l_orderkey, year, CAST(sum(stated) AS BIGINT) AS computed, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY ALL), m AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS groups FROM s GROUP BY ALL)
    SELECT CAST(l_orderkey AS VARCHAR) AS sheet, 'Total ' || l_returnflag AS label, 'leaf_block' AS method, CAST(year AS INT) AS year, round(stated / 100.0::DOUBLE, 2) AS stated, round(cents / 100.0::DOUBLE, 2) AS computed, n AS contributors,
      CASE WHEN n < 2 THEN 'too_few' WHEN abs(cents - stated) <= 1e-4 + 1e-3 * stated THEN 'tied' ELSE 'mismatch' END AS state FROM s
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'Total', 'running', CAST(year AS INT), round(cents / 100.0::DOUBLE, 2), CASE WHEN groups >= 2 THEN round(computed / 100.0::DOUBLE, 2) END, CASE WHEN groups >= 2 THEN n ELSE 0 END,
      CASE WHEN groups < 2 OR n < 2 THEN 'too_few' WHEN abs(computed - cents) <= 1e-4 + 1e-3 * cents THEN 'tied' ELSE 'mismatch' END FROM g JOIN m USING (l_orderkey)""",
)
def sheet_subtotals(spark, sf_dir):
    """Each order as a sheet: lines under headers by return flag, a subtotal for each, a grand total; some stated totals are wrong."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", F.year("l_shipdate").alias("year"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    flagged = W.partitionBy("l_orderkey", "l_returnflag")
    lines = lines.where("l_orderkey IS NOT NULL AND l_returnflag IS NOT NULL").withColumns({"group": F.ascii("l_returnflag") * 1_000, "n": F.count("*").over(flagged), "l_linenumber": F.row_number().over(flagged.orderBy("l_linenumber", "year", "cents"))})
    lines = saved(lines.where("n >= 2").drop("n"))
    row = lambda df, at, label, role, cents: df.select(F.col("l_orderkey").cast("string").alias("sheet"), at.alias("ord"), label.alias("label"), F.lit(role).alias("role"), F.lit(False).alias("is_contra"), F.lit(None).cast("array<string>").alias("components"), "year", (cents / 100.0).alias("value"))
    sums = saved(lines.groupBy("l_orderkey", "l_returnflag", "group", "year").agg(F.sum("cents").alias("cents")))
    wrong = F.when(F.col("l_orderkey") % 7 == 0, F.col("cents") + 100_000).otherwise(F.col("cents"))
    grand = sums.groupBy("l_orderkey", "year").agg(F.sum("cents").alias("cents"))
    sheet = row(lines.where("false"), F.col("group"), F.col("l_returnflag"), "leaf", F.col("cents"))
    sheet = sheet.unionByName(row(sums.withColumn("year", F.lit(None).cast("int")), F.col("group"), F.concat(F.lit("FLAG "), F.col("l_returnflag")), None, F.lit(None).cast("double")).distinct())
    sheet = sheet.unionByName(row(lines, F.col("group") + F.col("l_linenumber"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")), "leaf", F.col("cents")))
    sheet = sheet.unionByName(row(sums, F.col("group") + 999, F.concat(F.lit("Total "), F.col("l_returnflag")), None, wrong)).unionByName(row(grand, F.lit(10_000_000), F.lit("Total"), "total", F.col("cents")))
    return tie_subtotals(sheet).select("sheet", "label", "method", "year", F.round("stated", 2).alias("stated"), F.round("computed", 2).alias("computed"), "contributors", "state")
