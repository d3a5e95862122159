"""Grids, pages and names: cells to facts, carried context, continuation, subtotals, resolution, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import FACTS_SQL, facts, read

registry = Registry()

_SHOWN = ["revenue", "cost_of_sales", "gross_profit", "pat"]
_SHOWN_SQL = ", ".join(f"'{m}'" for m in _SHOWN)
#: Each entity's facts as the cells of a sheet: a title, a header row of years, then lines.
_CELLS_SQL = f"""{FACTS_SQL}, s AS (SELECT * FROM facts WHERE metric IN ({_SHOWN_SQL})),
cells AS (SELECT entity AS sheet, 1 AS row_no, 1 AS col_no, 'Statement of ' || entity AS cell FROM s GROUP BY entity
  UNION ALL SELECT entity, 3, year - 1989, CAST(year AS VARCHAR) FROM s GROUP BY entity, year
  UNION ALL SELECT entity, 4, 1, 'PROFIT AND LOSS' FROM s GROUP BY entity
  UNION ALL SELECT entity, 4 + list_position({_SHOWN}, metric), 1, metric FROM s GROUP BY entity, metric
  UNION ALL SELECT entity, 4 + list_position({_SHOWN}, metric), year - 1989, CAST(CAST(round(value) AS BIGINT) AS VARCHAR) FROM s)"""


def cells(spark, sf_dir) -> DataFrame:
    """(sheet, row_no, col_no, cell) of a sheet for each entity."""
    s = facts(spark, sf_dir, _SHOWN)
    row = (4 + F.array_position(F.array(*map(F.lit, _SHOWN)), F.col("metric"))).cast("int")
    col = F.col("year") - 1989
    at = lambda r, c, cell: F.struct(r.alias("row_no"), c.alias("col_no"), cell.alias("cell"))
    each = F.array(
        at(F.lit(1), F.lit(1), F.concat(F.lit("Statement of "), F.col("entity"))),
        at(F.lit(3), col, F.col("year").cast("string")),
        at(F.lit(4), F.lit(1), F.lit("PROFIT AND LOSS")),
        at(row, F.lit(1), F.col("metric")),
        at(row, col, F.round("value").cast("long").cast("string")),
    )
    return s.select(F.col("entity").alias("sheet"), F.explode(each).alias("c")).select("sheet", "c.*").distinct()


@registry.add(
    "grid_to_facts",
    f"""WITH {_CELLS_SQL}, y AS (SELECT sheet, row_no, count(*) AS n FROM cells WHERE row_no <= 8 AND regexp_full_match(cell, '(19|20)[0-9]{{2}}') GROUP BY ALL HAVING count(*) >= 2),
    h AS (SELECT sheet, row_no FROM y QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY n DESC, row_no) = 1),
    c AS (SELECT cells.sheet, col_no, CAST(cell AS INT) AS year FROM cells JOIN h ON cells.sheet = h.sheet AND cells.row_no = h.row_no),
    l AS (SELECT cells.sheet, cells.row_no, cell AS label, NOT EXISTS (SELECT 1 FROM cells v WHERE v.sheet = cells.sheet AND v.row_no = cells.row_no AND v.col_no > 1) AND upper(cell) = cell AS is_section FROM cells JOIN h ON cells.sheet = h.sheet WHERE col_no = 1 AND cells.row_no > h.row_no),
    d AS (SELECT *, last_value(CASE WHEN is_section THEN label END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no) AS section FROM l)
    SELECT d.sheet, d.section, d.label, c.year, CAST(v.cell AS DOUBLE) AS value FROM d JOIN cells v ON v.sheet = d.sheet AND v.row_no = d.row_no JOIN c ON c.sheet = v.sheet AND c.col_no = v.col_no WHERE NOT is_section""",
)
def grid_to_facts(spark, sf_dir):
    """Header row by most years, sections carried down, one fact for each line and year column."""
    grid = cells(spark, sf_dir)
    year_cells = grid.where((F.col("row_no") <= 8) & F.col("cell").rlike("^(19|20)[0-9]{2}$"))
    header = year_cells.groupBy("sheet", "row_no").agg(F.count("*").alias("n")).where("n >= 2").groupBy("sheet").agg(F.max(F.struct("n", (-F.col("row_no")).alias("up"))).alias("h")).select("sheet", (-F.col("h.up")).alias("header_row"))
    columns = year_cells.join(header, "sheet").where("row_no = header_row").select("sheet", "col_no", F.col("cell").cast("int").alias("year"))
    rows = grid.join(header, "sheet").where("row_no > header_row").groupBy("sheet", "row_no").agg(F.max(F.when(F.col("col_no") == 1, F.col("cell"))).alias("label"), F.count_if(F.col("col_no") > 1).alias("values"))
    section = F.when((F.col("values") == 0) & (F.upper("label") == F.col("label")), F.col("label"))
    rows = rows.withColumn("section", F.last(section, ignorenulls=True).over(W.partitionBy("sheet").orderBy("row_no"))).where("values > 0")
    found = rows.join(grid, ["sheet", "row_no"]).join(columns, ["sheet", "col_no"])
    return found.select("sheet", "section", "label", "year", F.col("cell").cast("double").alias("value"))


@registry.add(
    "transposed_grid",
    f"""WITH {_CELLS_SQL} SELECT sheet, col_no AS row_no, row_no AS col_no, cell FROM cells WHERE row_no >= 3""",
)
def transposed_grid(spark, sf_dir):
    return cells(spark, sf_dir).where("row_no >= 3").select("sheet", F.col("col_no").alias("row_no"), F.col("row_no").alias("col_no"), "cell")


@registry.add(
    "sheet_profile",
    f"""WITH {_CELLS_SQL}, y AS (SELECT count(DISTINCT year) AS years, entity FROM facts GROUP BY entity) SELECT sheet, count(*) FILTER (WHERE col_no > 1 AND row_no > 4) AS filled, any_value(years) * 4 AS room, 1 - count(*) FILTER (WHERE col_no > 1 AND row_no > 4) / CAST(any_value(years) * 4 AS DOUBLE) AS empty_share, CASE WHEN 1 - count(*) FILTER (WHERE col_no > 1 AND row_no > 4) / CAST(any_value(years) * 4 AS DOUBLE) < 0.2 THEN 'output' ELSE 'input' END AS kind FROM cells JOIN y ON y.entity = sheet GROUP BY sheet""",
)
def sheet_profile(spark, sf_dir):
    """Sheets as output or input by how much of labelled rows and year columns is empty."""
    years = facts(spark, sf_dir).groupBy(F.col("entity").alias("sheet")).agg((F.countDistinct("year") * 4).alias("room"))
    filled = cells(spark, sf_dir).groupBy("sheet").agg(F.count_if((F.col("col_no") > 1) & (F.col("row_no") > 4)).alias("filled"))
    empty = 1 - F.col("filled") / F.col("room").cast("double")
    return filled.join(years, "sheet").select("sheet", "filled", "room", empty.alias("empty_share"), F.when(empty < 0.2, "output").otherwise("input").alias("kind"))


#: Columns of the wide statement: all years that the given orders can have.
STATEMENT_YEARS = range(1992, 2003)


@registry.add(
    "wide_statement",
    f"""WITH {FACTS_SQL} SELECT entity, metric, {", ".join(f"max(CASE WHEN year = {y} THEN value END) AS y{y}" for y in STATEMENT_YEARS)} FROM facts GROUP BY ALL""",
)
def wide_statement(spark, sf_dir):
    years = list(STATEMENT_YEARS)
    wide = facts(spark, sf_dir).groupBy("entity", "metric").pivot("year", years).agg(F.first("value"))
    return wide.select("entity", "metric", *(F.col(str(y)).alias(f"y{y}") for y in years))


@registry.add(
    "carried_basis",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked_at FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) = 1""",
)
def carried_basis(spark, sf_dir):
    """Context carried to later turns: the last user turn so far."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("own"))
    return c.select("conv_id", "turn", F.last("own", ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn")).alias("asked_at"))


@registry.add(
    "continued_runs",
    """WITH e AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS before, date_diff('second', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(CASE WHEN before = event_type AND gap <= 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY user_id, run""",
)
def continued_runs(spark, sf_dir):
    """Neighbours of the same kind and close in time merge into one run, as continued tables do."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    gap = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.date_trunc("second", F.lag("ts").over(w)))
    new = F.when((F.lag("event_type").over(w) == F.col("event_type")) & (gap <= 86400), 0).otherwise(1)
    return e.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@registry.add(
    "page_sections",
    """WITH s AS (SELECT entity, k, lo, lead(lo) OVER (PARTITION BY entity ORDER BY lo) - 1 AS hi FROM (SELECT s_nationkey AS entity, s_suppkey % 10 AS k, min(s_suppkey) AS lo FROM supplier GROUP BY ALL))
    SELECT p.s_suppkey AS page, p.s_nationkey AS entity, s.k AS section FROM supplier p JOIN s ON s.entity = p.s_nationkey AND p.s_suppkey >= s.lo AND p.s_suppkey <= coalesce(s.hi, p.s_suppkey)""",
)
def page_sections(spark, sf_dir):
    """Pages to the section that began last: starts are carried, so no range join is needed."""
    p = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_nationkey").alias("entity"), (F.col("s_suppkey") % 10).alias("k"))
    first = p.groupBy("entity", "k").agg(F.min("page").alias("page")).withColumn("starts", F.col("k")).drop("k")
    carried = F.last("starts", ignorenulls=True).over(W.partitionBy("entity").orderBy("page"))
    return p.join(first, ["entity", "page"], "left").select("page", "entity", carried.alias("section"))


@registry.add(
    "subtotal_tie_out",
    """WITH l AS (SELECT l_orderkey, count(*) AS parts, CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS summed FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, parts, summed, o_totalprice AS stated, abs(summed - o_totalprice) <= 1e-6 + 0.001 * abs(o_totalprice) AS ties FROM orders JOIN l ON o_orderkey = l_orderkey WHERE parts >= 2""",
)
def subtotal_tie_out(spark, sf_dir):
    """Order totals against the sum of at least two lines."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 100 + 0.5).cast("long")
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parts"), (F.sum(cents) / 100.0).alias("summed")).where("parts >= 2")
    both = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("stated")).join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", "parts", "summed", "stated", (F.abs(F.col("summed") - F.col("stated")) <= 1e-6 + 0.001 * F.abs("stated")).alias("ties"))


@registry.add(
    "source_provenance",
    """WITH x AS (SELECT o_custkey, o_orderpriority, list_sort(list(DISTINCT CAST(year(o_orderdate) AS INT))) AS pages, count(*) AS weight FROM orders GROUP BY ALL)
    SELECT o_custkey AS sheet, o_orderpriority AS file, pages, weight, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, o_orderpriority) AS INT) AS place FROM x""",
)
def source_provenance(spark, sf_dir):
    x = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sheet"), F.col("o_orderpriority").alias("file")).agg(F.sort_array(F.collect_set(F.year("o_orderdate"))).alias("pages"), F.count("*").alias("weight"))
    return x.withColumn("place", F.row_number().over(W.partitionBy("sheet").orderBy(F.desc("weight"), "file")))


_QUERY_NAMES_SQL = """q AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN s_name WHEN c_custkey % 4 = 1 THEN upper(s_name) WHEN c_custkey % 4 = 2 THEN 'S' || s_suppkey ELSE c_name END AS q FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) + 1)"""


@registry.add(
    "entity_resolution_exact",
    f"""WITH {_QUERY_NAMES_SQL}, m AS (SELECT s_suppkey, 'S' || s_suppkey AS symbol, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS key FROM supplier)
    SELECT c_custkey, q, coalesce(t.symbol, n.symbol) AS ticker, CAST(CASE WHEN t.symbol IS NOT NULL THEN 0.99 WHEN n.symbol IS NOT NULL THEN 0.98 ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN t.symbol IS NOT NULL OR n.symbol IS NOT NULL THEN 'RESOLVED' ELSE 'QUARANTINED' END AS state
    FROM q LEFT JOIN m t ON t.symbol = q.q LEFT JOIN m n ON n.key = regexp_replace(lower(q.q), '[^a-z0-9]+', '', 'g')""",
)
def entity_resolution_exact(spark, sf_dir):
    """Queries to tickers: exact ticker, then exact name in any case, else quarantined."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = s.agg(F.count("*").alias("n_suppliers"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(F.broadcast(n))  # one row
    c = c.join(s, F.col("s_suppkey") == F.col("c_custkey") % F.col("n_suppliers") + 1, "left")
    turn = F.col("c_custkey") % 4
    q = F.when(turn == 0, F.col("s_name")).when(turn == 1, F.upper("s_name")).when(turn == 2, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).otherwise(F.col("c_name"))
    asked = c.select("c_custkey", q.alias("q"), T.squash(q).alias("key"))
    master = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), T.squash(F.col("s_name")).alias("name_key"))
    found = asked.join(master.select(F.col("symbol").alias("t")), F.col("q") == F.col("t"), "left").join(master.select(F.col("symbol").alias("n"), "name_key"), F.col("key") == F.col("name_key"), "left")
    confidence = F.when(F.col("t").isNotNull(), 0.99).when(F.col("n").isNotNull(), 0.98).otherwise(0.0)
    return found.select("c_custkey", "q", F.coalesce("t", "n").alias("ticker"), confidence.alias("confidence"), F.when(F.coalesce("t", "n").isNotNull(), "RESOLVED").otherwise("QUARANTINED").alias("state"))


@registry.add("entity_resolution_fuzzy")
def entity_resolution_fuzzy(spark, sf_dir):
    """Part names against part types by token overlap, blocked on shared tokens: RESOLVED, REVIEW or QUARANTINED.

    Labels are resolved once each; a near tie with another name is for review.
    """
    p = read(spark, sf_dir, "part")
    asked = p.select(T.spaced(F.col("p_name")).alias("q")).distinct()
    known = p.select(T.spaced(F.col("p_type")).alias("name")).distinct()
    words = lambda df, c: df.withColumn("token", F.explode(F.array_distinct(F.split(c, " "))))
    counts = lambda c: F.size(F.array_distinct(F.split(c, " ")))
    shared = words(asked, "q").join(words(known, "name"), "token").groupBy("q", "name").agg(F.count("*").alias("common"))
    scored = shared.withColumn("score", 2.0 * F.col("common") / (counts("q") + counts("name")))
    top = scored.groupBy("q").agg(F.max(F.struct("score", "name")).alias("best"))
    rival = scored.join(top, "q").where(F.col("name") != F.col("best.name")).groupBy("q").agg(F.max("score").alias("rival"))
    out = asked.join(top, "q", "left").join(rival, "q", "left")
    score = F.coalesce(F.col("best.score"), F.lit(0.0))
    state = F.when((score >= 0.7) & (score - F.coalesce("rival", F.lit(0.0)) <= 0.05), "REVIEW").when(score >= 0.88, "RESOLVED").when(score >= 0.7, "REVIEW").otherwise("QUARANTINED")
    return out.select("q", F.col("best.name").alias("name"), score.alias("score"), state.alias("state"))


@registry.add(
    "semantic_retrieval",
    """WITH q AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), a AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT query_id, a.vec_id, list_cosine_similarity(q.e, a.e) AS cosine FROM q JOIN a ON q.label = a.label AND a.vec_id <> query_id)
    SELECT query_id, vec_id, round(cosine, 6) AS cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, vec_id) AS INT) AS place FROM s WHERE round(cosine, 6) >= 0.2 QUALIFY place <= 8""",
)
def semantic_retrieval(spark, sf_dir, k: int = 8):
    """The k nearest vectors of each query vector at cosine 0.2 or more, in the same category."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = v.withColumn("norm", F.sqrt(dot("e", "e"))).where("norm > 0")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("e").alias("qe"), F.col("norm").alias("qn"))
    scored = v.join(q, "label").where("vec_id <> query_id").select("query_id", "vec_id", F.round(dot("qe", "e") / (F.col("qn") * F.col("norm")), 6).alias("cosine")).where("cosine >= 0.2")
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("place") <= k)


@registry.add(
    "line_item_search",
    f"""WITH {FACTS_SQL}, m AS (SELECT DISTINCT metric, string_split(metric, '_') AS t FROM facts), q AS (SELECT DISTINCT p_type AS q, list_distinct(string_split(lower(p_type), ' ')) AS t FROM part UNION SELECT 'total current assets', ['total', 'current', 'assets'] UNION SELECT 'cost of gross profit', ['cost', 'of', 'gross', 'profit']),
    s AS (SELECT q, metric, len(list_intersect(q.t, m.t)) / CAST(len(q.t) AS DOUBLE) AS score FROM q, m WHERE len(list_intersect(q.t, m.t)) > 0)
    SELECT q, metric, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, metric) AS INT) AS place FROM s QUALIFY place <= 8""",
)
def line_item_search(spark, sf_dir):
    """Metrics by the share of a query's tokens that they have; an equi join on tokens."""
    metrics = facts(spark, sf_dir).select("metric").distinct().withColumn("token", F.explode(F.array_distinct(F.split("metric", "_"))))
    asked = read(spark, sf_dir, "part").select(F.col("p_type").alias("q")).distinct().union(spark.createDataFrame([("total current assets",), ("cost of gross profit",)], "q string")).distinct()
    tokens = asked.withColumn("t", F.array_distinct(F.split(F.lower("q"), " "))).withColumn("n", F.size("t")).withColumn("token", F.explode("t"))
    scored = tokens.join(metrics, "token").groupBy("q", "metric", "n").agg(F.count("*").alias("common")).select("q", "metric", (F.col("common") / F.col("n").cast("double")).alias("score"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "metric"))).where("place <= 8")


@registry.add(
    "payout_details",
    """WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 250 AS VARCHAR) || '%(' || CASE WHEN o_orderkey % 3 = 0 THEN 'i' ELSE 'F' END || ') (' || CASE WHEN o_orderkey % 5 = 0 THEN 'B' ELSE 'D' END || ')' AS details FROM orders)
    SELECT o_orderkey, CAST(regexp_extract(details, '([0-9.]+)%', 1) AS DOUBLE) AS pct, regexp_matches(details, '\\(i+\\)') AS interim, contains(details, '(F)') AS final, contains(details, '(D)') AS dividend, contains(details, '(B)') AS bonus FROM p""",
)
def payout_details(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.concat((k % 250).cast("string"), F.lit("%("), F.when(k % 3 == 0, "i").otherwise("F"), F.lit(") ("), F.when(k % 5 == 0, "B").otherwise("D"), F.lit(")"))
    p = read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))
    has = lambda s: F.contains("d", F.lit(s))
    return p.select("o_orderkey", F.regexp_extract("d", r"([0-9.]+)%", 1).cast("double").alias("pct"), F.col("d").rlike(r"\(i+\)").alias("interim"), has("(F)").alias("final"), has("(D)").alias("dividend"), has("(B)").alias("bonus"))


@registry.add(
    "page_links",
    """WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<li><a href="[^"]*">[^<]*</a></li>') AS e FROM pages), x AS (SELECT page_id, unnest(range(1, len(e) + 1)) AS place, unnest(e) AS entry FROM l)
    SELECT page_id, place, regexp_extract(entry, 'href="([^"]*)"', 1) AS link, regexp_extract(entry, '>([^<]*)</a>', 1) AS label FROM x""",
)
def page_links(spark, sf_dir):
    """List entries of each page as cells (page, place, link, text)."""
    entry = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<li><a href="[^"]*">[^<]*</a></li>'), F.lit(0))
    each = read(spark, sf_dir, "pages").select("page_id", F.posexplode(entry).alias("at", "entry"))
    return each.select("page_id", (F.col("at") + 1).cast("long").alias("place"), F.regexp_extract("entry", 'href="([^"]*)"', 1).alias("link"), F.regexp_extract("entry", ">([^<]*)</a>", 1).alias("label"))
