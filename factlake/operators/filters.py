"""Predicates over facts, feeds and names: lookups, slices, gates and peers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import FACTS_SQL, OBS_SQL, facts, observations, read
from .evidence import _QUESTIONS_SQL, questions

registry = Registry()


@registry.add(
    "fact_lookup",
    f"WITH {OBS_SQL} SELECT entity, metric, value_year, report_year, value FROM obs WHERE metric = 'revenue' AND value_year = 1995 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY value IS NULL, report_year) = 1",
)
def fact_lookup(spark, sf_dir, metric: str = "revenue", year: int = 1995):
    """One fact of each entity: a valued row if there is any, else the first."""
    rows = observations(spark, sf_dir, [metric]).where((F.col("value_year") == year))
    first = F.row_number().over(W.partitionBy("entity").orderBy(F.col("value").isNull(), "report_year"))
    return rows.withColumn("r", first).where("r = 1").drop("r")


@registry.add("available_metrics", f"WITH {FACTS_SQL} SELECT DISTINCT entity, metric FROM facts WHERE value IS NOT NULL AND year = 1994")
def available_metrics(spark, sf_dir, year: int = 1994):
    return facts(spark, sf_dir).where(F.col("value").isNotNull() & (F.col("year") == year)).select("entity", "metric").distinct()


@registry.add(
    "segment_peers",
    """WITH s AS (SELECT lower(c_mktsegment) AS segment, count(*) AS members, min(c_custkey) AS first_member FROM customer GROUP BY ALL) SELECT c_custkey, segment, members - 1 AS peers, first_member FROM customer JOIN s ON lower(c_mktsegment) = segment""",
)
def segment_peers(spark, sf_dir):
    """How many peers a member's segment has; members of a segment aren't paired with each other."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))
    sizes = c.groupBy("segment").agg(F.count("*").alias("members"), F.min("c_custkey").alias("first_member"))
    return c.join(sizes, "segment").select("c_custkey", "segment", (F.col("members") - 1).alias("peers"), "first_member")


@registry.add("anchored_prefix", "SELECT s_suppkey, s_name FROM supplier WHERE starts_with(upper(s_name), upper('Supplier_') || '1')")
def anchored_prefix(spark, sf_dir, base: str = "Supplier_1"):
    """Contracts of a base symbol: anchored at the start, in any case."""
    return read(spark, sf_dir, "supplier").where(F.startswith(F.upper("s_name"), F.lit(base.upper()))).select("s_suppkey", "s_name")


@registry.add(
    "type_precedence",
    """WITH t AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus = 'F' AS trusted FROM orders) SELECT * FROM t a WHERE trusted OR NOT EXISTS (SELECT 1 FROM t b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.trusted)""",
)
def type_precedence(spark, sf_dir):
    """Rule-based tables go where a trusted one has the same owner and type."""
    t = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", (F.col("o_orderstatus") == "F").alias("trusted"))
    covered = t.where("trusted").select("o_custkey", "o_orderpriority").distinct()
    return t.where("trusted").unionByName(t.where("NOT trusted").join(covered, ["o_custkey", "o_orderpriority"], "left_anti").select(t.columns))


@registry.add(
    "tabular_guard",
    """SELECT l_orderkey, count(*) AS n_rows, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS numeric_share, count(*) >= 2 AND avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) >= 0.15 AND count(*) FILTER (WHERE l_returnflag <> 'N') >= greatest(2, count(*) / 2.0) AS keep FROM lineitem GROUP BY l_orderkey""",
)
def tabular_guard(spark, sf_dir):
    """Tables with enough rows, numeric cells and labelled rows, in one aggregate."""
    share, labelled = F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)), F.count_if(F.col("l_returnflag") != "N")
    t = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), share.alias("numeric_share"), labelled.alias("labelled"))
    keep = (F.col("n_rows") >= 2) & (F.col("numeric_share") >= 0.15) & (F.col("labelled") >= F.greatest(F.lit(2.0), F.col("n_rows") / 2.0))
    return t.select("l_orderkey", "n_rows", "numeric_share", keep.alias("keep"))


@registry.add(
    "numeric_guard",
    rf"""WITH {_QUESTIONS_SQL}, n AS (SELECT question_id, year, entity, unnest(regexp_extract_all(q, '[0-9]+')) AS token FROM questions)
    SELECT question_id, token FROM n WHERE NOT (abs(CAST(token AS DOUBLE) - year) <= 0.01 * greatest(abs(year), 1)) AND token <> regexp_extract(entity, '[0-9]+')""",
)
def numeric_guard(spark, sf_dir):
    """Numbers of a text that neither its year within 1 % nor its entity's own number backs."""
    tokens = questions(spark, sf_dir).withColumn("token", F.explode(F.regexp_extract_all("q", F.lit("[0-9]+"), F.lit(0))))
    backed = (F.abs(F.col("token").cast("double") - F.col("year")) <= 0.01 * F.greatest(F.abs("year"), F.lit(1))) | (F.col("token") == F.regexp_extract("entity", "[0-9]+", 0))
    return tokens.where(~backed).select("question_id", "token")


@registry.add(
    "premise_check",
    f"""WITH {_QUESTIONS_SQL}, g AS (SELECT entity, metric, year, value - lag(value) OVER (PARTITION BY entity, metric ORDER BY year) AS delta FROM facts)
    SELECT question_id, CASE WHEN q.year % 2 = 0 THEN 'up' ELSE 'down' END AS asserted, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS actual, (q.year % 2 = 0) = (delta > 0) AS holds FROM questions q JOIN g USING (entity, metric, year) WHERE delta IS NOT NULL AND delta <> 0""",
)
def premise_check(spark, sf_dir):
    """A question's asserted direction, here by its year's parity, against the facts."""
    delta = F.col("value") - F.lag("value").over(W.partitionBy("entity", "metric").orderBy("year"))
    g = facts(spark, sf_dir).withColumn("delta", delta).where("delta IS NOT NULL AND delta <> 0").select("entity", "metric", "year", "delta")
    rows = questions(spark, sf_dir).join(g, ["entity", "metric", "year"])
    up = F.col("year") % 2 == 0
    return rows.select("question_id", F.when(up, "up").otherwise("down").alias("asserted"), F.when(F.col("delta") > 0, "up").otherwise("down").alias("actual"), (up == (F.col("delta") > 0)).alias("holds"))


@registry.add(
    "identity_repair",
    f"""WITH {OBS_SQL}, r AS (SELECT entity, value_year AS year, report_year, max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'cost_of_sales' THEN value END) AS cost_of_sales, max(CASE WHEN metric = 'gross_profit' THEN value END) AS gross_profit FROM obs GROUP BY ALL),
    m AS (SELECT entity, year, arg_min(revenue, report_year) AS revenue, arg_max(cost_of_sales, report_year) AS cost_of_sales, arg_max(gross_profit, report_year) AS gross_profit FROM r WHERE revenue IS NOT NULL GROUP BY ALL),
    f AS (SELECT * FROM m WHERE abs(revenue + cost_of_sales - gross_profit) > greatest(1, 0.01 * abs(gross_profit))),
    c AS (SELECT f.entity, f.year, r.report_year, r.revenue, r.cost_of_sales, r.gross_profit, CAST(r.revenue <> f.revenue AS INT) + CAST(r.cost_of_sales <> f.cost_of_sales AS INT) + CAST(r.gross_profit <> f.gross_profit AS INT) AS changes FROM f JOIN r ON f.entity = r.entity AND f.year = r.year
      WHERE abs(r.revenue + r.cost_of_sales - r.gross_profit) <= greatest(1, 0.01 * abs(r.gross_profit)))
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY changes, report_year DESC) = 1""",
)
def identity_repair(spark, sf_dir):
    """Where values of mixed reports break an identity, the one report that repairs it with fewest changes."""
    names = ["revenue", "cost_of_sales", "gross_profit"]
    r = observations(spark, sf_dir, names).groupBy("entity", F.col("value_year").alias("year"), "report_year").pivot("metric", names).agg(F.first("value"))
    mixed = r.groupBy("entity", "year").agg(F.min_by("revenue", "report_year").alias("m_revenue"), *(F.max_by(n, "report_year").alias(f"m_{n}") for n in names[1:]))
    holds = lambda p: F.abs(F.col(p + "revenue") + F.col(p + "cost_of_sales") - F.col(p + "gross_profit")) <= F.greatest(F.lit(1.0), 0.01 * F.abs(p + "gross_profit"))
    changes = sum((F.col(n) != F.col(f"m_{n}")).cast("int") for n in names)
    both = mixed.where(~holds("m_")).join(r, ["entity", "year"]).where(holds("")).withColumn("changes", changes)
    best = F.row_number().over(W.partitionBy("entity", "year").orderBy("changes", F.desc("report_year")))
    return both.withColumn("b", best).where("b = 1").select("entity", "year", "report_year", *names, "changes")


@registry.add(
    "top_driver_share",
    f"""WITH {FACTS_SQL}, e AS (SELECT entity, metric, arg_max(value, year) AS v1, max(year) AS y1 FROM facts GROUP BY ALL), p AS (SELECT f.entity, f.metric, e.v1 - arg_max(f.value, f.year) AS delta FROM facts f JOIN e ON f.entity = e.entity AND f.metric = e.metric AND f.year < e.y1 GROUP BY f.entity, f.metric, e.v1),
    t AS (SELECT entity, delta AS total FROM p WHERE metric = 'total_assets'), d AS (SELECT entity, arg_max(metric, abs(delta)) AS driver, arg_max(delta, abs(delta)) AS delta FROM p WHERE metric IN ('current_assets', 'non_current_assets') GROUP BY entity)
    SELECT entity, driver, CASE WHEN abs(total) >= 0.5 * abs(delta) THEN delta / nullif(total, 0) END AS share, CASE WHEN abs(total) >= 0.5 * abs(delta) THEN 'share' ELSE 'offsetting' END AS label FROM t JOIN d USING (entity)""",
)
def top_driver_share(spark, sf_dir):
    """The top driver's part of the net change, unless components offset each other."""
    f = facts(spark, sf_dir, ["total_assets", "current_assets", "non_current_assets"])
    delta = F.col("value") - F.lag("value").over(W.partitionBy("entity", "metric").orderBy("year"))
    last = f.withColumn("delta", delta).groupBy("entity", "metric").agg(F.max_by("delta", "year").alias("delta")).where("delta IS NOT NULL")
    total = last.where("metric = 'total_assets'").select("entity", F.col("delta").alias("total"))
    driver = last.where("metric <> 'total_assets'").groupBy("entity").agg(F.max_by("metric", F.abs("delta")).alias("driver"), F.max_by("delta", F.abs("delta")).alias("delta"))
    enough = F.abs("total") >= 0.5 * F.abs("delta")
    return total.join(driver, "entity").select("entity", "driver", F.when(enough & (F.col("total") != 0), F.col("delta") / F.col("total")).alias("share"), F.when(enough, "share").otherwise("offsetting").alias("label"))


@registry.add(
    "valuation",
    f"""WITH {FACTS_SQL}, q AS (SELECT n_name AS entity, arg_max(o_totalprice, struct_pack(o_orderdate, o_orderkey)) / 100 AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
    l AS (SELECT entity, metric, arg_max(value, year) AS v FROM facts GROUP BY ALL), w AS (SELECT entity, {", ".join(f"max(CASE WHEN metric = '{m}' THEN v END) AS {m}" for m in ("pat", "shares_outstanding", "total_equity", "operating_profit", "depreciation_expense", "total_liabilities", "cash_and_bank"))} FROM l GROUP BY entity)
    SELECT entity, price, CASE WHEN pat > 0 THEN price / (pat / shares_outstanding) END AS pe, CASE WHEN total_equity > 0 THEN price * shares_outstanding / total_equity END AS pb,
    CASE WHEN operating_profit + depreciation_expense > 0 THEN (price * shares_outstanding + total_liabilities - coalesce(cash_and_bank, 0)) / (operating_profit + depreciation_expense) END AS ev_ebitda, CASE WHEN pat > 0 THEN 'ok' ELSE 'no positive earnings' END AS caveat FROM q JOIN w USING (entity)""",
)
def valuation(spark, sf_dir):
    """Price multiples from the latest quote (an order's price here) and the latest facts, null where meaningless."""
    names = ["pat", "shares_outstanding", "total_equity", "operating_profit", "depreciation_expense", "total_liabilities", "cash_and_bank"]
    owners = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("entity"))
    quote = read(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).groupBy("entity").agg((F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")) / 100).alias("price"))
    latest = facts(spark, sf_dir, names).groupBy("entity").pivot("metric", names).agg(F.max_by("value", "year"))
    x = quote.join(latest, "entity")
    cap, ebitda = F.col("price") * F.col("shares_outstanding"), F.col("operating_profit") + F.col("depreciation_expense")
    return x.select(
        "entity", "price", F.when(F.col("pat") > 0, F.col("price") / (F.col("pat") / F.col("shares_outstanding"))).alias("pe"), F.when(F.col("total_equity") > 0, cap / F.col("total_equity")).alias("pb"),
        F.when(ebitda > 0, (cap + F.col("total_liabilities") - F.coalesce("cash_and_bank", F.lit(0))) / ebitda).alias("ev_ebitda"), F.when(F.col("pat") > 0, "ok").otherwise("no positive earnings").alias("caveat"),
    )


@registry.add(
    "feed_payloads",
    """SELECT event_id, event_type AS provider, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'purchase' THEN value WHEN 'click' THEN value / 2 ELSE NULL END AS sentiment, strftime(ts, '%Y-%m-%d') AS published_on FROM events""",
)
def feed_payloads(spark, sf_dir):
    """Payloads of several providers as one schema; fields that a provider lacks are null."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"), "value", F.date_format("ts", "yyyy-MM-dd").alias("published_on"))
    sentiment = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "click", F.col("value") / 2)
    return e.select("event_id", F.col("event_type").alias("provider"), "p.k", sentiment.alias("sentiment"), "published_on")


@registry.add(
    "narrative_sections",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, n, length(line) AS size, last_value(CASE WHEN length(trim(line)) BETWEEN 1 AND 40 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
    SELECT doc_id, section, count(*) AS lines, CAST(sum(size) AS BIGINT) AS chars FROM s WHERE section IS NOT NULL GROUP BY ALL""",
)
def narrative_sections(spark, sf_dir):
    """Lines to the short heading line above them; a document's lines are bounded by its text."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))
    start = F.when(F.length(F.trim("line")).between(1, 40), F.col("n"))
    s = d.withColumn("section", F.last(start, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("n"))).where("section IS NOT NULL")
    return s.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@registry.add(
    "round_robin_chunks",
    """WITH c AS (SELECT doc_id, source AS section, CAST(len(regexp_extract_all(lower(coalesce(text, '')), 'token|and|the')) AS INT) AS hits FROM documents), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY 1.5 * hits DESC, doc_id) AS INT) AS turn FROM c)
    SELECT doc_id, section, hits, turn FROM r WHERE turn <= 10""",
)
def round_robin_chunks(spark, sf_dir, most: int = 10):
    """The best ten of each section, to be taken in turns across sections (order by turn, section)."""
    c = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section"), F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("token|and|the")).alias("hits"))
    return c.withColumn("turn", F.row_number().over(W.partitionBy("section").orderBy(F.desc(1.5 * F.col("hits")), "doc_id"))).where(F.col("turn") <= most)


@registry.add(
    "one_to_one_assignment",
    """WITH n AS (SELECT DISTINCT p_name, unnest(list_distinct(string_split(lower(p_name), ' '))) AS t FROM part), k AS (SELECT DISTINCT p_type, unnest(list_distinct(string_split(lower(p_type), ' '))) AS t FROM part),
    s AS (SELECT p_name, p_type, count(*) AS common FROM n JOIN k USING (t) GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY common DESC, p_type) = 1)
    SELECT p_type, p_name, common, row_number() OVER (PARTITION BY p_type ORDER BY common DESC, p_name) = 1 AS placed FROM b""",
)
def one_to_one_assignment(spark, sf_dir):
    """Each line goes to its best row, and each row keeps its best line; losers are reported."""
    p = read(spark, sf_dir, "part").select("p_name", "p_type")
    words = lambda c: p.select(c).distinct().select(c, F.explode(F.array_distinct(F.split(F.lower(c), " "))).alias("t"))
    scored = words("p_name").join(words("p_type"), "t").groupBy("p_name", "p_type").agg(F.count("*").alias("common"))
    best = scored.withColumn("b", F.row_number().over(W.partitionBy("p_name").orderBy(F.desc("common"), "p_type"))).where("b = 1")
    return best.select("p_type", "p_name", "common", (F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("common"), "p_name")) == 1).alias("placed"))


@registry.add("story_folding")
def story_folding(spark, sf_dir, same: float = 0.85):
    """Retrieved items of a query folded greedily: one within `same` of a kept item joins it.

    Groups are the few items that retrieval keeps for each query, so each fits in a task.
    """
    import numpy as np
    import pandas as pd

    from .tables import semantic_retrieval

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = semantic_retrieval(spark, sf_dir).join(vectors, "vec_id")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        x = np.stack(group["embedding"].map(np.asarray)).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        kept: list[int] = []
        story = []
        for i in range(len(group)):
            near = [k for k in kept if x[k] @ x[i] >= same]
            kept += [] if near else [i]
            story.append(near[0] if near else i)
        out = group.assign(story=group["vec_id"].to_numpy()[story])
        outlets = out.groupby("story")["vec_id"].transform("size")
        return out.assign(corroboration=1 - 0.5 ** (outlets - 1))[["query_id", "vec_id", "place", "story", "corroboration"]]

    return rows.groupBy("query_id").applyInPandas(fold, "query_id long, vec_id long, place int, story long, corroboration double")
