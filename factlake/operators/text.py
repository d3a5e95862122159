"""Text operators over documents, conversations, events and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import FACTS_SQL, facts, read

registry = Registry()
_TOKENS_SQL = "regexp_extract_all(text, '[0-9][0-9,.]*')"


def _cells(spark, sf_dir) -> DataFrame:
    """Amounts of orders printed as accounting cells."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice")).cast("long").alias("amount"))
    printed = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("("), F.col("amount").cast("string"), F.lit(")"))).when(F.col("o_orderkey") % 7 == 0, F.lit("-")).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Rs. "), F.col("amount").cast("string"), F.lit(".50"))).otherwise(F.concat(F.col("amount").cast("string"), F.lit("%")))
    return orders.withColumn("cell", printed)


_CELLS_SQL = """cells AS (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS amount, CASE WHEN o_orderkey % 5 = 0 THEN '(' || CAST(floor(o_totalprice) AS BIGINT) || ')' WHEN o_orderkey % 7 = 0 THEN '-'
  WHEN o_orderkey % 3 = 0 THEN 'Rs. ' || CAST(floor(o_totalprice) AS BIGINT) || '.50' ELSE CAST(floor(o_totalprice) AS BIGINT) || '%' END AS cell FROM orders)"""


@registry.add(
    "parse_money",
    f"""WITH {_CELLS_SQL} SELECT o_orderkey, cell, CASE WHEN cell = '-' THEN NULL WHEN cell LIKE '(%' THEN -CAST(amount AS DOUBLE) WHEN cell LIKE 'Rs%' THEN amount + 0.5 ELSE CAST(amount AS DOUBLE) END AS value FROM cells""",
)
def parse_money(spark, sf_dir):
    return _cells(spark, sf_dir).select("o_orderkey", "cell", T.parse_money(F.col("cell")).alias("value"))


@registry.add(
    "value_hardening",
    f"""WITH {_CELLS_SQL} SELECT o_orderkey, CASE WHEN cell LIKE '(%' THEN -CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS value, cell LIKE '(%' AS sign_fixed FROM cells""",
)
def value_hardening(spark, sf_dir):
    """Positive values whose printed cell is negative at the same size get their sign back."""
    rows = _cells(spark, sf_dir).withColumn("raw", T.parse_money(F.col("cell"))).withColumn("parsed", F.col("amount").cast("double"))
    near = F.abs(F.abs("raw") - F.col("parsed")) <= F.greatest(F.lit(0.5), 0.001 * F.abs("parsed"))
    fixed = F.coalesce((F.col("raw") < 0) & (F.col("parsed") > 0) & near, F.lit(False))
    return rows.select("o_orderkey", F.when(fixed, -F.col("parsed")).otherwise(F.col("parsed")).alias("value"), fixed.alias("sign_fixed"))


@registry.add(
    "normalized_names",
    r"""SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS squashed, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS spaced,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name), '[–—]', '-', 'g'), '[^a-z0-9&\- ]+', ' ', 'g'), '\s+', ' ', 'g')) AS label,
    trim(regexp_replace(replace(replace(lower(c_mktsegment), '&', ' and '), '_', ' '), '[^a-z0-9]+', ' ', 'g')) AS segment FROM customer""",
)
def normalized_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", T.squash(F.col("c_name")).alias("squashed"), T.spaced(F.col("c_name")).alias("spaced"), T.normalize_label(F.col("c_name")).alias("label"), T.normalize_text(F.col("c_mktsegment")).alias("segment"))


_UNITS = ["Rupees in thousand", "Rs. million", "PKR", "PKR/share", "PKR bn", "x"]


@registry.add(
    "unit_reconcile",
    f"""WITH u AS (SELECT o_orderkey, o_totalprice AS a, {_UNITS}[o_orderkey % 6 + 1] AS unit_a, floor(o_totalprice * CASE WHEN o_orderkey % 4 = 0 THEN 1000 WHEN o_orderkey % 4 = 1 THEN 1.02 ELSE 2 END) AS b, {_UNITS}[(o_orderkey + 1) % 2 * 2 + 1] AS unit_b FROM orders),
    s AS (SELECT *, a * CASE unit_a WHEN 'Rupees in thousand' THEN 1e3 WHEN 'Rs. million' THEN 1e6 WHEN 'PKR' THEN 1.0 WHEN 'PKR bn' THEN 1e9 END AS ca, b * CASE unit_b WHEN 'Rupees in thousand' THEN 1e3 WHEN 'PKR' THEN 1.0 END AS cb FROM u),
    r AS (SELECT *, abs(ca) / nullif(abs(cb), 0) AS q FROM s), k AS (SELECT *, CASE WHEN ca IS NULL OR cb IS NULL OR ca = 0 OR cb = 0 THEN NULL WHEN abs(q - 1e3) <= 50 THEN 3 WHEN abs(q - 1e6) <= 5e4 THEN 6 WHEN abs(q - 1e9) <= 5e7 THEN 9 WHEN abs(q - 1e-3) <= 5e-5 THEN -3 WHEN abs(q - 1e-6) <= 5e-8 THEN -6 WHEN abs(q - 1e-9) <= 5e-11 THEN -9 END AS factor_k FROM r)
    SELECT o_orderkey, ca AS canonical_a, cb AS canonical_b, CAST(factor_k AS INT) AS factor_k, CASE WHEN ca IS NULL OR cb IS NULL THEN 'not_comparable' WHEN abs(ca - cb) <= 0.05 * greatest(abs(ca), abs(cb), 1) THEN 'agree' WHEN factor_k IS NOT NULL THEN 'scale_disagreement' ELSE 'divergent' END AS verdict FROM k""",
)
def unit_reconcile(spark, sf_dir):
    """Two statements of an amount in stated units: agreeing, off by a scale or divergent."""
    o, unit = read(spark, sf_dir, "orders"), lambda i: F.element_at(F.array(*map(F.lit, _UNITS)), (i + 1).cast("int"))
    other = F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 4 == 0, 1000.0).when(F.col("o_orderkey") % 4 == 1, 1.02).otherwise(2.0))
    rows = o.select("o_orderkey", (F.col("o_totalprice") * T.unit_scale(unit(F.col("o_orderkey") % 6))).alias("canonical_a"), (other.cast("double") * T.unit_scale(unit((F.col("o_orderkey") + 1) % 2 * 2))).alias("canonical_b"))
    return rows.withColumns({"factor_k": T.scale_factor(F.col("canonical_a"), F.col("canonical_b")), "verdict": T.reconcile(F.col("canonical_a"), F.col("canonical_b"))})


@registry.add(
    "document_years",
    r"""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(coalesce(text, ''), '(\D)', '\1\1', 'g') || ' ', '\D((?:19|20)\d{2})\D', 1), lambda x: CAST(x AS INT)))) AS years FROM documents""",
)
def document_years(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.years(F.coalesce("text", F.lit(""))).alias("years"))


def report_year(years, name):
    """The largest plausible year of a report's text, else that of its file name, else null."""
    plausible = lambda found: F.array_max(F.filter(found, lambda y: (y >= 1990) & (y <= 2100)))
    return F.coalesce(plausible(years), plausible(T.years(name)))


@registry.add(
    "report_year",
    r"""WITH y AS (SELECT doc_id, source, list_transform(regexp_extract_all(' ' || regexp_replace(coalesce(text, ''), '(\D)', '\1\1', 'g') || ' ', '\D((?:19|20)\d{2})\D', 1), lambda x: CAST(x AS INT)) AS years FROM documents)
    SELECT doc_id, coalesce(list_max(list_filter(years, lambda v: v >= 1990 AND v <= 2100)), CASE WHEN doc_id % 2 = 0 THEN 2000 + CAST(doc_id % 30 AS INT) END) AS report_year FROM y""",
)
def report_year_query(spark, sf_dir):
    """Documents whose every other file name bears a year."""
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("annual_"), (F.col("doc_id") % 30 + 2000).cast("string"), F.lit(".pdf"))).otherwise("annual.pdf")
    return read(spark, sf_dir, "documents").select("doc_id", report_year(T.years(F.coalesce("text", F.lit(""))), name).alias("report_year"))


@registry.add(
    "text_gates",
    r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS letters, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS digits, regexp_matches(lower(coalesce(text, '')), 'revenue|profit|assets|token') AS signal FROM documents)
    SELECT doc_id, letters, digits, letters >= 120 AND digits <= 0.35 * (letters + digits) AS is_prose, signal AND digits >= 120 AS is_financial FROM c""",
)
def text_gates(spark, sf_dir):
    """Prose and financial-page gates of each document."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    c = d.select("doc_id", F.regexp_count("t", F.lit("[A-Za-z]")).cast("long").alias("letters"), F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("digits"), F.lower("t").rlike("revenue|profit|assets|token").alias("signal"))
    prose = (F.col("letters") >= 120) & (F.col("digits") <= 0.35 * (F.col("letters") + F.col("digits")))
    return c.select("doc_id", "letters", "digits", prose.alias("is_prose"), (F.col("signal") & (F.col("digits") >= 120)).alias("is_financial"))


@registry.add(
    "sliding_chunks",
    """WITH d AS (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN 0 ELSE CAST(ceil((length(text) - 500) / 400.0) AS BIGINT) END AS last FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, unnest(range(0, last + 1)) AS chunk, text FROM d) SELECT doc_id, chunk, substr(text, chunk * 400 + 1, 500) AS body FROM c""",
)
def sliding_chunks(spark, sf_dir, size: int = 500, overlap: int = 100):
    """Windows of `size` code points that overlap; the last one reaches the end."""
    step = size - overlap
    d = read(spark, sf_dir, "documents").where(F.length("text") > 0)
    last = F.when(F.length("text") <= size, 0).otherwise(F.ceil((F.length("text") - size) / step)).cast("long")
    return d.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).select("doc_id", "chunk", F.substring(F.col("text"), (F.col("chunk") * step + 1).cast("int"), F.lit(size)).alias("body"))


@registry.add(
    "text_direction",
    f"""WITH d AS (SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), '{"|".join(T.POSITIVE)}') AS up, regexp_matches(lower(coalesce(text, '')), '{"|".join(T.NEGATIVE)}') AS down, regexp_matches(coalesce(text, ''), '[0-9]') AS quantified FROM conversations)
    SELECT conv_id, turn, CASE WHEN up AND NOT down THEN 'positive' WHEN down AND NOT up THEN 'negative' END AS direction, quantified FROM d""",
)
def text_direction(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", T.direction(F.col("text")).alias("direction"), F.col("text").rlike("[0-9]").alias("quantified"))


@registry.add("sanitized_turns")
def sanitized_turns(spark, sf_dir):
    """Turns as data that can be embedded, with secrets redacted."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.redact(T.sanitize(F.col("text"))).alias("body"))


@registry.add(
    "identifier_validity",
    r"""SELECT c_custkey, regexp_full_match(upper(trim(c_mktsegment)), '[A-Z0-9]{1,6}') AS is_ticker, regexp_full_match(c_name, '[A-Za-z0-9._\-]{1,64}') AND NOT contains(c_name, '..') AS is_url_safe FROM customer""",
)
def identifier_validity(spark, sf_dir):
    ticker, safe = F.upper(F.trim("c_mktsegment")).rlike("^[A-Z0-9]{1,6}$"), F.col("c_name").rlike(r"^[A-Za-z0-9._\-]{1,64}$") & ~F.contains("c_name", F.lit(".."))
    return read(spark, sf_dir, "customer").select("c_custkey", ticker.alias("is_ticker"), safe.alias("is_url_safe"))


@registry.add(
    "exact_text_dedup",
    "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text), lang ORDER BY doc_id) = 1",
)
def exact_text_dedup(spark, sf_dir):
    """The first of equal lower-cased texts; groups meet as a hash and a minimum, not as rows."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.lower("text"), 256).alias("key"))
    first = d.groupBy("key", "lang").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    return first.select("f.doc_id", "lang", "f.source")


@registry.add(
    "recency_weights",
    """WITH e AS (SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) AS INT) AS age, year(ts) AS y FROM events)
    SELECT event_id, pow(0.5::DOUBLE, greatest(age, 0) / 14.0::DOUBLE) AS half_life, greatest(0.0, least(1.0, (y - 2015) / 15.0::DOUBLE)) AS year_recency FROM e""",
)
def recency_weights(spark, sf_dir, days: float = 14.0):
    events = read(spark, sf_dir, "events").select("event_id", "ts")
    anchor = F.broadcast(events.agg(F.to_date(F.max("ts")).alias("anchor")))  # one row
    age = F.datediff("anchor", F.to_date("ts"))
    return events.join(anchor).select("event_id", T.half_life(age, days).alias("half_life"), T.year_recency(F.year("ts")).alias("year_recency"))


@registry.add(
    "last_good_feed",
    """SELECT user_id, event_type, arg_max(value, struct_pack(ts, event_id)) AS value, max(ts) AS as_of, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL""",
)
def last_good_feed(spark, sf_dir):
    """The newest value of each symbol and source."""
    return read(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("as_of"), F.count("*").alias("n"))


@registry.add(
    "provider_failover",
    """WITH p AS (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS priority, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, n FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY priority, event_type) = 1""",
)
def provider_failover(spark, sf_dir):
    """The first provider, by priority, that delivered anything for a query."""
    priority = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    found = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("priority", priority)
    first = F.row_number().over(W.partitionBy("user_id").orderBy("priority", "event_type"))
    return found.withColumn("r", first).where("r = 1").select("user_id", "event_type", "n")


@registry.add(
    "latency_profile",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, round(avg(value), 6) AS mean, max(CASE WHEN k = greatest(1, ceil(0.5 * n)) THEN value END) AS p50, max(CASE WHEN k = greatest(1, ceil(0.95 * n)) THEN value END) AS p95 FROM r GROUP BY event_type""",
)
def latency_profile(spark, sf_dir):
    """Mean and nearest-rank percentiles by kind, from counts of distinct values."""
    counts = read(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    # a third of all events may be of one kind: ranks come from sums over ranges of values
    part = counts.withColumn("bin", F.floor(F.col("value") / 4))
    bins = part.groupBy("event_type", "bin").agg(F.sum("c").alias("b"), F.sum(F.col("value") * F.col("c")).alias("s"))
    by_bin = W.partitionBy("event_type")
    bins = bins.withColumns({"before": F.coalesce(F.sum("b").over(by_bin.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("b").over(by_bin), "total": F.sum("s").over(by_bin)})
    ranked = part.join(bins, ["event_type", "bin"]).withColumn("to", F.col("before") + F.sum("c").over(W.partitionBy("event_type", "bin").orderBy("value"))).withColumn("from", F.col("to") - F.col("c"))
    at = lambda p: F.max(F.when(F.greatest(F.lit(1), F.ceil(p * F.col("n"))).between(F.col("from") + 1, F.col("to")), F.col("value")))
    return ranked.groupBy("event_type").agg(F.round(F.max(F.col("total") / F.col("n")), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@registry.add("counters", "SELECT event_type, CAST(year(ts) AS INT) AS year, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def counters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.year("ts").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@registry.add(
    "monthly_windows",
    """WITH a AS (SELECT event_type, max(CAST(ts AS DATE)) AS anchor FROM events GROUP BY event_type)
    SELECT event_type, k, CAST(CAST(anchor - CAST(30 * k AS INT) AS DATE) AS VARCHAR) AS window_end, CAST(CAST(anchor - CAST(30 * (k + 1) AS INT) AS DATE) AS VARCHAR) AS window_start FROM a, range(0, 3) t(k)""",
)
def monthly_windows(spark, sf_dir, n: int = 3, span: int = 30):
    """The n windows of span days before the newest event of each kind, most recent first."""
    ends = read(spark, sf_dir, "events").groupBy("event_type").agg(F.to_date(F.max("ts")).alias("anchor")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return ends.select("event_type", "k", F.date_sub("anchor", (F.col("k") * span).cast("int")).cast("string").alias("window_end"), F.date_sub("anchor", ((F.col("k") + 1) * span).cast("int")).cast("string").alias("window_start"))


@registry.add(
    "label_to_metric",
    f"""WITH {FACTS_SQL}, m AS (SELECT DISTINCT metric FROM facts), l AS (SELECT DISTINCT entity, replace(upper(metric), '_', ' ') AS label FROM facts)
    SELECT l.entity, l.label, m.metric FROM l LEFT JOIN m ON regexp_replace(lower(l.label), '[^a-z0-9]+', '', 'g') = regexp_replace(m.metric, '[^a-z0-9]+', '', 'g')""",
)
def label_to_metric(spark, sf_dir):
    """Printed labels resolved by their squashed form, each distinct label once."""
    rows = facts(spark, sf_dir)
    labels = rows.select("entity", F.replace(F.upper("metric"), F.lit("_"), F.lit(" ")).alias("label")).distinct()
    known = rows.select("metric").distinct().withColumn("key", T.squash(F.col("metric")))
    resolved = labels.select("label").distinct().withColumn("key", T.squash(F.col("label"))).join(known, "key", "left").select("label", "metric")
    return labels.join(resolved, "label").select("entity", "label", "metric")
