"""Mixing sources to target weights by entropy balancing, by built-in functions only.

Of all document rates that meet the token constraint of each source and stay below a cap, the
balanced ones lie closest, in relative entropy, to taking each document once. Their dual has a
multiplier for each source: a document's rate is exp(multiplier * size), at most the cap.
Newton steps find the multipliers; each sums gradients and curvatures over the whole corpus,
and a bracket keeps the steps safe. Rates become whole copies: each document gets the whole
part, and one more goes to documents in order of a hash divided by the rest of their rate,
until the source's remaining tokens are met.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, offered, table, written

#: Newton steps at most, parts of a word in which sums are kept whole, and words and share of the target that may be missed.
NEWTON_STEPS, PARTS, MISSED_WORDS, MISSED_SHARE = 80, 1_000_000, 0.05, 1e-9
#: Buckets of the order of extra copies for each unit of it, and in all.
BUCKETS, LAST_BUCKET = 1_024, 4_095


def source_plan(totals: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources rank by code point, null last. Targets are shares by weight of share times all
    sizes; those above cap times their source's size stop there and the rest is dealt again,
    which is a common level that sorted prefix sums find. The list of sources is one window.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", cycle)
    plan = plan.withColumn("most", F.col("source_size") * cap).withColumn("budget", F.lit(share) * F.sum("source_size").over(W.partitionBy()))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    plan = plan.withColumn("level", (F.col("budget") - before) / after).withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(W.partitionBy())["level"]
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return plan.select("source", "source_size", target.alias("target"))


def _whole(value):
    """Whole parts of a word, so that sums don't depend on the order of their rows."""
    return F.round(value * PARTS).cast("decimal(38,0)") * F.col("n")


def balanced(sizes: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """(source, source_size, target, multiplier) from (source, size, n) and the plan; null where a source takes nothing.

    The tokens of a source rise with its multiplier, from its target or less at
    -log(source_size / target) to cap times its size at log(cap), so a solution lies between.
    A Newton step that leaves what is left of that bracket is replaced by its middle.
    """
    rate = F.least(F.exp(F.col("multiplier") * F.col("size")), F.lit(float(cap)))
    takes = (F.col("target") > 0) & (F.col("source_size") > 0)
    full = F.col("target") >= F.col("source_size") * cap
    low = F.least(-F.log(F.col("source_size") / F.col("target")), F.lit(0.0))
    now = plan.withColumns({"multiplier": F.when(takes, F.when(full, F.lit(math.log(cap))).otherwise(F.lit(0.0))), "low": F.when(takes, low), "high": F.when(takes, F.lit(math.log(cap))), "done": ~takes | full})
    now = written(now)
    for _ in range(NEWTON_STEPS):
        if now.where("NOT done").isEmpty():
            break
        asked = now.where("NOT done").select(F.col("source").alias("s"), "multiplier")
        met = sizes.join(asked, F.col("source").eqNullSafe(F.col("s"))).where("size > 0")
        sums = met.groupBy("s").agg(F.sum(_whole(rate * F.col("size"))).alias("tokens"), F.sum(F.when(rate < cap, _whole(rate * F.col("size") * F.col("size"))).otherwise(F.lit(0))).alias("slope"))
        sums = sums.select("s", *((F.col(c).cast("double") / PARTS).alias(c) for c in ("tokens", "slope")))
        step = now.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("tokens") - F.col("target")
        step = step.withColumn("close", F.abs(over) <= MISSED_WORDS + MISSED_SHARE * F.col("target"))
        step = step.withColumns({"high": F.when(over > 0, F.col("multiplier")).otherwise(F.col("high")), "low": F.when(over < 0, F.col("multiplier")).otherwise(F.col("low"))})
        newton = F.col("multiplier") - over / F.col("slope")
        middle = (F.col("low") + F.col("high")) / 2
        following = F.when((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        then = written(step.select("source", "source_size", "target", F.when(F.col("done") | F.col("close"), F.col("multiplier")).otherwise(following).alias("multiplier"), "low", "high", (F.col("done") | F.col("close")).alias("done")))
        discard(now)
        now = then
    return now.select("source", "source_size", "target", "multiplier")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: (id, source, size, source_size, target, rate, copies, taken, *carry).

    A document's size is its number of words between ASCII white space, 0 for null and empty
    texts. taken = copies * size, never above cap * size; whole documents are rounded, so a
    source's taken words miss its target by at most half of one document. The order of extra
    copies is a hash of the id over the rest of the rate, ties by hash, id and size, and sums
    are of whole numbers, so reruns agree. Null sources are one source, ranked last; null and
    repeated ids keep their rows. Sources of size 0 take nothing. Columns in carry pass
    unchanged, others are not read; an empty table gives an empty one.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    held = {c: f"carry_{i}" for i, c in enumerate(carry)}
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"), *(F.col(c).alias(h) for c, h in held.items()))
    sized = written(base.drop(*held.values()))
    sizes = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = written(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = balanced(sizes, source_plan(totals, weights, share, cap), cap)

    rate = F.coalesce(F.least(F.exp(F.col("multiplier") * F.col("size")), F.lit(float(cap))), F.lit(0.0))
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    named = plan.withColumnRenamed("source", "plan_source")
    whole = sizes.join(offered(named, 112), same).groupBy("plan_source", "source_size", "target", "multiplier").agg(F.sum(F.floor(rate) * F.col("size") * F.col("n")).alias("whole_size"))
    plan = written(whole.select("plan_source", "source_size", "target", "multiplier", (F.col("target") - F.col("whole_size")).alias("quota")))

    def ordered(df: DataFrame) -> DataFrame:
        df = df.join(offered(plan, 112), same, "left").withColumn("rate", rate).withColumn("rest", F.col("rate") - F.floor("rate"))
        place = (F.conv(F.substring("key", 1, 13), 16, 10).cast("long") / F.lit(float(2**52))) / F.col("rest")
        df = df.withColumn("place", F.when((F.col("rest") > 0) & (F.col("size") > 0), place))
        bucket = F.least(F.floor(F.col("place") * BUCKETS), F.lit(LAST_BUCKET)).cast("int")
        return df.withColumn("bucket", F.when(F.col("place").isNotNull(), bucket))  # least() passes over nulls

    # the bucket of each source in which the quota ends: only its documents are put in order
    buckets = ordered(sized).where("bucket IS NOT NULL").groupBy("plan_source", "quota", "bucket").agg(F.sum("size").alias("bucket_size"))
    run = W.partitionBy("plan_source", "quota").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(run), F.lit(0))).where(F.col("before") <= F.col("quota"))
    ends = ends.groupBy("plan_source").agg(F.max(F.struct("bucket", "before")).alias("end")).select(F.col("plan_source").alias("end_source"), "end.bucket", "end.before")
    ends = offered(written(ends.select("end_source", F.col("bucket").alias("end_bucket"), "before")), 80)
    rows = ordered(base if carry else sized).join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
    edge = F.coalesce(F.col("bucket") == F.col("end_bucket"), F.lit(False))
    clear = rows.where(~edge).withColumn("extra", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)))
    order = W.partitionBy("source").orderBy("place", "key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    at_edge = rows.where(edge).withColumn("extra", middle <= F.col("quota"))
    copies = F.least(F.floor("rate") + F.col("extra").cast("int"), F.lit(cap)).cast("long")
    out = clear.unionByName(at_edge).withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(h).alias(c) for c, h in held.items()))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(documents: str) -> str:
    """DuckDB SQL for (doc_id, size, source_size, target, taken, copies) of a relation of documents."""
    return rf"""
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5(CAST(doc_id AS VARCHAR)) AS key FROM {documents}),
sizes AS MATERIALIZED (SELECT source, size, count(*) AS n FROM sized GROUP BY source, size),
totals AS (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM ranked),
levels AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
split AS (SELECT *, most <= weight * level AS is_full FROM levels),
aimed AS MATERIALIZED (SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE weight * (SELECT first(level ORDER BY most / weight, rank) FROM split WHERE NOT is_full) END AS target FROM split),
newton AS (SELECT 0 AS k, source, CAST(source_size AS DOUBLE) AS s, target, CASE WHEN target >= 2 * source_size THEN ln(2) ELSE 0 END AS x, least(-ln(source_size / target), 0) AS low, ln(2) AS high, target >= 2 * source_size AS done
  FROM aimed WHERE target > 0 AND source_size > 0
  UNION ALL
  SELECT k + 1, source, s, target, CASE WHEN close THEN x WHEN slope > 0 AND x - over / slope > low2 AND x - over / slope < high2 THEN x - over / slope ELSE (low2 + high2) / 2 END, low2, high2, close
  FROM (SELECT *, tokens - target AS over, abs(tokens - target) <= {MISSED_WORDS} + {MISSED_SHARE} * target AS close, CASE WHEN tokens < target THEN x ELSE low END AS low2, CASE WHEN tokens > target THEN x ELSE high END AS high2
    FROM (SELECT k, w.source, s, target, x, low, high,
      CAST(sum(CAST(round(least(exp(x * size), 2) * size * {PARTS}) AS HUGEINT) * n) AS DOUBLE) / {PARTS} AS tokens,
      CAST(coalesce(sum(CAST(round(exp(x * size) * size * size * {PARTS}) AS HUGEINT) * n) FILTER (WHERE x * size < ln(2) AND exp(x * size) < 2), 0) AS DOUBLE) / {PARTS} AS slope
      FROM newton w JOIN sizes z ON z.source IS NOT DISTINCT FROM w.source AND z.size > 0
      WHERE NOT done AND k < {NEWTON_STEPS} GROUP BY k, w.source, s, target, x, low, high))),
multiplied AS (SELECT source, first(x ORDER BY k DESC) AS x FROM newton GROUP BY source),
rated AS (SELECT d.*, a.source_size, a.target, CASE WHEN m.x IS NULL THEN 0 ELSE least(exp(m.x * size), 2) END AS rate
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN multiplied m ON d.source IS NOT DISTINCT FROM m.source),
placed AS (SELECT *, CASE WHEN rate > floor(rate) AND size > 0 THEN CAST(CAST('0x' || substr(key, 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 / (rate - floor(rate)) END AS place,
  target - sum(floor(rate) * size) OVER (PARTITION BY source) AS quota FROM rated),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY least(floor(place * {BUCKETS}), {LAST_BUCKET}), place, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle FROM placed WHERE place IS NOT NULL),
mixed AS (SELECT doc_id, source, size, source_size, target, CAST(least(2, floor(rate) + CAST(middle <= quota AS INT)) AS BIGINT) AS copies FROM run
  UNION ALL SELECT doc_id, source, size, source_size, target, CAST(floor(rate) AS BIGINT) FROM placed WHERE place IS NULL)"""


QUERIES = {"op10_mixing": op10_mixing}
SQL = {"op10_mixing": f"WITH RECURSIVE {mixing_sql('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"}
