"""The numeric guard: every number of an answer must be backed by what the answer cites.

What is cited grows into an allowed set: values, their thousandths and millionths, sums,
differences and ratios of pairs, years, pages and counts. Numbers meet the set within a tolerance
by an equi-join on buckets a tolerance wide, logarithmic above 1 and even below, each number
looking into its own bucket and the two beside it; no number is compared with a whole set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import FACTS_SQL, facts
from .matching import number_tokens

registry = Registry()

#: Relative tolerance, distinct values up to which pairs are formed, and the band of ratios that mean something.
TOLERANCE, MOST_PAIRED, RATIO_BAND = 0.01, 64, (1e-4, 1e4)


def _bucket(x: Column, tolerance: float) -> Column:
    """The number of a value's bucket; neighbours are within a tolerance of max(|x|, 1) of each other."""
    size = F.abs(x)
    log = F.floor(F.log(F.greatest(size, F.lit(1.0))) / math.log1p(tolerance)) + math.ceil(1 / tolerance)
    place = F.when(size < 1, F.floor(size / tolerance)).otherwise(log)
    return F.when(x < 0, -place - 1).otherwise(place)


def within(left: DataFrame, a: str, right: DataFrame, b: str, on: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Distinct rows of left that equal some row of right on `on` and lie within tolerance * max(|b|, 1) of it."""
    step = F.explode(F.array(*(F.lit(k) for k in (-2, -1, 0, 1, 2))))
    probes = left.withColumn("step", step).withColumn("bucket", _bucket(F.col(a).cast("double"), tolerance) + F.col("step")).drop("step")
    offers = right.select(*on, F.col(b).cast("double").alias("offer__value")).distinct().withColumn("bucket", _bucket(F.col("offer__value"), tolerance))
    near = F.abs(F.col(a) - F.col("offer__value")) <= tolerance * F.greatest(F.abs("offer__value"), F.lit(1.0))
    return probes.join(offers, [*on, "bucket"]).where(near).select(*left.columns).distinct()


def allowed_values(values: DataFrame, quotes: DataFrame) -> DataFrame:
    """(answer_id, value) that an answer may state: from values (answer_id, value) and quotes (answer_id, kind, text)."""
    base = values.where("value IS NOT NULL").select("answer_id", F.round(F.col("value").cast("double"), 6).alias("value")).distinct()
    few = base.groupBy("answer_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, MOST_PAIRED)).select("answer_id")
    paired = base.join(few, "answer_id")
    other = paired.select("answer_id", F.col("value").alias("other"))
    pairs = paired.join(other, "answer_id").where("value <> other")  # at most 64 x 63 for an answer
    scaled = lambda v: F.array(*(v / s for s in (1.0, 1e3, 1e6)))
    made = pairs.select("answer_id", F.when(F.col("value") < F.col("other"), F.array(F.col("value") - F.col("other"), F.col("value") + F.col("other"))).alias("sums"), (F.col("value") / F.when(F.col("other") != 0, F.col("other"))).alias("ratio"))
    sums = made.select("answer_id", F.explode("sums").alias("value"))
    wide = base.unionByName(sums).select("answer_id", F.explode(scaled(F.col("value"))).alias("value"))
    ratios = made.where(F.abs("ratio").between(*RATIO_BAND)).select("answer_id", F.col("ratio").alias("value"))
    said = quotes.select("answer_id", "kind", F.explode(number_tokens(F.col("text"))).alias("t")).where(~((F.col("kind") != "external") & F.col("t.is_integer") & F.col("t.magnitude").between(1900, 2100)))
    every = wide.unionByName(ratios).unionByName(said.select("answer_id", F.col("t.magnitude").alias("value")))
    return every.select("answer_id", F.explode(F.array("value", F.abs("value"))).alias("value")).select("answer_id", F.round("value", 6).alias("value")).distinct()


def guard_numbers(answers: DataFrame, values: DataFrame, integers: DataFrame, quotes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(answer_id, token, magnitude, backed) of each distinct number in the texts of answers (answer_id, text).

    values: (answer_id, value) cited or calculated; integers: (answer_id, n), years, pages and
    counts; quotes: (answer_id, kind, text), kind external, insight or question: numbers in them
    are backed, but years only in external ones. Backed are years from 1900 to 2100, whole
    numbers among the integers, 0, 1, 2, and numbers within the tolerance of an allowed value.
    Pairs are formed where an answer has 2 to 64 distinct values. Texts without numbers have no row.
    """
    tokens = answers.select("answer_id", F.explode(number_tokens(F.col("text"))).alias("t")).select("answer_id", "t.token", "t.magnitude", "t.is_integer").distinct()
    plain = F.col("is_integer") & (F.col("magnitude").between(1900, 2100) | F.col("magnitude").isin(0.0, 1.0, 2.0))
    counted = integers.where("n IS NOT NULL").select("answer_id", F.col("n").cast("double").alias("magnitude"), F.lit(True).alias("is_integer")).distinct()
    known = tokens.where(plain).select("answer_id", "token").unionByName(tokens.join(counted, ["answer_id", "magnitude", "is_integer"], "left_semi").select("answer_id", "token"))
    open_tokens = tokens.where(~plain)
    near = within(open_tokens, "magnitude", allowed_values(values, quotes), "value", ["answer_id"], tolerance).select("answer_id", "token")
    backed = known.unionByName(near).distinct().withColumn("backed", F.lit(True))
    return tokens.join(backed, ["answer_id", "token"], "left").select("answer_id", "token", "magnitude", F.coalesce("backed", F.lit(False)).alias("backed"))


_ANSWERS_SQL = f"""WITH {FACTS_SQL}, c AS (SELECT entity || ' ' || year AS answer_id, year, max(CASE WHEN metric = 'revenue' THEN value END) AS a, max(CASE WHEN metric = 'gross_profit' THEN value END) AS b, max(CASE WHEN metric = 'total_assets' THEN value END) AS d FROM facts GROUP BY entity, year),
    v AS (SELECT answer_id, round(unnest([a, b, d]), 6) AS value FROM c), k AS (SELECT answer_id, year, a, b, d FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL),
    t AS (SELECT answer_id, unnest([CAST(CAST(floor(a) AS BIGINT) AS VARCHAR), CAST(CAST(floor(a / 1000) AS BIGINT) AS VARCHAR), CAST(CAST(floor(abs(a - b)) AS BIGINT) AS VARCHAR), CAST(CAST(floor(100 * b / a) AS BIGINT) AS VARCHAR) || '.5%', CAST(year AS VARCHAR), CAST(CAST(floor(a * 1.02) AS BIGINT) AS VARCHAR), CAST(CAST(floor(d * 3) AS BIGINT) AS VARCHAR)]) AS token FROM k)"""


@registry.add(
    "answer_numbers",
    _ANSWERS_SQL
    + """, n AS (SELECT DISTINCT answer_id, token, CASE WHEN token LIKE '%\\%' ESCAPE '\\' THEN CAST(replace(token, '%', '') AS DOUBLE) / 100 ELSE CAST(token AS DOUBLE) END AS magnitude FROM t),
    b AS (SELECT DISTINCT answer_id, value FROM v WHERE value IS NOT NULL), p AS (SELECT x.answer_id, x.value AS x, y.value AS y FROM b x JOIN b y ON x.answer_id = y.answer_id AND x.value <> y.value),
    w AS (SELECT answer_id, value FROM b UNION SELECT answer_id, x - y FROM p WHERE x < y UNION SELECT answer_id, x + y FROM p WHERE x < y),
    s AS (SELECT answer_id, unnest([value, value / 1000, value / 1000000]) AS value FROM w UNION SELECT answer_id, x / y FROM p WHERE y <> 0 AND abs(x / y) BETWEEN 1e-4 AND 1e4),
    al AS (SELECT DISTINCT answer_id, round(unnest([value, abs(value)]), 6) AS value FROM s)
    SELECT answer_id, token, magnitude, (magnitude = floor(magnitude) AND magnitude BETWEEN 1900 AND 2100 AND token NOT LIKE '%.%') OR (magnitude IN (0, 1, 2) AND token NOT LIKE '%.%') OR EXISTS (SELECT 1 FROM al WHERE al.answer_id = n.answer_id AND abs(n.magnitude - al.value) <= 0.01 * greatest(abs(al.value), 1)) AS backed FROM n""",
)
def answer_numbers(spark, sf_dir):
    """Answers about each entity and year that state cited, scaled and derived figures, and some that nothing backs."""
    c = facts(spark, sf_dir, ["revenue", "gross_profit", "total_assets"]).groupBy(F.concat_ws(" ", "entity", "year").alias("answer_id"), "year").pivot("metric", ["revenue", "gross_profit", "total_assets"]).agg(F.first("value"))
    values = c.select("answer_id", F.explode(F.array("revenue", "gross_profit", "total_assets")).alias("value"))
    a, b, d = (F.col(m) for m in ("revenue", "gross_profit", "total_assets"))
    whole = lambda x: F.floor(x).cast("long").cast("string")
    text = F.concat_ws(" and ", whole(a), whole(a / 1000), whole(F.abs(a - b)), F.concat(whole(100 * b / a), F.lit(".5%")), F.col("year").cast("string"), whole(a * 1.02), whole(d * 3))
    answers = c.where("revenue IS NOT NULL AND gross_profit IS NOT NULL AND total_assets IS NOT NULL").select("answer_id", text.alias("text"))
    none = spark.createDataFrame([], "answer_id string, kind string, text string")
    return guard_numbers(answers, values, c.select("answer_id", F.col("year").alias("n")), none)
