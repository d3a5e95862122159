"""Retrieval by meaning and recency, and stories told once.

Queries go to the articles in blocks of a bounded size; a task holds, for each query of a block,
only its best k so far, and gives those out. What is shuffled is k rows a task and query, never
the scores of a category.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import read
from ..sources.scratch import saved

registry = Registry()

#: Weight of recency, its half-life in days, the least cosine, the similarity of one story, of one insight, and what is kept.
RECENCY, HALF_LIFE, FLOOR, SAME_STORY, SAME_INSIGHT, TOP = 0.2, 14.0, 0.20, 0.85, 0.90, 8
#: Bytes of query vectors that go to the tasks at once.
BLOCK_BYTES = 16 << 20


def _unit(vectors: list) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    x = np.array(vectors, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(block: list[tuple], k: int, floor: float, weight: float, half_life: float):
    """(query_id, article_id, cosine, score) of the best k articles that a task holds, for each query of the block."""
    by_label: dict = {}
    for i, (query_id, label, anchor, vector) in enumerate(block):
        by_label.setdefault((label, len(vector)), []).append(i)
    queries = {at: _unit([block[i][3] for i in own]) for at, own in by_label.items()}

    def best(batches):
        held = {i: (np.empty(0, np.int64), np.empty(0), np.empty(0)) for i in range(len(block))}
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows[rows["vector"].map(lambda v: v is not None and len(v) > 0 and bool(np.isfinite(np.asarray(v, float)).all()) and bool(np.any(v)))]
            for (label, size), part in rows.groupby([rows["label"].map(lambda x: None if pd.isna(x) else int(x)), rows["vector"].map(len)], dropna=False):
                own = by_label.get((None if pd.isna(label) else int(label), int(size)))
                if not own:
                    continue
                ids, ages = part["article_id"].to_numpy(np.int64), part["day"].to_numpy(float)
                cosines = np.round(queries[None if pd.isna(label) else int(label), int(size)] @ _unit(part["vector"].tolist()).T, 6)
                for row, i in enumerate(own):
                    recent = np.where(np.isnan(ages) | (block[i][2] is None), 0.5, 0.5 ** (np.maximum(0.0, (block[i][2] or 0.0) - ages) / half_life))
                    score = np.round((1 - weight) * cosines[row] + weight * recent, 6)
                    ok = (cosines[row] >= floor) & (ids != block[i][0])
                    a, c, s = (np.concatenate([old, new[ok]]) for old, new in zip(held[i], (ids, cosines[row], score), strict=True))
                    keep = np.lexsort((a, -s))[:k]
                    held[i] = (a[keep], c[keep], s[keep])
        for i, (a, c, s) in held.items():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([block[i][0]] * len(a), pa.int64()), pa.array(a), pa.array(c), pa.array(s)], names=["query_id", "article_id", "cosine", "score"])

    return best


def retrieve(queries: DataFrame, articles: DataFrame, k: int = TOP, floor: float = FLOOR, weight: float = RECENCY, half_life: float = HALF_LIFE) -> DataFrame:
    """(query_id, article_id, cosine, score, place): the best k articles of each query.

    queries: (query_id, label int, day double, vector); articles: (article_id, label, day, vector);
    days on one scale, labels equal or both null. The cosine, to 6 places, is at least floor;
    score = (1 - weight) * cosine + weight * 0.5 ^ (age / half_life), 0.5 for an unknown day, no
    age below 0. Ties go to the smaller article_id; an article with the query's id is not its
    own answer. Null, zero and non-finite vectors are in no result. Each block of queries is one
    pass over the articles.
    """
    asked = queries.where("vector IS NOT NULL AND size(vector) > 0 AND query_id IS NOT NULL").select(F.col("query_id").cast("long"), F.col("label").cast("int"), F.col("day").cast("double"), F.col("vector").cast("array<double>"))
    asked = asked.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("vector") * 8 + 64).alias("bytes")).first()
    parts = max(1, -(-(size["bytes"] or 0) // BLOCK_BYTES))
    offers = articles.where("article_id IS NOT NULL").select(F.col("article_id").cast("long"), F.col("label").cast("int"), F.col("day").cast("double"), F.col("vector").cast("array<double>"))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    dealt = saved(dealt) if parts > 1 else dealt
    found = []
    for p in range(parts):
        block = [tuple(r) for r in dealt.where(F.col("part") == p).drop("part").collect()]  # BLOCK_BYTES on average
        found.append(offers.mapInArrow(_best(block, k, floor, weight, half_life), "query_id long, article_id long, cosine double, score double"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "article_id"))
    return reduce(DataFrame.unionByName, found).withColumn("place", place).where(F.col("place") <= k)


def fold_stories(found: DataFrame, same: float = SAME_STORY, top: int = TOP) -> DataFrame:
    """(group, item, rank, story, outlets, independent_stories, corroboration) of the items of a group, in the order of rank.

    found: (group long, item long, rank double, outlet string, vector), the few that retrieval keeps.
    An item whose cosine with a kept one is at least `same` joins the first such story, else it is
    kept; after `top` stories the rest has none. outlets are a story's, sorted; corroboration =
    1 - 0.5 ^ (independent stories - 1).
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "item"], kind="stable").reset_index(drop=True)
        x, kept, story = _unit(rows["vector"].tolist()), [], []
        for i in range(len(rows)):
            near = np.flatnonzero(x[kept] @ x[i] >= same) if kept else ()
            if len(near):
                story.append(kept[near[0]])
            elif len(kept) < top:
                kept.append(i)
                story.append(i)
            else:
                story.append(-1)
        told = rows.assign(story=[None if s < 0 else int(rows["item"][s]) for s in story])
        outlets = told.dropna(subset=["story"]).groupby("story")["outlet"].agg(lambda o: sorted(set(o.dropna())))
        told["outlets"] = [None if pd.isna(s) else outlets[s] for s in told["story"]]
        told["story"] = told["story"].astype("Int64")
        return told.assign(independent_stories=len(kept), corroboration=1 - 0.5 ** (len(kept) - 1))[["group", "item", "rank", "story", "outlets", "independent_stories", "corroboration"]]

    return found.groupBy("group").applyInPandas(fold, "group long, item long, rank double, story long, outlets array<string>, independent_stories int, corroboration double")


def fold_insights(insights: DataFrame, same: float = SAME_INSIGHT) -> DataFrame:
    """(entity, insight_id, kept_as) of insights (entity, insight_id, confidence, vector): the most confident of each meaning stays.

    Per entity, in the order of falling confidence, then id, an insight that a kept one resembles
    (cosine at least `same`) is kept as that one. The order is followed in rounds: an insight is
    settled as kept when no better open one resembles it, and as folded when a kept better one
    does; pairs come from one join within the entity, so no entity's insights are held in a task.
    """
    v = insights.select("entity", "insight_id", F.col("confidence").cast("double").alias("c"), F.col("vector").cast("array<double>").alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
    v = saved(v.withColumn("norm", F.sqrt(dot("x", "x"))))
    better = (F.col("a.c") > F.col("b.c")) | ((F.col("a.c") == F.col("b.c")) & (F.col("a.insight_id") < F.col("b.insight_id")))
    near = dot("a.x", "b.x") / (F.col("a.norm") * F.col("b.norm")) >= same
    pairs = saved(v.where("norm > 0").alias("a").join(v.where("norm > 0").alias("b"), (F.col("a.entity") == F.col("b.entity")) & better).where(near).select(F.col("a.insight_id").alias("better"), F.col("a.c").alias("c"), F.col("b.insight_id").alias("worse")))
    settled = saved(v.select("insight_id").join(pairs.select(F.col("worse").alias("insight_id")).distinct(), "insight_id", "left_anti").withColumn("kept_as", F.col("insight_id")))
    while True:
        rest = pairs.join(settled.select(F.col("insight_id").alias("worse")), "worse", "left_anti").join(settled.select(F.col("insight_id").alias("better"), (F.col("kept_as") == F.col("insight_id")).alias("kept")), "better", "left")
        state = rest.groupBy("worse").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("met"), F.bool_or(F.col("kept").isNull()).alias("waits"), F.min(F.when(F.coalesce("kept", F.lit(False)), F.struct(-F.col("c"), F.col("better")))).alias("by"), F.min(F.when(F.col("kept").isNull(), F.struct(-F.col("c"), F.col("better")))).alias("open"))
        done = state.where("NOT waits OR (met AND by < open)")
        now = saved(done.select(F.col("worse").alias("insight_id"), F.when(F.col("met"), F.col("by.better")).otherwise(F.col("worse")).alias("kept_as")))
        if now.isEmpty():
            break
        settled = saved(settled.unionByName(now))
    return v.select("entity", "insight_id").join(settled, "insight_id")


@registry.add(
    "blended_retrieval",
    """WITH a AS (SELECT vec_id, label, vec_id % 60 AS day, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label, day, e FROM a WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id AS article_id, round(list_cosine_similarity(q.e, a.e), 6) AS cosine, greatest(q.day - a.day, 0) AS age FROM q JOIN a ON q.label IS NOT DISTINCT FROM a.label AND vec_id <> query_id),
    b AS (SELECT query_id, article_id, cosine, round(0.8::DOUBLE * cosine + 0.2::DOUBLE * pow(0.5::DOUBLE, age / 14.0::DOUBLE), 6) AS score FROM s WHERE cosine >= 0.2)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS INT) AS place FROM b QUALIFY place <= 8""",
)
def blended_retrieval(spark, sf_dir):
    """Every hundredth vector as a query, all vectors as articles of the last 60 days."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 60).cast("double").alias("day"), F.col("embedding").alias("vector"))
    return retrieve(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "article_id"))


@registry.add("independent_stories")
def independent_stories(spark, sf_dir):
    """What blended retrieval keeps, folded to stories; an article's outlet is its label and day."""
    v = read(spark, sf_dir, "embeddings")
    outlet = F.concat_ws("-", F.col("label").cast("string"), (F.col("vec_id") % 5).cast("string"))
    found = blended_retrieval(spark, sf_dir).join(v.select(F.col("vec_id").alias("article_id"), outlet.alias("outlet"), F.col("embedding").cast("array<double>").alias("vector")), "article_id")
    return fold_stories(found.select(F.col("query_id").alias("group"), F.col("article_id").alias("item"), F.col("place").cast("double").alias("rank"), "outlet", "vector"), same=0.5)
