"""One-to-one assignment to a fixed point, and template rows matched to extracted lines.

Taking pairs in the order of their rank, each if both its sides are still free, needs no global
order: a pair that is the best of its row and of its item is taken by that loop whatever the others
are. So each round takes all such pairs at once, by two aggregations, and removes what they close;
rounds end when no pair is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import facts, read
from ..sources.scratch import remove, saved
from .similar import similar_pairs

registry = Registry()

#: Words of sections that tell nothing, beginnings of labels that are totals, and metrics at home in several statements.
SECTION_STOP = ("and", "the", "for", "from", "other", "others", "total", "net")
TOTALS = ("total", "gross ", "net ", "subtotal", "operating profit", "profit ")
AT_HOME_ANYWHERE = ("deferred_tax", "depreciation", "amortization", "taxes_paid")
#: Abbreviations in labels.
WRITTEN_OUT = {"pvt": "private", "ltd": "limited", "corp": "corporation", "incl": "including", "amt": "amount", "recd": "received", "accum": "accumulated", "invt": "investment", "mfg": "manufacturing", "wppf": "workers profit participation fund", "wwf": "workers welfare fund"}


def assign(pairs: DataFrame, rank: list[str]) -> DataFrame:
    """The pairs (row_id, item_id, *) that a loop over all pairs in the order of rank takes, each side once.

    rank: expressions, smaller first; ties go by row_id, then item_id. Repeated pairs count by
    their best rank. Nulls in row_id or item_id are in no pair.
    """
    order = F.struct(*(F.expr(r).alias(f"rank_{i}") for i, r in enumerate(rank)), F.col("row_id"), F.col("item_id"))
    rest = saved(pairs.where("row_id IS NOT NULL AND item_id IS NOT NULL").select(F.col("row_id"), F.col("item_id"), order.alias("order"), F.struct(*pairs.columns).alias("pair")))
    taken = None
    while not rest.isEmpty():
        of_row = rest.groupBy("row_id").agg(F.min_by(F.struct("item_id", "pair"), "order").alias("r"))
        of_item = rest.groupBy("item_id").agg(F.min_by("row_id", "order").alias("best_row"))
        best = of_row.select("row_id", F.col("r.item_id").alias("item_id"), F.col("r.pair").alias("pair")).join(of_item, "item_id").where("row_id = best_row").drop("best_row")
        best = saved(best)
        left = saved(rest.join(best.select("row_id"), "row_id", "left_anti").join(best.select("item_id"), "item_id", "left_anti"))
        remove(rest)
        rest, taken = left, best if taken is None else taken.unionByName(best)
    if taken is None:
        return pairs.limit(0)
    return taken.select("pair.*")


def expanded(label):
    """A label in lower case, its abbreviations written out."""
    known = F.create_map(*(F.lit(x) for pair in WRITTEN_OUT.items() for x in pair))
    return F.array_join(F.transform(F.split(T.spaced(F.coalesce(label, F.lit(""))), " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def looks_total(label):
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.array_contains(F.transform(F.array(*map(F.lit, TOTALS)), lambda t: F.startswith(low, t)), True)


def section_words(section):
    """The words of a section that tell it from others."""
    return F.filter(F.array_distinct(F.split(T.spaced(F.coalesce(section, F.lit(""))), " ")), lambda w: (F.length(w) >= 3) & ~w.isin(*SECTION_STOP))


def match_template(rows: DataFrame, items: DataFrame, statements: DataFrame, face: DataFrame | None = None, least: float = 82.0) -> DataFrame:
    """(entity, row_id, item_id, method, score, overlap, value) for each entity and row of the template.

    rows: (row_id, statement, label, section, metric, polarity, strict). items: (entity, item_id,
    statement, label, section, metric, role, polarity). statements: (statement, family, face); both
    lists are as short as templates are. face: (entity, metric, value) of trusted totals.

    Labels are compared by token_set after abbreviations are written out. A total never goes to a
    leaf, a known metric not to another, a known family not to another nor a known polarity (a
    strict row needs its own), but for metrics at home in several statements. A row looks among
    lines of its own statement, else among those of the statements around the same face, else, where
    an entity has no line there, among all. Pairs of an entity are assigned one to one by own
    statement, shared section words, and score; rows left over take their metric's trusted total
    (method face) or are unmatched. Rows and items are read by several jobs but computed once.
    """
    home = statements.select("statement", "family", "face")
    r = rows.join(F.broadcast(home), "statement", "left").select("row_id", F.col("statement").alias("r_statement"), F.col("family").alias("r_family"), F.col("face").alias("r_face"), F.col("metric").alias("r_metric"), F.col("polarity").alias("r_polarity"), F.coalesce("strict", F.lit(False)).alias("strict"), section_words(F.col("section")).alias("r_words"), looks_total(F.col("label")).alias("r_total"), expanded(F.col("label")).alias("r_label"))
    r = saved(r)
    role = F.lower(F.coalesce("role", F.lit("")))
    total = role.isin("total", "subtotal") | ((role == "") & looks_total(F.col("label")))
    i = items.join(F.broadcast(home), "statement", "left").select("entity", "item_id", F.col("statement").alias("i_statement"), F.col("family").alias("i_family"), F.col("face").alias("i_face"), F.col("metric").alias("i_metric"), F.col("polarity").alias("i_polarity"), section_words(F.col("section")).alias("i_words"), total.alias("i_total"), expanded(F.col("label")).alias("i_label"))
    i = saved(i)
    alike = similar_pairs(r.select("r_label"), i.select("i_label"), least, "token_set")
    met = i.join(alike, F.col("i_label") == F.col("b")).join(F.broadcast(r), F.col("a") == F.col("r_label"))
    differ = lambda c: F.coalesce(F.col(f"r_{c}") != F.col(f"i_{c}"), F.lit(False))
    anywhere = F.coalesce(F.col("i_metric").isin(*AT_HOME_ANYWHERE), F.lit(False))
    strict = F.col("strict") & F.col("r_polarity").isNotNull() & ~F.col("r_polarity").eqNullSafe(F.col("i_polarity"))
    met = saved(met.where(~(F.col("i_total") & ~F.col("r_total")) & ~differ("metric") & (anywhere | (~differ("family") & ~differ("polarity") & ~strict))))
    scratch = met
    # which pools an entity has lines in
    pools = i.groupBy("entity").agg(F.collect_set("i_face").alias("faces"), F.collect_set("i_statement").alias("held"))  # as many as statements
    met = met.join(pools, "entity")
    own = F.col("r_statement").eqNullSafe(F.col("i_statement")) & F.col("r_statement").isNotNull()
    has_near = F.coalesce(F.array_contains("faces", F.col("r_face")) | F.array_contains("held", F.col("r_statement")), F.lit(False))
    tier = F.when(own, 0).when(F.coalesce(F.col("r_face") == F.col("i_face"), F.lit(False)), 1).when(~has_near, 2)
    met = met.withColumn("tier", tier).where("tier IS NOT NULL")
    first = met.groupBy("entity", "row_id").agg(F.min("tier").alias("first"))
    met = met.join(first, ["entity", "row_id"]).where("(tier = 0) = (first = 0)")
    overlap = F.size(F.array_intersect("r_words", "i_words"))
    pairs = met.select(F.struct("entity", F.col("row_id").alias("id")).alias("row_id"), F.struct("entity", F.col("item_id").alias("id")).alias("item_id"), F.when(F.col("tier") == 0, "own").when(F.col("tier") == 1, "widened").otherwise("pooled").alias("method"), (F.col("tier") > 0).alias("away"), "score", overlap.alias("overlap"))
    taken = assign(pairs, ["away", "-overlap", "-score"]).select(F.col("row_id.entity").alias("entity"), F.col("row_id.id").alias("row_id"), F.col("item_id.id").alias("item_id"), "method", "score", "overlap")
    remove(scratch)
    every = i.select("entity").distinct().join(F.broadcast(r.select("row_id", "r_metric")))
    out = every.join(taken, ["entity", "row_id"], "left")
    value = F.lit(None).cast("double")
    if face is not None:
        out = out.join(face.select("entity", F.col("metric").alias("r_metric"), F.col("value").cast("double").alias("total")), ["entity", "r_metric"], "left")
        value = F.when(F.col("item_id").isNull(), F.col("total"))
    method = F.coalesce("method", F.when(value.isNotNull(), "face").otherwise("unmatched"))
    return out.select("entity", "row_id", "item_id", method.alias("method"), "score", "overlap", value.alias("value"))


@registry.add(
    "global_assignment",
    """WITH p AS MATERIALIZED (SELECT l_suppkey AS row_id, l_partkey AS item_id, min(l_returnflag <> 'R') AS away, CAST(max(l_linenumber) AS INT) AS overlap, CAST(sum(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY ALL),
    g AS (SELECT list_reduce(list_prepend({'row_id': NULL, 'item_id': NULL, 'rs': CAST([] AS BIGINT[]), 'ks': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])}, list({'row_id': CAST(row_id AS BIGINT), 'item_id': CAST(item_id AS BIGINT), 'rs': CAST([] AS BIGINT[]), 'ks': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])} ORDER BY away, overlap DESC, score DESC, row_id, item_id)),
      lambda s, x: CASE WHEN list_contains(s.rs, x.row_id) OR list_contains(s.ks, x.item_id) THEN s ELSE {'row_id': s.row_id, 'item_id': s.item_id, 'rs': list_append(s.rs, x.row_id), 'ks': list_append(s.ks, x.item_id), 'out': s.out} END) AS s FROM p)
    SELECT p.* FROM p JOIN (SELECT unnest(s.rs) AS row_id, unnest(s.ks) AS item_id FROM g) USING (row_id, item_id)""",
)
def global_assignment(spark, sf_dir):
    """Suppliers and parts that lines bring together, one to one: returned lines first, then the latest line number and the largest quantity."""
    lines = read(spark, sf_dir, "lineitem")
    pairs = lines.groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("item_id")).agg(F.min(F.col("l_returnflag") != "R").alias("away"), F.max("l_linenumber").alias("overlap"), F.sum("l_quantity").cast("double").alias("score"))
    return assign(pairs.withColumn("overlap", F.col("overlap").cast("int")), ["away", "-overlap", "-score"])


@registry.add("template_matching")
def template_matching(spark, sf_dir):
    """A template of the metrics against each entity's lines of its newest year, some bent, in other statements or missing."""
    f = facts(spark, sf_dir)
    newest = saved(f.groupBy("entity", "metric").agg(F.max_by("value", "year").alias("value")))  # rows, items and totals come from it
    label = F.replace("metric", F.lit("_"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat("entity", "metric").cast("binary")), F.lit(6))
    pl = F.when(F.col("metric").rlike("asset|liabilit|equity|cash|inventor|receiv|payab"), "bs").otherwise("pl")
    base = newest.select("entity", "metric", "value", pl.alias("statement"), label.alias("label"), k.alias("k"))
    bent = F.when(F.col("k") == 1, F.concat("label", F.lit(" - net"))).when(F.col("k") == 2, F.regexp_replace("label", "t", "tt")).otherwise(F.col("label"))
    items = base.where("k <> 5").select("entity", F.concat(F.lit("line "), "metric").alias("item_id"), F.when(F.col("k") == 3, F.concat("statement", F.lit(" note"))).otherwise(F.col("statement")).alias("statement"), bent.alias("label"), F.when(F.col("k") == 1, "Trading account").alias("section"), F.when(F.col("k") == 4, F.col("metric")).alias("metric"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("polarity"))
    rows = base.select(F.col("metric").alias("row_id"), "statement", "label", F.lit("Trading").alias("section"), "metric", F.lit(None).cast("string").alias("polarity"), F.lit(False).alias("strict")).distinct()
    statements = spark.createDataFrame([(s + n, s, s) for s in ("pl", "bs") for n in ("", " note")], "statement string, family string, face string")
    return match_template(rows, items, statements, newest.select("entity", "metric", "value"))
