"""Personal data by patterns, and terms that disclose it by corpus co-occurrence; built-in functions only.

Entities are the values that the patterns find. For each term that stands near an entity the
corpus gives its pointwise mutual information with it; a term that carries at least a stated
part of the entity's information discloses it and is sanitised where the entity occurs: terms
with digits are generalised to their shape, others are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offered, table, written
from .spans import SPAN, joined, listed, with_matches

#: \G lets a match begin where the last one ended; else a run is tried from its first character.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Code points on either side of an entity that are its context, and words taken from each side: names, employers and
#: accounts stand beside what they reveal; with whole texts as contexts every rare word of a text would disclose its entities.
CONTEXT_CHARS, CONTEXT_WORDS = 120, 4
TERM = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]{3,64}(?![\p{L}\p{N}])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _keeps(kind: str, match: Column) -> Column:
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.substring(number(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & F.when(F.length(_digits(match)).between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _keeping(kind: str):
    return lambda s: _keeps(kind, s["match"])


def with_base_spans(df: DataFrame, body: str) -> DataFrame:
    """Adds an array of spans for each kind of KINDS; what fails its test is dropped, not retried."""
    needs = {"email": F.contains(F.col(body), F.lit("@")), "phone": F.contains(F.col(body), F.lit("+"))}
    for kind, pattern in KINDS.items():
        df = with_matches(df, body, pattern, f"{kind}__all", needs.get(kind))

        df = df.withColumn(kind, F.filter(f"{kind}__all", _keeping(kind))).drop(f"{kind}__all")
    return df


def _near(body: str, start: Column, end: Column) -> Column:
    """Words near a span, lower-cased; those that the edge of the context may cut are left out."""
    first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    left = F.split(F.substring(F.col(body), first + 1, start - first), r"\s+")
    left = F.when(first > 0, F.slice(left, 2, F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    right = F.split(F.substring(F.col(body), end + 1, F.lit(CONTEXT_CHARS)), r"\s+")
    right = F.when(F.length(body) > end + CONTEXT_CHARS, F.slice(right, 1, F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    taken = F.concat(F.slice(left, F.greatest(F.size(left) - CONTEXT_WORDS, F.lit(1)), CONTEXT_WORDS + 1), F.slice(right, 1, CONTEXT_WORDS + 1))
    return F.lower(F.array_join(taken, " "))


def distinct_texts(source: DataFrame, body: str) -> DataFrame:
    """(text_key, body), a row for each distinct text; only texts with copies are shuffled."""
    keyed = source.select(F.xxhash64(body).alias("text_key"), body)
    copied = written(keyed.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key"))
    copied = offered(copied, 16)
    once = keyed.join(copied, "text_key", "left_anti")
    return once.unionByName(keyed.join(copied, "text_key", "left_semi").dropDuplicates(["text_key"]))


def disclosing_terms(source: DataFrame, body: str, min_contexts: int, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """(text_key, entity) of all texts with entities, and (entity, term) where the term discloses the entity; None where no term can.

    All counts are of distinct texts, so copies count once. With n texts that hold the entity,
    k of them with the term near it, the term in d of N texts: PMI = log(k N / (n d)) and the
    entity's information is log(N / n); the term discloses at PMI >= threshold * information
    and k >= min_contexts.
    """
    texts = distinct_texts(source, body)
    base = with_base_spans(texts, body)
    each = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["match"]).alias("entity"))) for k in KINDS))
    seen = base.where(F.size(each) > 0).select("text_key", body, F.explode(each).alias("x"))
    contexts = written(seen.select("text_key", F.col("x.entity").alias("entity"), _near(body, F.col("x.start"), F.col("x.end")).alias("context")).distinct())
    known = contexts.groupBy("entity").agg(F.countDistinct("text_key").alias("n")).where(F.col("n") >= min_contexts)
    terms = contexts.join(known, "entity").select("entity", "n", "text_key", F.explode(F.array_distinct(F.regexp_extract_all("context", F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    pairs = written(terms.groupBy("entity", "n", "term").agg(F.count("*").alias("k")).where(F.col("k") >= min_contexts))
    wanted = written(pairs.select("term").distinct())
    if wanted.isEmpty():
        return None
    held = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(TERM), F.lit(0)))).alias("term"))
    held = held.groupBy("term").agg(F.count("*").alias("d")).join(offered(wanted, 16 + F.octet_length("term")), "term")
    total = source.select(F.xxhash64(body).alias("text_key")).distinct().count()
    pmi = F.log(F.col("k") * float(total) / (F.col("n") * F.col("d")))
    information = F.log(F.lit(float(total)) / F.col("n"))
    return contexts.select("text_key", "entity").distinct(), pairs.join(held, "term").where((pmi > 0) & (pmi >= threshold * information)).select("entity", "term")


def personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_contexts: int = 3,
    threshold: float = 0.8,
) -> DataFrame:
    """One row for each document: (id, text sanitised, spans).

    spans: (start, number, end, kind) in code points, end exclusive, sorted by start and then
    kind in the order email, ip, card, phone, term. Base spans are whole matches; a term span
    is an occurrence, as a whole word in any case and outside base spans, of a term that
    discloses an entity of the same document. In the text base spans become <KIND>, terms with
    digits their shape (0 for digits) and other terms <TERM>; where base spans overlap, the one
    that starts first stands for both. Null texts count as empty. Null and repeated ids keep
    their rows. Other columns are not read; an empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    base = with_base_spans(source, "body")
    known = disclosing_terms(source, "body", min_contexts, threshold)
    none = F.array().cast(SPAN)
    if known is None:
        full = base.withColumn("term", none)
    else:
        # terms by (id, text), so that rows with null or repeated ids stay apart
        key = F.xxhash64("body")
        held = known[0].join(known[1], "entity")
        held = written(held.groupBy("text_key").agg(F.array_sort(F.collect_set("term")).alias("terms")))
        cost = 48 + F.aggregate("terms", F.lit(0), lambda a, t: a + 16 + F.octet_length(t))
        full = base.withColumn("text_key", key).join(offered(held, cost), "text_key", "left")
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.coalesce("terms", F.array(F.lit("x"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        full = with_matches(full.withColumn("pattern", pattern), "body", F.col("pattern"), "term__all", F.col("terms").isNotNull())
        others = F.concat(*KINDS)
        full = full.withColumn("base__all", others).withColumn("term", F.filter("term__all", lambda s: ~F.exists("base__all", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    spans = listed({k: k for k in [*KINDS, "term"]})
    full = full.withColumn("spans", spans)
    return full.select(F.col("id").alias(id_col), F.when(F.size("spans") > 0, sanitised("body", "spans")).otherwise(F.col("body")).alias(text_col), "spans")


def sanitised(body: str, spans: str) -> Column:
    """The text with each span replaced; spans that begin within an earlier one are part of it."""

    def step(acc: Column, s: Column) -> Column:
        own = F.substring(F.col(body), s["start"] + 1, s["end"] - s["start"])
        shape = F.regexp_replace(own, r"\p{N}", "0")
        new = F.when((s["kind"] == "term") & own.rlike(r"\p{N}"), shape).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        gap = F.substring(F.col(body), acc["at"] + 1, s["start"] - acc["at"])
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, new))).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(spans, start, step)
    return F.concat(F.array_join(done["parts"], ""), F.substring(F.col(body), done["at"] + 1, F.length(body)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["number"] < len(KINDS))
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
