"""Positions of pattern matches by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


def with_matches(df: DataFrame, text_col: str, pattern: str | Column, name: str, when: Column | None = None) -> DataFrame:
    """Adds array `name` of structs (start, end, match): leftmost non-overlapping matches.

    Places are in code points, the end exclusive. What lies between matches comes from split()
    and the matches from regexp_extract_all(); their lengths add up to the places. Patterns
    must not match empty strings, and text_col must not be null. `when`: rows to search.
    """
    hits, gaps = f"{name}__hits", f"{name}__gaps"
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text_col, pattern, F.lit(0))
    df = df.withColumn(hits, found if when is None else F.when(when, found).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.slice(F.split(text_col, pattern, -1), 1, F.size(hits))))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("spans"))

    pairs = F.zip_with(gaps, hits, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    none = F.array().cast(SPAN)
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return df.withColumn(name, F.when(F.size(hits) > 0, spans).otherwise(none)).drop(hits, gaps)


def listed(kinds: dict[str, Column | str]) -> Column:
    """All spans of several kinds as structs (start, kind number, end, kind), sorted."""

    def of(number: int, kind: str, spans) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(of(i, k, s) for i, (k, s) in enumerate(kinds.items()))))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
