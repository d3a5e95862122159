"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Windows of ten item words are the patterns. A shift table over blocks of words says how far
the search can jump, buckets by the last block of a window select the windows to test, and
comparing the words confirms an occurrence. Items are split into blocks of bounded size; each
block is broadcast, so a larger benchmark takes more passes and no more memory.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, types, words, written

#: Words of an item that stand in one segment at most, and bytes of segments in one broadcast.
SEGMENT_WORDS, BLOCK_BYTES = 2_000, 2 << 20
FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"
FOUND_TYPES = {"n_words": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}


class Patterns:
    """Windows of one length, searched by Wu-Manber with blocks of up to three words."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(3, length)
        self.shifts: dict[tuple, int] = {}
        self.buckets: dict[tuple, list] = {}

    def add(self, window: tuple, item: str) -> None:
        n, b = self.length, self.block
        bucket = self.buckets.setdefault(window[n - b :], [])
        for known, items in bucket:
            if known == window:
                if item not in items:
                    items.append(item)
                return
        bucket.append((window, [item]))
        for i in range(n - b + 1):
            block, shift = window[i : i + b], n - b - i
            if shift < self.shifts.get(block, n):
                self.shifts[block] = shift

    def search(self, text: tuple):
        """(start, items) of every occurrence."""
        n, b = self.length, self.block
        skip, shift_of, buckets = n - b + 1, self.shifts.get, self.buckets
        end = n
        while end <= len(text):
            block = text[end - b : end]
            shift = shift_of(block, skip)
            if shift:
                end += shift
                continue
            start = end - n
            for window, items in buckets[block]:
                if text[start:end] == window:
                    yield start, items
            end += 1


def search_tables(segments: list[tuple[str, str]], window: int) -> list[Patterns]:
    """A search table for each length of window; a segment is (item, its words with one space)."""
    by_length: dict[int, Patterns] = {}
    for item, text in segments:
        own = tuple(words(text))
        n = min(window, len(own))
        if n:
            patterns = by_length.setdefault(n, Patterns(n))
            for i in range(len(own) - n + 1):
                patterns.add(own[i : i + n], item)
    return list(by_length.values())


def occurrences(text: str | None, tables: list[Patterns]) -> tuple[int, list[int], list[int], list[str]]:
    """Words of a text, the merged stretches that windows hit, and the items that occur."""
    own = tuple(words(text))
    hits, items = [], set()
    for patterns in tables:
        for start, found in patterns.search(own):
            hits.append((start, start + patterns.length))
            items.update(found)
    return len(own), *merged(hits), sorted(items)


def merged(hits: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for start, end in sorted(hits):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _segments(window: int):
    """Items as segments of bounded size that overlap so that every window is in one."""

    def split(batches):
        for batch in batches:
            out = {"item": [], "words": []}
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words(text)
                for i in range(0, max(1, len(own) - window + 1), SEGMENT_WORDS - window + 1):
                    if own:
                        out["item"].append(item)
                        out["words"].append(b" ".join(own[i : i + SEGMENT_WORDS]).decode())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.string()), ("words", pa.string())]))

    return split


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: (id, n_words, starts, ends, items, contaminated), and its columns of carry.

    starts and ends are the stretches of words that windows of benchmark items hit, items the
    ids of items with occurring windows, as sorted strings. Items shorter than the window are
    one window; items and documents that are null, empty or without words have none. Items
    with a null id hit under the name "null". Ids may be null or repeated: rows are judged
    one by one. Other columns are not read; an empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")), F.col(item_text_col).cast("string"))
    segments = written(items.mapInArrow(_segments(window), "item string, words string").distinct())
    size = segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    segments = segments.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"`{id_col}` {kind}", FOUND, *types(docs, carry)]

    def searched(block: int) -> DataFrame:
        rows = [tuple(r) for r in segments.where(F.col("block") == block).select("item", "words").collect()]
        shared = spark.sparkContext.broadcast(rows)

        def search(batches):
            tables = search_tables(shared.value, window)
            for batch in sliced(batches):
                found = [occurrences(t, tables) for t in batch.column(1).to_pylist()]
                columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(FOUND_TYPES.values())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], names=[id_col, *FOUND_TYPES, *batch.schema.names[2:]])

        source = docs.select(id_col, F.col(text_col).alias("searched"), *carry)
        if n_blocks == 1:
            return source.mapInArrow(search, ", ".join(names))
        source = source.withColumn("text_key", F.xxhash64("searched"))
        return source.mapInArrow(search, ", ".join([*names, "text_key long"]))

    found = searched(0)
    if n_blocks > 1:
        for block in range(1, n_blocks):
            found = found.unionByName(searched(block))
        found = _joined(found, id_col, n_blocks, carry)
    return found.withColumn("contaminated", F.size("starts") > 0)


def _joined(found: DataFrame, id_col: str, n_blocks: int, carry: tuple[str, ...]) -> DataFrame:
    """The passes of all blocks as one row again; equal rows stay as many as they were."""

    def join(batches):
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("all_starts", "all_ends", "all_items")}
            hits = [merged([h for s, e in zip(a, b, strict=True) for h in zip(s, e, strict=True)]) for a, b in zip(columns["all_starts"], columns["all_ends"], strict=True)]
            items = [sorted({x for part in parts for x in part}) for parts in columns["all_items"]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("n_words"), pa.array([h[0] for h in hits], pa.list_(pa.int32())), pa.array([h[1] for h in hits], pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), *(batch.column(c) for c in carry), batch.column("rows")],
                names=[id_col, *FOUND_TYPES, *carry, "rows"],
            )

    grouped = found.groupBy(id_col, *carry, "text_key", "n_words").agg(
        F.collect_set("starts").alias("s0"), F.collect_set(F.struct("starts", "ends")).alias("spans"), F.collect_set("items").alias("all_items"), (F.count("*") / n_blocks).cast("int").alias("rows")
    )
    grouped = grouped.select(id_col, "n_words", F.col("spans.starts").alias("all_starts"), F.col("spans.ends").alias("all_ends"), "all_items", *carry, "rows")
    kind = found.schema[id_col].dataType.simpleString()
    out = grouped.mapInArrow(join, ", ".join([f"`{id_col}` {kind}, {FOUND}", *types(found, carry), "rows int"]))
    return out.withColumn("rows", F.explode(F.array_repeat(F.lit(1), F.col("rows")))).drop("rows")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op1_decontamination": op1_decontamination}
SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw),
lengths AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
dk AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw),
hits AS (SELECT doc_id, i, n, item_id FROM dk JOIN windows USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
}
