"""Sharding by histogram sort: near-equal bytes, in the order of a key, with one exchange.

Rows are ordered by a unique key: a hash of the text, a hash of the id, and the row's number, which
only separates equal rows. A probe is a key; each round counts the exact bytes and rows between
probes over all partitions, and the driver keeps, for every splitter, the two probes around its
place. New probes go between the least and greatest keys there, first by text hash, so that rows
with equal texts stay together where that costs no more than the tolerance, then by id, then by
row. When all splitters are met, rows are exchanged once, by pieces of shards.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, types, written

#: Share of a shard (of a piece) by which a splitter may miss its place, and probes for each open splitter in a round.
TOLERANCE, PIECE_TOLERANCE, PROBES = 0.005, 0.2, 10
#: Rows of a piece; shards of more rows are several pieces.
PIECE_ROWS = 200_000

Key = tuple[int, int, int]
LEAST: Key = (-(2**63), -(2**63), -1)
GREATEST: Key = (2**63 - 1, 2**63 - 1, 2**63 - 1)


class Edge(NamedTuple):
    """A key, with the bytes and rows below it."""

    key: Key
    bytes: int
    rows: int


class Target(NamedTuple):
    """What a splitter is to have below it: so much of a measure ('bytes' or 'rows'), or as near as tolerance."""

    measure: str
    aim: float
    tolerance: float


class Bracket(NamedTuple):
    """The edges around a splitter's place, and the least and greatest key between them."""

    low: Edge
    high: Edge
    least: Key
    greatest: Key


def _below(probes: list[Key], h: np.ndarray, g: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each key the number of probes, sorted, at or below it."""
    first = np.array([p[0] for p in probes], np.int64)
    at = np.searchsorted(first, h, "left")
    for value in np.intersect1d(first, h).tolist():  # keys that begin as some probe does
        own = np.flatnonzero(h == value)
        for _, pg, prow in probes[np.searchsorted(first, value, "left") : np.searchsorted(first, value, "right")]:
            at[own] += (g[own] > pg) | ((g[own] == pg) & (row[own] >= prow))
    return at


def histogram(keys: DataFrame, probes: list[Key]) -> dict[int, tuple[int, int, Key, Key]]:
    """Exact (bytes, rows, least key, greatest key) between neighbouring sorted probes, by the number of probes below."""

    def intervals(batches):
        for batch in batches:
            h, g, row, size = batch.columns
            at = _below(probes, h.to_numpy(), g.to_numpy(), row.to_numpy())
            yield pa.RecordBatch.from_arrays([h, g, row, size, pa.array(at, pa.int64())], names=["h", "g", "row", "size", "at"])

    key = F.struct("h", "g", "row")
    rows = keys.select("h", "g", "row", "size").mapInArrow(intervals, "h long, g long, row long, size long, at long")
    found = rows.groupBy("at").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"))
    return {r["at"]: (r["bytes"], r["rows"], tuple(r["least"]), tuple(r["greatest"])) for r in found.collect()}


def _probes(b: Bracket, target: Target) -> set[Key]:
    """Probes inside a bracket: around the place that its sums suggest, and evenly between its keys.

    All are above the least key and at most the greatest, so each of them parts the rows.
    """
    level = next(i for i in range(3) if b.least[i] != b.greatest[i])
    low, high = b.least[level], b.greatest[level]
    start, end = getattr(b.low, target.measure), getattr(b.high, target.measure)
    guess = low + int((high - low) * (target.aim - start) / (end - start))
    near = max(1, (high - low) // (8 * PROBES))
    places = {guess + step * near for step in range(-2, 3)} | {low + (high - low) * i // (PROBES - 5) for i in range(1, PROBES - 4)}
    return {(*b.least[:level], min(max(p, low + 1), high), *LEAST[level + 1 :]) for p in places}


def splitters(keys: DataFrame, targets: list[Target]) -> list[Edge]:
    """An edge for each target, with about its aim below.

    An edge within the tolerance is taken; edges between texts are looked for before those inside
    a group of equal ones. Where a single row reaches over the tolerance on both sides, its nearer
    side is taken. Every round parts the rows of each open bracket, so rounds end.
    """
    met: dict[int, Edge] = {}
    probes = [LEAST, GREATEST]
    waiting = dict(enumerate(targets))
    while waiting:
        counted = histogram(keys, probes)
        edges, sums = [], (0, 0)
        for i, probe in enumerate(probes):
            here = counted.get(i, (0, 0))
            sums = (sums[0] + here[0], sums[1] + here[1])
            edges.append(Edge(probe, *sums))
        below = {m: [getattr(e, m) for e in edges] for m in ("bytes", "rows")}
        asked: set[Key] = set()
        for i, target in list(waiting.items()):
            at = bisect_right(below[target.measure], target.aim)
            low, high = edges[at - 1], edges[at]
            far = lambda e: abs(getattr(e, target.measure) - target.aim)  # noqa: E731, B023
            nearest = min(low, high, key=far)
            if far(nearest) <= target.tolerance or high.rows - low.rows <= 1:
                met[i] = nearest
                del waiting[i]
            else:
                asked |= {low.key, high.key} | _probes(Bracket(low, high, *counted[at][2:]), target)
        probes = sorted(asked)
    return [met[i] for i in range(len(targets))]


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    overhead: int = 16,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: (id, size, text_crc32, shard, slot, *carry); shards hold nearly the same bytes.

    A document's size is the UTF-8 bytes of its text, none for null, plus overhead. Shards are
    consecutive in the order of the key, so each differs from an equal share by at most twice the
    tolerance (a share of it), or by the documents at its ends where these are longer; shards are
    empty where there are fewer documents than shards or one document is longer than a share.
    Slots number a shard's rows from 0 without gaps. Null texts are empty; null and repeated ids
    and repeated rows keep their rows. Columns in carry pass unchanged, whatever their names but
    those of the result; others are not read. An empty table gives an empty one.
    """
    made = [id_col, "size", "text_crc32", "shard", "slot"]
    if set(carry) & set(made):
        raise ValueError(f"carried columns may not be named as the result's: {sorted(set(carry) & set(made))}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + overhead).cast("long")
    held = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    base = written(docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col)).alias("g"), F.monotonically_increasing_id().alias("row"), size.alias("size"), F.crc32(text).alias("crc"), F.col(id_col).alias("id"), *held))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    share, pieces = total["bytes"] / shards, -(-total["rows"] // PIECE_ROWS)
    targets = [Target("bytes", share * i, tolerance * share) for i in range(1, shards)]
    targets += [Target("rows", total["rows"] * i / pieces, PIECE_TOLERANCE * PIECE_ROWS) for i in range(1, pieces)]
    found = splitters(base, targets if total["rows"] else [])
    cuts = sorted(found[: shards - 1])
    starts = sorted({Edge(LEAST, 0, 0), *found})
    shard_of = [bisect_right(cuts, e) for e in starts]
    first_row = [([Edge(LEAST, 0, 0), *cuts][s]).rows for s in shard_of]
    kinds = ["h long", "g long", "row long", "size long", "crc long", *types(base, ("id", *(f"carry_{i}" for i in range(len(carry))))), "piece int", "shard int", "before long"]

    def pieces_of(batches):
        of, before = np.array(shard_of, np.int32), np.array([e.rows - f for e, f in zip(starts, first_row, strict=True)], np.int64)
        for batch in batches:
            piece = _below([e.key for e in starts], *(batch.column(i).to_numpy() for i in range(3))) - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece, pa.int32()), pa.array(of[piece]), pa.array(before[piece])], names=[*batch.schema.names, "piece", "shard", "before"])

    place = F.row_number().over(W.partitionBy("piece").orderBy("h", "g", "row")) - 1
    out = base.mapInArrow(pieces_of, ", ".join(kinds)).withColumn("slot", F.col("before") + place)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_by_bytes(table(spark, sf_dir, "documents"))
    return dealt.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {"op13_shards": op13_shards}
#: Which edges splitters end at depends on the probes; tests hold the result against the law and a plain sort.
SQL: dict[str, str] = {}
