"""Line dedup with a sharded minimal perfect hash over hashes of lines.

Hashes of lines that enough documents hold are dealt into shards; each shard is a minimal
perfect hash (levels of bits with ranks) over compact arrays of fingerprints, counts and the
document that keeps the line. Documents probe the arrays; lines are never joined. While all
shards fit in a stated number of bytes they are broadcast; beyond that hashes travel to shards.
"""

from __future__ import annotations

import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, written

BLANK = " \t\n\x0b\x0c\r"
#: Hashes in one shard on average, and bytes of all shards up to which they are broadcast.
SHARD_KEYS, BROADCAST_BYTES = 50_000, 64 << 20
BYTES_PER_KEY, LEVELS, SALTS = 24, 64, 16


def line_key(line: str, min_chars: int) -> tuple[int, int] | None:
    """Two signed 64-bit hashes of a line's key; None where the key is short."""
    key = line.strip(BLANK)
    if len(key) < min_chars:
        return None
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key.encode().lower()))


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Well-mixed 64-bit values of the keys, others for each level."""
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _seeded(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit values that a perfect hash is built on: first hashes, or for another seed a mix of both."""
    key = h1.view(np.uint64)
    return key if seed == 0 else _mixed(key + _mixed(h2.view(np.uint64), seed), seed)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: each key has its own number below n.

    A level has a bit for each place; keys that hash to a place alone set its bit, the rest go
    to the next level. A key's number is the count of bits before its own. Other keys may get
    a number too, so what it leads to holds a fingerprint.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(total + ones - bits)
            total += int(ones[-1]) if len(ones) else 0
        self.n = total

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            if len(levels) >= LEVELS:
                raise ValueError("keys are not distinct")
            size = 2 * len(rest) + 1
            at = (_mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where no level has the key's bit."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(rest):
                break
            at = (_mixed(keys[rest], level) % np.uint64(len(bits))).astype(np.int64)
            set_here = bits[at]
            out[rest[set_here]] = self.ranks[level][at[set_here]]
            rest = rest[~set_here]
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<i", len(self.levels))]
        for bits in self.levels:
            parts += [struct.pack("<q", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        n, at, levels = struct.unpack_from("<i", data)[0], 4, []
        for _ in range(n):
            size = struct.unpack_from("<q", data, at)[0]
            at += 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels), at


class Shard:
    """A perfect hash with the arrays that its numbers index."""

    def __init__(self, data: bytes):
        self.seed = data[0]
        self.hash, at = PerfectHash.from_bytes(data[1:])
        data, n = data[1:], self.hash.n
        self.prints = np.frombuffer(data, np.uint64, n, at)
        self.keepers = np.frombuffer(data, np.int64, n, at + 8 * n)
        self.counts = np.frombuffer(data, np.int32, n, at + 16 * n)

    @staticmethod
    def build(h1: np.ndarray, h2: np.ndarray, keepers: np.ndarray, counts: np.ndarray) -> bytes:
        """The shard of distinct pairs of hashes; where first hashes are equal, the next seed takes both."""
        seed = next(s for s in range(256) if len(np.unique(_seeded(h1, h2, s))) == len(h1))
        keys = _seeded(h1, h2, seed)
        own = PerfectHash.of(keys)
        order = np.argsort(own.find(keys))
        return b"".join([bytes([seed]), own.to_bytes(), h2.view(np.uint64)[order].tobytes(), keepers[order].tobytes(), np.minimum(counts[order], 2**31 - 1).astype(np.int32).tobytes()])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is indexed, and the document that keeps it."""
        at = self.hash.find(_seeded(h1, h2, self.seed))
        found = at >= 0
        found[found] = self.prints[at[found]] == h2.view(np.uint64)[found]
        return found, np.where(found, self.keepers[np.maximum(at, 0)] if self.hash.n else 0, 0)


def _hashes(min_chars: int):
    """Distinct keys of each document as hashes; without the texts."""

    def hashes(batches):
        for batch in sliced(batches):
            out = ([], [], [])
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key in {k for line in (text or "").split("\n") if (k := line_key(line, min_chars))}:
                    out[0].append(key[0])
                    out[1].append(key[1])
                    out[2].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["h1", "h2", "doc"])

    return hashes


def _build(rows: pa.Table) -> pa.Table:
    h1, h2, keeper, n = (rows.column(c).to_numpy() for c in ("h1", "h2", "keeper", "n"))
    return pa.table({"shard": [rows.column("shard")[0].as_py()], "data": [Shard.build(h1, h2, keeper, n)]}, pa.schema([("shard", pa.int64()), ("data", pa.binary())]))


def _assemble(n_carried: int, names: list[str], dropped_of):
    """Documents without the lines that dropped_of(ids, lines, extra) names; carried columns pass."""

    def assemble(batches):
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lines = [(t or "").split("\n") for t in texts]
            dropped = dropped_of(ids, lines, batch.columns[2 + n_carried :])
            kept = ["\n".join(x for i, x in enumerate(own) if i not in gone) if gone else t or "" for t, own, gone in zip(texts, lines, dropped, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), *batch.columns[2 : 2 + n_carried], pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in dropped], pa.int64())],
                names=names,
            )

    return assemble


def _probing(shards, n_shards: int, min_chars: int):
    """dropped_of() over broadcast shards: all lines of a batch are probed at once."""
    ready: list[dict] = []

    def dropped_of(ids, lines, _):
        if not ready:
            ready.append({s: Shard(d) for s, d in shards.value})
        rows, numbers, h1, h2 = [], [], [], []
        for r, own in enumerate(lines):
            for i, line in enumerate(own):
                if key := line_key(line, min_chars):
                    rows.append(r)
                    numbers.append(i)
                    h1.append(key[0])
                    h2.append(key[1])
        dropped: list[set] = [set() for _ in lines]
        h1, h2 = np.array(h1, np.int64), np.array(h2, np.int64)
        shard_of = np.mod(h1, n_shards)
        for s in np.unique(shard_of):
            if s in ready[0]:
                own = np.flatnonzero(shard_of == s)
                found, keepers = ready[0][s].probe(h1[own], h2[own])
                for k, keeper in zip(own[found].tolist(), keepers[found].tolist(), strict=True):
                    if ids[rows[k]] != keeper:
                        dropped[rows[k]].add(numbers[k])
        return dropped

    return dropped_of


def deduplicate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: (id, text without dropped lines, *carry, n_lines, n_dropped).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at
    least min_chars code points in at least min_docs documents lose their lines except in the
    largest id holding them. Null texts are one empty line, as empty ones are. Each row is a
    document of its own: repeated ids count again, and all rows of the largest id keep the
    line. Null ids count as documents but never keep a line that another id holds; lines that
    only null ids hold stay. Ids are 64-bit integers; columns in carry pass unchanged, others
    are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), *carry)
    hashes = source.select(id_col, text_col).mapInArrow(_hashes(min_chars), "h1 long, h2 long, doc long")
    counted = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    frequent = written(counted.where((F.col("n") >= min_docs) & F.col("keeper").isNotNull()))
    total = frequent.count()
    n_shards = max(1, -(-total // SHARD_KEYS))
    sharded = frequent.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    index = sharded.groupBy("shard").applyInArrow(_build, "shard long, data binary")
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    out = ", ".join([f"`{id_col}` long", f"`{text_col}` string", *kinds, "n_lines long", "n_dropped long"])
    names = [id_col, text_col, *carry, "n_lines", "n_dropped"]
    if total * BYTES_PER_KEY <= broadcast_bytes:
        shards = spark.sparkContext.broadcast([(r["shard"], bytes(r["data"])) for r in index.collect()])
        return source.mapInArrow(_assemble(len(carry), names, _probing(shards, n_shards, min_chars)), out)
    keyed = source.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("text_key"))
    dropped = _routed(keyed, index, n_shards, min_chars)
    joined = source.join(dropped, F.col(id_col).eqNullSafe(F.col("doc")) & (F.xxhash64(text_col) == F.col("doc_text_key")), "left")
    of_column = _assemble(len(carry), names, lambda ids, lines, extra: [set(x or ()) for x in extra[0].to_pylist()])
    return joined.select(id_col, text_col, *carry, "dropped").mapInArrow(of_column, out)


def _routed(keyed: DataFrame, index: DataFrame, n_shards: int, min_chars: int) -> DataFrame:
    """Numbers of dropped lines by document where the index is too large to broadcast.

    Hashes of lines go to their shard, a hot line's over SALTS copies of it; the shard comes
    first in its partition and the hashes stream past it.
    """

    def lines(batches):
        for batch in sliced(batches):
            out = ([], [], [], [], [])
            for doc, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, line in enumerate((text or "").split("\n")):
                    if h := line_key(line, min_chars):
                        for column, value in zip(out, (doc, key, i, *h), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc", "doc_text_key", "line", "h1", "h2"])

    probes = keyed.mapInArrow(lines, "doc long, doc_text_key long, line long, h1 long, h2 long")
    probes = probes.withColumns({"shard": F.pmod("h1", F.lit(n_shards)), "salt": F.pmod(F.xxhash64("doc", "doc_text_key"), F.lit(SALTS).cast("long")), "first": F.lit(1)})
    shards = index.withColumns({"salt": F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")), "first": F.lit(0)})
    both = shards.unionByName(probes, allowMissingColumns=True)
    both = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "first")

    def probe(batches):
        here, shard = None, None
        for batch in batches:
            of = batch.column("shard").to_numpy() * SALTS + batch.column("salt").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for at, end in pairwise(edges):
                own = batch.slice(at, end - at)
                is_line = own.column("first").to_numpy() == 1
                if len(is_line) and not is_line[0]:
                    here, shard = of[at], Shard(own.column("data")[0].as_py())
                if here != of[at] or not is_line.any():
                    continue
                lines = own.select(["doc", "doc_text_key", "line", "h1", "h2"]).filter(pa.array(is_line))
                found, keepers = shard.probe(lines.column("h1").to_numpy(), lines.column("h2").to_numpy())
                gone = [f and d != k for f, d, k in zip(found.tolist(), lines.column("doc").to_pylist(), keepers.tolist(), strict=True)]
                yield lines.select(["doc", "doc_text_key", "line"]).filter(pa.array(gone, pa.bool_()))

    found = both.select("shard", "salt", "first", "data", "doc", "doc_text_key", "line", "h1", "h2").mapInArrow(probe, "doc long, doc_text_key long, line long")
    return found.groupBy("doc", "doc_text_key").agg(F.collect_set("line").alias("dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicate_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {
    "op2_line_dedup": r"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
x AS (SELECT r, doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM l),
k AS (SELECT r, doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT k.*, f.keeper IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id"""
}
