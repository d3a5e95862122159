"""The prefix trie of conversations by truncation peeling.

A conversation is a path: for each turn a digest chained to the turns before, and the bytes of its
text. Conversations that are equal throughout are merged first. From the deepest level that two
different ones share, each level merges those that end there with the nodes that survive from the
level below, counts, strips the last turn and groups again by the parent; a node's numbers are sums
over its children, so nodes are counted while they are found. Deeper nodes have one path each and
are peeled where it lies. Texts are read once, for digests; they are never shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, shared_dir, sliced, table, written

#: Bytes of a digest and of a step of a path: digest, then the bytes of the text. Ids of one chunk of a list.
DIGEST, STEP, CHUNK_IDS = 16, 24, 512
#: Parents with more than this share of all nodes as children are joined by broadcast: at most as many as its inverse.
HOT_SHARE = 0.001
ROOT = bytes(DIGEST)

_NODE = "depth int, key binary, parent_key binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary"


def turns_of(conversations: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, turns) with turns as sorted (turn, digest, bytes); rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * DIGEST))
    one = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, head: int = 9) -> DataFrame:
    """(conv_id, turns) of conversations whose first h turns are those of conv_id - conv_id % family.

    h = crc32(conv_id) % head; fewer where that conversation has fewer, none where it is absent.
    """
    own = written(turns_of(conversations))
    first = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, head - 1).alias("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head)).cast("int")
    asked = own.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % family}).join(first, F.col("of") == F.col("base_id"), "left")
    start = F.coalesce(F.slice("base", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return asked.select("conv_id", F.concat(start, rest).alias("turns"))


def _paths(batches):
    """(conv_id, depth, key, path): digests chained turn by turn."""
    for batch in sliced(batches):
        depths, keys, paths = [], [], []
        for turns in batch.column(1).to_pylist():
            key, steps = ROOT, []
            for t in turns:
                key = hashlib.blake2b(key + t["digest"], digest_size=DIGEST).digest()
                steps.append(key + t["bytes"].to_bytes(8, "big"))
            depths.append(len(steps))
            keys.append(key)
            paths.append(b"".join(steps))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depths, pa.int32()), pa.array(keys, pa.binary()), pa.array(paths, pa.binary())], names=["conv_id", "depth", "key", "path"])


def _joined(batches):
    """Sorted chunks of ids as one row for each path, with the SHA-256 of all its ids."""

    def row(first, n, sha):
        return pa.RecordBatch.from_arrays(
            [pa.array([first["depth"]], pa.int32()), pa.array([first["key"]], pa.binary()), pa.array([first["path"]], pa.binary()), pa.array([first["least"]], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()], pa.string())],
            names=["depth", "key", "path", "conv_id", "n_convs", "ends_sha256"],
        )

    first, n, sha = None, 0, None
    for batch in sliced(batches, 500):
        for r in batch.to_pylist():
            if first is not None and r["key"] == first["key"]:
                sha.update(b",")
            else:
                if first is not None:
                    yield row(first, n, sha)
                first, n, sha = r, 0, hashlib.sha256()
            sha.update(r["ids"].encode())
            n += r["n"]
    if first is not None:
        yield row(first, n, sha)


def merged(paths: DataFrame) -> DataFrame:
    """(depth, key, path, conv_id, n_convs, ends_sha256): conversations that are equal throughout as one row.

    Ids are first joined in chunks of a bounded range, so a list of any length streams through.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunk = F.floor(F.col("conv_id") / CHUNK_IDS).alias("chunk")
    chunks = paths.groupBy("key", chunk).agg(ids.alias("ids"), F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("depth").alias("depth"), F.first("path").alias("path"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_joined, "depth int, key binary, path binary, conv_id long, n_convs long, ends_sha256 string")


def _alone(shared: int):
    """Nodes below the depth that different paths share: each path has its own, peeled from its end."""

    def alone(batches):
        for batch in sliced(batches, 500):
            out = []
            for r in batch.to_pylist():
                saved, path = 0, r["path"]
                for depth in range(r["depth"], shared, -1):
                    end = depth * STEP
                    saved += (r["n_convs"] - 1) * int.from_bytes(path[end - 8 : end], "big")
                    is_end = depth == r["depth"]
                    out.append(
                        {"depth": depth, "key": path[end - STEP : end - 8], "parent_key": path[end - 2 * STEP : end - STEP - 8] if depth > 1 else ROOT, "conv_id": r["conv_id"], "n_convs": r["n_convs"], "n_children": 0 if is_end else 1, "n_leaves": 1}
                        | {"saved_tokens": saved, "ends_sha256": r["ends_sha256"] if is_end else None, "path": path[:end] if depth == shared + 1 else None}
                    )
                    if len(out) >= 2_000:
                        yield pa.RecordBatch.from_pylist(out, _arrow())
                        out = []
            yield pa.RecordBatch.from_pylist(out, _arrow())

    return alone


def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in _NODE.split(", "))])


def _key(path: str, depth: int) -> Column:
    """The digest at that depth of a path."""
    return F.substring(path, (depth - 1) * STEP + 1, DIGEST) if depth else F.lit(ROOT)


def peeled(ends: DataFrame) -> DataFrame:
    """All nodes, as _NODE, from merged paths; a job for each level that different paths share."""
    spark = ends.sparkSession
    keys = F.posexplode(F.transform(F.sequence(F.lit(1), "depth"), lambda d: F.substring(F.col("path"), (d - 1) * STEP + 1, F.lit(DIGEST))))
    counts = ends.where("depth > 0").select(keys.alias("above", "key")).groupBy("key").agg(F.count("*").alias("n"), F.first("above").alias("above"))
    shared = (counts.where("n > 1").agg(F.max("above")).first()[0] or -1) + 1 if ends.where("depth > 0").limit(1).count() else 0
    level = written(ends.where(F.col("depth") > shared).mapInArrow(_alone(shared), _NODE))
    paths = [level.written_to]
    for depth in range(shared, -1, -1):
        below = level.where(F.col("depth") == depth + 1)
        strip = F.substring("path", 1, depth * STEP)
        up = below.select(_key("path", depth).alias("key"), strip.alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
        zero = F.lit(0).cast("long")
        new = ends.where(F.col("depth") == depth).select("key", "path", "conv_id", "n_convs", zero.alias("children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")
        sums = [F.sum(c).alias(c) for c in ("n_convs", "children", "n_leaves", "saved_tokens")]
        met = up.unionByName(new).groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.first("path").alias("path"))
        text = F.conv(F.hex(F.substring("path", depth * STEP - 7, 8)), 16, 10).cast("long") if depth else F.lit(0)
        saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * text
        parent = _key("path", depth - 1) if depth else F.lit(None).cast("binary")
        node = met.select(F.lit(depth).alias("depth"), "key", parent.alias("parent_key"), "conv_id", "n_convs", F.col("children").alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), "ends_sha256", "path")
        level = written(node)
        paths.append(level.written_to)
    return spark.read.schema(level.schema).parquet(*paths)


def prefix_trie(conversations: DataFrame, family: int = 5, head: int = 9) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by turn, null first, equal ones by a hash of role and text; null roles and
    texts are empty. Conversations are rebuilt as rebuilt() says; a node is a distinct sequence of
    first turns, the root has none. Rows without a conv_id are in no conversation, repeated rows
    are turns of their own. The digests of one conversation, 16 bytes a turn, are held in a task.
    A node is named by its smallest member. Other columns are not read; an empty table gives an
    empty one.
    """
    paths = written(rebuilt(conversations, family, head).mapInArrow(_paths, "conv_id long, depth int, key binary, path binary"))
    nodes = peeled(written(merged(paths)))
    out = nodes.drop("path")
    parents = out.select(F.col("key").alias("of"), F.col("conv_id").alias("of_conv"), "n_children")
    many = out.count() * HOT_SHARE
    hot = F.broadcast(parents.where(F.col("n_children") > many).select("of", "of_conv"))  # at most 1 / HOT_SHARE rows
    asked = out.join(hot, F.col("parent_key") == F.col("of"), "left").drop("of").withColumnRenamed("of_conv", "parent_conv_id")
    ready = asked.where("parent_conv_id IS NOT NULL OR depth = 0")
    rest = asked.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id")
    rest = rest.join(parents.where(F.col("n_children") <= many).select("of", F.col("of_conv").alias("parent_conv_id")), F.col("parent_key") == F.col("of"))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")]
    return ready.select(columns).unionByName(rest.select(columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, (a % 2) * 3988292384) END), 4294967295) % 9 AS h FROM t),
r AS MATERIALIZED (SELECT h.conv_id, coalesce(b.own[1:h.h], []) || h.own[h.h + 1:] AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS ends_at, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
q AS (SELECT conv_id, ends_at, depth, CASE WHEN depth = 0 THEN [] ELSE turns[1:depth] END AS node FROM p),
n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends_at = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(node[depth].text) END AS saved FROM q GROUP BY node, depth),
c AS (SELECT CASE WHEN depth = 1 THEN [] ELSE node[1:depth - 1] END AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children, unnest(range(0, depth + 1)) AS up FROM n LEFT JOIN c USING (node)),
s AS (SELECT CASE WHEN up = 0 THEN [] ELSE node[1:up] END AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY 1)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN c USING (node) LEFT JOIN n m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.node = CASE WHEN n.depth = 1 THEN [] ELSE n.node[1:n.depth - 1] END"""
}
