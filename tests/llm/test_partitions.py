"""The prefix trie, clusters and shards against SQL, brute force and the laws they keep."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import clusters, linededup, shards, trie
from factlake.llm.clusters import Heaps, cluster_vectors
from factlake.llm.shards import shard_by_bytes
from factlake.llm.trie import prefix_trie

TURNS = "conv_id long, turn int, role string, text string"
VECTORS = "vec_id long, embedding array<double>"


def _same(frame, relation):
    names = sorted(frame.columns)
    at = [relation.columns.index(c) for c in names]
    assert sorted(relation.columns) == names
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in frame.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in relation.fetchall())))


@pytest.mark.parametrize("module, name, table", [(trie, "op11_prefix_trie", "conversations"), (clusters, "op12_clusters", "embeddings")])
def test_query_matches_its_sql(spark, sf_dir, module, name, table):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    _same(module.QUERIES[name](spark, sf_dir), duck.sql(module.SQL[name]))


def _nodes(rows):
    """The trie by plain loops over whole rebuilt conversations."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:])  # % as SQL has it, below 0 too
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in sorted(paths.items()):
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = {}
    for p in members:
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        key = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), kids[p], sum(not kids[q] for q in below), saved, sha)
        out[p] = key
    return sorted(map(repr, out.values()))


def _trie(spark, rows, schema=TURNS):
    found = prefix_trie(spark.createDataFrame(rows, schema))
    return sorted(repr((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in found.collect())


def test_trie_matches_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rng = random.Random(11)
    rows = []
    for c in [*range(60), *range(700, 720), -7, -5, -3]:
        for turn in range(rng.choice([0, 1, 2, 4, 7, 12])):
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", None, "bot"]), rng.choice(["", None, "a", "ü" * 5, "b"])))
    for c in range(200, 260):  # a large group of copies, and two long ones that part late
        rows += [(c, t, "user", f"same {t}") for t in range(3)]
    for c in (300, 1300, 2303):
        rows += [(c, t, "user", f"long {t if t < 14 else (t, c)}") for t in range(20)]
    rows += [(None, 0, "user", "no conversation"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    rows = [r for r in rows if sum(1 for x in rows if x[:2] == r[:2]) == 1 or r[0] in (None,) or r[3] == "again"]  # equal turns have no order of their own
    rows = [r for r in rows if r[0] != 7 or r[3] == "again"]
    rng.shuffle(rows)
    assert _trie(spark, rows) == _nodes(rows)


def test_trie_of_odd_tables(spark):
    assert _trie(spark, []) == []
    assert _trie(spark, [(None, 1, "user", "x")]) == []
    # turnless: all turns of 11 are replaced by those of 10, which is absent
    absent = next(c for c in range(11, 5_000, 5) if zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(absent, 0, "user", "x"), (absent, 1, "bot", "y" * 3_000_000)]
    assert _trie(spark, rows) == _nodes(rows)
    extra = spark.createDataFrame([(1, 0, "u", "t", "clash", 5)], f"{TURNS}, key string, n_convs long")
    assert {r.depth for r in prefix_trie(extra).collect()} >= {0}
    rows = [(5 * c, t, "user", f"{t}") for c in range(3) for t in range(40 + c)]  # deep, all shared
    assert _trie(spark, rows) == _nodes(rows)


def _lloyd(rows, k=8, rounds=10):
    kept = [(i, np.floor(np.array(v, float) * 1024).astype(int).tolist()) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes())
    centroids = [r[1] for r in sorted(kept, key=rank)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == n]
            if members:
                centroids[n] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, n, d, inertia[n], sum(inertia.values()), digest[n])) for i, d, n in last)


def _clusters(frame, **more):
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in cluster_vectors(frame, **more).collect())


def test_clusters_match_plain_lloyd(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 40)
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=64) * 0.2 + (i % 5)).tolist()) for i in range(150)]
    rows += [(1_000 + i, rng.integers(-1, 2, 64).astype(float).tolist()) for i in range(60)]  # ties
    rows += [(7, rows[3][1])] * 25 + [(2_000 + i, rows[4][1]) for i in range(25)]  # repeated rows, ids and vectors
    rows += [(None, rows[5][1]), (3_000, None), (3_001, [1.0] * 63), (3_002, [None] + [1.0] * 63), (3_003, [float("nan")] + [0.0] * 63), (3_004, [float("inf")] * 64), (3_005, [-0.0] * 64), (3_006, [])]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"cluster": F.lit("clash"), "block": F.lit(1)}).repartition(7)
    assert _clusters(frame) == _lloyd(rows)


def test_clusters_of_odd_tables(spark):
    assert _clusters(spark.createDataFrame([], VECTORS)) == []
    assert _clusters(spark.createDataFrame([(1, None), (2, [0.5])], VECTORS)) == []
    few = [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64)]
    assert _clusters(spark.createDataFrame(few, VECTORS)) == _lloyd(few)
    with pytest.raises(Exception, match="do not fit"):
        cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], VECTORS)).collect()


def test_only_expired_vectors_are_measured_again():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-50, 50, (300, 4)), rng.integers(950, 1_050, (300, 4)), [[500, 500, 500, 500]]]).astype(np.int64)
    centroids = np.array([[0, 0, 0, 0], [1_000, 1_000, 1_000, 1_000]])
    heaps = Heaps.new(vectors, centroids)
    drift = np.zeros(2)
    for step in range(1, 6):
        moved = centroids + np.array([[step] * 4, [0] * 4])
        length = np.sqrt(np.square(moved - centroids).sum(axis=1).astype(float))
        drift = drift + length + length[::-1]
        centroids = moved
        assert len(heaps.settle(vectors, centroids, drift)) <= 1  # only the vector in the middle
        assert (heaps.cluster == clusters._distances(vectors, centroids).argmin(axis=1)).all()


def _check_shards(rows, found, n):
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, s, zlib.crc32((t or "").encode())) for (i, t), s in zip(rows, sizes, strict=True))
    load, slots, spread = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        spread[r.text_crc32].add(r.shard)
    assert all(0 <= s < n for s in load)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share = sum(sizes) / n
    assert all(abs(load[s] - share) <= max(2 * shards.TOLERANCE * share, max(sizes)) for s in range(n))
    return load, spread


def test_shards_keep_their_law(spark, monkeypatch):
    monkeypatch.setattr(shards, "PIECE_ROWS", 37)
    rng = random.Random(13)
    rows = [(i, "".join(rng.choices("abü ", k=rng.choice([0, 5, 40, 200])))) for i in range(900)]
    rows += [(5_000 + i, "a hot text " * 4) for i in range(400)] + [(9, "one row many times")] * 300 + [(None, None), (None, "x"), (3, None), (4, "")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "piece": F.lit(1), "carry_0": F.lit(2)}).repartition(9)
    found = shard_by_bytes(frame, 8, carry=("h", "piece", "carry_0")).collect()
    load, spread = _check_shards(rows, found, 8)
    assert {(r.h, r.piece, r.carry_0) for r in found} == {("clash", 1, 2)}
    whole = [x for crc, x in spread.items() if crc not in {zlib.crc32(t) for t in (b"a hot text " * 4, b"one row many times", b"")}]
    assert max(map(len, whole)) <= 2 and sum(len(x) > 1 for x in whole) <= 7  # a text is parted only where a splitter must fall in it
    with pytest.raises(ValueError, match="named"):
        shard_by_bytes(frame, carry=("text", "size"))


def test_shards_follow_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(shards, "PIECE_ROWS", 50)
    rows = [(i, "x" * (i % 7) + str(i // 3)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = shard_by_bytes(frame, 6).select("*", F.xxhash64(F.encode(F.lit(""), "utf-8")).alias("_")).join(frame.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("h"), F.xxhash64("doc_id").alias("g")), "doc_id").collect()
    in_key_order = sorted(found, key=lambda r: (r.h, r.g))
    assert [(r.shard, r.slot) for r in in_key_order] == sorted((r.shard, r.slot) for r in found)


def test_shards_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert shard_by_bytes(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a" * 5_000_000), (2, "b"), (3, None)]
    _check_shards(rows, shard_by_bytes(spark.createDataFrame(rows, schema)).collect(), 40)


def test_op13_of_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = shards.op13_shards(spark, sf_dir)
    assert dict(found.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    _check_shards([(r.doc_id, r.text) for r in docs.collect()], found.collect(), 40)


def test_lines_whose_first_hashes_are_equal_keep_their_own_places():
    rng = np.random.default_rng(2)
    h1 = rng.integers(-(2**63), 2**63 - 1, 500)
    h1[10], h1[11], h1[499] = h1[0], h1[0], h1[1]
    h2 = rng.integers(-(2**63), 2**63 - 1, 500)
    shard = linededup.Shard(linededup.Shard.build(h1, h2, np.arange(500), np.full(500, 5)))
    found, keepers = shard.probe(h1, h2)
    assert found.all() and (keepers == np.arange(500)).all()
    assert not shard.probe(h1, h2 + 1)[0].any()
