"""Embedding near-dedup by lattice hashing: E8 cells of random projections, probed and verified.

Each table projects unit vectors to eight dimensions, or to several times eight, and decodes each
eight to the nearest point of the E8 lattice. A vector stands in its own cell and probes the
neighbouring cells nearest to it. How fine cells are, and how many tables it takes to find a
stated share of the pairs at the threshold, follows from the number of vectors by one formula: the
least expected work, so the share of pairs that meet falls as the vectors become more. In each cell signs of random projections, sixteen bytes a vector, rule most pairs out;
vectors go only to cells where they have a partner left, and pairs are compared there by
cosine in double precision.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product
from math import acos, ceil, comb, log, log1p, pi
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, groups, offered, table, whole_groups, written

#: Cells of a vector in each table, its own and probes.
CELLS = 4
#: Share of the pairs at the threshold that meet in a table at least, sizes of unit vectors in the lattice and lattices of a cell to choose from.
RECALL, SCALES, DEPTHS = 0.997, (2.0, 2.5, 3.0, 3.5), (1, 2, 3)
#: Random pairs of which one probes the other's cell, for cells of one lattice at scale 2.5, and how they fall with the scale.
MEET, FALL = 2.5e-4, 7.6
#: What it costs to send a vector to a cell, in comparisons of signs there.
CELL_COST = 8
#: Signs of a vector, and the probability that a pair at the threshold differs in more than are allowed.
SIGNS, MISSED_BY_SIGNS = 128, 1e-10
#: Tables that are still worth their memory.
MOST_TABLES = 400
#: Members of a cell that one block compares at about most.
BLOCK = 1_024


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring cells."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(v) / 2 for v in product((1.0, -1.0), repeat=8) if np.prod(v) > 0]
    return np.array(found)


class Lattice(NamedTuple):
    """Tables of cells, the size of unit vectors in them, and the lattices that a cell is made of."""

    tables: int
    scale: float
    depth: int


@cache
def meeting(scale: float, depth: int, least: float, dim: int) -> float:
    """The share of pairs at the threshold that meet in one table, from pairs of a fixed seed."""
    rng, n, tables = np.random.default_rng(8_242), 1_000, 4
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = least * a + np.sqrt(1 - least**2) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    x, y = (cells(v, Lattice(tables, scale, depth)) for v in (a, b))
    return float(((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean())


@cache
def lattice_for(vectors: int, least: float, dim: int) -> Lattice:
    """The lattice with the least expected work for so many vectors that finds RECALL of the pairs at the threshold.

    Work is tables times the cells and the random vectors that a vector meets in one. dim: the
    vectors' length, with 64 as another, the harder of the two counts.
    """
    found = []
    for depth, scale in product(DEPTHS, SCALES):
        p = min(meeting(scale, depth, least, d) for d in {max(dim, 2), 64})
        if p > 0:
            tables = 1 if p >= RECALL else ceil(log(1 - RECALL) / log1p(-p))
            q = MEET * (2.5 / scale) ** FALL
            found.append((tables * (CELLS * CELL_COST + vectors * q * (q / CELLS) ** (depth - 1)), Lattice(tables, scale, depth)))
    if not found or min(found)[1].tables > MOST_TABLES:
        raise ValueError(f"pairs at a cosine of {least} are too far apart for lattice cells")
    return min(found)[1]


@cache
def most_different(least: float) -> int:
    """Signs that may differ: at the threshold more do with a probability of MISSED_BY_SIGNS at most."""
    p, tail, k = acos(max(-1.0, min(1.0, least))) / pi, 0.0, SIGNS
    while k > 0 and (tail := tail + comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)) <= MISSED_BY_SIGNS:
        k -= 1
    return k


@cache
def projections(dim: int, tables: int, scale: float, depth: int) -> list[np.ndarray]:
    """A dim x 8 depth matrix for each table, with orthogonal columns where dim allows."""
    rng, wide = np.random.default_rng(8_240), 8 * depth
    raw = [rng.standard_normal((max(dim, wide), wide)) for _ in range(tables)]
    return [np.linalg.qr(r)[0][:dim] * np.sqrt(max(dim, wide) / 8) * scale for r in raw]


@cache
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(8_241).standard_normal((dim, SIGNS))


def signs(unit: np.ndarray) -> np.ndarray:
    """A bit for the side of each random plane that a vector lies on, packed."""
    return np.packbits(unit @ directions(unit.shape[1]) > 0, axis=1)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    error = x - near
    worst = np.abs(error).argmax(1)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    near[odd, worst[odd]] += np.where(error[odd, worst[odd]] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 shifted by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def _codes(points: np.ndarray) -> np.ndarray:
    """A 64-bit code of each lattice point."""
    code = np.zeros(points.shape[:-1], np.uint64)
    for k in range(8):
        code = (code ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def _joined(codes: np.ndarray) -> np.ndarray:
    """One code for the codes of the lattices of a cell, along the last axis."""
    out = np.zeros(codes.shape[:-1], np.uint64)
    for k in range(codes.shape[-1]):
        out = (out ^ codes[..., k].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def cells(unit: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Codes (vectors, tables, CELLS): each vector's own cell, then the nearest of those with a neighbour in one lattice."""
    n, depth = len(unit), lattice.depth
    out, every = np.empty((n, lattice.tables, CELLS), np.int64), np.arange(n)
    for t, p in enumerate(projections(unit.shape[1], *lattice)):
        x = (unit @ p).reshape(n, depth, 8)
        own = decode(x.reshape(-1, 8)).reshape(n, depth, 8)
        codes = np.ascontiguousarray(_codes(own))
        nearest = np.argpartition(((own - x) @ roots().T).reshape(n, -1), CELLS - 1, axis=1)[:, : CELLS - 1]
        out[:, t, 0] = _joined(codes)
        for k in range(CELLS - 1):
            which, step = np.divmod(nearest[:, k], len(roots()))
            other = codes.copy()
            other[every, which] = _codes(own[every, which] + roots()[step])
            out[:, t, k + 1] = _joined(other)
        out[:, t] ^= np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF).astype(np.int64)
    return out


def unit_vectors(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_in_cell(number: int, rep, n, unit, codes, left, right, at_home, least: float):
    """(rep, partner that stands for its links here, links first found here) of linked members.

    left members are at home in the cell, right ones at home or probing; codes are 0 for cells
    where a member has no partner. A pair counts in the first table where it meets, and there
    in one cell only.
    """
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    pairs = []
    for start in range(0, len(lefts), 256):
        some = lefts[start : start + 256]
        i, j = np.nonzero(unit[some] @ unit[rights].T >= least)
        i, j = some[i], rights[j]
        i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
        if not len(i):
            continue
        pairs.append((i, j))
        of_i, of_j = (((codes[a, :, :1] == codes[b]) & (codes[b] != 0)).any(2) for a, b in ((i, j), (j, i)))
        here = (of_i | of_j).argmax(1) == number
        both_probe = of_i[:, number] & of_j[:, number] & ~at_home[j]
        here &= ~both_probe | (codes[i, number, 0] < codes[j, number, 0])
        i, j = i[here], j[here]
        np.add.at(links, i, n[j])
        guest = ~at_home[j]
        np.add.at(links, j[guest], n[i[guest]])
    if not pairs:
        return
    i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(rep, kind="stable")
    rank = np.empty(len(rep), np.int64)
    rank[order] = root
    low = rank.copy()
    while True:
        before = low.copy()
        least_of = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least_of)
        np.minimum.at(low, j, least_of)
        low = low[order[low]]
        if (low == before).all():
            break
    for k in np.unique(np.concatenate([i, j])).tolist():
        yield int(rep[k]), int(rep[order[low[k]]]), int(links[k])


def _screened(left, right, rep, sign, group, most: int) -> np.ndarray:
    """Which members have a partner in their group that signs don't rule out; groups are consecutive."""
    held = np.zeros(len(rep), bool)
    size = np.bincount(group)
    small = size[group] <= 64
    for d in range(1, int(size[size <= 64].max(initial=1))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        j = i + d
        meets = ((left[i] & right[j]) | (left[j] & right[i])) & (rep[i] != rep[j])
        i, j = i[meets], j[meets]
        near = np.bitwise_count(sign[i] ^ sign[j]).sum(1) <= most
        held[i[near]] = held[j[near]] = True
    for g in np.flatnonzero(size > 64):
        own = np.flatnonzero(group == g)
        rights = own[right[own]]
        for i in own[left[own]].tolist():
            near = rights[(np.bitwise_count(sign[rights] ^ sign[i]).sum(1) <= most) & (rep[rights] != rep[i])]
            if len(near):
                held[i] = held[near] = True
    return held


def _in_blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows (place, rep, at_home, ...) with (p, q, is_left, is_right); members of large places are dealt into pairs of blocks."""
    rows = rows.join(offered(large, 32), "place", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    every, own, at_home = F.sequence(F.lit(0), F.col("g") - 1), F.col("own"), F.col("at_home")
    block = lambda p, q, is_left, is_right: F.struct(p.alias("p"), q.alias("q"), is_left.alias("is_left"), is_right.alias("is_right"))
    as_left = F.transform(F.filter(every, lambda _: at_home), lambda q: block(own, q, F.lit(True), q == own))
    as_right = F.transform(F.filter(every, lambda p: ~at_home | (p != own)), lambda p: block(p, own, F.lit(False), F.lit(True)))
    dealt = rows.withColumn("block", F.explode(F.concat(as_left, as_right))).drop("g", "own").select("*", "block.*").drop("block")
    return dealt.repartition("place", "p", "q").sortWithinPartitions("place", "p", "q")


def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row for each vector: (id, n_links, component_id).

    Vectors with equal, non-null labels and equal lengths link at cosine >= least. Equal
    vectors are one class that is hashed once; its members link with each other and with all
    members of linked classes. Vectors that are null, empty or zero or hold null or non-finite
    components link with nothing and are their own component; so do those with a null id,
    whose component is null. Repeated ids are vectors of their own. Other columns are not read.
    The lattice and the screen by signs follow from least and from the number of vectors; a least
    for which no lattice will do raises an error.
    """
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    source = source.withColumn("good", F.coalesce(good & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    classes = written(source.where("good").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.min(F.size("v")), F.lit(64)).alias("dim")).first()
    lattice, most = lattice_for(size["n"], least, size["dim"]), most_different(least)

    def hashed(batches):
        for batch in batches:
            values = batch.column("v").to_pylist()
            codes, sign = [None] * len(values), [None] * len(values)
            for dim in {len(v) for v in values}:
                own = [k for k, v in enumerate(values) if len(v) == dim]
                unit = unit_vectors([values[k] for k in own])
                for k, c, b in zip(own, cells(unit, lattice).reshape(len(own), -1), signs(unit), strict=True):
                    codes[k], sign[k] = c.tolist(), b.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64())), pa.array(sign, pa.binary())], names=[*batch.schema.names, "codes", "sign"])

    kind = classes.schema["label"].dataType.simpleString()
    with_codes = lambda df: df.mapInArrow(hashed, f"label {kind}, v array<{number}>, rep long, n long, codes array<long>, sign binary")
    places_of = F.transform("codes", lambda c: F.xxhash64("label", F.size("v"), c))
    placed = with_codes(classes).select("rep", "sign", F.posexplode(places_of).alias("at", "place"))
    placed = placed.select("place", "rep", "sign", (F.col("at") % CELLS == 0).alias("at_home"))
    large = written(placed.groupBy("place").agg(F.count("*").alias("members")).where(F.col("members") > 2 * BLOCK).select("place", F.ceil(F.col("members") / BLOCK).cast("int").alias("g")))

    def screen(batches):
        for rows in whole_groups(batches, ["place", "p", "q"]):
            place, p, q, rep, left, right = (rows.column(c).to_numpy() for c in ("place", "p", "q", "rep", "is_left", "is_right"))
            sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint64).reshape(len(rep), -1)
            new = np.zeros(len(rep), bool)
            new[1:] = (place[1:] != place[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            held = _screened(left, right, rep, sign, np.cumsum(new), most)
            yield from rows.select(["rep", "place"]).filter(pa.array(held)).to_batches()

    marks = _in_blocks(placed, large).mapInArrow(screen, "rep long, place long").groupBy("rep").agg(F.collect_set("place").alias("marks"))
    marks = written(marks)
    open_classes = classes.join(offered(marks.withColumnRenamed("rep", "marked"), 48 + 8 * F.size("marks")), F.col("rep") == F.col("marked"))
    marked_codes = with_codes(open_classes.select(*classes.columns)).join(offered(marks, 48 + 8 * F.size("marks")), "rep")
    met = marked_codes.withColumn("codes", F.transform(places_of, lambda x: F.when(F.array_contains("marks", x), x).otherwise(F.lit(0)))).select("label", "v", "rep", "n", "codes", F.posexplode("codes").alias("at", "place")).where("place <> 0")
    met = met.select("place", "rep", (F.col("at") % CELLS == 0).alias("at_home"), (F.col("at") / CELLS).cast("int").alias("number"), "label", F.size("v").alias("dim"), "v", "n", "codes")

    def compare(batches):
        for _, members in groups(batches, ["place", "p", "q"]):
            kinds = list(zip(members.column("label").to_pylist(), members.column("dim").to_pylist(), strict=True))
            for one in set(kinds):  # places are hashes, so other labels may share one
                own = members.filter(pa.array([k == one for k in kinds])) if len(set(kinds)) > 1 else members
                rep, n, at_home, left, right = (own.column(c).to_numpy() for c in ("rep", "n", "at_home", "is_left", "is_right"))
                codes = np.array(own.column("codes").to_pylist(), np.int64).reshape(-1, lattice.tables, CELLS)
                out = list(links_in_cell(own.column("number")[0].as_py(), rep, n, unit_vectors(own.column("v").to_pylist()), codes, left, right, at_home, least))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "root", "links"])

    links = _in_blocks(met, large).mapInArrow(compare, "rep long, root long, links long")
    links = written(links.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    component = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = written(links.groupBy("rep").agg(F.sum("links").alias("links")).join(component.withColumnRenamed("node", "rep"), "rep", "left"))
    found = classes.join(offered(linked, 48), "rep", "left").where("n > 1 OR links IS NOT NULL")
    width = 64 + (4 if number == "float" else 8) * F.size("v")
    found = written(found.select("label", "v", F.lit(True).alias("good"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = source.join(offered(found, width), ["good", "label", "v"], "left")
    out = written(out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
    discard(classes, large, marks, links, linked, found)
    return out


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


QUERIES = {"op5_near_vectors": op5_near_vectors}
SQL = {
    "op5_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN comp ON comp.a = vec_id LEFT JOIN deg ON deg.a = vec_id"""
}
