"""Near-duplicate documents by DartMinHash signatures, banded candidates and exact comparison.

Each unit of an element's weight is a region into which an endless row of darts is thrown;
hashes of the element say when each dart lands and on which coordinate. A document sees the
darts of its own regions, and each coordinate keeps the earliest. So about k ln k darts make
k coordinates, whatever the document's size, and two documents agree on a coordinate with
the probability of their (weighted) Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, groups, offered, sliced, table, words, written

#: Bands and coordinates in each: at similarity 0.8 a pair meets in a band with 99.9 %.
BANDS, ROWS = 24, 6
WIDTH = 5
#: Comparisons with one pivot that a task makes on average.
PER_TASK = 256
#: Rounds with one pivot for each bucket before all pairs that are left are looked at.
PIVOT_ROUNDS = 1
#: Of these a pair whose coordinates agree in a share less by SLACK than the least similarity is
#: not similar (five standard deviations); members of a bucket on either side of one block.
SLACK, BLOCK = 0.17, 1_024
_DART, _PLACE, _LAYER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(own: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of some words as sorted 64-bit hashes, and how often each occurs.

    Fewer words than a shingle has are one shingle; no words have none.
    """
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known: dict[bytes, int] = {}
    hashes = np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in own], np.uint64)
    n = max(1, len(own) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(width, len(own))):
        total = _mixed(total + hashes[i : i + n] + _DART)
    return np.unique(total, return_counts=True)


def _darts(keys: np.ndarray, until: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the key, time, dart) of the darts that land until then in regions of this size."""
    mean = until * size
    thrown = int(mean + 4 * np.sqrt(mean) + 4)
    while True:
        darts = _mixed(keys[:, None] + np.arange(1, thrown + 1, dtype=np.uint64) * _DART)
        times = np.cumsum(-np.log(((darts >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53), axis=1)
        if times[:, -1].min() > mean:
            break
        thrown *= 2
    own, at = np.nonzero(times <= mean)
    return own, times[own, at] / size, darts[own, at]


def _thrown(keys: np.ndarray, weights: np.ndarray | None, until: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and darts until then. A weight w covers the regions [0, 1), [1, 2), [2, 4), [4, 8) ...
    up to w; darts that land above w in its last region are not its own, so cost follows elements."""
    if weights is None:
        return _darts(keys, until, 1)[1:]
    times, darts, low, size, level = [], [], 0, 1, 0
    while (own := np.flatnonzero(weights > low)).size:
        at, t, d = _darts(_mixed(keys[own] + np.array([level], np.uint64) * _LAYER), until, size)
        place = low + size * ((_mixed(d ^ _LAYER) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        inside = place < weights[own][at]
        times.append(t[inside])
        darts.append(d[inside])
        low, size, level = low + size, max(1, low + size), level + 1
    return np.concatenate(times), np.concatenate(darts)


def signature(elements: np.ndarray, weights: np.ndarray | None, k: int = BANDS * ROWS) -> np.ndarray:
    """The dart that each of k coordinates keeps; weights are whole numbers, 1 where None."""
    keys = _mixed(elements)
    until = k * (np.log(k) + 3) / (len(keys) if weights is None else int(weights.sum()))
    while True:
        times, darts = _thrown(keys, weights, until)
        darts = _mixed(darts ^ _PLACE)
        order = np.argsort(-times, kind="stable")
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        at = ((darts >> np.uint64(32)) % np.uint64(k)).astype(np.int64)[order]
        out[at] = darts[order]  # the last one written is the earliest
        filled[at] = True
        if filled.all():
            return out
        until *= 2


def band_keys(sign: np.ndarray) -> np.ndarray:
    parts, total = sign.reshape(BANDS, ROWS), np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        total = _mixed(total + parts[:, i] + _DART)
    return total.view(np.int64)


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of (shingles, weights); plain where all weights are 1."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / max(1, int(a[1].sum() + b[1].sum()) - least)


def _packed(elements: np.ndarray, weights: np.ndarray, weighted: bool) -> tuple[bytes, bytes]:
    return elements.tobytes(), weights.tobytes() if weighted else b""


def _unpacked(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(elements, np.uint64)
    return own, np.frombuffer(weights, np.int64) if weights else np.ones(len(own), np.int64)


def _prints(sign: np.ndarray) -> bytes:
    """A byte of each coordinate."""
    return sign.astype(np.uint8).tobytes()


def _sketch(weighted: bool, width: int):
    def sketch(batches):
        for batch in sliced(batches):
            keys, bands, prints = [], [], []
            for text in batch.column(1).to_pylist():
                own = words(text)
                keys.append(xxhash.xxh3_128_digest(b" ".join(own)) if own else None)
                elements, n = shingles(own, width)
                sign = signature(elements, n if weighted else None) if own else None
                bands.append(band_keys(sign).tolist() if own else None)
                prints.append(_prints(sign) if own else None)
            columns = [pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "words_key", "bands", "prints"])

    return sketch


def _compare(docs: DataFrame, pairs: DataFrame, least: float, weighted: bool, width: int) -> DataFrame:
    """Of pairs (pivot, other) of ids those that are similar; texts go to the pivot once each.

    The text of a pivot with many others goes to several tasks and the others are dealt over
    them, so many copies of one text do not meet in one task.
    """
    pivots = written(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts")))
    hot = offered(pivots.where("salts > 1"), 16)
    asked = pairs.join(hot, "pivot", "left").select(F.col("other").alias("asked"), "pivot", F.pmod(F.xxhash64("other"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(False).alias("is_pivot"))
    own = pivots.select(F.col("pivot").alias("asked"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_pivot"))
    roles = written(asked.union(own).groupBy("asked").agg(F.collect_set(F.struct("pivot", "salt", "is_pivot")).alias("roles")))
    source = docs.join(offered(roles, 32 + 24 * F.size("roles")), docs["id"] == roles["asked"])

    def sets(batches):
        for batch in sliced(batches):
            data = zip(*(_packed(*shingles(words(t), width), weighted) for t in batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(d, pa.binary()) for d in data), batch.column(2)], names=["id", "elements", "weights", "roles"])

    held = source.select("id", "body", "roles").mapInArrow(sets, "id long, elements binary, weights binary, roles array<struct<pivot:long,salt:int,is_pivot:boolean>>")
    each = held.withColumn("role", F.explode("roles")).select("id", "elements", "weights", "role.*")
    dealt = each.withColumn("late", (~F.col("is_pivot")).cast("int"))
    dealt = dealt.select("pivot", "salt", "late", "id", "elements", "weights").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "late")

    def compare(batches):
        here, pivots = None, []
        for batch in sliced(batches):
            out = ([], [])
            for pivot, salt, late, doc, elements, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _unpacked(elements, weights)
                if here != (pivot, salt):
                    here, pivots = (pivot, salt), []
                if not late:
                    pivots.append(own)
                elif any(similarity(p, own) >= least for p in pivots):
                    out[0].append(pivot)
                    out[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["pivot", "other"])

    found = written(dealt.mapInArrow(compare, "pivot long, other long"))
    discard(pivots, roles)
    return found


PLACE = "band int, bucket long, p int, q int, own int"


def _open_pairs(own, p, q, rep, component, prints, bands, band: int, need: float):
    """(member, others): in one pair of blocks of a bucket, those that the signature doesn't rule out.

    Members of one component are not compared, and a pair is looked at in the first band that it shares.
    """
    rights = np.flatnonzero(own == q)
    for i in np.flatnonzero(own == p).tolist():
        others = rights[(component[rights] != component[i]) & ((rep[rights] > rep[i]) | (p != q))]
        others = others[(prints[others] == prints[i]).sum(1) >= need]
        others = others[~(bands[others, :band] == bands[i, :band]).any(1)]
        if len(others):
            yield i, others


def _rows_of(rows: pa.Table, names: tuple[str, ...]):
    """Columns of a group as arrays: whole numbers, then prints and bands as matrices."""
    n = rows.num_rows
    prints, bands = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(n, -1) for c, kind in (("prints", np.uint8), ("band_keys", np.int64)))
    return *(rows.column(c).to_numpy() for c in names), prints, bands


def _compare_all(docs: DataFrame, classes: DataFrame, members: DataFrame, least: float, weighted: bool, width: int) -> DataFrame:
    """Links (a, b) between components that share a bucket: some that connect all that are linked.

    members: (band, bucket, rep, component). Buckets of more than BLOCK members are dealt into
    pairs of blocks. First only signatures meet there; then the texts of those that have a
    partner which the signature does not rule out, and pairs are compared exactly unless links
    of the block connect them already.
    """
    sizes = members.groupBy("band", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g")).where("g > 1")
    sized = members.join(offered(written(sizes), 32), ["band", "bucket"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    blocks = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct("band", "bucket", F.least("own", k).alias("p"), F.greatest("own", k).alias("q"), "own"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("place", F.explode(blocks))
    places = written(sized.groupBy("rep", "component").agg(F.collect_list("place").alias("places")))
    keys = ["band", "bucket", "p", "q"]
    need = (least - SLACK) * BANDS * ROWS
    whole = ("own", "rep", "component")

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.explode("places")).drop("places").select("*", "place.*").drop("place").repartition(*keys).sortWithinPartitions(*keys)

    def screen(batches):
        for key, rows in groups(batches, keys):
            own, rep, component, prints, bands = _rows_of(rows, whole)
            held = np.zeros(len(rep), bool)
            for i, others in _open_pairs(own, *key[2:], rep, component, prints, bands, key[0], need):
                held[i] = held[others] = True
            yield from rows.select(["rep", "component", *keys, "own"]).filter(pa.array(held)).to_batches()

    signed = classes.select("rep", "prints", "bands").join(offered(places, 64 + 32 * F.size("places")), "rep")

    def pack(batches):
        for batch in sliced(batches):
            packed = pa.array([np.array(b, np.int64).tobytes() for b in batch.column("bands").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("component"), batch.column("prints"), packed, batch.column("places")], names=["rep", "component", "prints", "band_keys", "places"])

    kinds = f"rep long, component long, prints binary, band_keys binary, places array<struct<{', '.join(x.replace(' ', ':') for x in PLACE.split(', '))}>>"
    left = dealt(signed.select("rep", "component", "prints", "bands", "places").mapInArrow(pack, kinds)).mapInArrow(screen, f"rep long, component long, {PLACE}")
    left = written(left.groupBy("rep", "component").agg(F.collect_set(F.struct(*keys, "own")).alias("places")))
    source = docs.where("body IS NOT NULL").join(offered(left, 64 + 32 * F.size("places")), docs["id"] == left["rep"])

    def sets(batches):
        for batch in sliced(batches):
            own = [words(t) for t in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array([bool(w) for w in own], pa.bool_()))  # texts without words link with nothing
            held = [shingles(w, width) for w in own if w]
            signs = [signature(e, n if weighted else None) for e, n in held]
            data = (*([x[i] for x in (_packed(e, n, weighted) for e, n in held)] for i in (0, 1)), [_prints(x) for x in signs], [band_keys(x).tobytes() for x in signs])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:3], *(pa.array(d, pa.binary()) for d in data), batch.column(3)], names=["rep", "component", "elements", "weights", "prints", "band_keys", "places"])

    texts = dealt(source.select("body", "rep", "component", "places").mapInArrow(sets, kinds.replace("prints", "elements binary, weights binary, prints")))

    def compare(batches):
        for key, rows in groups(batches, keys):
            own, rep, component, prints, bands = _rows_of(rows, whole)
            component, known, out = component.copy(), component, ([], [])
            elements, weights = (rows.column(c).to_pylist() for c in ("elements", "weights"))
            member = lambda k: _unpacked(elements[k], weights[k])
            for i, others in _open_pairs(own, *key[2:], rep, known, prints, bands, key[0], need):
                for j in others.tolist():
                    if component[i] != component[j] and similarity(member(i), member(j)) >= least:
                        component[component == component[j]] = component[i]
                        out[0].append(known[i])
                        out[1].append(known[j])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    found = written(texts.mapInArrow(compare, "a long, b long"))
    discard(places, left)
    return found


def near_documents(
    docs: DataFrame,
    least: float = 0.8,
    width: int = WIDTH,
    weighted: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: (id, component_id), the smallest id of its near-duplicate group.

    Documents link where the Jaccard similarity of their shingles of `width` words (as sets;
    with weighted, as multisets) is at least `least`; groups are connected by links. Texts with
    the same words are one class and compared once. Pairs that share a band are compared with
    one pivot of each bucket; then all pairs of a bucket that the links found so far leave
    apart are compared, but for those whose signatures rule the similarity out. Documents without words (null or
    empty ones too) and rows with a null id link with nothing; a null id's component is null.
    Rows with the same id are one document: any of its texts links it. Other columns are not
    read; an empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    sketched = written(source.mapInArrow(_sketch(weighted, width), "id long, words_key binary, bands array<long>, prints binary"))
    first = F.min(F.struct("id", "bands", "prints")).alias("r")
    classes = sketched.where(F.col("id").isNotNull() & F.col("words_key").isNotNull()).groupBy("words_key").agg(first, F.count("*").alias("n"))
    classes = written(classes.select("words_key", "n", F.col("r.id").alias("rep"), "r.bands", "r.prints"))
    rows = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("band", "bucket")
    shared = written(shared)
    rows = written(rows.join(offered(shared, 32), ["band", "bucket"]).distinct())
    discard(shared)

    component = found = None
    for turn in range(PIVOT_ROUNDS + 1):
        named = rows.withColumn("component", F.col("rep")) if component is None else rows.join(offered(component, 32), rows["rep"] == component["node"], "left").select("band", "bucket", "rep", F.coalesce("component", "rep").alias("component"))
        open_buckets = named.groupBy("band", "bucket").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("pivot"), F.col("component").alias("pivot_component"))).alias("p")).where("a < z")
        open_buckets = written(open_buckets.select("band", "bucket", "p.pivot", "p.pivot_component"))
        if open_buckets.isEmpty():
            break
        met = named.join(offered(open_buckets, 48), ["band", "bucket"])
        if turn == PIVOT_ROUNDS:
            found = _compare_all(source, classes, met.select("band", "bucket", "rep", "component"), least, weighted, width)
            break
        pairs = written(met.where(F.col("component") != F.col("pivot_component")).select("pivot", F.col("rep").alias("other")).distinct())
        links = _compare(source, pairs, least, weighted, width)
        if component is not None:
            links = links.union(component.select("node", "component"))
        component = written(components(links, "pivot", "other"))
        discard(pairs, open_buckets)
    members = classes.select("words_key", "n", "rep", F.col("rep").alias("component_id"))
    for moved in (component, None if found is None else written(components(found))):
        if moved is None:
            continue
        members = members.join(offered(moved, 32), F.col("component_id") == F.col("node"), "left").select("words_key", "n", "rep", F.coalesce("component", "component_id").alias("component_id"))
    # a document that is alone in its class, and its class in its component, keeps its own id
    members = written(members.where("n > 1 OR component_id <> rep").select("words_key", "component_id"))
    out = sketched.select("id", "words_key").join(offered(members, 64), "words_key", "left")
    out = written(out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")))
    discard(sketched, classes, rows, members, *(x for x in (component, found) if x is not None))
    return out


def op7_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


QUERIES = {"op7_near_documents": op7_near_documents}
SQL: dict[str, str] = {}
