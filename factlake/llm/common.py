"""What several operators share: reading tables, cutting lineage, streaming groups, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: digits, letters a-z and everything beyond ASCII, in UTF-8 after A-Z are lower-cased.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text, in order; null has none."""
    return WORDS.findall(text.encode().lower()) if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, one of our own if all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factlake-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from Parquet in the shared folder from now on; cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what written() wrote for these; no frame that is still to be read may come from them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which a side that has been measured is broadcast.
BROADCAST_BYTES = 32 << 20


def offered(df: DataFrame, cost: Column | int) -> DataFrame:
    """The same rows, broadcast in a join if they cost at most BROADCAST_BYTES; cost: bytes of a row."""
    total = df.agg(F.sum(F.lit(cost) if isinstance(cost, int) else cost)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is not among ids; few ids are broadcast, more are joined by shuffle."""
    gone = offered(written(ids.select(F.col(ids.columns[0]).alias("gone_id")).where("gone_id IS NOT NULL").distinct()), 16)
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def types(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The columns of these names as parts of a schema."""
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


def give_back() -> None:
    """Returns to the system what Arrow's pool and the C library hold free; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches, rows: int = 1_000):
    """The same rows in smaller batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def groups(batches, keys: list[str]):
    """Consecutive rows of equal keys as Arrow tables; the input is sorted by the keys.

    Holds one group and one batch at a time, so groups must be bounded where they are made.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        at = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[at]:
                continue
            part = batch.slice(at, i - at)
            if held and rows[at] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = rows[at]
            held.append(part)
            at = i
    if held:
        yield held_key, pa.Table.from_batches(held)
    held.clear()
    give_back()


def whole_groups(batches, keys: list[str]):
    """The same rows as Arrow tables that end where a group of equal keys ends; keys are whole numbers, rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for k, c in zip(keys, columns, strict=True):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
        ends = np.flatnonzero(new)
        if len(ends):
            done = [*held, batch.slice(0, ends[-1])]
            held = []
            yield pa.Table.from_batches([b for b in done if b.num_rows])
        held.append(batch.slice(ends[-1]) if len(ends) else batch)
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    give_back()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component), the least node of each.

    Alternating large-star and small-star steps, each a groupBy and a join; only nodes with
    links have a row. Each round is written and the one before it deleted, and rounds end when
    nothing changes.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        then = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(now)
        now = then
    # at the end each node has one link, to the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
