"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a whole
text. Each partition of labelled rows sums its part of the normal equations, the sums meet
in a fixed number of blocks, and the driver solves a system of fixed size. Scores of rows that
their own model did not see, counted in fixed bins, are calibrated by isotonic regression.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, offered, sliced, table, types, written

#: Features of the kernel, ridge penalty, folds by the remainder of crc32(id), labelled rows that one partition sums.
FEATURES, RIDGE, FOLDS, SUM_ROWS = 256, 0.3, 5, 8_192
#: Bins of raw scores from LOW to HIGH for the calibration, and rows of the system in a block.
BINS, LOW, HIGH, BLOCK = 2_000, -0.5, 1.5, 32
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@^_|~/\\{}[]", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty."""
    text = text or ""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = text.split()
    m = max(1, len(words))
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    share = counts[counts > 0] / n
    upper, lower = counts[_UPPER].sum(), counts[_LOWER].sum()
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        float(lengths.mean()),
        float(lengths.std()),
        np.log1p(float(lengths.max())),
        float((lengths <= 3).mean()),
        distinct / m,
        pairs / max(1, m - 1),
        len(set(lines)) / k,
        len(words) / k / 50,
        upper / max(1, upper + lower),
        counts[_DIGIT].sum() / n,
        counts[_SYMBOLS].sum() / n,
        counts[33] / n,
        counts[_STOPS].sum() / m,
        counts[10] / n,
        counts[128:].sum() / n,
        counts[32] / n,
        float(-(share * np.log2(share)).sum()) if len(data) else 0.0,
        len(zlib.compress(data, 1)) / n if len(data) else 0.0,
        sum(w[-1] in ".!?" for w in words) / m,
    ]


K = len(statistics(""))


@dataclass(frozen=True)
class Model:
    """Standardisation, ridge weights and calibration: a few hundred KB whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    places: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return kernel_features(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1; one part in a thousand keeps the order within a level."""
        raw = self.raw(stats)
        level = np.interp(raw, self.places, self.levels) if len(self.places) else np.full(len(raw), 0.5)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def kernel_features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """sqrt(2/D) cos(Wx + b) with a fixed seed, and a constant."""
    rng = np.random.default_rng(20_240)
    w, b = rng.standard_normal((K, FEATURES)) / np.sqrt(K), rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def with_statistics(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, stats) of every row, and the columns of carry."""

    def measure(batches):
        for batch in sliced(batches):
            stats = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats, *batch.columns[2:]], names=[id_col, "stats", *carry])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, F.col(text_col).cast("string").alias("body"), *carry)
    return source.mapInArrow(measure, ", ".join([f"`{id_col}` {kind}, stats array<double>", *types(docs, carry)]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, K) if len(column) else np.zeros((0, K))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of means y with counts n at x: (places, levels), both rising."""
    pools: list[list[float]] = []
    for place, mean, count in zip(x, y, n, strict=True):
        pools.append([place * count, mean * count, count])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(labelled: DataFrame) -> Model:
    """Fits on rows (stats, y, fold); y is 0 or 1. All rows count; what meets has a fixed size."""
    first = labelled.select(*(f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(K) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(K)])
    scale = np.array([first[f"s{i}"] or 1.0 for i in range(K)])
    size = FEATURES + 1

    def sums(batches):
        total = {}
        for batch in sliced(batches):
            z = kernel_features(_matrix(batch.column("stats")), mean, scale)
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                own = z[fold == f]
                total[f] = total.get(f, 0) + np.hstack([own.T @ own, (own.T @ y[fold == f])[:, None]])
        rows = [(f, b, m[b : b + BLOCK].tobytes()) for f, m in total.items() for b in range(0, size, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["fold", "block", "part"])

    def add(rows: pa.Table) -> pa.Table:
        part = sum(np.frombuffer(p.as_py()) for p in rows.column("part"))
        return pa.table([rows.column("fold")[:1], rows.column("block")[:1], pa.array([part.tobytes()], pa.binary())], names=["fold", "block", "part"])

    parts, n = "fold int, block int, part binary", max(1, -(-labelled.count() // SUM_ROWS))
    met = labelled.repartition(n).mapInArrow(sums, parts).withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(n) + 1)))
    met = met.groupBy("fold", "block", "lot").applyInArrow(add, parts).groupBy("fold", "block").applyInArrow(add, parts).collect()
    systems: dict[int, np.ndarray] = {}
    for r in met:
        own = systems.setdefault(r["fold"], np.zeros((size, size + 1)))
        part = np.frombuffer(r["part"]).reshape(-1, size + 1)
        own[r["block"] : r["block"] + len(part)] = part
    if not systems:
        return Model(mean, scale, np.zeros(size), np.zeros(0), np.zeros(0))
    penalty = RIDGE * np.eye(size)
    penalty[-1, -1] = 1e-9
    solve = lambda m: np.linalg.solve(m[:, :-1] + penalty, m[:, -1])
    whole = sum(systems.values())
    unseen = {f: solve(whole - m) if len(systems) > 1 else solve(whole) for f, m in systems.items()}

    def binned(batches):
        for batch in sliced(batches):
            z = kernel_features(_matrix(batch.column("stats")), mean, scale)
            raw = np.array([row @ unseen[f] for row, f in zip(z, batch.column("fold").to_pylist(), strict=True)])
            bins = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), batch.column("y")], names=["bin", "y"])

    counts = labelled.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    n, y = np.array([c["n"] for c in counts], float), np.array([c["y"] for c in counts], float)
    centre = LOW + (np.array([c["bin"] for c in counts]) + 0.5) * (HIGH - LOW) / BINS
    return Model(mean, scale, solve(whole), *isotonic(centre, y / n, n))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: (id, held_out, score, predicted), and its columns of carry.

    Only statistics of the text are inputs of a score. Labels of rows whose crc32(id as text)
    mod 5 is 0 are held out; all other labelled rows are learned from, each pair of a document
    and a label row once. Null and empty texts have statistics, and so scores, of their own.
    Null ids carry no label and are not held out; repeated ids keep their rows. Labels other
    than 0 and 1 are passed over. Without labelled rows every score is near 0.5. Other columns
    are not read; an empty table gives an empty one.
    """
    fold = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)).cast("int"), F.lit(-1))
    marks = written(labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("labelled_id"), F.col(label_col).cast("double").alias("y")))
    few = offered(marks, 32)
    learned = docs.where(fold > 0)
    if few is not marks:  # few labels: only labelled texts are measured, where they lie
        learned = with_statistics(learned.select(id_col, text_col).join(few, F.col(id_col) == F.col("labelled_id"), "left_semi"), id_col, text_col)
    else:
        learned = with_statistics(learned, id_col, text_col)
    labelled = written(learned.join(few, F.col(id_col) == F.col("labelled_id")).select("stats", "y", fold.alias("fold")))
    model = fit(labelled)
    discard(labelled, marks)
    measured = with_statistics(docs, id_col, text_col, carry).withColumn("fold", fold)

    def score(batches):
        for batch in sliced(batches):
            scores = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), *batch.columns[3:]], names=[id_col, "held_out", "score", *carry])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = measured.select(id_col, (F.col("fold") == 0).alias("held_out"), "stats", *carry).mapInArrow(score, ", ".join([f"`{id_col}` {kind}, held_out boolean, score double", *types(docs, carry)]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
