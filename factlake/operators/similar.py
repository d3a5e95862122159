"""Similarity joins of strings that lose no pair, and the ladders that rest on them.

A pair at or above the threshold differs by few insertions and deletions, so the two share most of
their bigrams. Each string is indexed by its rarest ones only, as many as must contain a shared
one if the pair is to reach the threshold (a prefix filter); strings too short for that are also
indexed by their rarest letters, which holds for every length. What the index brings together is
then compared exactly. For token_set, which a few shared words can satisfy, words that a string
needs for that are indexed too.

Where only the nearest few count and the threshold is low, no index is selective: `nearest_names` lays
strings and names out as a grid of cells and bounds all scores of a cell by matrix products.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..registry import Registry
from ..sources.bridge import read

registry = Registry()

#: Words that a metric must own if a label has them.
MODIFIERS = ("adjusted", "normalized", "normalised", "underlying", "forward", "ntm")
#: Confidences of the rungs, floors of the fuzzy states, and how near a rival may come.
TICKER, LEGAL_NAME, ALIAS = 0.99, 0.98, 0.95
RESOLVED, REVIEW, QUARANTINED, RIVAL = 0.88, 0.70, 0.62, 0.05
#: Most frequent features that are put last; all others count as rare.
FREQUENT = 2_000
SCORES = {"ratio": S.ratio, "token_sort": S.token_sort, "token_set": S.token_set}
#: Most strings and names that a cell of nearest_names has on average, and fewest strings worth a cell of their own.
CELL_STRINGS, CELL_NAMES, LEAST_STRINGS = 65_536, 262_144, 256
#: Names of a tile, strings compared with tiles at once, names that a rare word may be in, and how often a letter of a class is counted.
TILE, CHUNK, RARE, DEEP, CLASSES = 16, 64, 64, 16, 97
#: Tiles looked at together, pairs scored together, and letters of a string in a machine word.
TILES, PAIRS, WIDE = 512, 4_096, 64
_DIGITS = {ord(c): "0" for c in "123456789"}


def _features(text: str, kind: str) -> tuple[int, list[str], list[str], list[str]]:
    """(length, numbered bigrams, numbered letters, words) in the form that the score compares."""
    words = sorted(set(text.split())) if kind == "token_set" else sorted(text.split())
    plain = text if kind == "ratio" else " ".join(words)
    # token_set puts words in an order of the pair, so only bigrams inside words hold for every order
    pieces = words if kind == "token_set" else [plain]

    def numbered(mark, grams):
        seen: Counter = Counter()
        for g in grams:
            seen[g] += 1
            yield f"{mark}{g}{seen[g]}"

    bigrams = list(numbered("2", (p[i : i + 2] for p in pieces for i in range(len(p) - 1))))
    return len(plain), bigrams, list(numbered("1", plain)), words if kind == "token_set" else []


def _lengths(n: int, least: float) -> range:
    """Lengths that a string similar to one of length n may have."""
    return range(ceil(n * least / (200 - least) - 1e-9), floor(n * (200 - least) / least + 1e-9) + 1)


def _index(text: str, kind: str, least: float, order: dict[str, int], left: bool) -> set[str]:
    """The features under which a string is looked up, so that each similar pair has one in common."""
    n, bigrams, letters, words = _features(text, kind)
    rank = lambda f: (order.get(f, -1), f)
    shared = []
    for m in _lengths(n, least):
        apart = floor((100 - least) / 100 * (n + m) + 1e-9)  # insertions and deletions at most
        shared.append(len(bigrams) - (3 * apart + n - m) / 2)
    need = ceil(min(shared, default=0) - 1e-9)
    out = set(sorted(bigrams, key=rank)[: len(bigrams) - max(1, need) + 1])
    if need < 1:
        common = ceil(least / 200 * (n + min(_lengths(n, least), default=n)) - 1e-9)
        out |= set(sorted(letters, key=rank)[: max(0, n - max(1, common) + 1)])
    if words:
        mine, theirs = ("l", "r") if left else ("r", "l")
        out |= {f"{theirs}{w}" for w in words}
        tail, ranked = -1, sorted(words, key=lambda w: rank(f"w{w}"), reverse=True)
        for at, w in enumerate(ranked):  # the most frequent words, as long as they can't do without a rarer one
            tail += len(w) + 1
            if tail >= least / (200 - least) * n - 1e-9:
                out |= {f"{mine}{w}" for w in ranked[at:]}
                break
    return out


def similar_pairs(left: DataFrame, right: DataFrame, least: float, kind: str = "ratio") -> DataFrame:
    """(a, b, score): all pairs of strings of the first columns of left and right with a score of least or more.

    kind: ratio, token_sort or token_set, scored from 0 to 100; least is above 0. Strings are
    compared as they are. Repeated strings count once; nulls and empty strings are in no pair.
    """
    one = lambda df, c: df.select(F.col(df.columns[0]).alias(c)).where(f"{c} <> ''").distinct()
    a, b = one(left, "a"), one(right, "b")

    def all_features(batches):
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                _, bigrams, letters, words = _features(text, kind)
                found += [*bigrams, *letters, *(f"w{w}" for w in words)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["feature"])

    counts = b.mapInArrow(all_features, "feature string").groupBy("feature").count()
    frequent = counts.orderBy(F.desc("count"), "feature").limit(FREQUENT).collect()  # a fixed number
    order = {r["feature"]: r["count"] for r in frequent}

    def indexed(df, c, is_left):
        def rows(batches):
            for batch in batches:
                texts, features = [], []
                for text in batch.column(0).to_pylist():
                    own = sorted(_index(text, kind, least, order, is_left))
                    texts += [text] * len(own)
                    features += own
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(features, pa.string())], names=[c, "feature"])

        return df.mapInArrow(rows, f"{c} string, feature string")

    met = indexed(a, "a", True).join(indexed(b, "b", False), "feature")
    if kind != "token_set":
        short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
        met = met.where(200.0 * short / (short + long) >= least - 1e-9)
    met = met.select("a", "b").distinct()
    return met.withColumn("score", SCORES[kind](F.col("a"), F.col("b"))).where(F.col("score") >= least)


class _Laid:
    """Strings side by side, like ones together: their words in order, the letters of those and what is alike but for digits."""

    def __init__(self, texts: list[str], vocabulary: dict[str, int]):
        texts = [t for t in texts if t.split()]
        plain = [" ".join(sorted(set(t.split()))) for t in texts]
        shapes = [p.translate(_DIGITS) for p in plain]
        seen = Counter(shapes)
        self.shapes = sorted(x for x, n in seen.items() if n >= TILE)
        number = {x: i for i, x in enumerate(self.shapes)}
        shape = np.array([number.get(x, -1) for x in shapes], np.int32)
        order = np.lexsort((np.argsort(np.argsort(["".join(sorted(p, reverse=True)) for p in plain], kind="stable")), shape)) if plain else np.zeros(0, np.int64)
        self.texts, self.plain, self.shape = [texts[i] for i in order], [plain[i] for i in order], shape[order]
        self.length = np.array([len(p) for p in self.plain], np.int64)
        of = [p.split(" ") for p in self.plain]
        self.n_words = np.array([len(ws) for ws in of], np.int64)
        self.all_words = np.array([vocabulary.setdefault(w, len(vocabulary)) for ws in of for w in ws], np.int64)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        self.words = np.full((len(of), min(self.n_words.max(initial=1), WIDE // 2)), -1, np.int64)  # all words of strings below WIDE
        row, word = self.words_of(np.arange(len(of)))
        at = np.arange(len(row)) - self.first_word[row]
        self.words[row[at < WIDE // 2], at[at < WIDE // 2]] = word[at < WIDE // 2]
        self.counts = np.zeros((len(of), CLASSES), np.uint8)
        self.tail = np.zeros(len(of), np.int64)
        for i in range(0, len(of), 8_192):
            some = self.plain[i : i + 8_192]
            letters = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
            cells = np.repeat(np.arange(len(some)), self.length[i : i + 8_192]) * CLASSES + letters % CLASSES
            found = np.bincount(cells, minlength=len(some) * CLASSES).reshape(-1, CLASSES)
            self.counts[i : i + 8_192], self.tail[i : i + 8_192] = np.minimum(found, DEEP), np.maximum(found - DEEP, 0).sum(1)

    def words_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in at, word) of the words of some strings."""
        n = self.n_words[at]
        return np.repeat(np.arange(len(at)), n), self.all_words[np.arange(n.sum()) + np.repeat(self.first_word[at] - (np.cumsum(n) - n), n)]

    def lettered(self, numbers: np.ndarray) -> None:
        """The letters as numbers, a blank before each word, a row of WIDE at most for each string; which places are whose word's."""
        wide = np.minimum(self.length + 1, WIDE)
        self.codes = np.zeros((len(wide), wide.max(initial=1)), numbers.dtype)
        self.covers = np.zeros(self.words.shape, np.uint64)
        places = np.arange(self.codes.shape[1])
        bit = np.uint64(1) << places.astype(np.uint64)
        for i in range(0, len(wide), 8_192):
            at = places < wide[i : i + 8_192, None]
            joined = "".join(" " + p[: WIDE - 1] for p in self.plain[i : i + 8_192])
            self.codes[i : i + 8_192][at] = numbers[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
            word = np.cumsum((self.codes[i : i + 8_192] == numbers[32]) & at, 1, dtype=np.uint8) * at  # 1 for the first word
            for w in range(self.words.shape[1]):
                self.covers[i : i + 8_192, w] = ((word == w + 1) * bit).sum(1, dtype=np.uint64)


class _Chunk:
    """The nearest names so far of a few strings, and the least score that still counts for each."""

    def __init__(self, n: int, least: float, within: float, most: int, rank: np.ndarray):
        self.least, self.within, self.most, self.rank = least, within, most, rank
        self.floor = np.full(n, least)
        self.k, self.i, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, k: np.ndarray, i: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[k]
        if not keep.any():
            return
        k, i, score = (np.concatenate(x) for x in ((self.k, k[keep]), (self.i, i[keep]), (self.score, score[keep])))
        order = np.lexsort((self.rank[i], -score, k))
        k, i, score = k[order], i[order], score[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])]
        k, i, score = k[new], i[new], score[new]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        place = np.arange(len(k)) - np.repeat(starts, np.diff(np.r_[starts, len(k)]))
        self.floor[k[starts]] = np.maximum(self.floor[k[starts]], score[starts] - self.within)
        last = place == self.most - 1
        self.floor[k[last]] = np.maximum(self.floor[k[last]], score[last])
        keep = (place < self.most) & (score >= self.floor[k])
        self.k, self.i, self.score = k[keep], i[keep], score[keep]


def _scores(asked: _Laid, names: _Laid, letters: np.ndarray, word_length: np.ndarray, start: int, k: np.ndarray, i: np.ndarray) -> np.ndarray:
    """token_set of the strings start + k and the names i; letters: bits of each string's places by letter."""
    out = np.zeros(len(k))
    for lo in range(0, len(k), PAIRS):
        kk, q, n = k[lo : lo + PAIRS], k[lo : lo + PAIRS] + start, i[lo : lo + PAIRS]
        gone, cut, both, left, right = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64), asked.n_words[q], names.n_words[n]
        theirs = names.words[n, : right.max()]
        for w in range(min(left.max(), asked.words.shape[1])):
            mine = asked.words[q, w]
            at, place = np.nonzero((theirs == mine[:, None]) & (mine >= 0)[:, None])
            if len(at):
                gone[at] |= asked.covers[q[at], w]
                cut[at] |= names.covers[n[at], place]
                both[at] += word_length[mine[at]] + 1
                left[at] -= 1
                right[at] -= 1
        wide = int(min(names.length[n].max() + 1, names.codes.shape[1]))
        codes = names.codes[n, :wide]
        if both.any():
            codes = codes * (1 - np.unpackbits(cut.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=wide, bitorder="little"))
        codes, base, may = np.ascontiguousarray(codes.T), kk * letters.shape[1], ~gone
        row, flat = np.full(len(q), ~np.uint64(0)), letters.ravel()
        for column in codes:
            hit = flat[base + column]
            hit &= may
            hit &= row
            row = (row + hit) | (row - hit)
        common = np.bitwise_count(~row).astype(np.int64) - 1  # without the blank before the first words
        la, lb, shared = asked.length[q], names.length[n], np.maximum(both - 1, 0)
        score = 200.0 * np.where(both > 0, shared + 1 + common, common) / (la + lb)
        score = np.maximum(score, np.where(both > 0, np.maximum(200.0 * shared / (shared + la), 200.0 * shared / (shared + lb)), 0.0))
        score[(both > 0) & ((left == 0) | (right == 0))] = 100.0
        for x in np.flatnonzero((la >= WIDE) | (lb >= WIDE)).tolist():
            score[x] = S.token_set_of(asked.texts[q[x]], names.texts[n[x]])
        out[lo : lo + PAIRS] = score
    return out


def _nearest(asked: list[str], names: list[str], least: float, within: float, most: int) -> tuple[list[str], list[str], list[float]]:
    """(strings, names, scores): each string's nearest names in this cell, as nearest_names has them."""
    vocabulary: dict[str, int] = {}
    y, x = _Laid(names, vocabulary), _Laid(asked, vocabulary)
    if not x.texts or not y.texts:
        return [], [], []
    alphabet = sorted({ord(c) for p in (x.plain, y.plain) for c in set().union(*p)} | {32})
    numbers = np.zeros(alphabet[-1] + 1, np.min_scalar_type(len(alphabet)))
    numbers[alphabet] = np.arange(1, len(alphabet) + 1)
    x.lettered(numbers)
    y.lettered(numbers)
    word_length = np.array([len(w) for w in vocabulary], np.int64)
    rank = np.empty(len(y.texts), np.int64)
    rank[sorted(range(len(y.texts)), key=y.texts.__getitem__)] = np.arange(len(y.texts))
    # letters as a 0 or 1 for the first, second, ... of each class: products of rows count what two strings share at most
    deepest = np.minimum(x.counts.max(0), y.counts.max(0))
    kind, depth = (np.array(v, np.int64) for v in zip(*((c, d) for c in range(CLASSES) for d in range(deepest[c])))) if deepest.any() else (np.zeros(0, np.int64),) * 2
    unary = lambda counts: counts[:, kind] > depth
    tiles = np.arange(0, len(y.texts), TILE)
    any_count, least_len = np.maximum.reduceat(y.counts, tiles, 0), np.minimum.reduceat(y.length, tiles).astype(np.float32)
    any_letter = unary(any_count).astype(np.float32)
    one_shape = np.where(np.minimum.reduceat(y.shape, tiles) == np.maximum.reduceat(y.shape, tiles), np.minimum.reduceat(y.shape, tiles), -1)
    # words: those of few names lead to them, the others are counted by tile
    row, word = y.words_of(np.arange(len(y.texts)))
    held = np.bincount(word, minlength=len(vocabulary))
    by_word, word_start = row[np.argsort(word, kind="stable")], np.cumsum(held) - held
    frequent = np.flatnonzero(held > RARE)
    numbered = np.full(len(vocabulary), len(frequent), np.int64)  # the last is for other words
    numbered[frequent] = np.arange(len(frequent))
    in_tile = np.zeros((len(tiles), len(frequent) + 1), bool)
    in_tile[row // TILE, numbered[word]] = True
    shape_bounds: dict[int, np.ndarray] = {}

    def by_shape(p: int) -> np.ndarray:
        """No score of a string of shape p is above this in a tile: without a word in common, what two texts share stays in order when digits are taken as equal."""
        if p not in shape_bounds:
            bounds = np.full(len(y.shapes) + 1, 200.0, np.float32)
            for r in np.unique(one_shape[one_shape >= 0]).tolist():
                a, b = x.shapes[p], y.shapes[r]
                if not set(a.split(" ")) & set(b.split(" ")):
                    bounds[r] = S.ratio_of(a, b)
            shape_bounds[p] = bounds[one_shape]
        return shape_bounds[p]

    found = []
    for start in range(0, len(x.texts), CHUNK):
        part = slice(start, min(start + CHUNK, len(x.texts)))
        size = part.stop - start
        best = _Chunk(size, least, within, most, rank)
        letters = np.zeros((size, len(alphabet) + 1), np.uint64)
        for j in range(x.codes.shape[1]):
            letters[np.arange(size), x.codes[part, j]] |= np.uint64(1 << j)
        letters[:, 0] = 0
        scored = lambda k, i: best.add(k, i, _scores(x, y, letters, word_length, start, k, i))  # noqa: B023, E731
        ks, ws = x.words_of(np.arange(start, part.stop))
        rare = held[ws] <= RARE
        if (n := held[ws[rare]]).any():
            scored(np.repeat(ks[rare], n), by_word[np.repeat(word_start[ws[rare]] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        here, at = np.unique(numbered[ws[~rare]], return_inverse=True)
        shares = np.zeros((size, len(here)), np.float32)
        shares[ks[~rare], at] = word_length[ws[~rare]] + 1
        most_shared = np.maximum(shares.sum(1, keepdims=True) - 1, 0)
        local = np.full(len(frequent) + 1, len(here), np.int64)
        local[here] = np.arange(len(here))
        q, over, q_len = unary(x.counts[part]).astype(np.float32), x.tail[part, None].astype(np.float32), x.length[part, None].astype(np.float32)

        def bound(of_letters, of_words, lengths):
            """No score is above this: letters in common over both lengths, or the shared words over the shorter side."""
            by_letters = q @ of_letters.T  # noqa: B023
            by_letters += over  # noqa: B023
            by_letters *= 200 / (q_len + lengths)  # noqa: B023
            if (200 * most_shared < (best.floor[:, None] - 1e-3) * (most_shared + np.minimum(q_len, lengths.min()))).all():  # noqa: B023
                return by_letters
            shared = np.maximum(shares @ of_words.T - 1, 0)  # noqa: B023
            return np.maximum(by_letters, 200 * shared / (shared + np.minimum(q_len, lengths)))  # noqa: B023

        rough = bound(any_letter, in_tile[:, here].astype(np.float32), least_len)
        for p in np.unique(x.shape[part]).tolist():
            if p >= 0:
                own = x.shape[part] == p
                rough[own] = np.minimum(rough[own], by_shape(p))
        is_open = rough >= best.floor[:, None] - 1e-3

        def opened(which, of):
            """Scores the names of tiles for the strings that have them open, the likeliest first."""
            at = (tiles[of, None] + np.arange(TILE)).ravel()
            real = at < len(y.texts)  # the last tile may be shorter
            at = at[real]
            words = np.zeros((len(at), len(here) + 1), np.float32)  # noqa: B023
            of_name, word = y.words_of(at)
            words[of_name, local[numbered[word]]] = 1  # noqa: B023
            fine = bound(unary(y.counts[at]).astype(np.float32), words[:, : len(here)], y.length[at].astype(np.float32))  # noqa: B023
            k, j = np.nonzero((fine >= best.floor[:, None] - 1e-3) & np.repeat(which, TILE, axis=1)[:, real])  # noqa: B023
            upper, i = fine[k, j], at[j]
            if len(k) > PAIRS:
                order = np.argsort(-upper)
                upper, k, i = upper[order], k[order], i[order]
            for lo in range(0, len(k), PAIRS):
                some = slice(lo, lo + PAIRS)
                still = upper[some] >= best.floor[k[some]] - 1e-3  # noqa: B023
                scored(k[some][still], i[some][still])  # noqa: B023

        likely = rough.argmax(1)  # a tile of each string's own, so that its floor rises early
        own = is_open[np.arange(size), likely]
        firsts = np.unique(likely[own])
        for lo in range(0, len(firsts), TILES):
            of = firsts[lo : lo + TILES]
            opened(own[:, None] & (likely[:, None] == of), of)
        is_open[np.arange(size), likely] = False
        is_open &= rough >= best.floor[:, None] - 1e-3
        others = np.flatnonzero(is_open.any(0))
        others = others[np.argsort(-rough[:, others].max(0), kind="stable")]
        for lo in range(0, len(others), TILES):
            of = others[lo : lo + TILES]
            which = is_open[:, of] & (rough[:, of] >= best.floor[:, None] - 1e-3)
            if (some := which.any(0)).any():
                opened(which[:, some], of[some])
        keep = best.score >= best.floor[best.k]
        found.append((best.k[keep] + start, best.i[keep], best.score[keep]))
    k, i, score = (np.concatenate(v).tolist() for v in zip(*found, strict=True))
    return [x.texts[j] for j in k], [y.texts[j] for j in i], score


def nearest_names(left: DataFrame, right: DataFrame, least: float, within: float, most: int = 5) -> DataFrame:
    """(a, b, score): for each string of left the `most` names of right that token_set has nearest, of those with a score of least or more and no more than `within` below the best.

    Equal scores go by name. Strings and names are dealt by hash into a grid whose cells have a
    bounded size; each cell bounds all its scores by the letters and frequent words in common, for
    tiles of like names first, and scores what may still be among the nearest. A cell gives out its
    nearest only, so what is sorted in the end is a few rows for each string and column of cells.
    The work is that of all pairs at worst, some nanoseconds each.
    """
    one = lambda df, c: df.select(F.col(df.columns[0]).alias(c)).where(f"{c} <> ''").distinct()
    a, b = one(left, "a"), one(right, "b")
    n_a, n_b = a.count(), b.count()
    at_once = 2 * left.sparkSession.sparkContext.defaultParallelism
    rows, columns = max(ceil(n_a / CELL_STRINGS), min(at_once, ceil(n_a / LEAST_STRINGS)), 1), max(ceil(n_b / CELL_NAMES), 1)
    dealt = lambda df, c, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    cells = min(rows * columns, 4_000)
    x = dealt(a, "a", "row", rows, "column", columns).repartition(cells, "row", "column")
    y = dealt(b, "b", "column", columns, "row", rows).repartition(cells, "row", "column")

    def compared(strings: pa.Table, names: pa.Table) -> pa.Table:
        found = _nearest(strings.column("a").to_pylist(), names.column("b").to_pylist(), least, within, most)
        return pa.table({c: pa.array(found[i], t) for i, (c, t) in enumerate((("a", pa.string()), ("b", pa.string()), ("score", pa.float64())))})

    met = x.groupBy("row", "column").cogroup(y.groupBy("row", "column")).applyInArrow(compared, "a string, b string, score double")
    w = W.partitionBy("a")
    ranked = met.withColumns({"best": F.max("score").over(w), "at": F.row_number().over(w.orderBy(F.desc("score"), "b"))})
    return ranked.where((F.col("at") <= most) & (F.col("score") >= F.col("best") - (within + 1e-9))).select("a", "b", "score")


def resolve_labels(labels: DataFrame, known: DataFrame, least: float = 90.0, kind: str = "ratio") -> DataFrame:
    """(label, metric, score, method) of distinct labels (label) by names (name, metric); null metric where none fits.

    A name equal but for case and punctuation is exact (100), the smallest metric winning. Else the
    most similar name of least or more is the only candidate, ties by name, then metric; it is
    passed over if the label has a modifier that no name of its metric has.
    """
    asked = labels.select("label", T.squash(F.col("label")).alias("key"), T.spaced(F.col("label")).alias("plain")).distinct()
    names = known.select(T.squash(F.col("name")).alias("key"), T.spaced(F.col("name")).alias("plain"), "metric").where("key <> ''").distinct()
    asked = asked.join(names.groupBy("key").agg(F.min("metric").alias("exact")), "key", "left")
    pairs = similar_pairs(asked.where("exact IS NULL").select("plain"), names.select("plain"), least, kind)
    scored = pairs.join(names.groupBy("plain").agg(F.min("metric").alias("near")), F.col("b") == F.col("plain")).drop("plain")
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b", "near")).alias("x")).select("a", F.col("x.near").alias("near"), (-F.col("x.s")).alias("near_score"))
    has = lambda c: F.filter(F.array(*map(F.lit, MODIFIERS)), lambda m: F.array_contains(F.split(c, " "), m))
    owned = names.select("metric", F.explode(has("plain")).alias("word")).groupBy("metric").agg(F.collect_set("word").alias("owned"))  # at most the modifiers
    best = best.join(owned, F.col("near") == F.col("metric"), "left").where(F.size(F.array_except(has("a"), F.coalesce("owned", F.array().cast("array<string>")))) == 0)
    out = asked.join(best.select("a", "near", "near_score"), F.col("plain") == F.col("a"), "left")
    method = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "fuzzy").otherwise("unmapped")
    score = F.when(F.col("exact").isNotNull(), 100.0).otherwise(F.col("near_score"))
    return out.select("label", F.coalesce("exact", "near").alias("metric"), score.alias("score"), method.alias("method"))


def resolve_entities(asked: DataFrame, entities: DataFrame, aliases: DataFrame, quarantine: tuple[str, ...] = ()) -> DataFrame:
    """(query, ticker, state, confidence, method, candidates) of distinct queries (query).

    entities: (ticker, name); aliases: (ticker, alias). Rungs in order: a quarantined term, a ticker
    (0.99), a query shaped like a ticker that is none, a legal name (0.98), an alias (0.95), then
    the best of the five most similar names and aliases by token_set. Another ticker among those
    five within 0.05 of the best makes it REVIEW with both as candidates; else 0.88 is RESOLVED,
    0.70 REVIEW, less QUARANTINED, without a ticker. Equal scores go by name, then ticker. Where
    no similarity reaches 0.62 the confidence is 0.
    """
    norm = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    q = asked.select("query", F.trim("query").alias("bare"), norm(F.col("query")).alias("key")).distinct()
    first = lambda df, key, out: df.where("key <> ''").groupBy("key").agg(F.min("ticker").alias(out)).withColumnRenamed("key", key)
    tickers = first(entities.select("ticker", norm(F.col("ticker")).alias("key")), "tk", "by_ticker")
    legal = first(entities.select("ticker", norm(F.col("name")).alias("key")), "nk", "by_name")
    other = first(aliases.select("ticker", norm(F.col("alias")).alias("key")), "ak", "by_alias")
    q = q.join(tickers, F.col("key") == F.col("tk"), "left").join(legal, F.col("key") == F.col("nk"), "left").join(other, F.col("key") == F.col("ak"), "left").drop("tk", "nk", "ak")
    banned = F.col("key").isin(*[" ".join(t.lower().split()) for t in quarantine]) if quarantine else F.lit(False)
    shaped = F.col("bare").rlike("^[A-Z][A-Z0-9]{1,5}$")
    rung = (
        F.when(F.coalesce(F.col("key"), F.lit("")) == "", "empty")
        .when(banned, "quarantine_term")
        .when(F.col("by_ticker").isNotNull(), "exact_ticker")
        .when(shaped, "ticker_shaped_unknown")
        .when(F.col("by_name").isNotNull(), "exact_legal_name")
        .when(F.col("by_alias").isNotNull(), "alias")
    )
    q = q.withColumns({"rung": rung, "lowered": F.lower("bare")})
    names = entities.select("ticker", F.lower("name").alias("name")).unionByName(aliases.select("ticker", F.lower("alias").alias("name"))).distinct()
    pairs = nearest_names(q.where("rung IS NULL").select("lowered"), names.select("name"), 100 * (QUARANTINED - RIVAL), 100 * RIVAL).join(names, F.col("b") == F.col("name"))
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "name", "ticker"))
    found = pairs.withColumn("place", place).where("place <= 5").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "score", "ticker"))).alias("near"))
    found = found.where(F.col("near")[0]["score"] >= 100 * QUARANTINED)
    out = q.join(found, (F.col("lowered") == F.col("a")) & F.col("rung").isNull(), "left")
    top, score = F.col("near")[0], F.coalesce(F.col("near")[0]["score"] / 100, F.lit(0.0))
    rival = F.filter("near", lambda x: (x["ticker"] != top["ticker"]) & (score - x["score"] / 100 <= RIVAL + 1e-12))
    rival = F.when(F.size(rival) > 0, rival[0]["ticker"])
    method = F.coalesce("rung", F.when(F.col("near").isNull(), "below_floor").when(rival.isNotNull(), "fuzzy_ambiguous").when(score >= RESOLVED, "fuzzy").when(score >= REVIEW, "fuzzy_low").otherwise("fuzzy_quarantine"))
    out = out.withColumns({"method": method, "rival": rival, "top": top["ticker"]})
    exact = F.when(F.col("method") == "exact_ticker", F.struct(F.lit(TICKER).alias("c"), F.col("by_ticker").alias("t"))).when(F.col("method") == "exact_legal_name", F.struct(F.lit(LEGAL_NAME).alias("c"), F.col("by_name").alias("t"))).when(F.col("method") == "alias", F.struct(F.lit(ALIAS).alias("c"), F.col("by_alias").alias("t")))
    ticker = F.coalesce(exact["t"], F.when(F.col("method").isin("fuzzy", "fuzzy_low", "fuzzy_ambiguous"), F.col("top")))
    state = F.when(F.col("method").isin("exact_ticker", "exact_legal_name", "alias", "fuzzy"), "RESOLVED").when(F.col("method").isin("fuzzy_low", "fuzzy_ambiguous"), "REVIEW").otherwise("QUARANTINED")
    candidates = F.array_compact(F.array(F.coalesce(exact["t"], F.when(F.col("method").startswith("fuzzy"), F.col("top"))), F.when(F.col("method") == "fuzzy_ambiguous", F.col("rival"))))
    return out.select("query", ticker.alias("ticker"), state.alias("state"), F.coalesce(exact["c"], F.when(F.col("method").startswith("fuzzy"), score), F.lit(0.0)).alias("confidence"), "method", candidates.alias("candidates"))


@registry.add("label_to_metric_resolved")
def label_to_metric_resolved(spark, sf_dir):
    """Part names with a letter lost, doubled, glued or with a modifier before them, against the part names themselves."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey") % 5
    torn = (
        F.when(k == 0, F.upper("p_name")).when(k == 1, F.regexp_replace("p_name", "e", "ee")).when(k == 2, F.concat(F.lit("ntm "), F.col("p_name")))
        .when(k == 3, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.concat(F.regexp_replace("p_name", "a", ""), F.lit("s")))
    )
    return resolve_labels(p.select(torn.alias("label")), p.select(F.col("p_name").alias("name"), F.col("p_name").alias("metric")).distinct())


@registry.add("entity_ladder")
def entity_ladder(spark, sf_dir):
    """Customers' names for suppliers, exact, bent or not theirs, resolved to suppliers' tickers."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    name = F.concat_ws(" ", F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))), F.element_at(F.split("s_name", "#"), -1), F.lit("Works Limited"))
    entities = s.select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), name.alias("name"))
    aliases = entities.select("ticker", F.concat(F.lit("Works "), F.col("ticker")).alias("alias"))
    n = entities.agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(F.broadcast(n))  # one row
    c = c.join(entities, F.col("s_suppkey") == F.col("c_custkey") % F.col("n") + 1)
    k = F.col("c_custkey") % 7
    query = (
        F.when(k == 0, F.col("ticker")).when(k == 1, F.upper("name")).when(k == 2, F.concat(F.lit("works  "), F.lower("ticker"))).when(k == 3, F.replace("name", F.lit("Limited"), F.lit("Ltd")))
        .when(k == 4, F.concat(F.lit("Z"), F.col("ticker"))).when(k == 5, F.regexp_replace("name", "[aeo]", "")).otherwise(F.col("c_name"))
    )
    return resolve_entities(c.select(query.alias("query")), entities.select("ticker", "name"), aliases, ("works s1",))
