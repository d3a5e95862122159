"""Token counts by heap-and-linked-list byte-pair merging.

A count is the number of initial symbols less the number of merges; no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: Fixed pattern of byte-level pre-tokenizers; white space is Unicode's property.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces up to this many code points are remembered, at most so many in a worker.
REMEMBERED_LENGTH, REMEMBERED = 48, 1_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next from U+0100."""
    own = {b: chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    rest = [b for b in range(256) if b not in own]
    return [own[b] if b in own else chr(256 + rest.index(b)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left once the lowest-rank adjacent pair, leftmost first, is merged until none is."""
    n = left = len(symbols)
    get = ranks.get
    heap = [r * n + i for i, pair in enumerate(pairwise(symbols)) if (r := get(pair)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        rank, i = divmod(pop(heap), n)
        j = after[i]
        if j >= n or get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged since
        symbols[i] = here = symbols[i] + symbols[j]
        symbols[j] = ""
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get((here, symbols[k]))) is not None:
                push(heap, r * n + i)
        if (h := before[i]) >= 0 and (r := get((symbols[h], here))) is not None:
            push(heap, r * n + h)
    return left


class Counter(dict):
    """Counts of pieces, remembered up to a bound; the vocabulary is read once for each worker."""

    _of: dict[str, Counter] = {}

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in vocabulary["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        added = [t["content"] for t in vocabulary["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None

    @classmethod
    def of(cls, path: str) -> Counter:
        return cls._of.get(path) or cls._of.setdefault(path, cls(path))

    def __missing__(self, piece: str) -> int:
        n = merged_length([self.symbols[b] for b in piece.encode()], self.ranks)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, PIECES.findall(part))) for part in parts)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: (id, n_bytes, n_tokens) by the byte-level vocabulary at that path.

    vocabulary: a path that exists on every executor. Null and empty texts have 0 bytes and
    0 tokens; added tokens of the file count 1 where their strings stand in a text. Ids may be
    null or repeated; other columns are not read. An empty table gives an empty table.
    """

    def count(batches):
        counter = Counter.of(vocabulary)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
