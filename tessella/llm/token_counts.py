"""Token counts of a piece vocabulary by heap-and-linked-list merging, without making any identifiers.

The symbols of a text form a doubly linked list; a heap holds the adjacent pairs whose concatenation is in
the vocabulary, keyed by rank and place. Popping the lowest rank again and again, leftmost first, and merging
gives the tokenizer's segmentation. Its count is the number of initial symbols minus the number of merges;
a symbol outside the vocabulary costs its UTF-8 bytes (byte fallback).

A text is cut where no merge can reach across: no piece of the vocabulary has the space mark after another
character (checked when the vocabulary is read; else the whole text is one unit), and a symbol outside
every piece bars merges too. So counts are additive over units, and a bounded cache holds counts of units.

Cases: null text is empty and has 0 bytes and tokens; texts of any length are counted whole; repeated rows
give a row each; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame, SparkSession

from .common import documents, small_batches, text_of

#: Units whose counts a worker remembers; when full, the cache starts anew.
CACHE_UNITS = 400_000
MARK = "▁"


def vocabulary(path: str) -> dict[str, int]:
    """Pieces and merge ranks (the lowest merges first) of a sentencepiece BPE model; byte and control pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): round(-sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}


def merge_count(unit: str, ranks: dict[str, int]) -> int:
    """Tokens of a unit: symbols outside the vocabulary count their bytes; the rest is initial symbols minus merges."""
    n = len(unit)
    piece, get = list(unit), ranks.get
    rank = [get(a + b, -1) for a, b in zip(unit, unit[1:])] + [-1]  # of the pair that begins here
    heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
    tokens = n
    if heap:
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank[i] != r:  # an end of the pair has merged since
                continue
            tokens -= 1
            j = after[i]
            piece[i] = joined = piece[i] + piece[j]
            rank[j] = rank[i] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = r = get(joined + piece[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            h = before[i]
            if h >= 0:
                rank[h] = r = get(piece[h] + joined, -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + h)
    return tokens + sum(len(c.encode()) - 1 for c in unit if c not in ranks)


class Counts(dict):
    """Unit -> tokens, filled on demand and bounded. A unit is cut between characters that are adjacent in no piece."""

    def __init__(self, ranks: dict[str, int], most: int = CACHE_UNITS):
        super().__init__()
        self.ranks, self.most, self.parts = ranks, most, {}
        self.adjacent = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.most:
            self.clear()
        if len(self.parts) >= self.most:
            self.parts.clear()
        total, start, adjacent, parts = 0, 0, self.adjacent, self.parts
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in adjacent:
                part = unit[start:i]
                got = parts.get(part)
                if got is None:
                    parts[part] = got = merge_count(part, self.ranks)
                total, start = total + got, i
        self[unit] = total
        return total


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, ranks: dict[str, int]):
        self.counts = Counts(ranks)
        additive = not any(MARK in p.lstrip(MARK) for p in ranks) and not any("\n" in p for p in ranks)
        self.units = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall if additive else (lambda text: [text])

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.units(MARK + text.replace(" ", MARK))))


_COUNTERS: dict[int, Counter] = {}


def counter_of(ranks: dict[str, int]) -> Counter:
    """The worker's counter for a vocabulary: its cache outlives a task when Spark uses the worker again."""
    key = hash(frozenset(ranks.items()))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(ranks)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    The vocabulary, bounded by the model file, is read on the driver and broadcast, so executors need no file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(vocabulary(model_path))

    def count(batches):
        import pyarrow as pa

        counter = counter_of(ranks.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [counter(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), model_path or public_tokenizers.path("piece_bpe_32k.model"))
