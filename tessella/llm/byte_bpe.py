"""Byte-level BPE encoding and decoding in Spark higher-order functions.

A text is split by the vocabulary's pattern. A word's bytes become an array of one-byte pieces (binary data shown as
ISO-8859-1 strings, one character a byte), and a fold merges the adjacent pair with the lowest rank, leftmost first,
until no pair is in the vocabulary. The ranks are a literal map. Spark looks keys up in a map one after another,
so the map is cut into BUCKETS small maps by crc32. The fold keeps the ranks of all adjacent pairs beside the pieces, so
a merge looks up two new pairs only. Decoding turns ids into pieces by a literal array and concatenates them.

Words repeat, so the fold is not run for each occurrence: the COMMON most frequent words of a sample of the documents
(one in SAMPLE) are encoded and decoded once, as distinct words, by the fold. This dictionary is bounded and is broadcast.

The pass over the documents is in Python on Arrow batches, and words outside the dictionary are merged there by the same
ranks with a heap: looked up and folded in higher-order functions too, the whole query was several times slower than
the limits allow (figures in the README). `encode_decode(native=True)` is that form; both give the same rows.
There is no shuffle of texts, and which words are common only saves work and changes no result.

Cases: null or empty text has no ids, and its hashes are those of the empty string; a word of n bytes takes n log n
steps (in the native form n - 1 fold steps over arrays of up to n entries); ids may be null or repeat; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, small_batches, text_of

BUCKETS, WORD_BUCKETS = 8192, 16384
#: Distinct words in the dictionary at most, and the share of documents whose words compete for it.
COMMON, SAMPLE = 60_000, 16
#: Words that a worker remembers beside the dictionary, about.
CACHE_WORDS = 500_000
NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bind(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bucketed(entries: dict[str, object], buckets: int) -> str:
    """JSON of `buckets` maps; a key is in the one that crc32 of its UTF-8 names."""
    maps: list[dict[str, object]] = [{} for _ in range(buckets)]
    for key, value in entries.items():
        maps[zlib.crc32(key.encode()) % buckets][key] = value
    return json.dumps(maps)


def _found(maps: Column, key: Column, buckets: int) -> Column:
    return F.element_at(F.get(maps, F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")), key)


def _fold(word: Column, ranks: Column) -> Column:
    """The pieces of a word: ranked merges over its bytes. ranks is bound to the literal maps."""
    rank = lambda a, b: F.coalesce(_found(ranks, F.concat(a, b), BUCKETS), F.lit(NONE))
    nothing = F.array().cast("array<int>")

    def start(raw: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substr(raw, i, F.lit(1)))
        pairs = lambda p: F.when(F.size(p) < 2, nothing).otherwise(F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(F.get(p, i), F.get(p, i + 1))))
        return _bind(parts, lambda p: F.struct(p.alias("p"), pairs(p).alias("r")))

    def merge(s: Column, k: Column) -> Column:  # k: place of the pair, from 1
        p, r = s["p"], s["r"]
        n = F.size(p)

        def put(joined: Column) -> Column:
            parts = F.concat(F.slice(p, F.lit(1), k - 1), F.array(joined), F.slice(p, k + 2, n))
            left = F.when(k > 1, F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), F.array(rank(F.get(p, k - 2), joined)))).otherwise(nothing)
            right = F.when(k + 1 < n, F.concat(F.array(rank(joined, F.get(p, k + 1))), F.slice(r, k + 2, n))).otherwise(nothing)
            return F.struct(parts.alias("p"), F.concat(left, right).alias("r"))

        return _bind(F.concat(F.get(p, k - 1), F.get(p, k)), put)

    def step(s: Column, _: Column) -> Column:
        low = lambda m: F.when(m.isNull() | (m == NONE), s).otherwise(_bind(F.array_position(s["r"], m).cast("int"), lambda k: merge(s, k)))
        return _bind(F.array_min(s["r"]), low)

    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return _bind(latin, lambda raw: F.aggregate(F.sequence(F.lit(1), F.length(raw)), start(raw), step, lambda s: s["p"]))


def _coded(word: Column, ranks: Column, pieces: Column) -> Column:
    """(i, d): the word's ids joined by commas, and its bytes as decoded from those ids."""

    def both(parts: Column) -> Column:
        ids = F.transform(parts, lambda x: _found(ranks, x, BUCKETS))
        return _bind(ids, lambda i: F.struct(F.array_join(i.cast("array<string>"), ",").alias("i"), F.array_join(F.transform(i, lambda k: F.get(pieces, k)), "").alias("d")))

    return _bind(_fold(word, ranks), both)


def merge_pieces(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word: the adjacent pair with the lowest rank merges first, the leftmost of equals, until none is left."""
    n, get = len(word), ranks.get
    piece = [word[i : i + 1] for i in range(n)]
    rank = [get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]  # of the pair that begins here
    heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if rank[i] != r:  # an end of the pair has merged since
            continue
        j = after[i]
        piece[i] = joined = piece[i] + piece[j]
        piece[j] = b""
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
    return [p for p in piece if p]


class Coded(dict):
    """Word -> (ids joined by commas, decoded bytes): the dictionary, and words merged on demand, bounded."""

    def __init__(self, known: dict[str, tuple[str, bytes]], ranks: dict[bytes, int]):
        super().__init__(known)
        self.known, self.ranks = known, ranks
        self.pieces = {k: p for p, k in ranks.items()}

    def __missing__(self, word: str) -> tuple[str, bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(self.known)
        ids = [self.ranks[p] for p in merge_pieces(word.encode(), self.ranks)]
        self[word] = got = (",".join(map(str, ids)), b"".join(self.pieces[i] for i in ids))
        return got


_CODED: dict[int, Coded] = {}


def coded_of(key: int, known: dict, ranks: dict[bytes, int]) -> Coded:
    """The worker's dictionary for a broadcast; it outlives a task when Spark uses the worker again."""
    if key not in _CODED:
        _CODED.clear()
        _CODED[key] = Coded(known, ranks)
    return _CODED[key]


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", native: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids (joined by commas) and decoded (binary)."""
    spark = docs.sparkSession
    small_batches(spark)
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, k in ranks.items():
        by_id[k] = piece.decode("latin-1")
    maps = F.from_json(F.lit(_bucketed({p.decode("latin-1"): k for p, k in ranks.items()}, BUCKETS)), "array<map<string,int>>")
    pieces = F.from_json(F.lit(json.dumps(by_id)), "array<string>")
    base = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"(?U)({pattern})"), F.lit(1))

    some = base.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counted = cut(some.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "pretokens")
    least, room = 2, COMMON
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(COMMON).collect():
        room -= r["words"]
        if room < 0:
            least = r["n"] + 1
            break
    common = counted.filter(F.col("n") >= least).repartition(spark.sparkContext.defaultParallelism).select("w")
    coded = common.select("w", _bind(maps, lambda m: _bind(pieces, lambda p: _coded(F.col("w"), m, p))).alias("c")).select("w", "c.i", "c.d")
    known = {r["w"]: (r["i"], r["d"]) for r in coded.toLocalIterator()}
    if native:
        return _native(base, {w: {"i": i, "d": d} for w, (i, d) in known.items()}, words, maps, pieces)

    held = spark.sparkContext.broadcast(({w: (i, d.encode("latin-1")) for w, (i, d) in known.items()}, ranks))
    # Unicode white space, as the library's pattern engine means it.
    told, key = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), uuid.uuid4().int

    def run(batches):
        import pyarrow as pa
        import regex

        split, table = regex.compile(told).findall, coded_of(key, *held.value)
        for b in batches:
            got = [[table[w] for w in split(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([",".join(i for i, _ in g) for g in got], pa.string()), pa.array([b"".join(d for _, d in g) for g in got], pa.binary())], ["doc_id", "ids", "decoded"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids string, decoded binary")


def _native(base: DataFrame, known: dict, words: Column, maps: Column, pieces: Column) -> DataFrame:
    """The pass over the documents in higher-order functions only."""
    dictionary = F.from_json(F.lit(_bucketed(known, WORD_BUCKETS)), "array<map<string,struct<i:string,d:string>>>")
    one = lambda k, m, p: lambda w: F.coalesce(_found(k, w, WORD_BUCKETS), _coded(w, m, p))
    join = lambda c: F.struct(F.array_join(F.transform(c, lambda x: x["i"]), ",").alias("ids"), F.encode(F.array_join(F.transform(c, lambda x: x["d"]), ""), "ISO-8859-1").alias("decoded"))
    done = _bind(dictionary, lambda k: _bind(maps, lambda m: _bind(pieces, lambda p: _bind(F.transform(words, one(k, m, p)), join))))
    return base.select("doc_id", done.alias("c")).select("doc_id", "c.ids", "c.decoded")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    n = F.when(F.col("ids") == "", F.lit(0)).otherwise(F.length(F.regexp_replace("ids", "[^,]+", "")) + 1).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
