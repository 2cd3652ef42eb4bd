"""Language-model scoring with a weighted backoff automaton.

Training counts cover every training document. Words are told apart by 64-bit hashes; each text ends with one end token.

Automaton. State 0 is the empty history; every counted word, and for order 3 every counted pair, is a state, and every counted n-gram is an arc
from the state of its history: none is dropped. With n occurrences of w after a history seen c times, the arc weighs
(n + PRIOR * P(w | shorter history)) / (c + PRIOR); a word without an arc takes the failure arc to the shorter history, which weighs
PRIOR / (c + PRIOR), and goes on from there (hierarchical Dirichlet smoothing: arcs and failure arc of a state sum to 1). In state 0 a known
word weighs (c(w) - d) / N, d from the counts of counts. The mass d V / N of unknown words is spread over spellings by
a letter model (bytes of the training words and an end mark), so an unknown word weighs less the longer and odder it is. One left-to-right
traversal carries the state, the longest counted history, and sums log10 weights.

Scale. Counts grow with the corpus and are never collected or broadcast. One scan packs documents into blocks of about BLOCK_BYTES,
compressed, as rows of a written table. A block's distinct n-grams, sorted by hash, are cut into hash ranges; all blocks' pieces of a
range meet in one task, which adds up their counts and sends each block the sums in the block's own order, without the hashes. So the hashes are shuffled
once, and a block meets only the part of the automaton that its texts can reach. A word as frequent as one likes is one entry for each block. Ranges
grow in number with the volume, so a task holds about PART_BYTES of text's n-grams whatever the input.

Cases: null or empty text is the end token alone; a very long text is a block by itself; without training documents N and V are 0 and every probability is 1;
ids may be null or repeat, each row is scored; equal texts get equal scores; an empty table gives an empty result; only the id and text columns (and those of the training
column) are read, so others may clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, documents, fold, small_batches, text_of
from .ngram_jaccard import _HASHES, _mix

#: Bytes of text in a block, and in the n-grams of a hash range, about.
BLOCK_BYTES, PART_BYTES = 8_000_000, 32_000_000
#: Longest n-gram of the query, and how many occurrences the shorter history weighs.
ORDER, PRIOR = 2, 8.0
#: The end token is no word, so its hash is that of a byte string no word can be.
END = b" "
_SPACES = b" \t\n\x0b\x0c\r"


def _words(texts: list[bytes]) -> list[list[bytes]]:
    return [[*t.lower().split(), END] for t in texts]


def _hashes(words: list[list[bytes]]):
    """(hashes of all tokens of all texts, tokens of each text)."""
    import numpy as np

    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((_HASHES[w] for t in words for w in t), np.uint64, int(n.sum())), n


def _places(n):
    """The place of each token in its text, from n tokens for each text."""
    import numpy as np

    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def grams(h, places, order: int):
    """(keys of the n-grams of `order` tokens that end at a token, the tokens at which one ends)."""
    import numpy as np

    ends = np.flatnonzero(places >= order - 1)
    keys = h[ends - (order - 1)]
    with np.errstate(over="ignore"):
        for k in range(order - 2, -1, -1):
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + h[ends - k])
    return keys, ends


def pack_keys(keys) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are zeros, which the shuffle's compression takes away."""
    import numpy as np

    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes):
    import numpy as np

    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts) -> bytes:
    import zlib

    import numpy as np

    return zlib.compress(np.asarray(counts, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(data: bytes):
    import zlib

    import numpy as np

    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)


def _blocks(base: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block: block, ids, train, lens, texts (compressed), letters (training bytes by value, then words)."""

    def row(ids, train, texts, block):
        import numpy as np
        import pyarrow as pa
        import zstandard

        learned = b"".join(t.lower() for t, x in zip(texts, train) if x)
        letters = np.bincount(np.frombuffer(learned, np.uint8), minlength=257)
        letters[list(_SPACES)] = 0
        letters[256] = sum(len(t.split()) for t, x in zip(texts, train) if x)
        held = pa.concat_arrays(ids)
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        lens, blob = pa.array([len(t) for t in texts], pa.int64()), zstandard.ZstdCompressor(3).compress(b"".join(texts))
        columns = [pa.array([block], pa.int64()), listed(held), listed(pa.array(train, pa.bool_())), listed(lens), pa.array([blob], pa.binary()), listed(pa.array(letters.astype(np.int64)))]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "train", "lens", "texts", "letters"])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, train, texts, size = [], [], [], 0
        for b in batches:
            first = 0
            found = as_bytes(b.column("text"))
            for i, t in enumerate(found):
                size += len(t)
                if size >= block_bytes or i == len(found) - 1:
                    ids.append(b.column("doc_id").slice(first, i + 1 - first))
                    train += b.column("train").slice(first, i + 1 - first).to_pylist()
                    texts += found[first : i + 1]
                    first = i + 1
                if size >= block_bytes:
                    yield row(ids, train, texts, block)
                    block += 1
                    ids, train, texts, size = [], [], [], 0
        if texts:
            yield row(ids, train, texts, block)

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"block long, ids array<{kind}>, train array<boolean>, lens array<long>, texts binary, letters array<long>")


def _texts(blob: bytes, lens) -> list[bytes]:
    import zstandard

    whole, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for n in lens:
        out.append(whole[at : at + n])
        at += n
    return out


def _pieces(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """(size, part, block, keys, counts): a block's distinct n-grams of each size within a hash range, and their occurrences in training documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for b in batches:
            for block, train, lens, texts in zip(*(b.column(c).to_pylist() for c in ("block", "train", "lens", "texts"))):
                h, n = _hashes(_words(_texts(texts, lens)))
                places, learned = _places(n), np.repeat(np.array(train, bool), n)
                for size in range(1, order + 1):
                    keys, ends = grams(h, places, size)
                    if not len(keys):
                        continue
                    distinct, at = np.unique(keys, return_inverse=True)
                    counts = np.bincount(at, weights=learned[ends], minlength=len(distinct)).astype(np.int64)
                    cuts = [0, *np.searchsorted(distinct, bounds).tolist(), len(distinct)]
                    rows = [(k, x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                    columns = [pa.array([size] * len(rows), pa.int32()), pa.array([k for k, _, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64())]
                    columns += [pa.array([pack_keys(distinct[x:y]) for _, x, y in rows], pa.binary()), pa.array([pack_counts(counts[x:y]) for _, x, y in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["size", "part", "block", "keys", "counts"])

    return blocks.select("block", "train", "lens", "texts").mapInArrow(run, "size int, part int, block long, keys binary, counts binary")


def _summed(table):
    """The pieces of one range with the sums over all blocks in place of each block's own counts; the first row has the range's total, distinct, ones and twos."""
    import numpy as np
    import pyarrow as pa

    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    found, cuts = sums[at], np.cumsum([0, *map(len, keys)]).tolist()
    first = lambda x: pa.array([int(x)] + [0] * (len(keys) - 1), pa.int64())
    names = ["size", "part", "block", "counts", "total", "distinct", "ones", "twos"]
    columns = [table.column(c) for c in names[:3]] + [pa.array([pack_counts(found[x:y]) for x, y in zip(cuts, cuts[1:])], pa.binary())]
    return pa.table([*columns, first(sums.sum()), first((sums > 0).sum()), first((sums == 1).sum()), first((sums == 2).sum())], names)


def spelling(words: list[bytes], letters):
    """Probability of each word's letters and its end, from bytes counted by value and then words."""
    import numpy as np

    log = np.log(letters + 1.0) - np.log(letters.sum() + len(letters))
    return np.exp(np.array([log[np.frombuffer(w, np.uint8)].sum() + log[256] for w in words]))


def traverse(p, places, counts):
    """log10 weight of every token: p weights in state 0, counts of the n-grams of 1, 2, .. tokens that end at each token (0: no such arc)."""
    import numpy as np

    for size, arcs in enumerate(counts[1:], 2):
        state = np.r_[0, counts[size - 2][:-1]]  # how often the history of size - 1 tokens was seen
        held = (places >= size - 1) & (state > 0)
        p = np.where(held, (arcs + PRIOR * p) / (state + PRIOR), p)
    return np.log10(p)


def score(docs: DataFrame, train_column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score. train_column marks training rows."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"), F.coalesce(train_column, F.lit(False)).alias("train"))
    blocks = cut(_blocks(base, BLOCK_BYTES), "blocks")
    volume = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    parts = max(1, -(-volume // PART_BYTES))
    told = _pieces(blocks, order, parts).groupBy("size", "part").applyInArrow(_summed, "size int, part int, block long, counts binary, total long, distinct long, ones long, twos long")
    told = cut(told, "told")
    total, known, n1, n2 = (x or 0 for x in told.filter("size = 1").agg(*(F.sum(c) for c in ("total", "distinct", "ones", "twos"))).first())
    by_value = blocks.select(F.posexplode("letters").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # 257 rows
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        letters = np.zeros(257)
        for k, n in by_value:
            letters[k] = n
        out = {c: [] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for lens, texts in zip(left.column("lens").to_pylist(), left.column("texts").to_pylist()):  # one row
            words = _words(_texts(texts, lens))
            h, n = _hashes(words)
            places, counts = _places(n), []
            pieces = sorted(zip(*(right.column(c).to_pylist() for c in ("size", "part", "counts"))))
            for size in range(1, order + 1):
                keys, ends = grams(h, places, size)
                counts.append(np.zeros(len(h), np.int64))
                if len(keys):
                    sums = np.concatenate([unpack_counts(c) for s, _, c in pieces if s == size])  # in the order of the block's distinct keys
                    distinct, at = np.unique(keys, return_inverse=True)
                    assert len(distinct) == len(sums)
                    counts[-1][ends] = sums[at]
            c = counts[0]
            p = np.ones(len(h))
            if total:
                p = (c - d) / total
                new = np.flatnonzero(c == 0)
                flat = [w for t in words for w in t]
                p[new] = np.maximum(d * known / total * spelling([flat[i] for i in new], letters), 1e-300)
            starts = np.cumsum(n) - n
            sums = lambda x: np.add.reduceat(x, starts) if len(x) else x  # noqa: B023, E731
            values = (n, sums((c > 0).astype(np.int64)), np.full(len(n), total, np.int64), sums(np.log10((c + 1) / (total + known + 1))), sums(traverse(p, places, counts)))
            for held, x in zip(out.values(), values):
                held.append(x)
        ids = pa.concat_arrays([x.flatten() for x in left.column("ids").chunks]) if left.num_rows else pa.array([], left.schema.field("ids").type.value_type)
        return pa.table([ids, *(pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(out.values(), (pa.int64(),) * 3 + (pa.float64(),) * 2))], ["doc_id", *out])

    kind = base.schema["doc_id"].dataType.simpleString()
    pairs = blocks.select("block", "ids", "lens", "texts").groupBy("block").cogroup(told.select("block", "size", "part", "counts").groupBy("block"))
    return pairs.applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fold(docs["doc_id"], 7) != 2)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
