"""Sum-of-squares packing of token sequences.

Each document becomes its token ids plus an end id; a longer one is cut into full pieces and a rest. A piece of
length s goes to an open sequence of residual gap g >= s, or to a new one, such that afterwards the sum over
all gaps of the squared number of open sequences with that gap is smallest. With N(g) such sequences, moving
one from g to g - s changes the sum by 2 (N(g - s) - N(g)) + 2, filling it (g = s) by 1 - 2 N(s), and a new one by
2 N(limit - s) + 1 (a full sequence is closed and counts no more); ties take the smaller gap, and an open sequence before a new one. Pieces come longest first, so small pieces fill
what large ones leave.

Scale. Token ids never leave the Arrow batch in which they are made: only piece lengths and checksums are
packed. Pieces are dealt by a hash of the document id into shards of about SHARD_PIECES pieces, each packed on
its own in one task; a shard ends with few open sequences, so the loss is a small constant per
SHARD_PIECES pieces. Full pieces are sequences by themselves and are not dealt at all.

Ids. Texts of tokenizers that drop white space and join nothing across it (`chunked`, checked on the definition) are encoded by distinct
chunks, which a worker remembers; any other tokenizer's are encoded whole. The ids are the library's in both cases.

Cases: null text is empty and is packed as its end id alone; very long texts are cut, nothing is dropped; rows that repeat
an id are packed once for each row; pieces of equal length are taken in row order; an empty table gives an empty result; only the id and text columns are read, so others may clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, documents, small_batches, text_of

LIMIT, END = 4096, 1
#: Pieces in a shard, about. The packer keeps counts by gap and stacks of open sequences: memory follows this number only.
SHARD_PIECES = 50_000
#: Texts that are encoded together.
TEXTS_AT_ONCE = 256
#: Chunks between white space whose ids a worker remembers, and words that go to the library as one text.
CACHE_CHUNKS, WORDS_AT_ONCE = 2_000_000, 4000

#: ASCII punctuation that may end a chunk; marks of contractions and of special tokens are not among it.
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: First bytes of the marks that may compose with an ASCII letter before it is put in lower case (U+0300 to U+036F).
MARKS = (b"\xcc", b"\xcd")
APART = re.compile(rb"([,.])(?<=[a-z].)(?=[ \n])").sub
#: The steps of the one kind of tokenizer for which a text's ids are those of its chunks between ASCII white space, one after another.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def chunked(definition: str) -> bool:
    """Whether texts may be encoded by their chunks: the steps are CHUNKED, words have an end mark, and no added token holds white space or letters alone."""
    held = json.loads(definition)
    model = held["model"]
    plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["content"].isalpha() and not re.search(r"\s", t["content"]) for t in held["added_tokens"])
    return plain and all(held[k] == v for k, v in CHUNKED.items()) and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]


def sliced(strings) -> list[bytes]:
    """The values of an Arrow large string array without nulls, by slices of its buffer."""
    import numpy as np

    _, ends, data = strings.buffers()
    bounds = np.frombuffer(ends, np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist() if len(strings) else []
    raw = data.to_pybytes() if data else b""
    return [raw[x:y] for x, y in zip(bounds, bounds[1:])]


class Ids(dict):
    """Chunk of a text between ASCII white space (UTF-8) -> its ids as little-endian unsigned 32-bit integers, for `chunked` tokenizers."""

    def __init__(self, tokenizer, most: int = CACHE_CHUNKS):
        import numpy as np

        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.marks = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
        # ASCII words in lower case pass the steps before the merges unchanged, so a tokenizer without these gives their ids.
        self.bare = type(tokenizer).from_str(json.dumps(json.loads(tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, new: set[bytes]) -> None:
        """Adds new chunks.

        A word of letters alone whose lower-cased form has letters alone is one word of the tokenizer, and so is apart from the punctuation after it:
        only new words and tails are encoded, ASCII words in lower case. All other chunks are encoded whole.
        """
        if len(self) + 2 * len(new) > self.most:
            self.clear()
        lower = [c for c in new if c.isalpha() and c.islower()]  # ASCII letters alone
        words, cut_up, odd = set(), [], set()
        for c in new.difference(lower):
            if c.isalpha():
                cut_up.append((c, c.lower(), b""))
                words.add(c.lower())
                continue
            word = c.rstrip(TAIL)
            if word.isascii():
                fits, stem = word.isalpha() or not word, word.lower()
            else:
                shown, stem = word.decode(), word
                fits = shown.isalpha() and shown.lower().isalpha()
            if not fits or not word:
                odd.add(c)
                continue
            words.add(stem)
            if stem != c:
                tail = c[len(word) :]
                cut_up.append((c, stem, tail))
                if tail:
                    odd.add(tail)
        self.encode(list(odd.difference(self)))
        fresh = words.difference(self, lower)
        self.encode_words(lower + [w for w in fresh if w.isascii()], self.bare)
        self.encode_words([w for w in fresh if not w.isascii()], self.tokenizer)
        for c, stem, tail in cut_up:
            self[c] = self[stem] + self[tail] if tail else self[stem]

    def encode(self, chunks: list[bytes]) -> None:
        for c, got in zip(chunks, self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)):
            ids = got.ids
            self[c] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_words(self, words: list[bytes], tokenizer) -> None:
        """Many words as one text, cut at the ids that end a word; where these are not as many as the words, one by one."""
        import numpy as np

        for first in range(0, len(words), WORDS_AT_ONCE):
            some = words[first : first + WORDS_AT_ONCE]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            bounds = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(bounds) != len(some) + 1:
                self.encode(some)
                continue
            raw = ids.tobytes()
            for w, x, y in zip(some, bounds, bounds[1:]):
                self[w] = raw[x:y]

    def plain(self, text: bytes) -> bytes:
        """The text with fewer distinct chunks and the same ids: ASCII letters in lower case, a comma or stop after one apart from it. A text stays in which that could make an added token, or
        in which a capital may compose with a mark first."""
        low = text.lower()
        return text if any(m in low for m in (*MARKS, *self.marks)) else APART(rb" \1", low)

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts. Arrow tells their chunks apart, only distinct ones are looked up, those not known yet are learned together, and numpy deals the ids out."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        chunks = pc.ascii_split_whitespace(pa.array([self.plain(t) for t in texts], pa.large_binary()).view(pa.large_string()))
        coded = chunks.values.dictionary_encode()
        distinct = sliced(coded.dictionary)
        found = list(map(self.get, distinct))
        if not all(found):  # a chunk of no ids leads here, too
            self.learn({c for c, ids in zip(distinct, found) if ids is None})
            found = [self[c] if ids is None else ids for c, ids in zip(distinct, found)]
        flat = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(length) - length
        at = coded.indices.to_numpy()
        n = length[at]
        stop = np.concatenate([[0], np.cumsum(n)])
        raw = flat[np.repeat(first[at] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        bounds = (4 * stop[chunks.offsets.to_numpy()]).tolist()
        return [raw[x:y] for x, y in zip(bounds, bounds[1:])]


class WholeTexts:
    """The ids of whole texts by the library, for all other tokenizers."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [struct.pack(f"<{len(got.ids)}I", *got.ids) for got in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


_IDS: dict[int, Ids | WholeTexts] = {}


def ids_of(definition: str) -> Ids | WholeTexts:
    """The worker's cache for a tokenizer; it outlives a task when Spark uses the worker again."""
    key = zlib.crc32(definition.encode())
    if key not in _IDS:
        from tokenizers import Tokenizer

        _IDS.clear()
        tokenizer = Tokenizer.from_str(definition)
        _IDS[key] = Ids(tokenizer) if chunked(definition) else WholeTexts(tokenizer)
    return _IDS[key]


def pieces(docs: DataFrame, definition: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of docs (doc_id, text); definition is the tokenizer's JSON."""
    held = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = ids_of(held.value)
        tail = end.to_bytes(4, "little")
        for b in batches:
            texts = as_bytes(b.column("text"))
            out = [[] for _ in range(5)]
            at = []
            for first in range(0, len(texts), TEXTS_AT_ONCE):
                for i, got in enumerate(ids.whole(texts[first : first + TEXTS_AT_ONCE]), first):
                    whole = got + tail
                    for k, start in enumerate(range(0, len(whole), 4 * limit)):
                        part = whole[start : start + 4 * limit]
                        at.append(i)
                        for column, x in zip(out, (k, start // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(x)
            cols = [b.column("doc_id").take(pa.array(at, pa.int64())), b.column("row").take(pa.array(at, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(out[k], pa.int64()) for k in (1, 2, 3))]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array(out[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def sum_of_squares(lengths, limit: int = LIMIT):
    """(sequence, offset) for each length, taken in the order given. Sequences are numbered from 0."""
    import numpy as np

    count = np.zeros(limit + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    absent = np.iinfo(np.int64).max
    for i, s in enumerate(lengths):
        # Change of the sum less 1: 2 (N(g - s) - N(g)) + 1; a full sequence no longer counts; a new one adds 2 N(limit - s).
        held = count[s:] > 0
        fresh = 2 * count[limit - s] if s < limit else -1
        if held.any():
            change = 2 * (count[: limit + 1 - s] - count[s:]) + 1
            change[0] = -2 * count[s]
            change[~held] = absent
            k = int(change.argmin())
            if change[k] <= fresh:
                g = s + k
                q = stacks[g].pop()
                count[g] -= 1
                sequence[i], offset[i] = q, limit - g
                if k:
                    stacks[k].append(q)
                    count[k] += 1
                continue
        sequence[i], offset[i] = opened, 0
        if s < limit:
            stacks[limit - s].append(opened)
            count[limit - s] += 1
        opened += 1
    return sequence, offset


def pack(docs: DataFrame, definition: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    made = cut(pieces(base, definition, limit, end, keep_ids), "pieces")
    shards = max(1, round(made.filter(F.col("length") < limit).count() / SHARD_PIECES))
    alone = made.filter(F.col("length") == limit)
    # Full pieces: a sequence number from the row and piece, negative so that it meets no packed one.
    whole = alone.withColumn("sequence_id", -(F.monotonically_increasing_id() + 1)).withColumn("offset", F.lit(0).cast("long"))
    rest = made.filter(F.col("length") < limit).select("doc_id", "row", "piece", "start", "length", "ids_crc32").withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        lengths, row, piece = (table.column(c).to_numpy() for c in ("length", "row", "piece"))
        order = np.lexsort((piece, row, -lengths))
        table = table.take(pa.array(order))
        sequence, offset = sum_of_squares(lengths[order].tolist(), limit)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence * shards + key[0].as_py())).append_column("offset", pa.array(offset))

    kind = made.schema["doc_id"].dataType.simpleString()
    packed = rest.groupBy("shard").applyInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if keep_ids:
        packed = packed.join(made.select("row", "piece", "ids"), ["row", "piece"])
        columns.append("ids")
    return whole.select(columns).unionByName(packed.select(columns))


def tokenizer_definition(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver; executors get it by broadcast (its size is that of the file)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_definition())
