"""Exact Jaccard join of word-shingle sets by a size-aware heavy-light split, and its connected components.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Documents with one and the same set are
one vertex (the 64-bit hash of the set), so copies are never paired; of rows with one and the same text only one is read for its set.

Candidates. Elements are ordered rarest first (a bounded list of the most common elements of a sample of the
documents goes last, all others by hash; any total order gives the whole result, this one keeps lists short).
With t = ceil(0.8 n) every partner of a set of n elements shares at least t of them, so

* light sets (n up to a boundary) enumerate all subsets of SUBSET = 2 elements of their first n - t + 2
  elements: two linked light sets have such a subset in common;
* heavy sets scan the inverted lists of their first n - t + 1 elements: a linked pair with a heavy side has
  such an element in common. Light sets that are large enough to be linked with a heavy one (n >= 0.8 x
  boundary) are listed too. A row of a list holds the element's place i in the set's order. Of a linked pair, the lesser set has its first common
  element within its first n - ceil(1.6 n / 1.8) + 1, and neither set has more than n - i elements from there on:
  other pairs of a list are not formed, so a passage that makes up little of its documents pairs none of them.

The boundary is where the subsets cost as much as the lists: C(n-t+2, 2) subset rows against n-t+1 list rows,
each followed by the entries that the list of a rare element holds on average (estimated from the sample).

Decisions. A bucket (the members of one subset or list) is not expanded into all pairs. In each round a bucket
names a few pivots (the members of lowest and highest hash, and those within a hash bound), all members that are not yet in a pivot's component are paired with it, and the components
are joined; then the pivots leave. A bucket ends when its members are in one component or no pair of them can be linked; buckets of up to
SMALL members name all. Each round names more pivots than the last, so rounds are few and no link between components is ever lost.

Verification. A vertex has a parity bitmap of its set (one bit for each element or two). The bits in which two bitmaps differ are no
more than the elements in which the sets differ, so most pairs that aren't linked fall there, without their sets. The
others are compared by whole sets: each text goes once to the tasks of its pivots, at most STAR others beside a pivot.

Cases: null or empty text has an empty set and is linked with nothing; fewer than five words make one shingle; a very long text is
one set like any other; ties of rank are ordered by hash;
vertices are contents, so null and repeated ids and repeated rows do no harm (component_id is the smallest id that is not null); an
empty table gives an empty result; only the id and text columns are read, so others may clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, checked, cut, discard, documents, small_batches, text_of

WORDS = 5
#: A link: PERCENT * |union| <= 100 * |intersection|.
PERCENT = 80
SUBSET = 2
#: One document in SAMPLE tells how common elements are; at most COMMON elements are put last (8 bytes each).
SAMPLE, COMMON = 16, 300_000
#: In buckets of up to SMALL members all are pivots; larger ones name two, and about PIVOTS in the first round and MORE times as many in each further one.
SMALL, PIVOTS, MORE = 4, 2, 8
#: Texts beside a pivot in one task, about.
STAR = 64
#: Bits of a parity bitmap, at least.
BITS = 512
#: Entries of a light set's subset row or a heavy set's list row; salts keep the two kinds apart.
LIGHT, HEAVY = 1, 2


class WordHash(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_HASHES = WordHash()


def _mix(x):
    """A bijective 64-bit finaliser, on numpy arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS):
    """The sorted distinct shingle hashes of a text: A-Z lower-cased, words between ASCII white space."""
    import numpy as np

    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def least_overlap(n, m, percent: int = PERCENT):
    """Smallest intersection of linked sets of n and m elements: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def boundary(list_length: float, percent: int = PERCENT, most: int = 4096) -> int:
    """Largest set size for which subsets cost no more than lists."""
    best = 0
    for n in range(1, most):
        t = -(-percent * n // 100)
        if math.comb(n - t + SUBSET, SUBSET) > (n - t + 1) * (1.0 + list_length):
            break
        best = n
    return best


def rare_list_length(counted: DataFrame, percent: int = PERCENT) -> float:
    """About how many entries the list of an element of a prefix has: the mean over the rarest 100 - percent per cent of the sampled occurrences."""
    bands = counted.groupBy(F.floor(F.log2("f")).alias("band")).agg(F.sum("f").alias("f"), F.sum(F.col("f") * (1 + (F.col("f") - 1) * SAMPLE)).alias("entries")).orderBy("band").collect()
    room = whole = sum(r["f"] for r in bands) * (100 - percent) / 100
    entries = 0.0
    for r in bands:
        part = min(1.0, room / r["f"])
        entries, room = entries + part * r["entries"], room - part * r["f"]
        if room <= 0:
            break
    return entries / whole if whole else 1.0


def parity(s) -> bytes:
    """The parity bitmap of a set: a power of two of bits, at least BITS and at least one for each element."""
    import numpy as np

    bits = max(BITS, 1 << (max(1, len(s)) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two parity bitmaps differ; the longer one is folded to the length of the other."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _vertices(sets):
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _sampled(docs: DataFrame) -> DataFrame:
    """(h, f): in how many different texts of a sample, one document in SAMPLE, an element occurs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            parts = [shingles(t) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64), pa.int64())], ["h"])

    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    return chosen.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("f"))


def _entries(s, size: int, edge: int, percent: int):
    """(bucket hashes, places) of a set in its order: subsets of a light one (place -1), list places of a heavy one or one that a heavy one may be linked with."""
    import itertools

    import numpy as np

    t = -(-percent * size // 100)
    keys, places = [], []
    with np.errstate(over="ignore"):
        if size <= edge:
            pairs = np.array(list(itertools.combinations(range(min(size, size - t + SUBSET)), SUBSET)), np.int64).reshape(-1, 2)
            low, high = np.minimum(s[pairs[:, 0]], s[pairs[:, 1]]), np.maximum(s[pairs[:, 0]], s[pairs[:, 1]])
            keys.append(_mix(_mix(low) + high + np.uint64(LIGHT)))
            places.append(np.full(len(low), -1, np.int32))
        if size > edge or 100 * size >= percent * edge:
            keys.append(_mix(s[: size - t + 1] + np.uint64(HEAVY)))
            places.append(np.arange(size - t + 1, dtype=np.int32))
    return np.concatenate(keys), np.concatenate(places)


def _profiles(docs: DataFrame, common, edge: int, percent: int) -> DataFrame:
    """(doc_id, t, n, v, bits, buckets, places): v stands for the whole set (null for the empty one), bits is its parity bitmap."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = common.value
        listed = lambda lens, x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(x))
        for b in batches:
            sets = [shingles(t) for t in as_bytes(b.column("text"))]
            n = np.array([len(s) for s in sets], np.int64)
            ends = np.cumsum(n)
            often = np.zeros(int(n.sum()), np.uint32)
            if len(known) and n.sum():  # how common each element is, for the whole batch at once
                whole = np.concatenate(sets)
                at = np.searchsorted(known["h"], whole)
                at[at == len(known)] = 0
                often = np.where(known["h"][at] == whole, known["f"][at], 0)
            keys, places = [], []
            for s, end in zip(sets, ends):
                size = len(s)
                if not size:
                    keys.append(np.empty(0, np.uint64))
                    places.append(np.empty(0, np.int32))
                    continue
                rank = often[end - size : end]
                k, i = _entries(s[np.argsort(rank, kind="stable")] if rank.any() else s, size, edge, percent)
                keys.append(k)
                places.append(i)
            lens = [len(k) for k in keys]
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            where = np.concatenate(places) if places else np.empty(0, np.int32)
            columns = [b.column("doc_id"), b.column("t"), pa.array(n), pa.array(_vertices(sets), mask=n == 0), pa.array([parity(s) for s in sets], pa.binary()), listed(lens, flat), listed(lens, where)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n", "v", "bits", "buckets", "places"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n long, v long, bits binary, buckets array<long>, places array<int>")


def _need(x, y, percent: int):
    """least_overlap on columns."""
    return F.floor((percent * (x + y) + (99 + percent)) / (100 + percent))


def _indexed(n, i, percent: int):
    """Whether an element at place i can be the first that a set of n shares with one as large or larger."""
    return (i < 0) | (i <= n - _need(n, n, percent))


def _alike(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, p) that the parity bitmaps (v, n, bits) let pass."""

    def run(batches):
        import pyarrow as pa

        for x in batches:
            rows = zip(*(x.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))
            keep = [differing(sa, sb) <= na + nb - 2 * least_overlap(na, nb, percent) for na, nb, sa, sb in rows]
            yield x.select(["a", "b", "p"]).filter(pa.array(keep, pa.bool_()))

    of = lambda x: bits.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "p", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, p long")


def _verified(pairs: DataFrame, base: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, p) whose whole sets are linked; p is a or b, the pivot. base (doc_id, text) has the texts, ids (v, id) a document of each vertex."""
    stars = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    other = F.when(F.col("a") == F.col("p"), F.col("b")).otherwise(F.col("a"))
    dealt = pairs.join(stars, "p").select("p", other.alias("v"), F.pmod(F.xxhash64(other), F.ceil(F.col("m") / STAR).cast("long")).alias("part"))
    roles = dealt.select("p", "part", "v").union(dealt.select("p", "part", F.col("p").alias("v")).distinct())
    told, _ = checked(roles.join(ids, "v").select("id", "p", "part", "v"), "roles")
    texts = base.join(told, F.col("doc_id").eqNullSafe(F.col("id"))).select("p", "part", "v", "text")

    def run(table):
        import numpy as np
        import pyarrow as pa

        sets = [shingles(t) for t in as_bytes(table.column("text").combine_chunks())]
        v, same = table.column("v").to_numpy(), _vertices(sets) if sets else np.empty(0, np.int64)
        pivot = table.column("p")[0].as_py()
        held = {int(x): s for x, y, s in zip(v, same, sets) if x == y}  # of rows that share an id, the one meant
        out, mine = [], held.get(pivot)
        for x, s in held.items() if mine is not None else ():
            place = np.searchsorted(mine, s)
            place[place == len(mine)] = 0
            both = int((mine[place] == s).sum())
            if x != pivot and 100 * both >= percent * (len(mine) + len(s) - both):
                out.append((min(x, pivot), max(x, pivot)))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return texts.groupBy("p", "part").applyInArrow(run, "a long, b long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (v, comp) after the links (a, b) have joined their components; a component bears its smallest vertex."""
    of = lambda x, c: labels.select(F.col("v").alias(x), F.col("comp").alias(c))
    ends = links.join(of("a", "ca"), "a").join(of("b", "cb"), "b").filter("ca <> cb")
    edges = cut(ends.select(F.greatest("ca", "cb").alias("hi"), F.least("ca", "cb").alias("lo")).distinct(), "edges")
    if edges.isEmpty():
        discard(edges)
        return labels
    roots = _contract(edges)
    joined = cut(labels.join(roots, labels.comp == roots.hi, "left").select("v", F.coalesce("root", "comp").alias("comp")), "labels")
    discard(edges, labels)
    return joined


def _contract(edges: DataFrame) -> DataFrame:
    """(hi, root): a label for labels that edges join, by large-star and small-star steps until every vertex hangs at its smallest."""
    e, held, before = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")), None, None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut(large.join(up, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(up.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held is not None:
            discard(held)
        if now == before:
            return small.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "hi")
        e, held, before = small, small, now


def _linked(rows: DataFrame, bits: DataFrame, base: DataFrame, ids: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """labels (v, comp) of the components that the linked pairs of the buckets' rows (bucket, v, n, i) make, round by round."""
    done, held, step = None, [], 0
    own = F.col("v").alias("comp")
    live = rows.select("bucket", "v", "n", "i", own)
    while True:
        hashed = F.xxhash64("v", F.lit(step))
        state = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(hashed).alias("low"), F.max(hashed).alias("high"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max(_indexed(F.col("n"), F.col("i"), percent)).alias("some"))
        state = state.filter("lo <> hi and some").select("bucket", "m", "low", "high", "least")
        able = _need(F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100)), percent) <= F.col("n") - F.greatest("i", F.lit(0))
        many = F.when(F.col("m") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("m") / (PIVOTS * MORE**step))).cast("long")
        pivot = hashed.isin(F.col("low"), F.col("high")) | (F.pmod(hashed, many) == 0)
        kept = cut(live.join(state, "bucket").filter(able).select("bucket", "v", "n", "i", "comp", pivot.alias("pivot")), "rows")
        discard(*held)
        held = [kept]
        if kept.isEmpty():
            discard(kept, *([done] if done is not None else []))
            return labels
        x, y = kept.alias("x"), kept.filter("pivot").alias("y")
        n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i")
        first = ((n <= m) & _indexed(n, i, percent)) | ((m <= n) & _indexed(m, j, percent))
        reach = F.least(n - F.greatest(i, F.lit(0)), m - F.greatest(j, F.lit(0))) >= _need(n, m, percent)
        fits = (F.col("x.comp") != F.col("y.comp")) & (~F.col("x.pivot") | (F.col("x.v") < F.col("y.v"))) & first & reach & (F.greatest(n, m) * percent <= F.least(n, m) * 100)
        pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & fits).select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"), F.col("y.v").alias("p"))
        pairs = pairs.groupBy("a", "b").agg(F.max("p").alias("p"))
        pairs = cut(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        near = cut(_alike(pairs, bits, percent), "near")
        links = cut(_verified(near, base, ids, percent), "links")
        labels = components(labels, links)
        discard(near, links)
        if done is None:
            done = pairs
        else:
            both = cut(done.union(pairs), "done")
            discard(done, pairs)
            done = both
        # A pivot has met all other members of its bucket.
        live = kept.filter("not pivot").select("bucket", "v", "n", "i").join(labels, "v").select("bucket", "v", "n", "i", "comp")
        step += 1


def _known_first(c: str):
    """For a minimum that takes a null only where there is nothing else."""
    return F.struct(F.col(c).isNull(), F.col(c))


def _copies(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, t) of all rows, (__id, __t) of the rows whose text another row with a lower id has): t is the hash of the text."""
    rows = cut(base.select("doc_id", F.xxhash64(text_of()).alias("t")), "texts")
    several = rows.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min(_known_first("doc_id")).getField("doc_id").alias("id")).filter("m > 1").select("t", "id")
    return rows, rows.join(several, "t").filter(~F.col("doc_id").eqNullSafe(F.col("id"))).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()


def jaccard_join(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, t (hash of the text), n_shingles, component_id, class_id (the smallest id with an equal set)."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    firsts, copies = _copies(base)
    base = base.withColumn("t", F.xxhash64(text_of()))
    held, n = checked(copies, "copies")
    distinct = base.join(held, base.doc_id.eqNullSafe(F.col("__id")) & (base.t == F.col("__t")), "left_anti") if n else base
    counted = cut(_sampled(distinct), "sampled")
    edge = boundary(rare_list_length(counted, percent), percent)
    common = spark.sparkContext.broadcast(_common(counted))
    discard(counted)
    profiles = cut(_profiles(distinct.select("doc_id", "t", "text"), common, edge, percent), "profiles")
    sets = profiles.select("doc_id", "t", F.col("n").alias("n_shingles"), "v")
    classes = cut(sets.filter("v is not null").groupBy("v").agg(F.min("doc_id").alias("class_id"), F.min(_known_first("doc_id")).getField("doc_id").alias("id")), "classes")
    rows = profiles.select("v", F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("buckets", "places")).alias("x")).select(F.col("x.buckets").alias("bucket"), "v", "n", F.col("x.places").alias("i"))
    bits = profiles.filter("v is not null").groupBy("v").agg(F.first("n").alias("n"), F.min("bits").alias("bits"))
    labels = _linked(rows, bits, base, classes.select("v", "id"), cut(classes.select("v", F.col("v").alias("comp")), "labels"), percent)
    whole = classes.join(labels, "v").select("v", "class_id", "comp")
    least = whole.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    found = whole.join(least, "comp").select("v", "class_id", "component_id")
    alone = lambda c: F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    told = sets.select("t", "n_shingles", "v").dropDuplicates(["t"]).join(found, "v", "left")
    return firsts.join(told, "t").select("doc_id", "t", "n_shingles", alone("component_id"), alone("class_id"))


def _common(counted: DataFrame):
    """The most common sampled elements as a sorted array of (h, f), at most COMMON of them."""
    import numpy as np

    rows = counted.filter("f > 1").orderBy(F.col("f").desc(), "h").limit(COMMON).toPandas()
    out = np.empty(len(rows), [("h", np.uint64), ("f", np.uint32)])
    out["h"], out["f"] = rows["h"].to_numpy(np.int64).view(np.uint64), rows["f"].to_numpy()
    return np.sort(out, order="h")


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns: of each component the document with the smallest id.

    Rows are told by id and text, so of rows that share an id only the linked ones leave. Rows that repeat the smallest id of
    their component stay together; rows without an id leave only if a linked one has an id.
    """
    found = jaccard_join(docs, percent, id_col, text_col)
    gone = found.filter("component_id is not null and (doc_id is null or component_id <> doc_id)")
    held, n = checked(gone.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct(), "gone")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_of(text_col)) == F.col("__t"))
    return docs.join(held, same, "left_anti") if n else docs


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


#: The query in SQL: shingles as hashes of their text, all pairs that share one, and the documents reachable from each.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([hash(array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ')) for i in generate_series(1, greatest(1, len(w) - {WORDS - 1}))]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(b) AS component_id FROM s JOIN reach ON a = doc_id GROUP BY doc_id, len(s)
"""
