"""The candidates of exact top-k search, by blocks of queries against Arrow batches of chunks.

All queries meet all chunks, but only pairs that can be among a query's k best leave a worker. Dot products are a matrix product. Token hits are a matrix product
for the block's HEAVY commonest tokens, and counted pair by pair through the queries' postings for the others; no token is left out.

Scores here are not rounded yet, so a pair stays if it is within SLACK of the k-th best one seen in its partition; the caller rounds and ranks. Of pairs of a query
with the same values only the k first by chunk can count. Dot products of candidates are summed again in the order of the array, as `columns.dot` does.
Cases: a null vector or one of another length or with a null has no dot product; null tokens hit nothing; NaN counts as the largest number, as in Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries in a block: with vectors only, and with tokens (some 10 kB each).
VECTORS, TOKENS = 10_000, 5_000
#: Pairs scored at once, pairs of a rarer token at once, tokens in the matrix product.
CELLS, PAIRS, HEAVY = 2_000_000, 4_000_000, 512
#: Rounding moves a score by half a millionth at most.
SLACK = 1.1e-6


def candidates(queries: DataFrame, chunks: DataFrame, k: int, vectors: bool, tokens: bool, least: float = 0.0, weights: tuple[float, float] = (1.0, 1.0), carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, dot, hits, n_query, n_doc) and the columns of a chunk named in carry, among them the k best of each query (query_id[, vector][, tokens]) in chunks (chunk_id[, embedding][, tokens]).

    vectors only: by dot product, at least `least`; tokens only: by hits over the larger token count, at least one hit; both: by their weighted sum over pairs with
    a hit, a dot product below `least` counting as 0. With both, a pair with a hit and a dot product of `least` is among the rows if the query has one, and else
    the k best of its pairs without a hit.
    """
    size = TOKENS if tokens else VECTORS
    blocks = max(1, -(-queries.count() // size))
    asked = queries.select("query_id", *(["vector"] if vectors else []), *(["tokens"] if tokens else []))
    held = chunks.select("chunk_id", *(["embedding"] if vectors else []), *([F.array_distinct("tokens").alias("tokens")] if tokens else []), *carry)
    parts = [asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [_block(p, held, k, vectors, tokens, least, weights, carry) for p in parts])


def _block(asked: DataFrame, held: DataFrame, k: int, vectors: bool, tokens: bool, least: float, weights: tuple[float, float], carry: tuple[str, ...]) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    t = asked.toArrow().combine_chunks()
    col = lambda name: pa.concat_arrays(t[name].chunks) if t[name].num_chunks else pa.array([], t.schema.field(name).type)
    block = {"ids": col("query_id"), "n": t.num_rows}
    if vectors:
        block["vectors"] = col("vector")
    if tokens:
        lists = col("tokens")
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        words = len(coded.dictionary)
        pairs, times = np.unique(np.asarray(coded.indices, dtype=np.int64) * max(t.num_rows, 1) + np.repeat(np.arange(t.num_rows), sizes), return_counts=True)
        word, query = pairs // max(t.num_rows, 1), pairs % max(t.num_rows, 1)
        count = np.bincount(word, minlength=words)
        heavy = np.argsort(-count, kind="stable")[:HEAVY]
        heavy = heavy[count[heavy] >= 0.02 * t.num_rows]
        block |= {"words": coded.dictionary, "sizes": sizes, "first": np.concatenate([[0], np.cumsum(count)]), "query": query.astype(np.int32), "times": times.astype(np.float64), "heavy": heavy}
    shared = asked.sparkSession.sparkContext.broadcast(block)
    cells, most, slack, (wv, wk) = CELLS, PAIRS, SLACK, weights

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        b = shared.value
        n = b["n"]

        def by_length(lists):
            """{length: (places, matrix)} of the vectors without nulls."""
            lists = lists.cast(pa.list_(pa.float64()))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), -1), dtype=np.int64)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.maximum(sizes, 0))
            if flat.null_count:
                sizes = sizes.copy()
                spoiled = np.zeros(len(lists), bool)
                spoiled[owner[np.asarray(flat.is_null())]] = True
            else:
                spoiled = np.zeros(len(lists), bool)
            values = np.asarray(pc.fill_null(flat, 0.0))
            found = {}
            for d in np.unique(sizes[(sizes >= 0) & ~spoiled]):
                at = np.nonzero((sizes == d) & ~spoiled)[0]
                found[int(d)] = (at, values[np.isin(owner, at)].reshape(len(at), d) if d else np.zeros((len(at), 0)))
            return found

        asked_vectors = by_length(b["vectors"]) if vectors else {}
        place = np.full(n, -1)
        for at, _ in asked_vectors.values():
            place[at] = np.arange(len(at))
        if tokens:
            heavy = b["heavy"]
            rank = np.full(len(b["words"]) + 1, -1)
            rank[heavy] = np.arange(len(heavy))
            dense = np.zeros((n, len(heavy)), np.float32 if b["sizes"].max(initial=0) < 2**24 else np.float64)
            for h, w in enumerate(heavy):
                span = slice(b["first"][w], b["first"][w + 1])
                dense[b["query"][span], h] = b["times"][span]
        top, other, answered = np.full((n, k), -np.inf), np.full((n, k), -np.inf), np.zeros(n, bool)

        def chosen(score, top, slack):
            """Where a score is within the slack of its query's k-th best so far; top is brought up to date."""
            near = top.min(axis=1) - slack
            rows = np.nonzero(score.max(axis=1) >= near)[0]
            if len(rows) == 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            some = score if len(rows) == n else score[rows]
            best = np.partition(some, some.shape[1] - k, axis=1)[:, -k:] if some.shape[1] > k else some
            both = np.concatenate([top[rows], best], axis=1)
            top[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            q, c = np.nonzero((some >= (top[rows].min(axis=1) - slack)[:, None]) & (some > -np.inf))
            return rows[q], c

        def hits_of(row, word, size):
            """Hits of every query in the rows: the matrix product, then the queries of each rarer word."""
            common = rank[word]
            one = np.zeros((size, len(heavy)), dense.dtype)
            one[row[common >= 0], common[common >= 0]] = 1
            hits = (dense @ one.T).astype(np.float64)
            row, word = row[common < 0], word[common < 0]
            long = b["first"][word + 1] - b["first"][word]
            group = np.cumsum(long) // most
            for g in np.unique(group):
                r, w, m = row[group == g], word[group == g], long[group == g]
                at = np.arange(m.sum()) + np.repeat(b["first"][w] - (np.cumsum(m) - m), m)
                hits += np.bincount(b["query"][at].astype(np.int64) * size + np.repeat(r, m), b["times"][at], n * size).reshape(n, size)
            return hits

        step = max(16, cells // max(n, 1))
        for batch in batches:
            for begin in range(0, batch.num_rows if n else 0, step):
                part = batch.slice(begin, step)
                size, ids = part.num_rows, part.column("chunk_id")
                order = np.empty(size, np.int64)
                order[np.asarray(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(size)
                dots, hits, force, wide = None, None, None, slack  # wide: the slack with what the order of a sum may change
                if vectors:
                    dots, stored = np.full((n, size), -np.inf), by_length(part.column("embedding"))
                    for d, (at, matrix) in stored.items():
                        if d in asked_vectors:
                            with np.errstate(all="ignore"):
                                made = asked_vectors[d][1] @ matrix.T
                            if not tokens and d:  # of equal vectors only the k first by chunk can count
                                _, same = np.unique(np.ascontiguousarray(matrix).view(f"V{8 * d}").ravel(), return_inverse=True)
                                by = np.lexsort((order[at], same))
                                start = np.nonzero(np.r_[True, same[by][1:] != same[by][:-1]])[0]
                                made[:, by[np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)])) >= k]] = -np.inf
                            made[np.isnan(made)] = np.inf
                            dots[np.ix_(asked_vectors[d][0], at)] = made
                            norms = [np.sqrt(np.square(x).sum(axis=1)).max(initial=0) for x in (asked_vectors[d][1], matrix)]
                            wide = max(wide, slack + 1e-15 * d * norms[0] * norms[1]) if np.isfinite(norms).all() else wide
                    near = dots >= least - wide
                if tokens:
                    lists = part.column("tokens")
                    n_doc = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                    word = pc.index_in(lists.flatten(), value_set=b["words"])
                    known = np.asarray(word.is_valid())
                    hits = hits_of(np.repeat(np.arange(size), n_doc)[known], np.asarray(word.drop_null(), dtype=np.int64), size)
                    share = hits / np.maximum(np.maximum(b["sizes"][:, None], n_doc[None, :]), 1)
                if not tokens:
                    score = np.where(near, dots, -np.inf)
                elif not vectors:
                    score = np.where(hits > 0, share, -np.inf)
                else:
                    score = np.where(hits > 0, wv * np.where(near, dots, 0.0) + wk * share, -np.inf)
                    if least != 0:  # at the bound a rounding decides whether the dot product counts
                        force = (hits > 0) & (np.abs(dots - least) <= wide)
                        score[force] = -np.inf
                q, c = chosen(score, top, wide)
                if force is not None:
                    q, c = (np.concatenate(x) for x in zip((q, c), np.nonzero(force)))
                if vectors and tokens and not answered.all():
                    open_ = np.nonzero(~answered)[0]
                    both = np.where((hits[open_] > 0) & near[open_], dots[open_], -np.inf)
                    best = both.argmax(axis=1)
                    found = both[np.arange(len(open_)), best]
                    q, c = np.concatenate([q, open_[found > -np.inf]]), np.concatenate([c, best[found > -np.inf]])
                    answered[open_[found >= least + wide]] = True
                    lone = np.where((hits > 0) | ~near | answered[:, None], -np.inf, wv * dots)
                    q, c = (np.concatenate(x) for x in zip((q, c), chosen(lone, other, wide)))
                q, c = np.divmod(np.unique(q * size + c), size)
                dot = np.full(len(q), np.nan)
                valid = np.zeros(len(q), bool)
                if vectors:
                    for d, (at, matrix) in stored.items():
                        if d in asked_vectors:
                            spot = np.full(size, -1)
                            spot[at] = np.arange(len(at))
                            is_d = np.zeros(n, bool)
                            is_d[asked_vectors[d][0]] = True
                            own = np.nonzero(is_d[q] & (spot[c] >= 0))[0]
                            valid[own] = True
                            for piece in np.array_split(own, max(1, len(own) // 50_000)):
                                with np.errstate(all="ignore"):
                                    dot[piece] = np.cumsum(asked_vectors[d][1][place[q[piece]]] * matrix[spot[c[piece]]], axis=1)[:, -1] if d else 0.0
                hit, docs, sizes = (hits[q, c], n_doc[c], b["sizes"][q]) if tokens else (np.zeros(len(q)),) * 3
                value = (hit, docs, np.where(valid, dot, -np.inf))
                by = np.lexsort((order[c], *value, q))
                changed = np.r_[True, np.any([x[by][1:] != x[by][:-1] for x in (q, *value)], axis=0)][: len(by)]
                start = np.nonzero(changed)[0]
                keep = by[np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)])) < k]
                yield pa.RecordBatch.from_arrays([b["ids"].take(pa.array(q[keep])), ids.take(pa.array(c[keep])), pa.array(dot[keep], mask=~valid[keep]), *(pa.array(x[keep].astype(np.int64)) for x in (hit, sizes, docs)), *(part.column(x).take(pa.array(c[keep])) for x in carry)], names=["query_id", "chunk_id", "dot", "hits", "n_query", "n_doc", *carry])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    carried = "".join(f", `{x}` {kind(held, x)}" for x in carry)
    return held.mapInArrow(run, f"query_id {kind(asked, 'query_id')}, chunk_id {kind(held, 'chunk_id')}, dot double, hits long, n_query long, n_doc long{carried}")
