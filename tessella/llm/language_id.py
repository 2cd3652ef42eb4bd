"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word's features are the word and its character n-grams (with its bounds), hashed into BINS embedding rows; a
text is the average over all features of all its words, and a softmax over a linear map of it gives the
languages. Training is stochastic gradient descent in numpy on the driver, over a bounded sample of labelled rows
(TRAIN rows, whole texts cut into examples of EXAMPLE words). A part of the sample is kept back to calibrate: the
temperature minimises its log-loss, and `rejected` marks predictions below the lowest score at which the part
kept back is right in PRECISION of the cases.

The average is linear, so a word adds a fixed vector of language scores: a worker keeps those of the words it has met (bounded).

Cases: null text, or one without a letter, gets `und` with score 0; null languages teach nothing; without labelled
rows every text gets `und`; a very long text is read whole; languages of equal score: the first in order of name; ids may be null or
repeat, each row is predicted; an empty table gives an empty result; only the id, text and lang columns are read, so others may clash.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drawn, fold, small_batches

#: Bounds of the training sample: rows in all, rows of a language at least, and code points of a row (longer rows are not drawn).
TRAIN, LEAST_ROWS, TRAIN_POINTS = 3000, 20, 20_000
#: Words of a training example, and examples that training goes through (drawn evenly from those of the sample).
EXAMPLE, EXAMPLES = 40, 24_000
BINS, SIZE, GRAMS = 1 << 16, 16, (2, 3, 4)
EPOCHS, LEAST_STEPS, RATE, KEPT_BACK, PRECISION = 3, 6000, 0.5, 10, 0.98
CACHE_WORDS = 300_000
UNKNOWN = "und"

WORDS = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[int]:
    bound = f"<{word}>"
    return [zlib.crc32(g.encode()) % BINS for g in [bound, *(bound[i : i + n] for n in GRAMS for i in range(len(bound) - n + 1))]]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words with a letter, of the whole text."""
    return [w for w in WORDS(text.lower()) if w[0].isalpha() or any(map(str.isalpha, w))] if text else []


def train(rows: list[tuple[str, str]], seed: int = 7):
    """(languages, scores of each bin by language, bias, temperature, rejection score) from (text, language) rows."""
    import numpy as np

    langs = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    examples, memo = [], {}
    for text, y in rows:
        words = words_of(text)
        for i in range(0, len(words), EXAMPLE):
            examples.append((words[i : i + EXAMPLE], langs.index(y)))
    if not examples:
        return None
    chosen = rng.permutation(len(examples))[:EXAMPLES]
    ready = []
    for k in chosen:
        words, y = examples[k]
        ids = []
        for w in words:
            if w not in memo:
                memo[w] = features(w)
            ids += memo[w]
        ready.append((np.array(ids), y))
    embed = rng.uniform(-1 / SIZE, 1 / SIZE, (BINS, SIZE)).astype(np.float32)
    out = np.zeros((SIZE, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    fit = [r for k, r in enumerate(ready) if k % KEPT_BACK] or ready
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(fit)))  # a small sample is gone through more often
    for epoch in range(epochs):
        for step, k in enumerate(rng.permutation(len(fit))):
            ids, y = fit[k]
            rate = RATE * (1 - (epoch + step / len(fit)) / epochs)
            mean = embed[ids].mean(0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            down = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            np.subtract.at(embed, ids, (rate / len(ids)) * down)
    scores = embed @ out
    held = ready[::KEPT_BACK]
    z = np.array([scores[ids].mean(0) + bias for ids, _ in held])
    y = np.array([y for _, y in held])
    loss = {t: float((-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12)).mean()) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(loss, key=lambda t: (loss[t], t))
    p = softmax(z / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.nonzero(right >= PRECISION)[0]
    limit = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return langs, scores, bias, temperature, limit


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Scores(dict):
    """Word -> place in a growing table of language scores (last column: number of features)."""

    def __init__(self, bins):
        import numpy as np

        super().__init__()
        self.bins, self.table = bins, np.empty((1 << 12, bins.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        import numpy as np

        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        ids = features(word)
        self.table[n, :-1] = self.bins[ids].sum(0)
        self.table[n, -1] = len(ids)
        self[word] = n
        return n


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache = None
        for b in batches:
            preds, scores, rejected = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text) if held.value else []
                pred, score = UNKNOWN, 0.0
                if words:
                    langs, bins, bias, temperature, limit = held.value
                    if cache is None or len(cache) > CACHE_WORDS:
                        cache = Scores(bins)
                    at = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
                    total = cache.table[at].sum(0)
                    p = softmax((total[:-1] / total[-1] + bias) / temperature)
                    pred, score = langs[int(p.argmax())], float(p.max())
                preds.append(pred)
                scores.append(score)
                rejected.append(not words or score < limit)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def fit(docs: DataFrame):
    """A model from the labelled rows of docs (doc_id, text, lang); None where there are none."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TRAIN_POINTS))
    langs = labelled.select("lang").distinct().count()
    if not langs:
        return None
    rows = drawn(labelled, "lang", max(LEAST_ROWS, TRAIN // langs), "doc_id", "text")  # as many rows of each language
    return train(sorted((r["text"], r["lang"]) for r in rows.toLocalIterator()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id"), 3) != 1)
    found = predict(docs, fit(learn))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
