"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps a token to a tag: insult, threat verb, target, negation, report, clause end or other.
Five small transducers read the tags of a clause: target (a target near by), negation (a negation shortly before), report
(a verb of saying or an opening quotation mark before), repetition (an insult before) and threat (a threat verb
completed by a target). Their composition, computed once as a table over product states, emits for every insult and
completed threat of a clause the class (threat, targeted, negated, reported, repeated). Each class weighs the share of toxic documents among
training documents with such a match, shrunk towards a prior; a document's score is the noisy-or of the distinct
classes that its clauses match, so no word counts by how often it occurs. An insult that stands in no pattern (no target, no
other insult) has a prior below the threshold: alone it decides only if the labels say so.

Learning. The lexicon starts from a small seed in four languages. From a bounded sample of labelled rows (TRAIN
rows of each label by lowest hash of the id; near copies, told by their smallest shingle, counted once) words and word beginnings join it whose document counts differ between the labels beyond
chance (G2 above 2 ln(candidates / ALPHA)), and seed words that the labels contradict leave it. Words, beginnings and classes are counted
in Spark; the driver gets only terms of MIN_DOCS toxic documents or more, the seed's counts and the 32 classes' counts.

Cases: null or empty text gets the score of a text without a match; a very long text is read whole, clause by clause (one in training is
drawn only up to TRAIN_POINTS code points); a document without a label, or with several, does
no harm (any toxic label counts); equal gains need no order, as every term is decided by itself; without training rows the seed and the priors alone decide; ids may be null or
repeat, each row is scored; an empty table gives an empty result; only named columns are read, so others may clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, documents, drawn, fold, small_batches
from .ngram_jaccard import shingles

#: Bounds of the training sample: rows of each label, and code points of a row (longer rows are not drawn).
TRAIN, TRAIN_POINTS = 4000, 20_000
ALPHA, MIN_DOCS = 0.01, 4
BEGIN, BEGIN_MOST = 4, 12
THRESHOLD = 0.3
CACHE_WORDS = 500_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: The seed lexicon.
SEED = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile scumbag bastard "
    "dummkopf arschloch abschaum schwachkopf vollidiot imbécile connard salaud ordure crétin abruti estúpido imbécil basura escoria",
    THREAT: "kill hurt destroy murder strangle töten umbringen vernichten tuer frapper détruire matar destruir golpear",
    TARGET: "you your u yourself du dich dir euch ihr tu te toi vous ti usted ustedes vosotros",
    NEGATION: "not never no nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says called wrote quoted sagte schrieb nannte dit écrit dijo escribió llamó",
}
TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n\"“„«]").findall
ENDS, QUOTES = set(".!?;\n"), set('"“„«')
#: Reach in tokens: of a negation before a match, and of a target around one.
NEGATION_REACH, TARGET_REACH = 3, 4
#: Prior share of toxic documents by pattern, and how many documents a prior weighs. A bare insult stays below THRESHOLD.
PRIOR = {"bare": 0.2, "repeated": 0.6, "targeted": 0.75, "threat": 0.8}
PRIOR_DOCS, QUIET = 4.0, 0.01
DISCOUNT = {"negated": 0.4, "reported": 0.5}
THREATS, TARGETED, NEGATED, REPORTED, REPEATED = 1, 2, 4, 8, 16
CLASSES = 32


def _counter_machine(trigger: int, reach: int):
    """A transducer that flags tokens up to `reach` after a trigger. Returns step(state, tag) -> (state, flag)."""
    return lambda state, tag: (0 if tag == END else reach if tag == trigger else max(0, state - 1), state > 0)


def _report_machine(state: int, tag: int):
    return (0 if tag == END else 1 if tag == REPORT else state, state > 0)


def _threat_machine(state: int, tag: int):
    """A threat verb waits TARGET_REACH tokens for a target; the target completes the match."""
    waits = state > 0 and tag == TARGET
    return (0 if tag == END or waits else TARGET_REACH if tag == THREAT else max(0, state - 1), waits)


def _repeat_machine(state: int, tag: int):
    return (0 if tag == END else 1 if tag == INSULT else state, state > 0)


def compose() -> dict[tuple[int, int], tuple[int, int]]:
    """(product state, tag) -> (product state, output): output 0 is nothing, else 1 + class number (see classes)."""
    machines = (_counter_machine(TARGET, TARGET_REACH), _counter_machine(NEGATION, NEGATION_REACH), _report_machine, _threat_machine, _repeat_machine)
    begin = (0,) * len(machines)
    states, table, todo = {begin: 0}, {}, [begin]
    while todo:
        at = todo.pop()
        for tag in range(7):
            after, flags = zip(*(m(s, tag) for m, s in zip(machines, at)))
            targeted, negated, reported, threat, repeated = flags
            out = 0
            if tag == INSULT or threat:
                out = 1 + (THREATS * threat + TARGETED * targeted + NEGATED * negated + REPORTED * reported + REPEATED * repeated)
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            table[states[at], tag] = (states[after], out)
    return table


GRAMMAR = compose()


class Tags(dict):
    """Token -> tag, by word or by the beginning of a word; bounded."""

    def __init__(self, words: dict[str, int], begins: set[str]):
        super().__init__()
        self.words, self.begins = words, begins

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        tag = self.words.get(token)
        if tag is None:
            tag = END if token in ENDS else REPORT if token in QUOTES else OTHER
            if tag == OTHER and any(token[:k] in self.begins for k in range(BEGIN, min(len(token), BEGIN_MOST) + 1)):
                tag = INSULT
        self[token] = tag
        return tag


_HITS = re.compile(bytes([ord("["), INSULT, THREAT, ord("]")])).search


def matches(text: str | None, tags: Tags) -> Counter:
    """How often each class of match occurs in the whole text."""
    if not text:
        return Counter()
    seen = bytes(map(tags.__getitem__, TOKENS(text.lower())))
    found: Counter = Counter()
    if not _HITS(seen):
        return found
    for clause in seen.split(bytes([END])):
        if _HITS(clause):
            state = 0
            for tag in clause:
                state, out = GRAMMAR[state, tag]
                if out:
                    found[out] += 1
    return found


def prior(out: int) -> float:
    """The prior share of toxic documents among those that match a class."""
    bits = out - 1
    share = max(PRIOR[name] for name, bit in (("threat", THREATS), ("targeted", TARGETED), ("repeated", REPEATED), ("bare", 0)) if bits & bit or not bit)
    return share * (DISCOUNT["negated"] if bits & NEGATED else 1.0) * (DISCOUNT["reported"] if bits & REPORTED else 1.0)


def terms(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings marked with a star."""
    found = {t for t in TOKENS(text.lower()) if t.isalpha()}
    return found | {w[:k] + "*" for w in found for k in range(BEGIN, min(len(w), BEGIN_MOST) + 1)}


def learn_lexicon(counts: dict[str, tuple[int, int]], total: tuple[int, int], candidates: int) -> tuple[dict[str, int], set[str]]:
    """(word -> tag, insulting word beginnings) from the seed and from term -> (documents, toxic documents) for terms of MIN_DOCS toxic ones.

    total: documents and toxic documents; candidates: distinct terms in all."""
    words = {w: tag for tag, line in SEED.items() for w in line.split()}
    n, toxic = total
    if not toxic or toxic == n:
        return words, set()
    ones = lambda x: counts.get(x, (0, 0))[1]
    zeros = lambda x: counts.get(x, (0, 0))[0] - ones(x)

    def gain(x: str) -> float:
        """G2 of a presence against the label."""
        a, b = ones(x), zeros(x)
        e = (a + b) * toxic / n
        return 2 * sum(o * math.log(o / m) for o, m in ((a, e), (b, a + b - e)) if o) if a > e else 0.0

    limit = 2 * math.log((candidates + 1) / ALPHA)
    for w in [w for w, tag in words.items() if tag == INSULT and zeros(w) > MIN_DOCS and gain(w) == 0]:
        del words[w]
    able = {x for x in counts if ones(x) >= MIN_DOCS and zeros(x) * 20 * toxic <= ones(x) * (n - toxic) and gain(x) > limit}
    begins: set[str] = set()
    often = [w for w in counts if ones(w) >= MIN_DOCS and w[-1] != "*"]
    starts = sorted(x[:-1] for x in able if x[-1] == "*")
    for x in sorted(starts, key=len):
        if any(x[:k] in begins for k in range(BEGIN, len(x))):
            continue
        longest = max((y for y in starts if y.startswith(x) and ones(y + "*") >= 0.9 * ones(x + "*")), key=len)
        single = max((ones(w) for w in often if w.startswith(longest)), default=0)
        if single < 0.7 * ones(longest + "*"):  # else one word makes up the beginning and speaks for itself
            begins.add(longest)
    for x in able:
        if x[-1] != "*" and words.get(x) in (None, INSULT) and not any(x[:k] in begins for k in range(BEGIN, len(x) + 1)):
            words[x] = INSULT
    return words, begins


def class_weights(seen: dict[int, tuple[int, int]]) -> tuple[dict[int, float], float]:
    """(class -> probability that a document with such a match is toxic, the score of a document without a match).

    seen: class -> (documents, toxic documents); class 0 stands for documents without a match."""
    shrunk = lambda out, share: (seen.get(out, (0, 0))[1] + PRIOR_DOCS * share) / (seen.get(out, (0, 0))[0] + PRIOR_DOCS)
    return {out: shrunk(out, prior(out)) for out in range(1, CLASSES + 1)}, shrunk(0, QUIET)


def train(docs: DataFrame, labels: DataFrame):
    """The grammar's lexicon and weights from labelled rows of docs (doc_id, text) and labels (doc_id, toxic)."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = drawn(marked.filter("toxic in (0, 1)"), "toxic", TRAIN, "doc_id")
    rows = docs.filter(F.length("text") <= TRAIN_POINTS).join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def marks(batches):
        import pyarrow as pa

        for b in batches:
            found = [shingles(t) for t in as_bytes(b.column("text"))]
            yield b.append_column("mark", pa.array([int(f[0]) >> 1 if len(f) else 0 for f in found], pa.int64()))

    # Near copies are no independent witnesses: of documents whose smallest shingle is the same, one counts.
    first = rows.mapInArrow(marks, "text string, toxic int, mark long").groupBy("mark", "toxic").agg(F.min("text").alias("text"))
    rows = cut(first.select("text", "toxic"), "toxic-train")

    def told(batches):
        import pyarrow as pa

        for b in batches:
            pairs = [(x, y) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()) for x in terms(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32())], ["term", "toxic"])

    counted = cut(rows.mapInArrow(told, "term string, toxic int").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones")), "toxic-terms")
    seeds = [w for line in SEED.values() for w in line.split()]
    counts = {r["term"]: (r["n"], r["ones"]) for r in counted.filter((F.col("ones") >= MIN_DOCS) | F.col("term").isin(seeds)).toLocalIterator()}
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    words, begins = learn_lexicon(counts, tuple(total), counted.count())
    tags = rows.sparkSession.sparkContext.broadcast((words, begins))

    def classes(batches):
        import pyarrow as pa

        lexicon = Tags(*tags.value)
        for b in batches:
            pairs = [(out, y) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()) for out in matches(t, lexicon) or (0,)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int32()), pa.array([y for _, y in pairs], pa.int32())], ["out", "toxic"])

    seen = rows.mapInArrow(classes, "out int, toxic int").groupBy("out").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones")).collect()
    weights, quiet = class_weights({r["out"]: (r["n"], r["ones"]) for r in seen})
    return words, begins, weights, quiet


def score_of(found, weights: dict[int, float], quiet: float) -> float:
    """Noisy-or over the distinct classes found."""
    clean = 1.0 - quiet
    for out in found:
        clean *= 1.0 - min(weights[out], 0.999)
    return 1.0 - clean


def score_toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, n_matches."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        words, begins, weights, quiet = held.value
        tags = Tags(words, begins)
        for b in batches:
            scores, n = [], []
            for text in b.column("text").to_pylist():
                found = matches(text, tags)
                scores.append(score_of(found, weights, quiet))
                n.append(sum(found.values()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "score", "n_matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, n_matches long")


def _model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 4) != 2)
    return train(docs.select("doc_id", "text"), labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, _model(spark, sf_dir, docs))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")


def keep_clean(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below THRESHOLD, with their own columns. One narrow pass: rows are filtered where they are read."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        words, begins, weights, quiet = held.value
        tags = Tags(words, begins)
        for b in batches:
            stay = [score_of(matches(text, tags), weights, quiet) < THRESHOLD for text in b.column(at).to_pylist()]
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
