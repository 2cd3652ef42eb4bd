"""Quality rules on lines that repeat across documents, in DataFrame functions only.

1. One scan turns each document into its base counts and its normalised lines (lower-cased, digits as 0,
   runs of white space as one space), as 64-bit hashes with their word counts. This narrow table is written to the shared folder.
2. For each host and line, the distinct documents that hold it are counted. Exact copies are one document: those of a
   host with the same set of normalised lines, told by the hash of the sorted line hashes. A line is above the
   limits when more than MIN_DOCS distinct documents hold it and these are more than one in SHARE of the host's
   distinct documents, or more than MANY_DOCS whatever the host's size. Copies are dropped first, by that hash, so a
   hot host or line is counted by partial aggregation, one row per map task.
3. Lines above the limits are removed: `decide` counts their words, `keep_good` gives the texts without them. A document
   is depleted, and rejected, if fewer than MIN_WORDS words remain and at least half of its words are gone.

Base counts (whole text, words `[^\\x20\\x09-\\x0D]+`): see `base_counts`. Windows of 8 words are compared by 64-bit hashes
after sorting them, so the work for a text of n words is n log n.

Cases: null or empty text has no words and fails the base; a null host is a host of its own; repeated rows of an id
count as documents each and are decided alike; very long texts are split whole; counts equal to a limit are within it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SPACE, checked, cut, documents, text_of

#: A line is removed if more than MIN_DOCS distinct documents hold it, and more than the lesser of one in SHARE of the host's and MANY_DOCS.
MIN_DOCS, SHARE, MANY_DOCS = 10, 1000, 1000
#: Fewest words that a document must have, and must keep.
MIN_WORDS = 20
WINDOW, MOST_REPEATED = 8, 30


def _bind(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more."""

    def covered(at: Column) -> Column:  # places of repeated windows, in order
        steps = F.zip_with(F.slice(at, F.lit(2), F.size(at) - 1), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x))

    def places(both: Column) -> Column:  # (hash, place) in order
        h = lambda i: F.get(both, i)["h"]
        twice = F.filter(both, lambda x, i: (x["h"] == h(i - 1)) | (x["h"] == h(i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def of_windows(w: Column) -> Column:
        pairs = F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_bind(F.sort_array(pairs), lambda s: _bind(places(s), covered)))

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
        return _bind(windows, of_windows)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars (code points in words), n_symbols (of `[#*$%&|<>]`), n_dup_lines (lines with a word, equal to an earlier one) and n_repeat_words."""
    words = F.col("__words")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(words),
    }


def _normal(text: Column) -> Column:
    """The normalised lines, one for each line of the text."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x))


def _lines(text: Column) -> Column:
    """All normalised lines as (h, w): hash and number of words."""
    full = F.filter(_normal(text), lambda x: x != "")
    return F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w")))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised form has a hash in gone."""
    return _bind(_normal(text), lambda plain: F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, F.xxhash64(F.get(plain, i)))), "\n"))


def profile(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The narrow table: doc_id, host, t (hash of the text), base counts and lines, from one scan of the texts."""
    text = F.col("__text")
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("__text"))
    held = held.withColumn("__words", F.filter(F.split("__text", f"[{SPACE}]+", -1), lambda w: w != ""))
    return held.select("doc_id", "host", F.xxhash64("__text").alias("t"), *(c.alias(n) for n, c in base_counts(text).items()), _lines(text).alias("lines"))


def crowded_lines(table: DataFrame) -> DataFrame:
    """(host, h): the lines above the limits."""
    sets = table.select("host", F.sort_array(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("hs"))
    distinct = cut(sets.withColumn("copy", F.xxhash64("hs")).dropDuplicates(["host", "copy"]).select("host", "hs"), "distinct")
    held = distinct.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > MIN_DOCS)
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    over = (F.col("held") * SHARE > F.col("docs")) | (F.col("held") > MANY_DOCS)
    return held.join(hosts, held.host.eqNullSafe(hosts.host)).filter(over).select(held.host, "h")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _verdicts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per row of docs: doc_id, host, t, the base counts, base_failed, n_removed_words, gone (hashes of the removed lines) and kept."""
    table = cut(profile(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "profile")
    crowded, _ = checked(crowded_lines(table), "crowded")
    lines = table.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    cut_words = lines.join(crowded, lines.host.eqNullSafe(crowded.host) & (lines.h == crowded.h)).groupBy("row").agg(F.sum("w").alias("removed"), F.collect_set(lines.h).alias("gone"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    depleted = (F.col("n_words") - removed < MIN_WORDS) & (2 * removed >= F.col("n_words"))
    return table.join(cut_words, "row", "left").select("doc_id", "host", "t", *COUNTS, failed.alias("base_failed"), removed.alias("n_removed_words"), "gone", (~failed & ~depleted).alias("kept"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, n_removed_words and kept."""
    return _verdicts(docs, id_col, text_col, host_col).select("doc_id", *COUNTS, "base_failed", "n_removed_words", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that stay, with their own columns, their texts without the lines above the limits.

    Rows are told by id, host and text, so of rows that share an id, or have none, only the rejected ones leave.
    Texts are only shuffled if there are too many changed rows and lines to broadcast.
    """
    told = _verdicts(docs, id_col, text_col, host_col).filter(~F.col("kept") | F.col("gone").isNotNull())
    changed = told.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("t").alias("__t"), F.when(F.col("kept"), F.col("gone")).alias("__gone")).dropDuplicates(["__id", "__host", "__t"])
    held = cut(changed.withColumn("__hit", F.lit(True)), "changed")
    most = held.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.greatest(F.size("__gone"), F.lit(0))), F.lit(0))).first()[0]
    held = F.broadcast(held) if most <= BROADCAST_IDS else held
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(host_col).cast("string").eqNullSafe(F.col("__host")) & (F.xxhash64(text_of(text_col)) == F.col("__t"))
    rest = docs.join(held, same, "left").filter(F.col("__hit").isNull() | F.col("__gone").isNotNull())
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(without_lines(text_of(text_col), F.col("__gone")))
    return rest.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir))



#: The query in SQL, with lines compared by their text.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^{SPACE}]+') AS w FROM d),
raw AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM raw WHERE regexp_matches(x, '[^{SPACE}]') GROUP BY r),
wins AS (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS x FROM w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS g(i)),
twice AS (SELECT r, x FROM wins GROUP BY r, x HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM wins JOIN twice USING (r, x), unnest(generate_series(0, {WINDOW - 1})) AS g(k) GROUP BY r),
norm AS (SELECT r, host, trim(unnest(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) AS x FROM d),
lines AS (SELECT * FROM norm WHERE x <> ''),
sets AS (SELECT r, coalesce(string_agg(x, chr(10) ORDER BY x), '') AS s FROM (SELECT DISTINCT r, x FROM lines) GROUP BY r),
hosts AS (SELECT host, count(DISTINCT coalesce(s, '')) AS docs FROM d LEFT JOIN sets USING (r) GROUP BY host),
held AS (SELECT host, x, count(DISTINCT s) AS n FROM lines JOIN sets USING (r) GROUP BY host, x),
crowded AS (SELECT held.host, x FROM held JOIN hosts ON held.host IS NOT DISTINCT FROM hosts.host WHERE n > {MIN_DOCS} AND (n * {SHARE} > docs OR n > {MANY_DOCS})),
gone AS (SELECT r, sum(len(lines.x) - len(replace(lines.x, ' ', '')) + 1) AS n FROM lines JOIN crowded ON lines.x = crowded.x AND lines.host IS NOT DISTINCT FROM crowded.host GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND NOT (n_words - n_removed_words < {MIN_WORDS} AND 2 * n_removed_words >= n_words) AS kept FROM f
"""
