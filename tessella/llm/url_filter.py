"""URL filter: rules, host word segmentation and multinomial naive Bayes.

A url's host and path are cut out in DataFrame functions, and the longest fitting rule decides. Where no rule
fits, host labels are split into words by unigram Viterbi (known words cost their frequency, unknown stretches a
price for each letter), the path into its tokens, and multinomial naive Bayes over these tokens decides. The
last label of a host and numbers say nothing.

The unigram counts are those of all words of the given texts (`texts`; the query gives documents and the visible text of
pages) and of the labelled lists below. The counted words are a written table without a bound: all substrings of
the distinct names in hosts meet it in a join, and each name is split by the words found in it. Words over LONGEST letters,
the most that a label of a host can have, are not counted. The naive Bayes weights are learned from the labelled lists and from
urls that a rule decides: of TRAIN urls of each verdict (those with the lowest hashes), the words in which the verdicts differ beyond chance (G2 above
2 ln(words / ALPHA)) count as words of that many more documents. Words that the rules themselves name tell which rule fitted and teach nothing.

Cases: null url, or one without `://`, has an empty host and path and is allowed (the prior); a score of 0 (a tie) allows; very long urls are read whole, their
names split up to LONGEST letters a word; ids may be null or repeat, each row is judged; any number of pages of one host is scored row by row; an empty table gives an empty result; only the id and url columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, cut, documents, drawn

#: The rules, as (verdict, host and path beginning).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Labelled token lists, the training documents of the classifier, one line each.
BLOCKED = [
    "casino win bet bets betting poker slots jackpot gambling roulette bingo lottery free spins bonus",
    "cheap pills viagra cialis pharmacy meds pill drugs discount rx tablets weight loss diet miracle",
    "adult porn sex xxx nude cam cams escort dating hot girls milf erotic hentai",
    "spam farm link seo backlinks doorway scam phishing malware virus crack keygen warez torrent hack",
    "ads ad track tracker tracking click clicks banner popup affiliate promo adserver pixel beacon",
    "free money fast cash loan loans payday credit crypto earn rich now offer deal deals prize winner",
]
ALLOWED = [
    "news daily times post herald world today local weather sport sports live press journal",
    "blog home page site web wiki forum help about contact mail portal guide",
    "university school college library science research museum academy institute education edu course learn",
    "shop store book books music film art photo travel food recipes garden health care",
    "tech code dev data cloud software docs api open source labs project program",
    "city gov public service community church club center family kids green house",
]
UNKNOWN_LETTER, UNKNOWN_WORD = 11.0, 3.0
LONGEST = 63
#: Urls of each verdict that teach, and the chance that a word is taken by accident.
TRAIN, ALPHA = 20_000, 0.01
LETTERS = re.compile(r"[a-z]+").findall


def cheapest(name: str, cost: dict[str, float], longest: int) -> tuple[str, ...]:
    """The cheapest split of a name into known words and unknown stretches; ties take the earlier cut."""
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # cost, start of the last piece, whether it is unknown
    for end in range(1, len(name) + 1):
        so_far, start, unknown = best[end - 1]
        choice = (so_far + UNKNOWN_LETTER + (0.0 if unknown else UNKNOWN_WORD), start if unknown else end - 1, True)
        for start in range(max(0, end - longest), end):
            price = cost.get(name[start:end])
            if price is not None and best[start][0] + price < choice[0]:
                choice = (best[start][0] + price, start, False)
        best.append(choice)
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return tuple(out[::-1])


class Model:
    """Unigram costs for Viterbi and naive Bayes weights, from labelled token lists."""

    def __init__(self, blocked=BLOCKED, allowed=ALLOWED, smoothing: float = 0.5):
        lists = {1: Counter(w for line in blocked for w in line.split()), 0: Counter(w for line in allowed for w in line.split())}
        both = self.counts = lists[0] + lists[1]
        total = sum(both.values())
        self.cost = {w: math.log(total / n) for w, n in both.items() if len(w) > 1}
        self.longest = max(map(len, self.cost))
        size = len(both) + 1
        n = {y: sum(c.values()) + smoothing * size for y, c in lists.items()}
        self.weight = {w: math.log((lists[1][w] + smoothing) / n[1]) - math.log((lists[0][w] + smoothing) / n[0]) for w in both}
        self.prior = math.log(len(blocked) / (len(blocked) + len(allowed))) - math.log(len(allowed) / (len(blocked) + len(allowed)))
        self.smoothing = smoothing
        self.words = lru_cache(200_000)(lambda name: cheapest(name, self.cost, self.longest))

    def learn(self, seen: dict[str, tuple[int, int]], urls: tuple[int, int], own: set[str]) -> None:
        """Weights with words of decided urls: word -> (allowed, blocked) urls that hold it, among (allowed, blocked) in all; own words are left out."""
        total = sum(urls)
        if not all(urls):
            return
        limit = 2 * math.log((len(seen) + 1) / ALPHA)

        def gain(n: tuple[int, int]) -> float:
            here = sum(n)
            cells = [(n[y], here * urls[y] / total) for y in (0, 1)] + [(urls[y] - n[y], (total - here) * urls[y] / total) for y in (0, 1)]
            return 2 * sum(o * math.log(o / e) for o, e in cells if o)

        for w, n in seen.items():
            if w not in own and gain(n) > limit:
                a, b = ((n[y] + self.smoothing) / (urls[y] + 2 * self.smoothing) for y in (0, 1))
                self.weight[w] = self.weight.get(w, 0.0) + math.log(b / a)

    def tokens(self, host: str, path: str) -> list[str]:
        labels = host.split(":")[0].split(".")
        named = labels[:-1] if len(labels) > 1 else labels
        return [w for label in named for part in LETTERS(label) for w in self.words(part)] + LETTERS(path.lower())

    def score(self, host: str, path: str) -> float:
        """Log odds of block; tokens outside the lists say nothing."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in self.tokens(host, path))


def parts(url) -> tuple:
    """(host, path) columns."""
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    found = F.coalesce(url.contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def fitting(host, path, rules):
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for told, text in sorted(rules, key=lambda r: len(r[1])):  # later, longer ones win
        name, _, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(told)).otherwise(verdict)
    return rule, verdict


def visible(html):
    """The text between the tags of a page, without scripts and styles."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")


def counted_words(texts: DataFrame, model: Model) -> DataFrame:
    """(w, n): all words of 2 to LONGEST letters a to z in the one column of texts, and those of the model's lists."""
    words = F.explode(F.split(F.lower(F.col(texts.columns[0])), r"[^\p{L}]+"))
    known = texts.sparkSession.createDataFrame(list(model.counts.items()), "w string, n long")
    seen = texts.select(words.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).unionByName(known)
    return seen.filter(F.col("w").rlike(f"^[a-z]{{2,{LONGEST}}}$")).groupBy("w").agg(F.sum("n").alias("n"))


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) from distinct hosts and counted words: the words into which the names of a host split; hosts without one are left out."""
    total = words.agg(F.sum("n")).first()[0] or 1
    labels = F.split(F.element_at(F.split("host", ":"), 1), r"\.")
    named = F.when(F.size(labels) > 1, F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1)))).otherwise(labels)
    parts_of = cut(hosts.select("host", F.explode(F.flatten(F.transform(named, lambda x: F.regexp_extract_all(x, F.lit("([a-z]+)"), F.lit(1))))).alias("name")), "names")
    names = parts_of.select("name").distinct().filter(F.length("name") > 1).withColumn("k", F.xxhash64("name"))
    # A name's substrings by way of its windows of LONGEST letters, so that no row grows with the square of a long name.
    windows = names.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", i, F.lit(LONGEST)))).alias("window"))
    pieces = windows.select("k", F.explode(F.transform(F.sequence(F.lit(2), F.length("window")), lambda n: F.substring("window", F.lit(1), n))).alias("w"))
    known = pieces.join(words, "w").groupBy("k").agg(F.collect_set(F.struct("w", "n")).alias("found"))
    found = names.join(known, "k").select("name", "found")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            split = []
            for name, known in zip(b.column("name").to_pylist(), b.column("found").to_pylist()):
                cost = {x["w"]: math.log(total / x["n"]) for x in known}
                split.append(list(cheapest(name, cost, max(map(len, cost)))))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(split, pa.list_(pa.string()))], ["name", "split"])

    told, _ = checked(found.mapInArrow(run, "name string, split array<string>"), "splits")
    return parts_of.join(told, "name").groupBy("host").agg(F.flatten(F.collect_list("split")).alias("words"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", texts: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, block_score. texts: one column, whose words are counted; without it, those of the lists are."""
    spark, model = pages.sparkSession, Model()
    host, path = parts(pages[url_col].cast("string"))
    held = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, told = fitting(F.col("host"), F.col("path"), rules)
    kind = pages.schema[id_col].dataType.simpleString()
    texts = spark.createDataFrame([], "text string") if texts is None else texts
    found, _ = checked(host_words(held.select("host").distinct(), cut(counted_words(texts, model), "vocabulary")), "hosts")
    in_path = F.regexp_extract_all(F.lower("path"), F.lit("([a-z]+)"), F.lit(1))
    decided = drawn(held.select("host", "path", told.alias("told")).filter("told is not null").distinct(), "told", TRAIN, "host", "path")
    decided = decided.join(found, "host", "left").select("told", F.array_distinct(F.concat(F.coalesce("words", F.array().cast("array<string>")), in_path)).alias("words"))
    urls = {r["told"]: r["n"] for r in decided.groupBy("told").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = decided.select("told", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("told") == "allow").alias("allow"), F.count_if(F.col("told") == "block").alias("block"))
    model.learn({r["w"]: (r["allow"], r["block"]) for r in counts.collect()}, (urls.get("allow", 0), urls.get("block", 0)), {w for _, r in rules for w in LETTERS(r)})
    prior, weight = model.prior, model.weight

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(b.column("path").to_pylist(), b.column("words").to_pylist())
            scores = [prior + sum(weight.get(w, 0.0) for w in (words or [])) + sum(weight.get(w, 0.0) for w in LETTERS(p.lower())) for p, words in rows]
            verdicts = [told or ("block" if s > 0 else "allow") for told, s in zip(b.column("told").to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "block_score"])

    scored = held.join(found, "host", "left").select("page_id", "host", "path", rule.alias("rule"), told.alias("told"), "words")
    return scored.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, block_score double")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = documents(spark, sf_dir).select("text").union(pages.select(visible(F.col("html"))))
    return judge(pages, texts=texts)
