"""Entity mentions: gazetteer matching, span rules and fusion, model and language-model answers, routing.

A mention is (text_id, start, end, text, etype, ...) with 0-based code-point offsets, end exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .constants import ANSWER_TYPES, COLLOQUIAL, COMPLEX_WORDS, MODEL_TYPES, QUESTION_WORDS, SOURCE_PRIORITY, TYPE_PRIORITY, VAGUE_WORDS
from .graph import literal_map


#: Surfaces that an automaton holds at most, some hundred bytes each in every worker.
AUTOMATON_FORMS = 500_000
#: Surfaces that are broadcast to the substrings of the texts at most, some hundred bytes each.
BROADCAST_FORMS = 50_000


def surface_forms(dictionary: DataFrame) -> DataFrame:
    """(surface, name, etype, kg_id, is_alias) of a dictionary (name, aliases, kg_id, etype)."""
    main = dictionary.select(F.col("name").alias("surface"), "name", "etype", "kg_id", F.lit(False).alias("is_alias"))
    other = dictionary.select(F.explode("aliases").alias("surface"), "name", "etype", "kg_id", F.lit(True).alias("is_alias"))
    return main.unionByName(other).filter("surface <> ''")


def match(texts: DataFrame, dictionary: DataFrame, engine: str = "join") -> DataFrame:
    """All occurrences, overlaps included, but for denials of one character between CJK characters. engine "join": substrings of each dictionary length meet the surfaces in an equi-join,
    for which up to BROADCAST_FORMS surfaces are broadcast; beyond it both sides are merged. The substrings are never broadcast: the planner's sizes know nothing of their number;
    "automaton": an Aho-Corasick automaton in each worker, for long texts and a dictionary of at most AUTOMATON_FORMS surfaces; a larger one is joined."""
    forms = surface_forms(dictionary)
    if engine == "automaton" and forms.count() <= AUTOMATON_FORMS:
        return _match_automaton(texts, forms)
    counts = forms.groupBy(F.length("surface").alias("n")).agg(F.count(F.lit(1)).alias("forms")).orderBy("n").collect()
    lengths = [r["n"] for r in counts]
    forms = F.broadcast(forms) if sum(r["forms"] for r in counts) <= BROADCAST_FORMS else forms.hint("merge")
    # One row for each place; the lengths are distinct lengths of surfaces, a few dozen at most.
    at = texts.select("text_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)))).alias("start"))
    cuts = [F.when(F.col("start") + n <= F.length("text"), F.substring("text", F.col("start") + 1, F.lit(n))) for n in lengths]
    pieces = at.select("text_id", "text", "start", F.explode(F.array(*cuts) if lengths else F.array().cast("array<string>")).alias("surface")).filter("surface is not null")
    found = pieces.join(forms, "surface").filter(single_char_ok(F.col("text"), F.col("start"), F.col("etype"), F.col("surface")))
    return found.select("text_id", "start", (F.col("start") + F.length("surface")).alias("end"), F.col("surface").alias("text"), "etype", "name", "kg_id", "is_alias")


_CJK = re.compile("[一-龥]").match


def _match_automaton(texts: DataFrame, forms: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast([tuple(r) for r in forms.select("surface", "name", "etype", "kg_id", "is_alias").collect()])

    def run(frames):
        import ahocorasick
        import pandas as pd

        machine, by = ahocorasick.Automaton(), {}
        for surface, *rest in held.value:
            by.setdefault(surface, []).append(rest)
        for surface in by:
            machine.add_word(surface, surface)
        if by:
            machine.make_automaton()
        for frame in frames:
            rows = []
            for text_id, text in zip(frame["text_id"], frame["text"]):
                for last, surface in machine.iter(text) if by and text else ():
                    start = last + 1 - len(surface)
                    inside = len(surface) == 1 and start > 0 and last + 1 < len(text) and _CJK(text[start - 1]) and _CJK(text[last + 1])
                    rows += [(text_id, start, last + 1, surface, e, n, k, a) for n, e, k, a in by[surface] if not (inside and e == "Deny")]
            yield pd.DataFrame(rows, columns=["text_id", "start", "end", "text", "etype", "name", "kg_id", "is_alias"])

    kinds = dict(forms.dtypes)
    return texts.select("text_id", "text").mapInPandas(run, f"text_id {dict(texts.dtypes)['text_id']}, start int, end int, text string, etype string, name string, kg_id {kinds['kg_id']}, is_alias boolean")


def longest(mentions: DataFrame) -> DataFrame:
    """Mentions that no other mention of the text strictly contains.

    A span is contained by one that starts before it iff the largest end before its start's reaches its end, and by one that starts with it iff the
    largest end there is beyond its own: running maxima by start, in one pass over the mentions, instead of a self join.
    """
    w = Window.partitionBy("text_id").orderBy("start")
    before, same = F.max("end").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.max("end").over(w.rangeBetween(0, 0))
    return mentions.withColumn("__before", before).withColumn("__same", same).filter((F.col("__before").isNull() | (F.col("__before") < F.col("end"))) & (F.col("__same") <= F.col("end"))).drop("__before", "__same")


def single_char_ok(text: Column, start: Column, etype: Column, surface: Column) -> Column:
    """A one-character denial counts only if not both neighbours are CJK characters."""
    cjk = lambda at: F.substring(text, at, F.lit(1)).rlike("^[一-龥]$")
    inside = (start > 0) & cjk(F.greatest(start, F.lit(1))) & cjk(start + 2)
    return ~((etype == "Deny") & (F.length(surface) == 1) & inside)


def without_noise(mentions: DataFrame) -> DataFrame:
    return mentions.filter(~F.col("text").rlike(r"^[\x00-\x7F]$") & ~F.col("text").rlike("^[0-9]+$"))


def priority_of(etype: Column, priorities: dict = TYPE_PRIORITY) -> Column:
    return F.coalesce(F.element_at(literal_map(priorities), etype), F.lit(0))


def best_type(mentions: DataFrame) -> DataFrame:
    """Of mentions of one span, the one of the type with the highest priority."""
    w = Window.partitionBy("text_id", "start", "end").orderBy(priority_of(F.col("etype")).desc(), "etype", "name")
    return mentions.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def dedup_predictions(predictions: DataFrame) -> DataFrame:
    """One prediction for each span: the surest, then the first."""
    w = Window.partitionBy("text_id", "start", "end").orderBy(F.col("confidence").desc(), "seq")
    return predictions.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def valid_predictions(predictions: DataFrame, texts: DataFrame, least: float = 0.1) -> DataFrame:
    """Predictions within their text and sure enough; their text is rewritten from it."""
    joined = predictions.drop("text").join(texts.select("text_id", "text"), "text_id")
    ok = joined.filter((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")) & (F.col("confidence") >= least))
    return ok.withColumn("text", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))


def model_type(raw: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(MODEL_TYPES), F.lower(raw)), F.lit("Disease"))


def model_items(answers: DataFrame) -> DataFrame:
    """Rows of raw model output (text_id, text, output JSON array) whose items may name their fields differently."""
    item = "array<struct<type:string,label:string,start:int,start_pos:int,end:int,end_pos:int,prob:double,score:double,span:string,text:string,word:string>>"
    rows = answers.select("text_id", F.col("text").alias("whole"), F.posexplode(F.from_json("output", item)).alias("seq", "x"))
    span = F.coalesce("x.span", "x.text", "x.word")
    start = F.coalesce(F.col("x.start"), F.col("x.start_pos"), F.nullif(F.position(span, F.col("whole")), F.lit(0)) - 1)
    rows = rows.select("text_id", "seq", span.alias("span"), start.alias("start"), F.coalesce("x.end", "x.end_pos").alias("end"), F.coalesce("x.prob", "x.score", F.lit(1.0)).alias("confidence"), model_type(F.coalesce("x.type", "x.label")).alias("etype"))
    return rows.withColumn("end", F.coalesce("end", F.col("start") + F.length("span"))).drop("span")


def answer_json(text: Column) -> Column:
    """The JSON of an answer: an answer that begins with [ up to the bracket that closes it (all of it if none does), else what stands
    in a block fenced as json, else in the first closed block of any fence, else null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    depth = F.aggregate(
        F.split(t, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),
        lambda s, c: F.struct((s["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)).alias("depth"), (s["at"] + 1).alias("at"), F.when((s["end"] == 0) & (c == "]") & (s["depth"] == 1), s["at"] + 1).otherwise(s["end"]).alias("end")),
    )
    balanced = F.when(depth["end"] > 0, F.substring(t, F.lit(1), depth["end"])).otherwise(t)
    marked = F.regexp_extract(t, r"(?s)```json(.+?)```", 1)
    fences = F.split(t, "```", -1)
    inner = F.when(marked != "", marked).when(F.size(fences) >= 3, F.get(fences, F.lit(1)))
    return F.when(t.startswith("["), balanced).otherwise(F.regexp_replace(inner, r"^\s+|\s+$", ""))


def answer_type(raw: Column) -> Column:
    """A standard type from an answer's type: capitalised, or by its Chinese name; else null."""
    plain = F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, 2, 100)))
    return F.when(plain.isin(list(TYPE_PRIORITY)), plain).otherwise(F.element_at(literal_map(ANSWER_TYPES), raw))


def repair_span(whole: Column, surface: Column, start: Column, end: Column) -> Column:
    """0-based start of the surface: as told if the text there agrees, else inside the told range, else the first occurrence, else null."""
    told = F.when((start >= 0) & (F.substring(whole, start + 1, end - start) == surface), start)
    part = F.when((start >= 0) & (end > start), F.substring(whole, start + 1, end - start))
    inside = F.when(F.position(surface, part) > 0, start + F.position(surface, part) - 1)
    first = F.when(F.position(surface, whole) > 0, F.position(surface, whole) - 1)
    return F.coalesce(told, inside, first)


def answer_mentions(answers: DataFrame) -> DataFrame:
    """Mentions from language-model answers (text_id, text, answer)."""
    item = "array<struct<text:string,entity:string,span:string,type:string,entity_type:string,start:int,end:int,note:string>>"
    rows = answers.select("text_id", F.col("text").alias("whole"), F.posexplode(F.from_json(answer_json(F.col("answer")), item)).alias("seq", "x"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    surface = F.coalesce(filled("x.text"), filled("x.entity"), filled("x.span"))
    start = repair_span(F.col("whole"), surface, F.col("x.start"), F.col("x.end"))
    got = rows.select("text_id", "seq", start.cast("int").alias("start"), surface.alias("text"), answer_type(F.coalesce(filled("x.type"), filled("x.entity_type"))).alias("etype"), F.lit(0.85).alias("confidence"))
    return got.filter("start is not null and etype is not null and text <> ''").withColumn("end", F.col("start") + F.length("text"))


def fuse(mentions: DataFrame, least: float = 0.5) -> DataFrame:
    """Spans that don't overlap, from mentions of several sources (text_id, start, end, etype, source, confidence).

    A left-to-right fold over (start, -end, -source priority): a contained span is skipped, an overlapping one replaces
    the last if its source has priority, then if it is surer, then if it is longer; else the last stays. Then spans less sure than `least`
    go, so a sure span that lost to an unsure one of a better source doesn't come back. Further columns (text, name, kg_id) are carried.
    """
    more = [c for c in mentions.columns if c not in ("text_id", "start", "end", "etype", "source", "confidence")]
    rank = F.coalesce(F.element_at(literal_map(SOURCE_PRIORITY), F.col("source")), F.lit(0))
    row = F.struct(F.col("start"), (-F.col("end")).alias("neg_end"), (-rank).alias("neg_rank"), F.col("etype"), F.col("end"), rank.alias("rank"), F.col("confidence"), F.col("source"), *more)
    grouped = mentions.groupBy("text_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, x: Column) -> Column:
        q = last(acc)
        inside = (q["start"] <= x["start"]) & (x["end"] <= q["end"])
        wins = (x["rank"] > q["rank"]) | ((x["rank"] == q["rank"]) & ((x["confidence"] > q["confidence"]) | ((x["confidence"] == q["confidence"]) & (x["end"] - x["start"] > q["end"] - q["start"]))))
        replaced = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] >= q["end"], F.concat(acc, F.array(x))).when(inside, acc).when(wins, replaced).otherwise(acc)

    folded = grouped.select("text_id", F.explode(F.aggregate("all", F.filter("all", lambda x: F.lit(False)), step)).alias("m"))
    return folded.filter(F.col("m.confidence") >= least).select("text_id", *(F.col(f"m.{c}").alias(c) for c in ("start", "end", "etype", "source", "confidence", *more)))


def coverage(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(text_id, n, coverage, density, avg_confidence): distinct covered characters and mentions by length; texts without mentions too."""
    places = F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1)))
    got = mentions.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.size(F.array_distinct(places)).alias("covered"), F.avg("confidence").alias("avg_confidence"))
    joined = texts.select("text_id", F.length("text").alias("len")).join(got, "text_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("text_id", n.alias("n"), F.round(F.coalesce("covered", F.lit(0)) / F.col("len"), 6).alias("coverage"), F.round(n / F.col("len"), 6).alias("density"), F.round(F.coalesce("avg_confidence", F.lit(0.0)), 6).alias("avg_confidence"))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def vague(text: Column, spans: Column, words: list[str] = VAGUE_WORDS, reach: int = 5) -> Column:
    """A vague word whose first occurrence has no mention within reach. spans: array of structs with start and end."""

    def lonely(w: Column) -> Column:
        at = F.position(w, text) - 1
        near = F.exists(spans, lambda m: (m["start"] < at + F.length(w) + reach) & (m["end"] > F.greatest(at - reach, F.lit(0))))
        return (at >= 0) & ~near

    return F.exists(F.array(*map(F.lit, words)), lonely)


def route(texts: DataFrame, min_count: int = 2, long_text: int = 20, min_density: float = 0.05, low_confidence: float = 0.3) -> DataFrame:
    """Which layers run: texts (text_id, text, spans, n_model, model_confidence) with to_model and to_llm.

    spans are the dictionary's mentions; n_model and model_confidence tell the model layer's result (null if it did not run).
    """
    t, n = F.col("text"), F.size("spans")
    asked = (F.contains(t, F.lit("可以")) & F.contains(t, F.lit("吗"))) | (F.contains(t, F.lit("应该")) & F.contains(t, F.lit("什么"))) | F.contains(t, F.lit("怎么"))
    to_model = (n < min_count) | ((F.length(t) >= long_text) & (n / F.length(t) < min_density)) | asked | vague(t, F.col("spans"))
    total = n + F.coalesce("n_model", F.lit(0))
    questions = F.size(F.filter(F.array(*map(F.lit, QUESTION_WORDS)), lambda w: F.contains(t, w)))
    few = (total < 2) & (_any(t, COMPLEX_WORDS) | (questions >= 2) | _any(t, COLLOQUIAL))
    to_llm = F.coalesce(F.col("model_confidence") < low_confidence, F.lit(False)) | few | ((F.length(t) > 30) & (total < 3))
    return texts.withColumn("to_model", to_model).withColumn("to_llm", to_llm)


def cascade(texts: DataFrame, dictionary: DataFrame, model=None, llm=None, least: float = 0.1, routed: bool = True) -> DataFrame:
    """Fused mentions (text_id, start, end, etype, source, confidence, text, name, kg_id) of the layers that routing asks for, or of all
    layers on all texts if not routed. model and llm map a DataFrame (text_id, text) to mentions
    (text_id, start, end, etype, confidence); each runs on its routed texts only; `linking.link_results` takes the rows with an id for each."""
    first = best_type(without_noise(longest(match(texts, dictionary)))).select("text_id", "start", "end", "etype", F.lit("keyword").alias("source"), F.lit(1.0).alias("confidence"), "text", "name", "kg_id")
    found = lambda layer, source: layer.withColumn("source", F.lit(source)).join(texts.select("text_id", F.col("text").alias("__t")), "text_id").select(*first.columns[:6], F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(first.schema["kg_id"].dataType).alias("kg_id"))
    spans = first.groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    known = texts.join(spans, "text_id", "left").withColumn("spans", F.coalesce("spans", empty))
    blank = known.withColumn("n_model", F.lit(None).cast("int")).withColumn("model_confidence", F.lit(None).cast("double"))
    parts, second = [first], None
    if model is not None:
        second = model((route(blank).filter("to_model") if routed else texts).select("text_id", "text"))
        parts.append(found(second, "ner"))
    if llm is not None:
        stats = second.groupBy("text_id").agg(F.count(F.lit(1)).cast("int").alias("n_model"), F.avg("confidence").alias("model_confidence")) if second is not None else None
        told = blank if stats is None else known.join(stats, "text_id", "left")
        parts.append(found(llm((route(told).filter("to_llm") if routed else texts).select("text_id", "text")), "llm"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return fuse(whole, least)
