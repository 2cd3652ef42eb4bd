"""Intent classification and the templates that intents stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import INTENT_KEYWORDS, INTENT_TEMPLATES, MODEL_INTENTS
from .graph import literal_map


def votes(text: Column, keywords: dict[str, list[str]] = INTENT_KEYWORDS) -> Column:
    """(intent, votes) of each intent in order of declaration: listed keywords that the lower-cased text contains."""
    low = F.lower(text)
    return F.array(*(F.struct(F.lit(i).alias("intent"), F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))).alias("votes")) for i, words in keywords.items()))


def vote(texts: DataFrame, keywords: dict[str, list[str]] = INTENT_KEYWORDS) -> DataFrame:
    """texts with intent and confidence = votes / 5, at most 1; ties go to the first declared, no vote to `other`."""
    first = F.aggregate(votes(F.col("text"), keywords), F.struct(F.lit("other").alias("intent"), F.lit(0).alias("votes")), lambda best, x: F.when(x["votes"] > best["votes"], x).otherwise(best))
    return texts.withColumn("__v", first).withColumn("intent", F.col("__v.intent")).withColumn("confidence", F.least(F.lit(1.0), F.col("__v.votes") / 5.0)).drop("__v")


def with_model(voted: DataFrame, least: float = 0.6, labels: dict[str, str] = MODEL_INTENTS) -> DataFrame:
    """voted with model_label and model_confidence (null if the model did not run): the model wins if it is sure enough."""
    sure = F.coalesce(F.col("model_confidence") >= least, F.lit(False))
    named = F.coalesce(F.element_at(literal_map(labels), F.col("model_label")), F.lit("other"))
    return voted.withColumn("source", F.when(sure, "model").otherwise("keyword")).withColumn("intent", F.when(sure, named).otherwise(F.col("intent"))).withColumn("confidence", F.when(sure, F.col("model_confidence")).otherwise(F.col("confidence")))


def template(intent: Column, templates: dict = INTENT_TEMPLATES) -> Column:
    """(relations, hops, prompt) of an intent; an unknown one is `other`; null relations mean those of the entities' types."""
    whole = F.lit(None)
    none = F.lit(None).cast("array<string>")
    make = lambda t: F.struct((F.array(*map(F.lit, t[0])) if t[0] else none).alias("relations"), F.lit(t[1]).alias("hops"), F.lit(t[2]).alias("prompt"))
    for name, t in templates.items():
        whole = F.when(intent == name, make(t)).otherwise(whole if name != next(iter(templates)) else make(templates["other"]))
    return whole
