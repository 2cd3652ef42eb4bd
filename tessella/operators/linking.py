"""Entity linking: exact, alias, edit-distance and vector stages, in a cascade of anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .nearest import candidates

STAGES = ("exact", "alias", "edit", "vector")
#: Distinct mention texts whose nearest names are broadcast at most, some hundred bytes each.
BROADCAST_TEXTS = 50_000


def exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions (mention_id, text[, etype]) whose text is a name."""
    got = mentions.join(entities.select(F.col("name").alias("text"), "name", "etype", "kg_id"), [c for c in ("text", "etype") if c in mentions.columns])
    return got.select("mention_id", "text", "name", "etype", "kg_id", F.lit("exact").alias("stage"), F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))


def alias(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions whose text is an alias; of one type's entities with it, the first by name."""
    forms = entities.select(F.explode("aliases").alias("text"), "name", "etype", "kg_id")
    got = mentions.join(forms, [c for c in ("text", "etype") if c in mentions.columns])
    w = Window.partitionBy("mention_id", "etype").orderBy("name")
    return got.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("mention_id", "text", "name", "etype", "kg_id", F.lit("alias").alias("stage"), F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))


def edit(mentions: DataFrame, entities: DataFrame, most: int | None = None, keep: int = 3) -> DataFrame:
    """The `keep` nearest names within the edit distance that a mention's length allows.

    Each distinct text is compared once. A band equi-join on the length, then the banded levenshtein; for 2 edits or fewer, names also share one of three
    parts at about the same place (pigeonhole), which keeps the buckets of common lengths small. The sides of that join are exploded, of which the planner's
    sizes know nothing, so they are merged and never broadcast; up to BROADCAST_TEXTS texts, their names are broadcast to the mentions.
    """
    typed = [c for c in ("etype",) if c in mentions.columns]
    limit = C.max_distance(F.length("text")) if most is None else F.lit(most)
    d = 2 if most is None else most
    texts = mentions.select("text", *typed).distinct()
    asked = texts.withColumn("d", limit).select("*", F.explode(F.sequence(F.length("text") - F.col("d"), F.length("text") + F.col("d"))).alias("n"))
    # d + 1 parts of a name of n characters: at most d of them are touched, so one is found at a shift of up to d.
    cuts = [(F.floor(F.col("n") * k / (d + 1)).cast("int"), F.floor(F.col("n") * (k + 1) / (d + 1)).cast("int")) for k in range(d + 1)]
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("name", a + 1, b - a).alias("s")) for k, (a, b) in enumerate(cuts)))
    held = entities.withColumn("n", F.length("name")).select("name", "etype", "kg_id", "n", F.explode(parts).alias("p")).select("name", "etype", "kg_id", "n", "p.k", "p.s")

    def near_places(k: int, a, b):
        """The mention's substrings where part k may stand."""
        piece = lambda shift: F.struct(F.lit(k).alias("k"), F.substring("text", F.greatest(a + shift, F.lit(0)) + 1, b - a).alias("s"))
        return F.transform(F.sequence(F.lit(-d), F.lit(d)), piece)

    spots = F.flatten(F.array(*(near_places(k, a, b) for k, (a, b) in enumerate(cuts))))
    seen = asked.select("*", F.explode(F.array_distinct(spots)).alias("p")).select("*", "p.k", "p.s").drop("p")
    pairs = seen.join(held.hint("merge"), ["n", "k", "s", *typed]).select("text", "name", "etype", "kg_id", "d").distinct()
    near = pairs.withColumn("distance", F.levenshtein("text", "name")).filter(F.col("distance") <= F.col("d"))
    near = near.withColumn("similarity", F.round(C.edit_similarity(F.col("distance"), F.col("text"), F.col("name")), 6))
    order = (F.col("similarity").desc(), "name", "etype")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("text", *typed).orderBy(*order))).filter(F.col("rn") <= keep).drop("rn")
    near = F.broadcast(near) if texts.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else near.hint("merge")
    links = mentions.select("mention_id", "text", *typed).distinct().join(near, ["text", *typed])
    w = Window.partitionBy("mention_id").orderBy(*order)
    return links.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).select("mention_id", "text", "name", "etype", "kg_id", F.lit("edit").alias("stage"), "distance", "similarity")


def vector(mentions: DataFrame, entities: DataFrame, least: float = 0.6, keep: int = 3) -> DataFrame:
    """The `keep` names with the most similar embeddings: mentions (mention_id, text, vector), entities (name, etype, kg_id, embedding).

    Only pairs that can be among a mention's best leave a worker (see `nearest`), with the entity's type and id; an entity keeps its own score where another has its name.
    """
    asked = mentions.select(F.col("mention_id").alias("query_id"), "vector")
    held = entities.select(F.col("name").alias("chunk_id"), "embedding", "etype", "kg_id")
    pairs = candidates(asked, held, keep, True, False, least, carry=("etype", "kg_id"))
    near = pairs.select(F.col("query_id").alias("mention_id"), F.col("chunk_id").alias("name"), "etype", "kg_id", F.round("dot", 6).alias("similarity")).filter(F.col("similarity") >= least)
    w = Window.partitionBy("mention_id").orderBy(F.col("similarity").desc(), "name", "etype")
    got = near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).join(mentions.select("mention_id", "text").distinct(), "mention_id")
    return got.select("mention_id", "text", "name", "etype", "kg_id", F.lit("vector").alias("stage"), F.lit(0).alias("distance"), "similarity")


def best(links: DataFrame) -> DataFrame:
    """One link for each mention: by stage, then similarity, then length of the name."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    w = Window.partitionBy("mention_id").orderBy(order, F.col("similarity").desc(), F.length("name").desc(), "name", "etype")
    return links.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def cascade(mentions: DataFrame, entities: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All links: a stage sees only mentions that earlier stages left; vectors is (mention vectors, entity embeddings)."""
    whole, left = None, mentions
    for stage in (exact, alias, edit):
        got = stage(left, entities)
        whole = got if whole is None else whole.unionByName(got)
        left = left.join(got.select("mention_id").distinct(), "mention_id", "left_anti")
    if vectors is not None:
        asked = left.join(vectors[0].select("mention_id", "vector"), "mention_id")
        whole = whole.unionByName(vector(asked, entities.join(vectors[1].select("name", "embedding"), "name")))
    return whole.withColumn("confidence", F.round(C.calibrated(F.col("stage"), F.col("similarity"), F.col("name")), 6))


def link_results(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """mentions with kg_id, linked_name, link_stage and link_confidence; keyword mentions keep theirs, and a kg_id is never taken away."""
    found = best(links).select("mention_id", F.col("kg_id").alias("new_id"), F.col("name").alias("linked_name"), F.col("stage").alias("link_stage"), F.col("confidence").alias("link_confidence"))
    joined = mentions.join(found, "mention_id", "left")
    own = F.col("source") == "keyword"
    out = joined.withColumn("kg_id", F.when(own, F.col("kg_id")).otherwise(F.coalesce("new_id", "kg_id"))).drop("new_id")
    for c in ("linked_name", "link_stage", "link_confidence"):
        out = out.withColumn(c, F.when(~own, F.col(c)))
    return out
