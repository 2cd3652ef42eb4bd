"""Intent-driven retrieval: intent and entities give the relations to follow, the subgraph found is put into words.

One chain of exchanges: edges meet the nodes that they lead to, then the seeds, then all paths of a query meet and are limited, pruned and put into words where
they lie. Nothing is expanded twice, and no row is wider than a path until a query's nodes are listed. Nodes have one row for each id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import graph as G
from . import intents as I
from .constants import LABEL_HEADINGS, RELATION_NAMES, RELATION_WEIGHTS

NOTHING = "未找到相关的医疗知识。"


def plan(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, relations, hops, prompt) of asked (query_id, intent): the relations of the intent's template, else those
    of the types of the query's entities (query_id, name, etype), else all."""
    told = asked.withColumn("t", I.template(F.col("intent")))
    every = F.array(*map(F.lit, sorted(RELATION_WEIGHTS)))
    joined = told.join(G.infer_relations(entities).withColumnRenamed("relations", "of_types"), "query_id", "left")
    return joined.select("query_id", F.coalesce("t.relations", "of_types", every).alias("relations"), F.col("t.hops").alias("hops"), F.col("t.prompt").alias("prompt"))


def steps(edges: DataFrame, nodes: DataFrame, degree_limit: int | None = 50) -> DataFrame:
    """(src, rel_type, to): the edges (src, dst, rel_type) with id, completeness, label and name of the node (id, label, name, props[, degree]) that they
    lead to; without edges to nodes of degree_limit edges or more (a null degree is no hub), if there is a limit."""
    calm = nodes if degree_limit is None else nodes.filter(F.col("degree").isNull() | (F.col("degree") < degree_limit))
    held = calm.select(F.col("id").alias("dst"), C.completeness(F.col("props")).alias("full"), "label", "name")
    return edges.join(held, "dst").select("src", "rel_type", F.struct(F.col("dst").alias("id"), "full", "label", "name").alias("to"))


def expand(seeds: DataFrame, planned: DataFrame, along: DataFrame) -> DataFrame:
    """The columns of seeds (query_id, seed, ...) and hop, src, rel_type, to of paths as graph.expand gives them, each query along its own planned relations and
    hops over steps. The second hop starts from the steps of the first as they are exchanged, whole, so that exchange serves both."""
    asked = seeds.join(planned.select("query_id", "relations", "hops"), "query_id")
    path = lambda hop: (*seeds.columns, F.lit(hop).alias("hop"), "src", "rel_type", "to")
    meet = lambda queries, at: queries.join(along, F.col(at) == F.col("src")).filter(F.array_contains("relations", F.col("rel_type")) & (F.col("to.id") != F.col("seed")))
    first = meet(asked, "seed")
    near = meet(asked.filter("hops > 1"), "seed").select(*asked.columns, "to").distinct()
    second = meet(near.select(*asked.columns, F.col("to.id").alias("mid")), "mid").filter(F.col("to.id") != F.col("mid"))
    return first.select(*path(1)).unionByName(second.select(*path(2)))


def gather(paths: DataFrame, least: float = 0.5, most_nodes: int = 100) -> DataFrame:
    """(query_id, nodes, rels) of limited paths (query_id, seed, seed_node, hop, src, dst, rel_type, confidence, node, rn): as graph.prune, the surest nodes
    up to a cap, each with its best confidence, and the relation of each distinct edge between kept nodes. nodes: structs in order of confidence, hop, id."""
    entry = lambda id, hop, sure, node, via: F.struct(id.alias("id"), hop.alias("hop"), sure.alias("confidence"), node.alias("node"), via.alias("via"))
    via = F.struct("src", "rel_type")
    end = entry(F.col("dst"), F.col("hop"), F.col("confidence"), F.col("node"), via)
    start = entry(F.col("seed"), F.lit(0), F.lit(1.0), F.col("seed_node"), F.when(F.lit(False), via))
    # A seed's first path is its surest: it brings the seed.
    seen = paths.filter(F.col("confidence") >= least).select("query_id", F.explode(F.when(F.col("rn") == 1, F.array(start, end)).otherwise(F.array(end))).alias("e")).select("query_id", "e.*")
    best = seen.groupBy("query_id", "id").agg(F.min("hop").alias("hop"), F.max("confidence").alias("confidence"), F.max("node").alias("node"), F.collect_set("via").alias("into"))
    w = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "hop", "id")
    kept = best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most_nodes)
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "node", "into"))).alias("nodes"))
    between = lambda ids: lambda x: F.transform(F.filter(x["into"], lambda v: F.array_contains(ids, v["src"])), lambda v: v["rel_type"])
    return listed.select("query_id", "nodes", F.flatten(F.transform("nodes", between(F.col("nodes.id")))).alias("rels"))


def entity_names(names: Column, shown: int = 3) -> Column:
    """The first names, with a mark if there are more."""
    return F.concat(F.array_join(F.slice(names, 1, shown), "、"), F.when(F.size(names) > shown, F.lit("等")).otherwise(F.lit("")))


def describe(planned: DataFrame, entities: DataFrame, gathered: DataFrame, headings: dict[str, str] = LABEL_HEADINGS, relation_names: dict[str, str] = RELATION_NAMES) -> DataFrame:
    """(query_id, n_nodes, n_edges, description) of every planned query: the gathered nodes that are in the graph under the headings of their labels, its edges
    counted by relation, in the words of the plan's prompt; one fixed sentence where nothing was found."""
    found = F.filter("nodes", lambda x: x["node"].isNotNull())
    sized = gathered.select("query_id", F.size(found).cast("long").alias("n_nodes"), F.size("rels").cast("long").alias("n_edges"), F.transform(found, lambda x: x["node"]).alias("nodes"), "rels")

    def line(label: str, heading: str) -> Column:
        names = F.filter("nodes", lambda x: x["label"] == label)
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{heading}："), F.array_join(F.transform(names, lambda x: x["name"]), ", ")))

    def told(rel: Column) -> Column:
        n = F.size(F.filter("rels", lambda x: x == rel)).cast("string")
        name, at = (F.element_at(G.literal_map(m), rel) for m in (relation_names, {k: i for i, k in enumerate(relation_names)}))
        return F.struct(F.coalesce(at, F.lit(len(relation_names))).alias("at"), F.concat(F.coalesce(name, rel), F.lit("("), n, F.lit("条)")).alias("text"))

    rels = F.array_join(F.transform(F.array_sort(F.transform(F.array_distinct("rels"), told)), lambda x: x["text"]), ", ")
    parts = F.filter(F.array(*(line(*h) for h in headings.items()), F.when(F.size("rels") > 0, F.concat(F.lit("关系类型："), rels))), lambda x: x.isNotNull())
    worded = sized.select("query_id", "n_nodes", "n_edges", F.array_join(F.transform(parts, lambda x: F.concat(F.lit("  - "), x)), "\n").alias("knowledge"))
    who = entities.groupBy("query_id").agg(entity_names(F.array_sort(F.collect_list("name"))).alias("entity"))
    whole = planned.join(worded, "query_id", "left").join(who, "query_id", "left")
    text = F.replace(F.replace(F.col("prompt"), F.lit("{entity}"), F.coalesce("entity", F.lit(""))), F.lit("{knowledge}"), F.coalesce("knowledge", F.lit("")))
    n = F.coalesce("n_nodes", F.lit(0))
    return whole.select("query_id", n.alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.when(n > 0, text).otherwise(F.lit(NOTHING)).alias("description"))


def retrieve(asked: DataFrame, entities: DataFrame, seeds: DataFrame, edges: DataFrame, nodes: DataFrame, degree_limit: int | None = 50, per_seed: int = 30, least: float = 0.5, most_nodes: int = 100, shown: Callable[[Column], Column] = lambda c: c, **words) -> DataFrame:
    """From intents (query_id, intent), entities (query_id, name, etype) and seeds (query_id, seed) to `describe`'s rows.

    Ids may be of any type; `shown` gives the form that they are ordered by, once a query's paths are together. Without a degree_limit, edges to hubs are taken as gone.
    """
    planned = plan(asked, entities)
    named = seeds.join(nodes.select(F.col("id").alias("seed"), F.struct("label", "name").alias("seed_node")), "seed", "left").select("query_id", "seed", "seed_node")
    paths = expand(named, planned, steps(edges, nodes, degree_limit)).repartition("query_id")
    weight = F.element_at(G.literal_map(RELATION_WEIGHTS), F.col("rel_type"))
    sure = F.round(C.edge_confidence(weight, F.col("to.full"), F.col("hop")), 6)
    told = paths.select("query_id", shown(F.col("seed")).alias("seed"), "seed_node", "hop", shown(F.col("src")).alias("src"), shown(F.col("to.id")).alias("dst"), "rel_type", sure.alias("confidence"), F.struct("to.label", "to.name").alias("node"))
    return describe(planned, entities, gather(G.limit_per_seed(told, per_seed, ranked=True), least, most_nodes), **words)
