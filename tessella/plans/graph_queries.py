"""Queries over the property graph of the star schema, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import text as TX
from ..operators.constants import INTENT_TEMPLATES, RELATION_NAMES, RELATION_WEIGHTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(label: str, column: str):
    return F.concat(F.lit(f"{label}:"), F.col(column).cast("string"))


#: The labels of this graph, and ids as a label's place and a key: a fraction of their text in an exchange, which _text gives back.
LABELS = ("Region", "Nation", "Customer", "Supplier", "Part")


def _code(label: str, column: str):
    return F.struct(F.lit(LABELS.index(label)).cast("tinyint").alias("label"), F.col(column).cast("long").alias("key"))


def _text(code):
    return F.concat(F.element_at(F.array(*map(F.lit, LABELS)), code["label"] + 1), F.lit(":"), code["key"].cast("string"))


def nodes(spark: SparkSession, sf_dir: str, key=_key) -> DataFrame:
    parts = []
    for name, label, number, title, props in (
        ("region", "Region", "r_regionkey", "r_name", []),
        ("nation", "Nation", "n_nationkey", "n_name", ["n_regionkey"]),
        ("customer", "Customer", "c_custkey", "c_name", ["c_mktsegment", "c_nationkey"]),
        ("supplier", "Supplier", "s_suppkey", "s_name", ["s_nationkey"]),
        ("part", "Part", "p_partkey", "p_name", ["p_brand", "p_type", "p_size"]),
    ):
        values = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
        held = F.create_map(*values) if props else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        parts.append(table(spark, sf_dir, name).select(key(label, number).alias("id"), F.lit(label).alias("label"), F.col(title).alias("name"), held.alias("props")))
    return reduce(DataFrame.unionByName, parts)


def edge_parts(spark: SparkSession, sf_dir: str, key=_key) -> list[DataFrame]:
    """The edges of each kind, with repeats."""
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem")
    return [
        t("nation").select(key("Nation", "n_nationkey").alias("src"), key("Region", "n_regionkey").alias("dst"), F.lit("belongs_to").alias("rel_type")),
        t("customer").select(key("Customer", "c_custkey").alias("src"), key("Nation", "c_nationkey").alias("dst"), F.lit("belongs_to").alias("rel_type")),
        t("supplier").select(key("Supplier", "s_suppkey").alias("src"), key("Nation", "s_nationkey").alias("dst"), F.lit("belongs_to").alias("rel_type")),
        line.select(key("Supplier", "l_suppkey").alias("src"), key("Part", "l_partkey").alias("dst"), F.lit("drugs_of").alias("rel_type")),
        line.join(t("orders"), line.l_orderkey == F.col("o_orderkey")).select(key("Customer", "o_custkey").alias("src"), key("Part", "l_partkey").alias("dst"), F.lit("recommand_drug").alias("rel_type")),
    ]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_edges(edge_parts(spark, sf_dir))


N_SQL = """n as (
  select 'Region:' || r_regionkey as id, 'Region' as label, r_name as name, 0 as n_props from region
  union all select 'Nation:' || n_nationkey, 'Nation', n_name, 1 from nation
  union all select 'Customer:' || c_custkey, 'Customer', c_name, 2 from customer
  union all select 'Supplier:' || s_suppkey, 'Supplier', s_name, 1 from supplier
  union all select 'Part:' || p_partkey, 'Part', p_name, 3 from part)"""
E_SQL = """e as (
  select 'Nation:' || n_nationkey as src, 'Region:' || n_regionkey as dst, 'belongs_to' as rel_type from nation
  union select 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'belongs_to' from customer
  union select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'belongs_to' from supplier
  union select 'Supplier:' || l_suppkey, 'Part:' || l_partkey, 'drugs_of' from lineitem
  union select 'Customer:' || o_custkey, 'Part:' || l_partkey, 'recommand_drug' from lineitem join orders on l_orderkey = o_orderkey)"""
W_SQL = "w(rel_type, weight) as (values " + ", ".join(f"('{k}', {v}::double)" for k, v in RELATION_WEIGHTS.items()) + ")"
DEG_SQL = "deg as (select id, count(*) as degree from (select src as id from e union all select dst from e) group by id)"
#: The seeds of the neighbourhood queries: all customers.
SEED_SQL = "s as (select 'Customer:' || c_custkey as seed from customer)"
HUB = 60
HOP1_SQL = f"""calm as (select id as dst from n left join deg using (id) where degree is null or degree < {HUB}),
step as (select e.* from e semi join calm using (dst)),
h1 as (select seed as query_id, seed, 1 as hop, src, dst, rel_type from s join step on seed = src where dst <> seed)"""
CONF_SQL = """round(case when hop = 2 then 0.8::double else 1.0::double end * (0.7::double * coalesce(weight, 0.5::double) + 0.3::double * case when n_props = 0 then 0.5::double else 1.0::double end), 6)"""


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(_key("Customer", "c_custkey").alias("query_id"), _key("Customer", "c_custkey").alias("seed"))


def _graph(spark, sf_dir):
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir)
    return e, n.join(G.degrees(e), "id", "left")


@query(f"with {N_SQL} select id, label, name, n_props from n")
def graph_nodes(spark, sf_dir):
    return G.build_nodes([nodes(spark, sf_dir)]).select("id", "label", "name", F.size("props").alias("n_props"))


@query(f"with {E_SQL} select * from e")
def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("select count(*) as n_edges, count(distinct src) as n_src, count(distinct dst) as n_dst from (select distinct l_suppkey as src, l_partkey as dst from lineitem semi join part on l_partkey = p_partkey semi join supplier on l_suppkey = s_suppkey)")
def edge_endpoint_check(spark, sf_dir):
    made = G.build_edges([edges(spark, sf_dir).filter("rel_type = 'drugs_of'")], nodes(spark, sf_dir))
    return made.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query(f"with {E_SQL}, {DEG_SQL} select * from deg")
def node_degree(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query(f"with {N_SQL}, {E_SQL}, {DEG_SQL} select label, count(*) filter (degree is null or degree < {HUB}) as calm, count(*) filter (degree >= {HUB}) as hubs from n left join deg using (id) group by label")
def hub_prune(spark, sf_dir):
    _, n = _graph(spark, sf_dir)
    calm = F.col("degree").isNull() | (F.col("degree") < HUB)
    return n.groupBy("label").agg(F.count_if(calm).alias("calm"), F.count_if(~calm).alias("hubs"))


@query(f"with {N_SQL}, {E_SQL}, {DEG_SQL}, {W_SQL}, {SEED_SQL}, {HOP1_SQL} select query_id, seed, hop, src, dst, rel_type, {CONF_SQL} as confidence from h1 join n on dst = id left join w using (rel_type)")
def one_hop(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return G.score_paths(G.expand(_seeds(spark, sf_dir), e, n, degree_limit=HUB), n).select("query_id", "seed", "hop", "src", "dst", "rel_type", "confidence")


#: Seeds of two hops: the nations of one region reach it by belongs_to; customers reach parts and nations.
TWO_SQL = f"""{HOP1_SQL.replace("s join", "s2 join")},
h2 as (select distinct query_id, seed, 2 as hop, step.src, step.dst, step.rel_type from (select distinct query_id, seed, dst as mid from h1) m left join step on mid = step.src and step.dst <> seed and step.dst <> mid where step.src is not null),
p as (select * from h1 union all select * from h2)"""
S2_SQL = "s2 as (select 'Supplier:' || s_suppkey as seed from supplier)"


@query(f"with {N_SQL}, {E_SQL}, {DEG_SQL}, {W_SQL}, {S2_SQL}, {TWO_SQL.replace(f'degree < {HUB}', 'degree < 1000000')} select query_id, seed, hop, src, dst, rel_type, {CONF_SQL} as confidence from p join n on dst = id left join w using (rel_type) where rel_type = 'belongs_to'")
def two_hop(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "supplier").select(_key("Supplier", "s_suppkey").alias("query_id"), _key("Supplier", "s_suppkey").alias("seed"))
    return G.score_paths(G.expand(seeds, e, n, ["belongs_to"], hops=2, degree_limit=1_000_000), n).select("query_id", "seed", "hop", "src", "dst", "rel_type", "confidence")


REF_SQL = "m as (select c_custkey as query_id, case when c_custkey % 2 = 0 then c_name else 'Customer:' || c_custkey end as ref from customer union all select s_suppkey + 1000000, s_name from supplier union all select 0, '')"


@query(f"with {N_SQL}, {REF_SQL} select distinct query_id, id as seed from m join n on (ref = id or ref = name) where ref <> ''")
def seed_by_name_or_id(spark, sf_dir):
    ref = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(_key("Customer", "c_custkey"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), ref.alias("ref"))
    asked = asked.union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 1000000, "s_name")).union(spark.createDataFrame([(0, "")], "query_id long, ref string"))
    return G.find_seeds(asked, nodes(spark, sf_dir))


PATHS_SQL = f"{N_SQL}, {E_SQL}, {DEG_SQL}, {W_SQL}, {SEED_SQL}, {HOP1_SQL}, paths as (select h1.*, {CONF_SQL} as confidence from h1 join n on dst = id left join w using (rel_type))"


def _paths(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return G.score_paths(G.expand(_seeds(spark, sf_dir), e, n, degree_limit=HUB), n)


@query(f"with {PATHS_SQL} select query_id, dst, rel_type, confidence from paths qualify row_number() over (partition by query_id, seed order by confidence desc, hop, rel_type, dst, src) <= 5")
def per_seed_limit(spark, sf_dir):
    return G.limit_per_seed(_paths(spark, sf_dir), 5).select("query_id", "dst", "rel_type", "confidence")


CAP_SQL = f"""{PATHS_SQL}, sure as (select * from paths where confidence >= 0.5),
best as (select query_id, id, min(hop) as hop, max(confidence) as confidence from (
  select distinct query_id, seed as id, 0 as hop, 1.0::double as confidence from sure union all select query_id, dst, hop, confidence from sure) group by query_id, id),
kept as (select * from best qualify row_number() over (partition by query_id order by confidence desc, hop, id) <= 8)"""


@query(f"with {CAP_SQL} select query_id, id, hop, confidence from kept")
def node_cap(spark, sf_dir):
    return G.prune(_paths(spark, sf_dir), 0.5, 8)[0]


@query(f"with {CAP_SQL} select distinct query_id, src, dst, rel_type from sure semi join (select query_id as q1, id as i1 from kept) on query_id = q1 and src = i1 semi join (select query_id as q2, id as i2 from kept) on query_id = q2 and dst = i2")
def edge_cascade(spark, sf_dir):
    return G.prune(_paths(spark, sf_dir), 0.5, 8)[1]


@query(f"with {PATHS_SQL} select query_id, count(*) as n_paths, count(*) filter (confidence < 0.9) as pruned from paths group by query_id")
def prune_counts(spark, sf_dir):
    return G.prune(_paths(spark, sf_dir), 0.9)[2]


@query("select * from (values (1, ['belongs_to', 'drugs_of']), (2, ['acompany_with', 'belongs_to', 'common_drug', 'cure_way', 'do_eat', 'drugs_of', 'has_symptom', 'need_check', 'no_eat', 'recommand_drug', 'recommand_eat']), (3, ['acompany_with', 'belongs_to', 'common_drug', 'cure_way', 'do_eat', 'has_symptom', 'need_check', 'no_eat', 'recommand_drug'])) t(query_id, relations)")
def infer_relations(spark, sf_dir):
    entities = spark.createDataFrame([(1, "Drug"), (1, "Department"), (2, "Food"), (2, "Check"), (3, "Disease")], "query_id int, etype string")
    return G.infer_relations(entities)


@query(f"with {E_SQL} select rel_type, count(*) as n from e group by rel_type")
def relation_counts(spark, sf_dir):
    return G.relation_counts(edges(spark, sf_dir))


GROUP_SQL = f"""{PATHS_SQL}, seen as (select distinct query_id, label, name from paths join n on dst = id),
g as (select query_id, label, list_sort(list(name)) as a from seen group by query_id, label)"""


@query(f"with {GROUP_SQL} select query_id, label, len(a) as n, array_to_string(a[1:10], ', ') || case when len(a) > 10 then ', ...等' || len(a) || '个' else '' end as names from g")
def label_groups(spark, sf_dir):
    found = _paths(spark, sf_dir).join(nodes(spark, sf_dir).select(F.col("id").alias("dst"), "label", "name"), "dst").select("query_id", "label", "name").distinct()
    return G.label_groups(found)


@query("""with nb as (select n_nationkey, n_name, r_name, list_sort(list(distinct s_name)) as sups from nation join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by all)
select n_nationkey as kg_id, '【疾病档案】' || n_name || chr(10) || '【分类路径】' || r_name || chr(10) || '【常见症状】' || coalesce(nullif(array_to_string(sups, '、'), ''), '暂无相关信息') || chr(10) || '【疾病简介】暂无相关信息' as raw_text from nb""")
def linearize(spark, sf_dir):
    return _linear(spark, sf_dir).select(F.col("n_nationkey").alias("kg_id"), "raw_text")


def _linear(spark, sf_dir):
    e = edges(spark, sf_dir)
    n = nodes(spark, sf_dir)
    into = e.filter("rel_type = 'belongs_to' and src like 'Supplier:%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("has_symptom").alias("rel_type"))
    star = TX.neighbourhoods(into, n, ["has_symptom"])
    base = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", _key("Nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("category"))
    return TX.render(base.join(star, "id", "left"), [("疾病档案", "name"), ("分类路径", "category"), ("常见症状", "has_symptom"), ("疾病简介", "desc")])


SECT_SQL = """with nb as (select n_nationkey, n_name, r_name, list_sort(list(distinct s_name)) as sups from nation join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by all)
select n_nationkey as kg_id, title, content from (
  select n_nationkey, '疾病档案' as title, n_name as content from nb union all select n_nationkey, '分类路径', r_name from nb
  union all select n_nationkey, '常见症状', array_to_string(sups, '、') from nb) where content <> ''"""


@query(SECT_SQL)
def section_parse(spark, sf_dir):
    return TX.sections(_linear(spark, sf_dir)).select(F.col("n_nationkey").alias("kg_id"), "title", "content")


@query(f"select kg_id || '__' || title || '__0' as chunk_id, title as section_type, '【' || n_name || '】的' || title || '包括：' || content as text from ({SECT_SQL}) join nation on kg_id = n_nationkey where floor(length('【' || n_name || '】的' || title || '包括：' || content) * 0.65) <= 256")
def section_chunks(spark, sf_dir):
    docs = _linear(spark, sf_dir).select(F.col("n_nationkey").alias("kg_id"), F.lit("Disease").alias("entity_type"), "name", "raw_text")
    return TX.chunks(docs).select("chunk_id", "section_type", "text")


@query(f"""with {N_SQL}, {E_SQL} select a.label as start_entity_type, b.label as end_entity_type, rel_type, count(distinct (a.name, b.name)) as n_pairs from e join n a on src = a.id join n b on dst = b.id group by all""")
def export_relations_json(spark, sf_dir):
    made = G.export_relations(edges(spark, sf_dir), nodes(spark, sf_dir))
    return made.groupBy("start_entity_type", "end_entity_type", "rel_type").agg(F.sum(F.json_array_length("rels")).alias("n_pairs"))


#: Headings for the labels of this graph.
HEADINGS = {"Nation": "nations", "Part": "parts", "Customer": "customers"}
INTENTS = {0: "medication_inquiry", 1: "disease_inquiry", 2: "diet_lifestyle", 3: "other"}
_listed = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_placed = lambda names, column: f"case {column} " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(names)) + f" else {len(names)} end"
_named = lambda names, column: f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {column} end"
INTENT_SQL = f"""{N_SQL}, {E_SQL}, {DEG_SQL}, {W_SQL}, {SEED_SQL}, {HOP1_SQL},
plan as (select 'Customer:' || c_custkey as query_id, c_name as entity, case c_custkey % 4 {" ".join(f"when {k} then {_listed(INTENT_TEMPLATES[i][0])}" for k, i in INTENTS.items() if INTENT_TEMPLATES[i][0])}
  when 3 then case when c_custkey % 8 = 3 then ['belongs_to'] else {_listed(sorted(RELATION_WEIGHTS))} end end as rels, case c_custkey % 4 {" ".join(f"when {k} then '{INTENT_TEMPLATES[i][2]}'" for k, i in INTENTS.items())} end as prompt from customer),
paths as (select h1.*, {CONF_SQL} as confidence from h1 join plan using (query_id) join n on dst = id left join w using (rel_type) where list_contains(rels, rel_type) qualify row_number() over (partition by query_id, seed order by {CONF_SQL} desc, hop, rel_type, dst, src) <= 30),
sure as (select * from paths where confidence >= 0.5),
kept as (select query_id, id, min(hop) as hop, max(confidence) as confidence from (select distinct query_id, seed as id, 0 as hop, 1.0::double as confidence from sure union all select query_id, dst, hop, confidence from sure) group by query_id, id),
lines as (select query_id, {_placed(HEADINGS, "label")} as spot, sum(count(*)) over (partition by query_id) as n_nodes, label, {_named(HEADINGS, "label")} || '：' || string_agg(name, ', ' order by confidence desc, hop, id) as line from kept join n using (id) group by query_id, label),
lined as (select query_id, max(n_nodes) as n_nodes, string_agg('  - ' || line, chr(10) order by spot) filter (label in ('Nation', 'Part', 'Customer')) as lines from lines group by query_id),
counts as (select query_id, rel_type, count(*) as n from (select distinct query_id, src, dst, rel_type from sure) group by query_id, rel_type),
rels as (select query_id, sum(n) as n_edges, string_agg({_named(RELATION_NAMES, "rel_type")} || '(' || n || '条)', ', ' order by {_placed(RELATION_NAMES, "rel_type")}) as rels from counts group by query_id)
select query_id, coalesce(n_nodes, 0)::bigint as n_nodes, coalesce(n_edges, 0)::bigint as n_edges,
  case when n_nodes is null then '{R.NOTHING}' else replace(replace(prompt, '{{entity}}', entity), '{{knowledge}}', lines || chr(10) || '  - 关系类型：' || rels.rels) end as description from plan left join lined using (query_id) left join rels using (query_id)"""


@query(f"with {INTENT_SQL}")
def intent_retrieval(spark, sf_dir):
    """From a question's intent and entity types to relations, subgraph and text, for every customer as the entity of a question."""
    parts = edge_parts(spark, sf_dir, _code)
    calm = G.calm_edges(reduce(DataFrame.union, parts), HUB, leaving=parts[0])  # of the nodes that edges lead to, only nations have edges of their own
    e = calm.filter(F.col("src.label") != LABELS.index("Supplier"))  # they count for degrees; no question asks for a supplier and no edge leads to one
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    asked = customers.select(key.alias("query_id"), F.element_at(F.array(*(F.lit(i) for i in INTENTS.values())), (key % 4 + 1).cast("int")).alias("intent"))
    entities = customers.select(key.alias("query_id"), F.col("c_name").alias("name"), F.when(key % 8 == 3, "Department").otherwise("Food").alias("etype"))
    seeds = customers.select(key.alias("query_id"), _code("Customer", "c_custkey").alias("seed"))
    found = R.retrieve(asked, entities, seeds, e, nodes(spark, sf_dir, _code), degree_limit=None, shown=_text, headings=HEADINGS)
    return found.withColumn("query_id", F.concat(F.lit("Customer:"), F.col("query_id").cast("string")))
