"""Search, linking-by-vector and fusion queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import fusion as FU
from ..operators import graph as G
from ..operators import intents as I
from ..operators import linking as L
from ..operators import search as S
from .graph_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Stated query sets: vectors with an id divisible by 20, benchmark items as keyword queries.
def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


V_SQL = "v as (select a.vec_id as query_id, b.vec_id as chunk_id, b.label, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 20 = 0)"
TOP = "qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {}"
RANKED = "select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from {} qualify rank <= {}"


@query(f"with {V_SQL} {RANKED.format('v', 5)}")
def vector_topk(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    return S.search(q, c, k=5, least=-1.0)


@query(f"with {V_SQL} {RANKED.format('(select * from v where label in (1, 2, 3) and score >= 0.05)', 5)}")
def vector_topk_filtered(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    return S.search(q, c, k=5, least=0.05, label=[1, 2, 3])


@query(f"with {V_SQL}, r as ({RANKED.format('v', 10)}) select * from r where score >= 0.25")
def vector_rank_gap(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    return S.rank_then_threshold(S.search(q, c, k=10, least=-1.0).drop("rank"), 10, 0.25)


@query("select case when vec_id % 50 = 0 then 'no_embedding' when label = 9 then 'bad_dim' else 'ok' end as reason, count(*) as n from embeddings group by 1")
def vector_validate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    spoiled = e.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 50 != 0, F.when(F.col("label") == 9, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))).alias("embedding"))
    return S.validate_chunks(spoiled, 64).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id as chunk_id, max(version) as version from (select vec_id, 1 as version from embeddings union all select vec_id, 2 from embeddings where vec_id % 3 = 0) group by 1")
def vector_upsert_latest(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return S.upsert_latest(ids.withColumn("version", F.lit(1)).unionByName(ids.filter("chunk_id % 3 = 0").withColumn("version", F.lit(2))))


TOK = "list_transform(regexp_extract_all({}, '[a-zA-Z]+'), lambda x: lower(x))"
K_SQL = f"""q as (select item_id as query_id, {TOK.format('text')} as t from benchmark),
d as (select doc_id as chunk_id, list_distinct({TOK.format('text')}) as t from documents),
qt as (select query_id, len(t) as nq, unnest(t) as token from q), dt as (select chunk_id, len(t) as nd, unnest(t) as token from d),
k as (select query_id, chunk_id, round(count(*)::double / greatest(nq, nd), 6) as score from qt join dt using (token) group by query_id, chunk_id, nq, nd)"""


def _texts(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), C.tokens(F.col("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source", C.tokens(F.col("text")).alias("tokens"))
    return q, d


@query(f"with {K_SQL} {RANKED.format('k', 5)}")
def keyword_search(spark, sf_dir):
    q, d = _texts(spark, sf_dir)
    return S.search(q, d, "keyword_only", k=5)


@query(f"with {K_SQL} {RANKED.format('(select k.* from k join documents on doc_id = chunk_id where lang in (' + chr(39) + 'de' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + '))', 3)}")
def keyword_search_filtered(spark, sf_dir):
    q, d = _texts(spark, sf_dir)
    return S.search(q, d, "keyword_only", k=3, lang=["de", "fr"])


@query("""with p as (select n_nationkey as query_id, doc_id as chunk_id, (source = 'src' || n_nationkey) as hit from documents, nation)
select query_id, chunk_id from (select *, bool_or(hit) over (partition by query_id) as anyhit from p) where hit or not anyhit""")
def keyword_prefilter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    pairs = docs.join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"))))
    return S.keyword_prefilter(pairs, F.col("source") == F.concat(F.lit("src"), F.col("query_id"))).select("query_id", "chunk_id")


@query(f"with dt as (select doc_id, unnest(list_distinct({TOK.format('text')})) as token from documents) select token, count(*) as n_docs, min(doc_id) as first_doc from dt group by token")
def inverted_index(spark, sf_dir):
    _, d = _texts(spark, sf_dir)
    return S.inverted_index(d).groupBy("token").agg(F.sum(F.size("postings")).alias("n_docs"), F.min(F.col("postings")[0]).alias("first_doc"))


H_SQL = f"""q as (select vec_id as query_id, e.embedding, {TOK.format('text')} as t from embeddings e join documents on doc_id = vec_id where vec_id % 20 = 0),
d as (select doc_id as chunk_id, embedding, list_distinct({TOK.format('text')}) as t from documents join embeddings on vec_id = doc_id),
qt as (select query_id, len(t) as nq, unnest(t) as token from q), dt as (select chunk_id, len(t) as nd, unnest(t) as token from d),
k as (select query_id, chunk_id, round(count(*)::double / greatest(nq, nd), 6) as score from qt join dt using (token) group by query_id, chunk_id, nq, nd),
v as (select query_id, chunk_id, round(list_inner_product(q.embedding::double[], d.embedding::double[]), 6) as score from q, d),
vf as (select v.* from v join k using (query_id, chunk_id) where v.score >= 0),
h as (select query_id, chunk_id, round(0.7::double * coalesce(vf.score, 0) + 0.3::double * coalesce(k.score, 0), 9) as score from vf full join k using (query_id, chunk_id))"""


@query(f"with {H_SQL} {RANKED.format('h', 10)}")
def hybrid_search(spark, sf_dir):
    _, d = _texts(spark, sf_dir)
    chunks = d.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    q = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "tokens")
    return S.search(q, chunks, "hybrid", k=10)


B_SQL = f"""with {K_SQL}, r as ({RANKED.format('k', 5)}), t as (select r.*, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text from r join documents on doc_id = chunk_id),
c as (select *, length(text) + length(printf(' (相似度: %.3f)', score)) + 20 as cost from t),
u as (select *, 8 + coalesce(sum(cost) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as used from c),
f as (select *, used + cost <= 3000 as fits, 3000 - used - length(printf(' (相似度: %.3f)', score)) - 30 as remaining from u),
g as (select *, not fits and sum((not fits)::int) over (partition by query_id order by rank) = 1 and remaining > 50 as truncated from f)
select query_id, rank, used::bigint as used, case when fits then length(text) else remaining + 3 end::bigint as kept_length, truncated from g where fits or truncated"""


@query(B_SQL)
def search_context_budget(spark, sf_dir):
    q, d = _texts(spark, sf_dir)
    hits = S.search(q, d, "keyword_only", k=5).join(d.select("chunk_id", "text"), "chunk_id")
    return S.context_budget(hits, 3000).select("query_id", "rank", F.col("used").cast("long").alias("used"), F.length("kept_text").cast("long").alias("kept_length"), "truncated")


@query("""with s as (select a.vec_id as mention_id, b.vec_id as name, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a, embeddings b where a.vec_id % 20 = 0)
select mention_id, name::varchar as name, similarity from s where similarity >= 0.2 qualify row_number() over (partition by mention_id order by similarity desc, name::varchar) <= 3""")
def link_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("mention_id"), F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector"))
    names = e.select(F.col("vec_id").cast("string").alias("name"), F.lit("Part").alias("etype"), F.col("vec_id").alias("kg_id"), "embedding")
    return L.vector(asked, names, 0.2).select("mention_id", "name", "similarity")


R_SQL = f"""with {H_SQL}, a as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from v qualify rank <= 20),
b as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from k qualify rank <= 20),
s as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from a union all select * from b) group by all)
{RANKED.format('s', 10)}"""


@query(R_SQL)
def rrf_fusion(spark, sf_dir):
    _, d = _texts(spark, sf_dir)
    chunks = d.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    q = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "tokens")
    return FU.rrf_lists([S.search(q, chunks, k=20, least=-1.0), S.search(q, chunks, "keyword_only", k=20)])


SRC_SQL = f"""{V_SQL}, src as (
  select query_id, 'document' as source_type, chunk_id as source_id, score from (select * from v {TOP.format(4)})
  union all select distinct query_id, 'graph', 0, 1.0::double from v)"""


def _sources(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    docs = S.search(q, c, k=4, least=-1.0).select("query_id", F.lit("document").alias("source_type"), F.col("chunk_id").alias("source_id"), "score", F.concat(F.lit("doc "), F.col("chunk_id").cast("string")).alias("content"))
    graph = q.select("query_id", F.lit("graph").alias("source_type"), F.lit(0).cast("long").alias("source_id"), F.lit(1.0).alias("score"), F.lit("graph").alias("content"))
    return docs.unionByName(graph)


@query(f"with {SRC_SQL}, x as (select query_id, source_type, source_id, round(score * case when source_type = 'graph' then 0.4::double else 0.6::double end, 6) as score from src) select *, row_number() over (partition by query_id order by score desc, source_type, source_id) as rank from x")
def weighted_fusion(spark, sf_dir):
    return FU.weighted(_sources(spark, sf_dir), 0.4, 0.6).drop("content")


@query(f"with {SRC_SQL}, x as (select query_id, source_type, source_id, round(1.0::double / (60 + row_number() over (partition by query_id, source_type order by score desc, source_id)), 9) as score from src) select *, row_number() over (partition by query_id order by score desc, source_type, source_id) as rank from x")
def reciprocal_rank_sources(spark, sf_dir):
    return FU.reciprocal_rank(_sources(spark, sf_dir)).drop("content")


@query(f"with {SRC_SQL} select query_id, source_type, source_id, score, row_number() over (partition by query_id order by score desc, source_type, source_id) as rank from src")
def rerank(spark, sf_dir):
    return FU.rerank(_sources(spark, sf_dir)).drop("content")


@query(f"with {SRC_SQL} select query_id, count(*) as n_sources, count(*) filter (source_type = 'graph') as n_graph, count(*) filter (source_type = 'document') as n_documents from src group by query_id")
def source_counts(spark, sf_dir):
    return FU.source_counts(_sources(spark, sf_dir))


F_SQL = f"""with {SRC_SQL}, d as (select query_id, row_number() over (partition by query_id order by score desc, source_id) as no, score, source_id from src where source_type = 'document'),
j as (select query_id, string_agg(chr(10) || '[' || no || '] (相似度: ' || printf('%.3f', score) || ')' || chr(10) || 'doc ' || source_id, chr(10) order by no) as t from d group by query_id),
w as (select query_id, '【背景知识】' || chr(10) || chr(10) || '【知识图谱】' || chr(10) || 'graph' || chr(10) || chr(10) || '【文档资料】' || chr(10) || t as c from j)
select query_id, case when length(c) > 100 then substr(c, 1, 100) || chr(10) || '...（内容已截断）' else c end as context from w"""


@query(F_SQL)
def fused_context(spark, sf_dir):
    return FU.contexts(FU.rerank(_sources(spark, sf_dir)), 100)


#: Keywords that occur in the driver's texts, as the voters' lists; the defaults are the Chinese ones.
KEYWORDS = {"symptom_inquiry": ["the", "and"], "disease_inquiry": ["der", "die", "und"], "medication_inquiry": ["que", "de la"], "examination_inquiry": ["est"], "diet_lifestyle": ["ción"], "other": ["zzz"]}
VOTES = ", ".join(f"({k}, '{i}', " + " + ".join(f"contains(lower(text), '{w}')::int" for w in words) + ")" for k, (i, words) in enumerate(KEYWORDS.items()))
VOTE_SQL = f"""b as (select conv_id, turn, v.k, v.i, v.n from (select conv_id, turn, text from conversations where role = 'user'), lateral (values {VOTES}) v(k, i, n)),
w as (select conv_id, turn, case when n > 0 then i else 'other' end as intent, least(1.0::double, n / 5.0::double) as confidence from b qualify row_number() over (partition by conv_id, turn order by n desc, k) = 1)"""


def _voted(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return I.vote(asked, KEYWORDS).select("conv_id", "turn", "intent", "confidence")


@query(f"with {VOTE_SQL} select * from w")
def intent_vote(spark, sf_dir):
    return _voted(spark, sf_dir)


@query(f"""with {VOTE_SQL} select conv_id, turn, case when turn % 3 = 0 then 'medication_inquiry' else intent end as intent, case when turn % 3 = 0 then 0.9::double else confidence end as confidence, case when turn % 3 = 0 then 'model' else 'keyword' end as source from w""")
def intent_model_combine(spark, sf_dir):
    told = _voted(spark, sf_dir).withColumn("model_label", F.lit("治疗方案")).withColumn("model_confidence", F.when(F.col("turn") % 3 == 0, 0.9).when(F.col("turn") % 3 == 1, 0.5))
    return I.with_model(told).select("conv_id", "turn", "intent", "confidence", "source")


@query(f"""with {VOTE_SQL}, t(intent, n_relations, hops) as (values ('symptom_inquiry', 4, 1), ('disease_inquiry', 8, 2), ('medication_inquiry', 4, 1), ('examination_inquiry', 1, 1), ('diet_lifestyle', 3, 1), ('other', 0, 1)) select conv_id, turn, intent, n_relations, hops from w join t using (intent)""")
def intent_templates(spark, sf_dir):
    return _voted(spark, sf_dir).withColumn("t", I.template(F.col("intent"))).select("conv_id", "turn", "intent", F.coalesce(F.size("t.relations"), F.lit(0)).alias("n_relations"), F.col("t.hops").alias("hops"))


@query("""with d as (select doc_id as chunk_id, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x))) as t from documents),
q as (select item_id as query_id, list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x)) as t from benchmark),
qt as (select query_id, len(t) as nq, unnest(t) as token from q), dt as (select chunk_id, len(t) as nd, unnest(t) as token from d),
k as (select query_id, chunk_id, round(count(*)::double / greatest(nq, nd), 6) as score from qt join dt using (token) group by query_id, chunk_id, nq, nd),
doc as (select query_id, chunk_id, score from k qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 3),
g as (select item_id as query_id, count(*) as n from benchmark join nation on n_regionkey = item_id % 5 group by item_id),
src as (select query_id, 'document' as source_type, chunk_id::varchar as source_id, score from doc union all select query_id, 'graph', 'subgraph', 1.0::double from g),
x as (select *, row_number() over (partition by query_id, source_type order by score desc, source_id) as r from src)
select query_id, source_type, source_id, round(1.0::double / (60 + r), 9) as score, row_number() over (partition by query_id order by round(1.0::double / (60 + r), 9) desc, source_type, source_id) as rank from x""")
def rag_query(spark, sf_dir):
    """Questions with a region as their entity: its nations from the graph and three documents by keywords, fused by reciprocal rank."""
    asked = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.concat(F.lit("Region:"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("Nation:"), F.col("n_nationkey")).alias("dst"), F.lit("belongs_to").alias("rel_type"))
    nodes = nation.select(F.concat(F.lit("Nation:"), F.col("n_nationkey")).alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"), F.create_map(F.lit("n_regionkey"), F.col("n_regionkey").cast("string")).alias("props"), F.lit(None).cast("long").alias("degree"))
    seeds = asked.select("query_id", F.concat(F.lit("Region:"), F.col("query_id") % 5).alias("seed"))
    paths = G.score_paths(G.expand(seeds, edges, nodes), nodes)
    found = paths.join(nodes.select(F.col("id").alias("dst"), "label", "name"), "dst")
    content = G.graph_context(G.label_groups(found), G.relation_counts(found, "query_id"))
    graph = content.select("query_id", F.lit("graph").alias("source_type"), F.lit("subgraph").alias("source_id"), F.lit(1.0).alias("score"), "content")
    q, d = _texts(spark, sf_dir)
    hits = S.search(q, d, "keyword_only", k=3).join(d.select("chunk_id", "text"), "chunk_id")
    docs = hits.select("query_id", F.lit("document").alias("source_type"), F.col("chunk_id").cast("string").alias("source_id"), "score", F.col("text").alias("content"))
    return FU.reciprocal_rank(docs.unionByName(graph)).drop("content")
