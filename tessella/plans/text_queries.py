"""Text, mention, linking and extraction queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import linking as L
from ..operators import mentions as M
from ..operators import text as TX
from ..operators.constants import TYPE_PRIORITY
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


STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(12288) || chr(160))"
SENT_SQL = f"s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。；\\n!?]*[。；\\n!?]|[^。；\\n!?]+'), lambda x: {STRIP.format('x')}), lambda x: x <> '') as ss from documents)"


@query(f"with {SENT_SQL} select doc_id, len(ss) as n_sentences, coalesce(list_sum(list_transform(ss, lambda x: length(x))), 0)::bigint as n_chars, floor(length(array_to_string(ss, '')) * 0.65)::int as est_tokens from s")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", C.sentences(F.coalesce("text", F.lit(""))).alias("ss"))
    joined = F.array_join("ss", "")
    return d.select("doc_id", F.size("ss").alias("n_sentences"), F.length(joined).cast("long").alias("n_chars"), C.token_estimate(joined).alias("est_tokens"))


@query()
def chunking(spark, sf_dir):
    """Chunks of whole documents as one section each; a fold, so it is held against plain Python in the tests."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.posexplode(TX.chunk_texts(F.col("text"), F.concat(F.lit("【"), F.col("doc_id").cast("string"), F.lit("】的text包括："))))).select("doc_id", F.col("pos").alias("idx"), F.length("col").alias("n_chars"), F.sha2("col", 256).alias("sha"))


@query("""select p_partkey, list_filter([case when p_size * 2 < 50 then 'low_cure_rate' end, case when p_partkey % 4 = 0 then 'non_medical_insurance' end], lambda x: x is not null) as flags from part""")
def safety_flags(spark, sf_dir):
    rate = F.concat(F.lit("about "), (F.col("p_size") * 2).cast("string"), F.lit(".0%"))
    return table(spark, sf_dir, "part").select("p_partkey", TX.safety_flags(rate, F.when(F.col("p_partkey") % 4 == 0, "否").otherwise("是")).alias("flags"))


#: The driver's gazetteer: part names as drugs, their words as symptoms, and Brand aliases.
DICT_SQL = """dict as (select surface, min(name) as name, etype from (
  select distinct p_name as surface, p_name as name, 'Drug' as etype from part
  union all select distinct string_split(p_name, ' ')[1], string_split(p_name, ' ')[1], 'Symptom' from part
  union all select distinct string_split(p_name, ' ')[2], string_split(p_name, ' ')[2], 'Check' from part) group by surface, etype)"""
TEXT_SQL = "t as (select p_partkey as text_id, 'we saw ' || p_name || ' near ' || p_type || ' 7' as text from part)"
GAZ_SQL = f"""{DICT_SQL}, {TEXT_SQL}, pos as (select text_id, text, unnest(range(0, length(text))) as st from t), lens as (select distinct length(surface) as n from dict),
g as (select text_id, st as start, st + n as "end", surface as text, etype from (select text_id, st, n, substr(text, st::int + 1, n::int) as surface from pos, lens where st + n <= length(text)) join dict using (surface))"""
LONG_SQL = GAZ_SQL + """, l as (select * from g where not exists (select 1 from g o where o.text_id = g.text_id and o.start <= g.start and g."end" <= o."end" and (o.start < g.start or o."end" > g."end")))"""


def _gazetteer(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    none = F.array().cast("array<string>").alias("aliases")
    entry = lambda name, etype: p.select(name.alias("name"), none, F.lit(None).cast("string").alias("kg_id"), F.lit(etype).alias("etype")).distinct()
    return entry(F.col("p_name"), "Drug").unionByName(entry(words[0], "Symptom")).unionByName(entry(words[1], "Check"))


def _named(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("we saw "), "p_name", F.lit(" near "), "p_type", F.lit(" 7")).alias("text"))


SPAN = ["text_id", "start", "end", "text", "etype"]


@query(f'with {GAZ_SQL} select text_id, start, "end", text, etype from g')
def gazetteer_match(spark, sf_dir):
    return M.match(_named(spark, sf_dir), _gazetteer(spark, sf_dir)).select(SPAN)


@query(f'with {GAZ_SQL} select text_id, start, "end", text, etype from g')
def gazetteer_automaton(spark, sf_dir):
    return M.match(_named(spark, sf_dir), _gazetteer(spark, sf_dir), "automaton").select(SPAN)


@query(f'with {LONG_SQL} select text_id, start, "end", text, etype from l')
def longest_match(spark, sf_dir):
    return M.longest(M.match(_named(spark, sf_dir), _gazetteer(spark, sf_dir))).select(SPAN)


@query(f"""with {TEXT_SQL}, m as (select text_id, text, unnest(string_split(text, ' ')) as w from t) select text_id, w as text from m where not regexp_full_match(w, '[\\x00-\\x7F]') and not regexp_full_match(w, '[0-9]+')""")
def noise_filter(spark, sf_dir):
    words = _named(spark, sf_dir).select("text_id", F.explode(F.split("text", " ")).alias("text"))
    return M.without_noise(words)


PRIORITY = " ".join(f"when '{t}' then {p}" for t, p in TYPE_PRIORITY.items())
TYPE_SQL = "m as (select p_partkey as text_id, 0 as start, length(p_name) as \"end\", p_name as name, etype from part, (values ('Drug'), ('Food'), ('Check'), ('Deny')) x(etype) where not (etype = 'Drug' and p_partkey % 2 = 0))"


@query(f'with {TYPE_SQL} select text_id, start, "end", etype from m qualify row_number() over (partition by text_id, start, "end" order by case etype {PRIORITY} end desc, etype, name) = 1')
def type_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("text_id"), F.lit(0).alias("start"), F.length("p_name").alias("end"), F.col("p_name").alias("name"), F.explode(F.array(*map(F.lit, ("Drug", "Food", "Check", "Deny")))).alias("etype"))
    return M.best_type(rows.filter(~((F.col("etype") == "Drug") & (F.col("text_id") % 2 == 0)))).select("text_id", "start", "end", "etype")


def _spans(spark, sf_dir):
    """Deterministic spans of three sources over events, ten to a text."""
    e = table(spark, sf_dir, "events")
    start = F.col("event_id") * 7 % 40
    return e.select(
        (F.col("event_id") % 200).alias("text_id"), start.cast("int").alias("start"), (start + 1 + F.col("event_id") * 3 % 9).cast("int").alias("end"),
        F.when(F.col("event_id") % 2 == 0, "Drug").otherwise("Food").alias("etype"), F.element_at(F.array(*map(F.lit, ("keyword", "ner", "llm"))), (F.col("user_id") % 3 + 1).cast("int")).alias("source"),
        (F.lit(0.4) + (F.col("event_id") % 7).cast("double") / 10.0).alias("confidence"),
    )


SPANS_SQL = """m as (select event_id % 200 as text_id, (event_id * 7 % 40)::int as start, (event_id * 7 % 40 + 1 + event_id * 3 % 9)::int as "end", case when event_id % 2 = 0 then 'Drug' else 'Food' end as etype,
  case user_id % 3 when 0 then 'keyword' when 1 then 'ner' else 'llm' end as source, 0.4::double + (event_id % 7)::double / 10.0::double as confidence from events)"""
FUSE_SQL = f"""with recursive {SPANS_SQL}, r as (select *, case source when 'keyword' then 3 when 'ner' then 2 else 1 end as rank from m),
o as (select *, row_number() over (partition by text_id order by start, -"end", -rank, etype, "end", confidence, source) as k from r),
f as (select text_id, k, start, "end", etype, rank, confidence, source, 1 as slot from o where k = 1
  union all select o.text_id, o.k,
    case when a or w then o.start else f.start end, case when a or w then o."end" else f."end" end, case when a or w then o.etype else f.etype end, case when a or w then o.rank else f.rank end,
    case when a or w then o.confidence else f.confidence end, case when a or w then o.source else f.source end, f.slot + a::int
  from (select f.text_id, f.k, f.slot, f.start, f."end", f.etype, f.rank, f.confidence, f.source, o.start >= f."end" as a,
      not (o.start >= f."end") and not (f.start <= o.start and o."end" <= f."end") and (o.rank > f.rank or (o.rank = f.rank and (o.confidence > f.confidence or (o.confidence = f.confidence and o."end" - o.start > f."end" - f.start)))) as w
    from f join o on o.text_id = f.text_id and o.k = f.k + 1) f join o on o.text_id = f.text_id and o.k = f.k + 1)
select text_id, start, "end", etype, source, confidence from (select * from f qualify row_number() over (partition by text_id, slot order by k desc) = 1) where confidence >= 0.5"""


@query(FUSE_SQL)
def span_fuse(spark, sf_dir):
    return M.fuse(_spans(spark, sf_dir))


@query(f"""with {SPANS_SQL}, t as (select c_custkey as text_id, length(c_name || c_mktsegment || '                                ') as len from customer),
c as (select text_id, count(distinct p) as covered from (select text_id, unnest(range(start, "end")) as p from m) group by 1), a as (select text_id, count(*) as n, avg(confidence) as avg_confidence from m group by 1)
select t.text_id, coalesce(n, 0)::int as n, round(coalesce(covered, 0) / len, 6) as coverage, round(coalesce(n, 0) / len, 6) as density, round(coalesce(avg_confidence, 0), 6) as avg_confidence from t left join c using (text_id) left join a using (text_id)""")
def coverage_density(spark, sf_dir):
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("text_id"), F.concat("c_name", "c_mktsegment", F.lit(" " * 32)).alias("text"))
    return M.coverage(texts, _spans(spark, sf_dir)).withColumn("n", F.col("n").cast("int"))


ROUTE_SQL = """with t as (select conv_id, turn, text || case when turn % 4 = 0 then ' 怎么' when turn % 4 = 1 then ' 感觉' else '' end || case when conv_id % 3 = 0 then ' 可能' else '' end as text, (conv_id % 4)::int as n, case when conv_id % 2 = 0 then 2 end as n_model, case when conv_id % 2 = 0 then 0.2::double * (conv_id % 5) end as mc from conversations where role = 'user')
select conv_id, turn, (n < 2 or (length(text) >= 20 and n::double / length(text) < 0.05) or contains(text, '怎么') or (contains(text, '感觉') and not (n > 0 and strpos(text, '感觉') - 1 - 5 < 5 * n))) as to_model,
  (coalesce(mc < 0.3, false) or (n + coalesce(n_model, 0) < 2 and contains(text, '可能')) or (length(text) > 30 and n + coalesce(n_model, 0) < 3)) as to_llm from t"""


@query(ROUTE_SQL)
def route_layers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    tail = F.when(F.col("turn") % 4 == 0, " 怎么").when(F.col("turn") % 4 == 1, " 感觉").otherwise("")
    text = F.concat("text", tail, F.when(F.col("conv_id") % 3 == 0, " 可能").otherwise(""))
    spans = F.slice(F.array(*(F.struct(F.lit(5 * k).alias("start"), F.lit(5 * k + 5).alias("end")) for k in range(3))), F.lit(1), (F.col("conv_id") % 4).cast("int"))
    even = F.col("conv_id") % 2 == 0
    told = c.select("conv_id", "turn", text.alias("text"), spans.alias("spans"), F.when(even, 2).alias("n_model"), F.when(even, 0.2 * (F.col("conv_id") % 5)).alias("model_confidence"))
    return M.route(told).select("conv_id", "turn", "to_model", "to_llm")


#: Mentions to link: part names as they are, and with one letter taken out by the key.
MENTION_SQL = """e as (select distinct p_name as name from part), al as (select name, upper(name) as alias from e),
m as (select p_partkey as mention_id, case p_partkey % 4 when 0 then p_name when 1 then upper(p_name) else substr(p_name, 1, (2 + p_partkey % 3)::int) || substr(p_name, (4 + p_partkey % 3)::int) end as text from part)"""


def _linkable(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    entities = p.select(F.col("p_name").alias("name")).distinct().select("name", F.array(F.upper("name")).alias("aliases"), F.lit("Drug").alias("etype"), F.concat(F.lit("kg:"), "name").alias("kg_id"))
    k = F.col("p_partkey") % 3
    cut = F.concat(F.substring("p_name", F.lit(1), (2 + k).cast("int")), F.substring("p_name", (4 + k).cast("int"), F.length("p_name")))
    text = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.upper("p_name")).otherwise(cut)
    return p.select(F.col("p_partkey").alias("mention_id"), text.alias("text")), entities


@query(f"with {MENTION_SQL} select mention_id, name, 'exact' as stage from m join e on text = name union all select mention_id, name, 'alias' from m join al on text = alias")
def link_exact_alias(spark, sf_dir):
    mentions, entities = _linkable(spark, sf_dir)
    return L.exact(mentions, entities).unionByName(L.alias(mentions, entities)).select("mention_id", "name", "stage")


EDIT_SQL = """ed as (select mention_id, text, name, levenshtein(text, name) as distance, round(1.0::double - levenshtein(text, name) / greatest(length(text), length(name)), 6) as similarity from {}, e
  where abs(length(text) - length(name)) <= 2 and levenshtein(text, name) <= case when length(text) <= 2 then 0 when length(text) <= 4 then 1 else 2 end)"""


@query(f"with {MENTION_SQL}, {EDIT_SQL.format('m')} select mention_id, name, distance::int as distance, similarity from ed qualify row_number() over (partition by mention_id order by similarity desc, name) <= 3")
def link_fuzzy(spark, sf_dir):
    mentions, entities = _linkable(spark, sf_dir)
    return L.edit(mentions, entities).select("mention_id", "name", "distance", "similarity")


CASC_SQL = f"""{MENTION_SQL}, x as (select mention_id, text, name, 'exact' as stage, 1.0::double as similarity from m join e on text = name), a as (select mention_id, text, name, 'alias' as stage, 1.0::double as similarity from m join al on text = alias where mention_id not in (select mention_id from x)),
rest as (select * from m where mention_id not in (select mention_id from x) and mention_id not in (select mention_id from a)), {EDIT_SQL.format('rest')},
k as (select mention_id, text, name, 'edit' as stage, similarity from ed qualify row_number() over (partition by mention_id order by similarity desc, name) <= 3),
whole as (select * from x union all select * from a union all select * from k)"""
CONF = "round(least(1.0::double, greatest(0.0::double, case stage when 'exact' then 1.0::double when 'alias' then 0.95::double when 'edit' then 0.75::double else 0.0::double end + 0.2::double * similarity + least(length(name) / 10.0::double, 0.1::double))), 6)"


@query(f"with {CASC_SQL} select mention_id, name, stage, similarity, {CONF} as confidence from whole")
def link_cascade(spark, sf_dir):
    mentions, entities = _linkable(spark, sf_dir)
    return L.cascade(mentions, entities).select("mention_id", "name", "stage", "similarity", "confidence")


@query(f"with {CASC_SQL} select mention_id, name, stage, {CONF} as confidence from whole qualify row_number() over (partition by mention_id order by case stage when 'exact' then 1 when 'alias' then 2 else 3 end, similarity desc, length(name) desc, name) = 1")
def link_best(spark, sf_dir):
    mentions, entities = _linkable(spark, sf_dir)
    return L.best(L.cascade(mentions, entities)).select("mention_id", "name", "stage", "confidence")


@query(f"select p_partkey, stage, {CONF.replace('similarity', 'sim').replace('length(name)', 'length(p_name)')} as confidence from (select p_partkey, p_name, ['exact', 'alias', 'vector_', 'edit', 'none'][(p_partkey % 5 + 1)::int] as stage, (p_partkey % 11)::double / 10.0::double as sim from part)")
def confidence_calibration(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stage = F.element_at(F.array(*map(F.lit, ("exact", "alias", "vector_", "edit", "none"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", stage.alias("stage"), F.round(C.calibrated(stage, (F.col("p_partkey") % 11).cast("double") / 10.0, F.col("p_name")), 6).alias("confidence"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", TX.html_title(F.col("html")).alias("title"))


@query("""select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as links from pages""")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", TX.html_links(F.col("html")).alias("links"))


@query(f"select page_id, len(p) as n, array_to_string(list_transform(p, lambda x: {STRIP.format("regexp_replace(x, '<[^>]*>', '', 'g')")}), '|') as paragraphs from (select page_id, regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) as p from pages)")
def html_paragraphs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", TX.html_paragraphs(F.col("html")).alias("p"))
    return p.select("page_id", F.size("p").alias("n"), F.array_join("p", "|").alias("paragraphs"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages),
k as (select href, min(page_id) as target from (select page_id, regexp_extract(html, '<a href="([^"]*)"', 1) as href from pages) where href <> '' group by href)
select page_id, count(*) as hits, list_sort(list(distinct target)) as targets from l join k using (href) group by page_id""")
def url_lookup(spark, sf_dir):
    """Links looked up in the table of pages by their first link: an equi-join, misses dropped, targets collected."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(TX.html_links(F.col("html"))).alias("href"))
    known = p.select("page_id", F.get(TX.html_links(F.col("html")), F.lit(0)).alias("href")).filter("href <> ''").groupBy("href").agg(F.min("page_id").alias("target"))
    return links.join(known, "href").groupBy("page_id").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("target")).alias("targets"))


@query("select event_id, event_type as kind, (json_extract_string(props, '$.k')) as k from events")
def attr_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    items = F.array(F.concat(F.lit("类型：x"), F.lit("")), F.concat(F.lit("类型："), "event_type"), F.concat(F.lit("值："), k), F.lit("bad"), F.lit("a：b：c"))
    pairs = TX.rename_keys(TX.attr_pairs(items), {"类型": "kind", "值": "k"})
    return e.select("event_id", F.element_at(pairs, "kind").alias("kind"), F.element_at(pairs, "k").alias("k"))


@query("select p_partkey, p_name as producer, p_brand as drug from part")
def producer_split(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("s", F.concat("p_name", F.lit("("), "p_brand", F.lit(")")))
    return p.select("p_partkey", C.before_paren(F.col("s")).alias("producer"), C.inside_paren(F.col("s")).alias("drug"))


@query("select distinct p_name, replace(p_name, ' ', '|') as cut from part where p_name like '% %'")
def segment_bidirectional(spark, sf_dir):
    """Part names without their space, cut by a dictionary of all the names' words."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    words = p.select(F.explode(F.split("p_name", " ")).alias("w"))
    joined = p.filter("p_name like '% %'").withColumn("text", F.replace("p_name", F.lit(" "), F.lit("")))
    return TX.segment(joined, words).select("p_name", F.array_join("cut", "|").alias("cut"))


@query("""select p_partkey as text_id, 9 as start, 9 + length(p_name) as "end", 'Drug' as etype from part""")
def llm_json_parse(spark, sf_dir):
    """Fenced answers with a Chinese type and a wrong place: parsed, normalised and repaired."""
    p = table(spark, sf_dir, "part")
    answer = F.concat(F.lit('ok:\n```json\n[{"text": "'), "p_name", F.lit('", "type": "药品", "start": 2, "end": 4}]\n```'))
    rows = p.select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("about -> "), "p_name").alias("text"), answer.alias("answer"))
    return M.answer_mentions(rows).select("text_id", "start", "end", "etype")


@query("""select p_partkey as text_id, 2 as start, 2 + length(p_name) as "end", 'Check' as etype, 0.9::double as confidence from part union all select p_partkey, 0, 1, 'Disease', 0.5::double from part""")
def model_items(spark, sf_dir):
    """Raw model output whose items name their fields differently."""
    out = F.concat(F.lit('[{"label": "PRO", "word": "'), "p_name", F.lit('", "score": 0.9}, {"type": "x", "start": 0, "end": 1, "prob": 0.5}]'))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit(": "), "p_name").alias("text"), out.alias("output"))
    return M.model_items(rows).select("text_id", "start", "end", "etype", "confidence")


@query(f"""with {SPANS_SQL.replace("event_id % 200 as text_id", "event_id % 200 as text_id, event_id as seq")} select text_id, start, "end", etype, confidence from m where "end" <= 40 qualify row_number() over (partition by text_id, start, "end" order by confidence desc, seq) = 1""")
def model_dedup(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    seq = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 200).alias("text_id"), (F.col("event_id") * 7 % 40).cast("int").alias("start"), (F.col("event_id") * 7 % 40 + 1 + F.col("event_id") * 3 % 9).cast("int").alias("end"), F.when(F.col("event_id") % 2 == 0, "Drug").otherwise("Food").alias("etype"), (F.lit(0.4) + (F.col("event_id") % 7).cast("double") / 10.0).alias("confidence"))
    texts = spans.select("text_id").distinct().withColumn("text", F.lit("x" * 40))
    return M.valid_predictions(M.dedup_predictions(seq).withColumn("text", F.lit("")), texts).select("text_id", "start", "end", "etype", "confidence")
