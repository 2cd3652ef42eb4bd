"""Hand-computed cases of rules that the driver's tables don't reach, and properties."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import fusion, graph, intents, linking, mentions, nearest, search, text
from tessella.sources import files, stores
from tessella.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_intent_smoke_questions(spark):
    asked = [("感冒了怎么办？", "symptom_inquiry", 0.2), ("高血压能吃什么药？", "medication_inquiry", 0.4), ("肺炎需要做什么检查？", "disease_inquiry", 0.4), ("糖尿病患者饮食要注意什么？", "diet_lifestyle", 0.4), ("看感冒挂什么科？", "disease_inquiry", 0.2), ("hello", "other", 0.0)]
    got = intents.vote(spark.createDataFrame([(q,) for q, _, _ in asked], "text string")).collect()
    assert {r["text"]: (r["intent"], r["confidence"]) for r in got} == {q: (i, c) for q, i, c in asked}


def test_edge_confidence_of_bare_second_hop(spark):
    assert one(spark, F.round(C.edge_confidence(F.lit(0.6), F.lit(0.5), F.lit(2)), 6)) == 0.456


def test_completeness(spark):
    assert one(spark, C.completeness(F.create_map(F.lit("name"), F.lit("a")))) == 0.5
    assert one(spark, C.completeness(F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("x")))) == 0.5


def test_cleaning(spark):
    assert one(spark, C.clean_list(F.array(F.lit(" a\n"), F.lit(""), F.lit("b")))) == "a、b"
    assert one(spark, C.clean_text(F.lit(None).cast("string"))) == C.PLACEHOLDER
    assert one(spark, C.tokens(F.lit("Ab1c 肺炎x"))) == ["ab", "c", "x", "肺", "炎"]
    assert one(spark, C.inside_paren(F.lit("p(q)(r)"))) == "r"


def test_department_paths(spark):
    records = spark.createDataFrame([("a", ["x"]), ("b", ["big", "small"]), ("c", ["1", "2", "3"])], "name string, cure_department array<string>")
    got = {(r["src"], r["dst"]) for r in graph.department_edges(records).collect()}
    assert got == {("a", "x"), ("small", "big"), ("b", "small")}


def plain_chunks(sentences, prefix, most=256, overlap=2, min_tail=15):
    est = lambda s: int(len(s) * 0.65)
    out, buf, tok = [], [], 0
    for s in sentences:
        if tok + est(s) > most and buf:
            out.append(prefix + "".join(buf))
            buf = buf[-overlap:] if len(buf) > overlap else []
            tok = sum(map(est, buf))
        buf.append(s)
        tok += est(s)
    return out + ([prefix + "".join(buf)] if len(buf) >= min_tail else [])


def test_chunks_against_plain_python(spark):
    texts = ["短。" * n + "长" * m + "。尾！ok?" * k for n, m, k in [(1, 1, 1), (300, 10, 3), (40, 500, 60), (0, 1000, 0), (200, 0, 20)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["s"], r["c"]) for r in df.select("i", C.sentences(F.col("t")).alias("s"), text.chunk_texts(F.col("t"), F.lit("p")).alias("c")).collect()}
    for i, t in enumerate(texts):
        sentences, chunks = got[i]
        assert chunks == (["p" + t] if int(len("p" + t) * 0.65) <= 256 else plain_chunks(sentences, "p"))


def test_safety_flags(spark):
    assert one(spark, text.safety_flags(F.lit("about 5.5%"), F.lit("否"))) == ["low_cure_rate", "non_medical_insurance"]
    assert one(spark, text.safety_flags(F.lit("85%"), F.lit("是"))) == []


def test_single_char_denial(spark):
    rows = spark.createDataFrame([("我不痛", 1), ("不痛", 0), ("a不b", 1)], "t string, s int")
    got = [r["x"] for r in rows.select(mentions.single_char_ok(F.col("t"), F.col("s"), F.lit("Deny"), F.lit("不")).alias("x")).collect()]
    assert got == [False, True, True]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(1, 8), st.sampled_from(["keyword", "ner", "llm"]), st.sampled_from([0.3, 0.6, 0.9])), min_size=1, max_size=40))
def test_fused_spans_never_overlap(spark, spans):
    df = spark.createDataFrame([(t, s, s + n, "Drug", src, c) for t, s, n, src, c in spans], "text_id int, start int, end int, etype string, source string, confidence double")
    kept = {}
    for r in mentions.fuse(df).collect():
        kept.setdefault(r["text_id"], []).append((r["start"], r["end"]))
    assert all(a[1] <= b[0] for rows in kept.values() for a, b in zip(sorted(rows), sorted(rows)[1:]))


def test_cascade_runs_layers_on_routed_texts_only(spark):
    texts = spark.createDataFrame([(1, "aspirin and fever"), (2, "nothing here")], "text_id int, text string")
    words = spark.createDataFrame([("aspirin", ["asa"], "k1", "Drug"), ("fever", [], None, "Symptom")], "name string, aliases array<string>, kg_id string, etype string")
    model = lambda df: df.select("text_id", F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit("Food").alias("etype"), F.lit(0.7).alias("confidence"))
    got = {(r["text_id"], r["start"], r["source"]) for r in mentions.cascade(texts, words, model).collect()}
    assert got == {(1, 0, "keyword"), (1, 12, "keyword"), (2, 0, "ner")}


def test_repair_span(spark):
    cases = [("abcabc", "bc", 1, 3, 1), ("abcabc", "bc", 3, 6, 4), ("abcabc", "bc", 0, 1, 1), ("abc", "x", 0, 1, None)]
    rows = spark.createDataFrame([c[:4] for c in cases], "w string, s string, a int, b int")
    assert [r["x"] for r in rows.select(mentions.repair_span(*map(F.col, "wsab")).alias("x")).collect()] == [c[4] for c in cases]


def test_edit_links_against_all_pairs(spark):
    names = ["almond", "salmon", "lemon", "melon", "demon", "ab", "abc", "abcd", "almonds", "bumble"]
    asked = ["almon", "lemom", "elon", "ab", "abx", "abdc", "slmon", "xalmond"]
    mention = spark.createDataFrame(list(enumerate(asked)), "mention_id int, text string")
    entity = spark.createDataFrame([(n, "Drug", None) for n in names], "name string, etype string, kg_id string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    want = {(i, n, distance(a, n)) for i, a in enumerate(asked) for n in names if distance(a, n) <= (0 if len(a) <= 2 else 1 if len(a) <= 4 else 2)}
    assert {(r["mention_id"], r["name"], r["distance"]) for r in linking.edit(mention, entity, keep=100).collect()} == want


def plan_of(df):
    """The physical plan before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_edit_links_never_broadcast_the_exploded_texts(spark, monkeypatch):
    mention = spark.createDataFrame([(1, "almon"), (2, "almon"), (3, "lemom"), (3, "lemom")], "mention_id int, text string")
    entity = spark.createDataFrame([(n, "Drug", None) for n in ("almond", "salmon", "lemon", "melon")], "name string, etype string, kg_id string")
    want = [(1, "almond", 1), (1, "lemon", 2), (1, "salmon", 1), (2, "almond", 1), (2, "lemon", 2), (2, "salmon", 1), (3, "lemon", 1)]
    plans = []
    for most in (linking.BROADCAST_TEXTS, 1):
        monkeypatch.setattr(linking, "BROADCAST_TEXTS", most)
        got = linking.edit(mention, entity)
        assert sorted((r["mention_id"], r["name"], r["distance"]) for r in got.collect()) == want
        plans.append(plan_of(got))
    assert [(p.count("BroadcastHashJoin"), p.count("SortMergeJoin")) for p in plans] == [(1, 1), (0, 2)]


def test_link_results_keep_keyword_ids(spark):
    found = spark.createDataFrame([(1, "aspirin", "keyword", "old"), (2, "aspirin", "ner", None), (3, "zzz", "ner", "own")], "mention_id int, text string, source string, kg_id string")
    names = spark.createDataFrame([("aspirin", [], "Drug", "new")], "name string, aliases array<string>, etype string, kg_id string")
    got = {r["mention_id"]: (r["kg_id"], r["link_stage"]) for r in linking.link_results(found, linking.cascade(found.select("mention_id", "text"), names)).collect()}
    assert got == {1: ("old", None), 2: ("new", "exact"), 3: ("own", None)}


def test_two_way_cut():
    words = {"研究", "研究生", "生命", "起源", "的"}
    assert text.forward_cut("研究生命起源", words, 3) == ["研究生", "命", "起源"]
    assert text.two_way_cut("研究生命起源", words, 3) == ["研究", "生命", "起源"]


def test_segmentation_by_join_gives_the_same_cut(spark):
    words = spark.createDataFrame([(w,) for w in ("研究", "研究生", "生命", "起源", "的", "研究")], "w string")
    texts = spark.createDataFrame([(t,) for t in ("研究生命起源", "研究生命起源", "的", "", "xyz", None)], "text string")
    cuts = lambda df: sorted((r["text"] or "", r["cut"] or []) for r in df.collect())
    assert cuts(text.segment(texts, words)) == cuts(text.segment(texts, words, shipped=0))
    assert ("研究生命起源", ["研究", "生命", "起源"]) in cuts(text.segment(texts, words, shipped=0))
    assert {len(x) for _, x in cuts(text.segment(texts, words.limit(0)))} == {0, 1, 3, 6}


def test_index_blocks_hold_every_posting_once(spark):
    chunks = spark.range(50).selectExpr("id as chunk_id", "array('the', 'the', cast(id as string)) as tokens")
    rows = search.inverted_index(chunks, block=8).filter("token = 'the'").collect()
    assert len(rows) > 1 and sorted(x for r in rows for x in r["postings"]) == list(range(50))
    assert all(r["postings"] == sorted(r["postings"]) for r in rows)


def test_keyword_sides_meet_by_shuffle_beyond_the_bound(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z", "x"])], "chunk_id string, tokens array<string>")
    asked = spark.createDataFrame([(1, ["x", "x", "q"]), (2, ["z"])], "query_id int, tokens array<string>")
    small = sorted(map(tuple, search.keyword_scores(asked, chunks).collect()))
    monkeypatch.setattr(search, "BROADCAST_TOKENS", 0)
    assert sorted(map(tuple, search.keyword_scores(asked, chunks).collect())) == small and len(small) == 3


@pytest.mark.parametrize("least", [-1.0, 0.0, 0.25])
def test_search_ranks_as_all_pairs_do(spark, monkeypatch, least):
    """Ties, copies, null and odd vectors, queries without tokens or hits, tiny blocks; but no pair is made that can't be among the best."""
    draw = random.Random(7)
    vector = lambda i: None if i % 17 == 3 else [1.0] if i % 17 == 5 else [1.0, None] if i % 17 == 7 else [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(2)]
    words = lambda i: None if i % 13 == 2 else [draw.choice("abcdefghij") for _ in range(draw.randrange(6))] if i % 13 != 4 else ["only" + str(i)]
    chunks = spark.createDataFrame([(f"c{i * 37 % 300}", vector(i), words(i)) for i in range(300)], "chunk_id string, embedding array<float>, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([(i, vector(i), words(i)) for i in range(40)] + [(40, [0.5, 0.5], ["zzz"]), (41, [0.5, 0.5], [])], "query_id int, vector array<float>, tokens array<string>")
    for name, value in (("VECTORS", 15), ("TOKENS", 15), ("CELLS", 400), ("PAIRS", 20), ("HEAVY", 3)):
        monkeypatch.setattr(nearest, name, value)
    v, k = search.vector_scores(asked, chunks, least), search.keyword_scores(asked, chunks)
    flagged = v.join(k.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    whole = {"vector_only": v, "keyword_only": k, "hybrid": search.hybrid_scores(search.keyword_prefilter(flagged, F.col("hit").isNotNull()).drop("hit"), k)}
    for mode, scores in whole.items():
        got = search.search(asked, chunks, mode, k=4, least=least)
        columns = ["query_id", "chunk_id", "score", "rank"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, search.top_k(scores, 4).select(columns).collect())), mode
        assert not any(x in plan_of(got) for x in ("CartesianProduct", "NestedLoop", "HashJoin", "SortMergeJoin"))


@pytest.mark.parametrize("least", [-1.0, 0.25])
def test_vector_links_make_no_pair_that_cannot_count(spark, monkeypatch, least):
    """Ties, copies, null and odd vectors, tiny blocks: the links that all pairs give, from a plan that doesn't make them."""
    draw = random.Random(3)
    vector = lambda i: None if i % 17 == 3 else [1.0] if i % 17 == 5 else [1.0, None] if i % 17 == 7 else [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(2)]
    asked = spark.createDataFrame([(i, f"t{i}", vector(i)) for i in range(40)], "mention_id int, text string, vector array<float>")
    names = spark.createDataFrame([(f"n{i * 37 % 300}", "Part", f"k{i}", vector(i)) for i in range(300)], "name string, etype string, kg_id string, embedding array<float>").repartition(3)
    monkeypatch.setattr(nearest, "VECTORS", 15)
    monkeypatch.setattr(nearest, "CELLS", 400)
    got = linking.vector(asked, names, least)
    pairs = search.vector_scores(asked.withColumnRenamed("mention_id", "query_id"), names.withColumnRenamed("name", "chunk_id"), least)
    best = search.top_k(pairs, 3).withColumnsRenamed({"query_id": "mention_id", "chunk_id": "name", "score": "similarity"})
    columns = ["mention_id", "text", "name", "etype", "kg_id", "similarity"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, best.join(asked, "mention_id").join(names, "name").select(columns).collect()))
    assert not any(x in plan_of(got) for x in ("CartesianProduct", "NestedLoop"))


def test_vector_links_of_a_shared_name_keep_their_own_score(spark):
    asked = spark.createDataFrame([(1, "t", [1.0, 0.0])], "mention_id int, text string, vector array<float>")
    names = spark.createDataFrame([("n", "Drug", "k1", [0.9, 0.0]), ("n", "Food", "k2", [0.7, 0.0]), ("m", "Food", "k3", [0.8, 0.0])], "name string, etype string, kg_id string, embedding array<float>")
    assert [(r["kg_id"], r["similarity"]) for r in linking.vector(asked, names, keep=2).orderBy(F.desc("similarity")).collect()] == [("k1", 0.9), ("k3", 0.8)]


def test_prefilter_falls_back_to_all(spark):
    pairs = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False), (2, "d", None)], "query_id int, chunk_id string, f boolean")
    got = search.keyword_prefilter(pairs, F.col("f"))
    assert sorted((r["query_id"], r["chunk_id"]) for r in got.collect()) == [(1, "a"), (2, "c"), (2, "d")]


def test_large_dictionary_is_joined(spark, monkeypatch):
    words = spark.createDataFrame([("flu", [], "k", "Disease")], "name string, aliases array<string>, kg_id string, etype string")
    texts = spark.createDataFrame([(1, "flu, flu")], "text_id int, text string")
    monkeypatch.setattr(mentions, "AUTOMATON_FORMS", 0)
    monkeypatch.setattr(mentions, "_match_automaton", None)
    assert sorted(r["start"] for r in mentions.match(texts, words, "automaton").collect()) == [0, 5]


def test_substrings_are_never_broadcast(spark, monkeypatch):
    words = spark.createDataFrame([("flu", [], "k", "Disease")], "name string, aliases array<string>, kg_id string, etype string")
    texts = spark.createDataFrame([(1, "flu, flu")], "text_id int, text string")
    plans = []
    for most in (mentions.BROADCAST_FORMS, 0):
        monkeypatch.setattr(mentions, "BROADCAST_FORMS", most)
        got = mentions.match(texts, words)
        assert sorted(r["start"] for r in got.collect()) == [0, 5]
        plans.append(plan_of(got))
    assert "BroadcastHashJoin" in plans[0] and "BuildRight" in plans[0] and "BuildLeft" not in plans[0]
    assert "SortMergeJoin" in plans[1] and "BroadcastHashJoin" not in plans[1]


def test_longest_match_reads_the_mentions_once(spark):
    spans = [(t, s, s + n, e) for t in range(3) for s, n, e in [(0, 3, "a"), (0, 3, "b"), (0, 2, "a"), (1, 2, "a"), (1, 4, "a"), (2, 3, "a"), (2 + t, 3, "b"), (9, 1, "a"), (9, 1, "a")]]
    df = spark.createDataFrame(spans, "text_id int, start int, end int, etype string")
    want = sorted(m for m in spans if not any(o[0] == m[0] and o[1] <= m[1] and m[2] <= o[2] and o[1:3] != m[1:3] for o in spans))
    got = mentions.longest(df)
    assert sorted(map(tuple, got.collect())) == want
    assert "Join" not in plan_of(got)


def test_scores_in_contexts_are_rounded_as_printf_does(spark):
    scores = [0.1235, 0.0625, 0.4375, 0.2345, 0.0005, 0.9995, -0.0625, -0.0004, 0.0, 1.0, 1234.5675, 1e13] + [i / 2000 for i in range(1, 400, 2)]
    rows = spark.createDataFrame([(i, "document", "a", s, "x") for i, s in enumerate(scores)], "query_id int, source_type string, source_id string, score double, content string")
    got = {r["query_id"]: r["context"] for r in fusion.contexts(fusion.rerank(rows)).collect()}
    assert [got[i].split("相似度: ")[1].split(")")[0] for i in range(len(scores))] == ["%.3f" % s for s in scores]


def test_rrf_is_monotone(spark):
    src = spark.createDataFrame([(1, "document", str(i), float(9 - i), "x") for i in range(5)] + [(1, "graph", "g", 1.0, "y")], "query_id int, source_type string, source_id string, score double, content string")
    got = [(r["source_type"], r["score"]) for r in fusion.reciprocal_rank(src).orderBy("rank").collect()]
    assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    assert fusion.contexts(fusion.rerank(src), 10_000).first()["context"].startswith("【背景知识】\n\n【知识图谱】\ny\n\n【文档资料】\n\n[1]")


def test_keyword_mode_needs_no_vectors(spark):
    chunks = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "chunk_id string, tokens array<string>")
    asked = spark.createDataFrame([(1, ["x", "x", "q"])], "query_id int, tokens array<string>")
    assert [(r["chunk_id"], r["score"]) for r in search.search(asked, chunks, "keyword_only").collect()] == [("a", 0.666667)]


def test_inbound_expansion(spark):
    edges = spark.createDataFrame([("d", "s", "has_symptom")], "src string, dst string, rel_type string")
    nodes = spark.createDataFrame([("d", 1), ("s", 1)], "id string, degree int")
    seeds = spark.createDataFrame([(1, "s")], "query_id int, seed string")
    assert graph.expand(seeds, edges, nodes).count() == 0
    assert [r["dst"] for r in graph.expand(seeds, edges, nodes, direction="in").collect()] == ["d"]


def test_files_and_store(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "drug.txt").write_text("aspirin|asa, acetyl|k1\n\nplain\n")
    (tmp_path / "d" / "other.txt").write_text("skip\n")
    got = {(r["name"], tuple(r["aliases"]), r["kg_id"], r["etype"]) for r in files.read_dictionary(spark, str(tmp_path / "d")).collect()}
    assert got == {("aspirin", ("asa", "acetyl"), "k1", "Drug"), ("plain", (), None, "Drug")}
    (tmp_path / "r.json").write_text(json.dumps({"name": "flu", "symptom": ["fever"]}, ensure_ascii=False) + "\n" + json.dumps({"name": ""}) + "\n")
    r = files.read_records(spark, str(tmp_path / "r.json")).collect()
    assert [(x["name"], x["desc"], x["symptom"], x["check"]) for x in r] == [("flu", "", ["fever"], [])]
    lines = [json.dumps({"chunk_id": c, "section_type": "s", "text": t, "embedding": e}) for c, t, e in [("a", "x", [1.0, 0.0]), ("b", "y", [0.0]), ("", "z", [1.0, 1.0])]] + ["", "{bad"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.jsonl").write_text("\n".join(lines))
    rows, bad = files.read_json_lines(spark, str(tmp_path / "in"))
    assert rows.count() == 3 and bad.count() == 1
    store = stores.create_store(spark, str(tmp_path / "store"), dim=2)
    store.create()
    rejected, counts = store.load(rows)
    assert counts == {"processed": 3, "inserted": 1, "skipped": 2} and rejected.count() == 2
    store.load(rows.withColumn("text", F.lit("new")))
    assert [(x["chunk_id"], x["text"]) for x in store.read().collect()] == [("a", "new")]
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    assert [x["chunk_id"] for x in store.search(asked).collect()] == ["a"]
    ingest.stream_into(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    assert store.read().count() == 1
    assert store.versions() == ["v-000000000002", "v-000000000003"] and not list((tmp_path / "store").glob(".load-*"))
    with pytest.raises(ValueError):
        stores.create_store(spark, "x", "nope")


def test_export_deals_a_relation_into_blocks(spark):
    nodes = spark.range(40).selectExpr("cast(id as string) as id", "if(id < 20, 'A', 'B') as label", "concat('n', id % 10) as name")
    edges = spark.range(400).selectExpr("cast(id % 20 as string) as src", "cast(20 + id div 20 as string) as dst", "'r' as rel_type")
    rows = graph.export_relations(edges, nodes, per_block=8).collect()
    pairs = [(x["start_entity_name"], x["end_entity_name"]) for r in rows for x in json.loads(r["rels"])]
    assert len(rows) == 5 and {(r["start_entity_type"], r["end_entity_type"], r["rel_type"]) for r in rows} == {("A", "B", "r")}
    assert sorted(pairs) == [(f"n{a}", f"n{b}") for a in range(10) for b in range(10)]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Disease", "A", {"k": "v"}), ("b", "Drug", "B", {})], "id string, label string, name string, props map<string,string>")
    edges = graph.build_edges([spark.createDataFrame([("a", "b", "common_drug"), ("a", "b", "common_drug"), ("a", "zz", "do_eat")], "src string, dst string, rel_type string")], nodes)
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and [tuple(r) for r in e.select("src", "dst", "rel_type").collect()] == [("a", "b", "common_drug")]
    files.write_names(nodes, str(tmp_path / "names"))
    assert spark.read.text(str(tmp_path / "names")).count() == 2


def test_softmax(spark):
    got = one(spark, C.softmax(F.array(F.lit(1.0), F.lit(1.0))))
    assert got == [0.5, 0.5]


def test_fusion_filters_after_merging(spark):
    """An unsure span of a better source takes the place of a sure one, and then goes; names and ids are carried."""
    rows = [(1, 0, 3, "Drug", "keyword", 0.3, "abc", "n", "k"), (1, 0, 3, "Drug", "llm", 0.9, "abc", None, None), (2, 0, 3, "Drug", "llm", 0.9, "abc", "m", "k2")]
    df = spark.createDataFrame(rows, 'text_id int, start int, end int, etype string, source string, confidence double, text string, name string, kg_id string')
    assert [(r["text_id"], r["text"], r["name"], r["kg_id"]) for r in mentions.fuse(df).collect()] == [(2, "abc", "m", "k2")]


def test_denial_inside_a_word_is_no_match(spark):
    words = spark.createDataFrame([("不", [], None, "Deny"), ("痛", [], None, "Symptom")], "name string, aliases array<string>, kg_id string, etype string")
    texts = spark.createDataFrame([(1, "他不舒服"), (2, "不痛"), (3, "是不，痛了")], "text_id int, text string")
    for engine in ("join", "automaton"):
        assert {(r["text_id"], r["text"]) for r in mentions.match(texts, words, engine).collect()} == {(2, "不"), (2, "痛"), (3, "不"), (3, "痛")}


def test_answer_shapes(spark):
    item = '{"text": "ab", "type": "Drug", "start": 0, "end": 2}'
    cases = {
        f"[{item}] and [more]": 1, f"```json\n[{item}]\n```": 1, f"see:\n```\n[{item}]\n```\nbye": 1, f'[{{"entity": "ab", "entity_type": "drug", "note": "[x]"}}]': 1,
        '[{"text": "", "span": "ab", "type": "药品"}]': 1, f"so [{item}]": 0, "": 0, "no json": 0, f"[{item}": 0,
    }
    df = spark.createDataFrame([(i, "ab cd", a) for i, a in enumerate(cases)], "text_id int, text string, answer string")
    got = [r["text_id"] for r in mentions.answer_mentions(df).collect()]
    assert [got.count(i) for i in range(len(cases))] == list(cases.values())


def test_all_layers_feed_linking(spark):
    texts = spark.createDataFrame([(1, "aspirin and fever"), (2, "aspirn here")], "text_id int, text string")
    words = spark.createDataFrame([("aspirin", ["asa"], "k1", "Drug"), ("fever", [], None, "Symptom")], "name string, aliases array<string>, kg_id string, etype string")
    model = lambda df: df.select("text_id", F.lit(0).alias("start"), F.lit(6).alias("end"), F.lit("Drug").alias("etype"), F.lit(0.7).alias("confidence"))
    found = mentions.cascade(texts, words, model, routed=False).withColumn("mention_id", F.concat_ws(":", "text_id", "start"))
    links = linking.cascade(found.filter("source <> 'keyword'").select("mention_id", "text"), words)
    got = {r["mention_id"]: (r["text"], r["kg_id"], r["link_stage"]) for r in linking.link_results(found, links).collect()}
    assert got == {"1:0": ("aspirin", "k1", None), "1:12": ("fever", None, None), "2:0": ("aspirn", "k1", "edit")}


def test_intent_plan_and_names(spark):
    from tessella.operators import retrieval

    asked = spark.createDataFrame([(1, "examination_inquiry"), (2, "other"), (3, "other"), (4, "nonsense")], "query_id int, intent string")
    entities = spark.createDataFrame([(2, "x", "Disease"), (3, "y", "Food")], "query_id int, name string, etype string")
    got = {r["query_id"]: (r["relations"], r["hops"]) for r in retrieval.plan(asked, entities).collect()}
    assert got[1] == (["need_check"], 1) and "cure_way" in got[2][0] and len(got[2][0]) == 9 and len(got[3][0]) == 11 and len(got[4][0]) == 11
    names = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],)], "n array<string>")
    assert [r[0] for r in names.select(retrieval.entity_names(F.col("n"))).collect()] == ["a、b、c等", "a"]


def test_context_of_a_query_without_sources(spark):
    src = spark.createDataFrame([(1, "graph", "g", 1.0, "y")], "query_id int, source_type string, source_id string, score double, content string")
    got = {r["query_id"]: r["context"] for r in fusion.contexts(fusion.rerank(src), queries=spark.createDataFrame([(1,), (2,)], "query_id int")).collect()}
    assert got[2] == fusion.NOTHING and got[1].startswith("【背景知识】\n")


def test_paragraphs_keep_nested_text(spark):
    df = spark.createDataFrame([("<p class='a'>one <b>two</b> three</p><pre>no</pre><P>four</P><div class=\"x box y\">five <i>six</i></div>",)], "h string")
    assert df.select(text.html_paragraphs(F.col("h"))).first()[0] == ["one two three", "four"]
    assert df.select(text.html_by_class(F.col("h"), "div", "box")).first()[0] == ["five six"]


def test_calm_edges_count_distinct_edges_at_either_end(spark):
    rows = [("a", "x", "r")] * 3 + [("b", "x", "r"), ("x", "y", "r"), ("c", "y", "r"), ("c", "y", "s"), ("z", "z", "r")]
    edges = spark.createDataFrame(rows, "src string, dst string, rel_type string")
    degree = {r["id"]: r["degree"] for r in graph.degrees(edges.distinct()).collect()}
    assert degree["x"] == 3 and degree["z"] == 2
    for limit in (2, 3, 4):
        for leaving in (None, edges.filter("src in ('x', 'z')")):
            assert sorted(map(tuple, graph.calm_edges(edges, limit, leaving).collect())) == sorted(r for r in set(rows) if degree[r[1]] < limit)


def test_retrieval_of_two_hops_with_caps(spark):
    """Two hops along the plan only, a node by its best path, edges between kept nodes only, a seed that is no node."""
    from tessella.operators import retrieval

    props = {"a": "x"}
    nodes = spark.createDataFrame([("d1", "Disease", "flu", props), ("s1", "Symptom", "cough", props), ("g1", "Drug", "syrup", props), ("g2", "Drug", "pills", props), ("f1", "Food", "soup", props)], "id string, label string, name string, props map<string,string>")
    edges = spark.createDataFrame([("d1", "s1", "has_symptom"), ("d1", "g1", "recommand_drug"), ("s1", "g2", "common_drug"), ("s1", "g1", "common_drug"), ("g1", "f1", "drugs_of"), ("s1", "d1", "has_symptom"), ("nowhere", "s1", "has_symptom")], "src string, dst string, rel_type string")
    asked = spark.createDataFrame([(1, "disease_inquiry"), (2, "disease_inquiry"), (3, "other")], "query_id int, intent string")
    entities = spark.createDataFrame([(1, "flu", "Disease")], "query_id int, name string, etype string")
    seeds = spark.createDataFrame([(1, "d1"), (2, "nowhere")], "query_id int, seed string")

    def told(**limits):
        got = retrieval.retrieve(asked, entities, seeds, edges, nodes, degree_limit=None, **limits).collect()
        return {r["query_id"]: (r["n_nodes"], r["n_edges"], r["description"]) for r in got}

    whole = told()
    assert whole[1] == (4, 4, "关于flu，以下是相关的医疗知识：\n  - 相关疾病：flu\n  - 相关症状：cough\n  - 推荐药品：syrup, pills\n  - 关系类型：有症状(1条), 推荐药品(1条), 常用药品(2条)")
    assert whole[2][:2] == (4, 4) and "flu" in whole[2][2] and whole[3] == (0, 0, retrieval.NOTHING)
    assert told(most_nodes=2)[1][:2] == (2, 1) and told(per_seed=1)[1][:2] == (2, 1)


def test_intent_retrieval_exchanges_its_edges_once(spark):
    from tessella.plans import graph_queries

    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1")):
            spark.conf.set(k, v)
        plan = graph_queries.intent_retrieval(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert plan.count("lineitem.parquet") == 2  # for suppliers and for customers
