"""Each operator on a small fixture against a brute-force version: null, empty and very long texts, ties, repeated rows,
null ids, empty tables and extra columns whose names clash with the operators' own."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from tessella.llm import byte_bpe, exact_dedup, language_id, lm_scoring, ngram_jaccard, packing, quality_rules, token_counts, toxicity, url_filter
from tessella.llm.common import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ("keep_id", "kept", "row", "v", "bucket", "h", "block", "score", "piece", "host", "text_sha256", "two", "ids", "train")


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    base = line(120)
    changed = base.split()
    rows += [(60, base), (61, base.replace(" ", "  ")), (62, " ".join(changed[:50] + ["zzz"] + changed[51:])), (63, " ".join(changed[:119]))]
    rows += [(64, None), (65, ""), (66, "   \n\t"), (67, "a b c"), (68, "A b C"), (69, "a b d"), (None, base), (None, "lonely words here"), (1, rows[1][1]), (1, rows[1][1])]
    rows += [(70, line(20000)), (71, "x" * 5000), (72, "same line again\n" * 12), (73, "12 é🙂 <|endoftext|> ﬁ\r\n\x0b\x1c #*$%&|<>")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 5 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none, rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = collections.Counter()
    for text, members in groups.items():
        for k, m in enumerate(sorted(members)):
            want[m[3], sorted(members)[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    kept = exact_dedup.keep_one(docs.filter("doc_id is not null"))
    assert kept.columns == docs.columns
    assert len({re.sub(r"\s", "", r["text"] or "") for r in kept.collect()}) == kept.count()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_heavy_groups(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")))).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(df).filter("group_size > 1")
    assert got.agg(F.count(F.lit(1)), F.min("group_size"), F.max("keep_id"), F.count_if("kept")).first() == (2000, 2000, 6, 1)


def sets_of(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def test_ngram_jaccard(docs, none, rows):
    held = sets_of(rows)
    parent = list(range(len(held)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(held)):
        for b in range(a):
            x, y = held[a][1], held[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(held):
        least[find(k)] += [i] if i is not None else []
    want = collections.Counter((i, len(s), min(least[find(k)], default=None) if s else i) for k, (i, s) in enumerate(held))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_join(docs).collect())
    assert got == want
    assert ngram_jaccard.jaccard_join(none).count() == 0
    assert ngram_jaccard.keep_one(docs).columns == docs.columns


def test_ngram_jaccard_chains_and_passages(spark):
    """A chain of near copies, many documents around one passage, and short sets on both sides of the boundary."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out, body = [], [word() for _ in range(150)]
    for _ in range(40):
        out.append(" ".join(body))
        body = list(body)
        body[rng.randrange(150)] = word()
    passage = " ".join(word() for _ in range(60))
    out += [passage + " " + " ".join(word() for _ in range(rng.choice([2, 8, 30, 90]))) for _ in range(60)]
    for n in (5, 8, 9, 10, 12, 15, 20, 40):
        w = [word() for _ in range(n)]
        out += [" ".join(w), " ".join(w + [word()]), " ".join([word(), *w]), " ".join(w[:-1])]
    rows = list(enumerate(out))
    held = [s for _, s in sets_of(rows)]
    parent = list(range(len(held)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(held)):
        for b in range(a):
            if 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_join(df).collect()} == {i: find(i) for i in range(len(held))}


def test_quality_base_counts(docs, none, rows):
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)] += 1
    got = quality_rules.decide(docs)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == want
    assert got.filter("base_failed and kept").count() == 0
    assert quality_rules.decide(none).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_quality_crowded_lines(spark):
    """A line of many different documents goes, and the document that it makes up; copies of one document stay."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    common, copy = line(30), "\n".join(line(12) for _ in range(4))
    rows = [common + "\n" + line(25) for _ in range(40)] + [common + "\nshort tail"] + [copy] * 60 + [line(40) for _ in range(50)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.decide(df).collect()}
    assert all(got[i]["n_removed_words"] == 30 and got[i]["kept"] for i in range(40))
    assert not got[40]["kept"]
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 0 for i in range(41, len(rows)))


def test_quality_template_lines(spark):
    """Every line of a template goes, also where all documents share its lowest hash; on a hot host the limit stays bounded."""
    rng = random.Random(7)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    fixed = [line(5) for _ in range(30)]
    rows = [("a", "\n".join(fixed + [line(3), line(3)])) for _ in range(200)]
    rows += [("a", "\n".join([*fixed[:3], line(40)]))] + [("b", line(30)) for _ in range(50)] + [(None, "\n".join(fixed))] * 60
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.decide(df).collect()}
    assert all(got[i]["n_removed_words"] == 150 and not got[i]["kept"] for i in range(200))
    assert got[200]["n_removed_words"] == 15 and got[200]["kept"]
    assert all(got[i]["n_removed_words"] == 0 and got[i]["kept"] for i in range(201, len(rows)))


def test_quality_texts_lose_crowded_lines(spark):
    """Kept texts come without the lines above the limits, with all others as they were; of rows that share an id only the rejected leave."""
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    common, own = line(30), [f"  {line(25)}\n\n{line(3)} 7\r" for _ in range(41)]
    rows = [(k, f"{common.upper()} \n{t}\n{common}", t) for k, t in enumerate(own[:40])] + [(None, own[40], own[40]), (None, common, None), (80, f"{common}\n" * 3 + "some words more", None), (None, "few", None), (3, "few", None), (None, None, None)]
    df = spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))
    got = quality_rules.keep_good(df)
    assert got.columns == df.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter((i, t) for i, _, t in rows if t)
    with pytest.MonkeyPatch.context() as patch:  # the same by a shuffle
        patch.setattr(quality_rules, "BROADCAST_IDS", 0)
        assert collections.Counter((r["doc_id"], r["text"]) for r in quality_rules.keep_good(df).collect()) == collections.Counter((i, t) for i, _, t in rows if t)


def test_quality_limit_on_a_hot_host(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SHARE", 2)
    monkeypatch.setattr(quality_rules, "MANY_DOCS", 40)
    common = " ".join(f"w{'abcdefghij'[k]}" for k in range(10))
    own = F.concat_ws(" ", *(F.translate(F.hash("id", F.lit(k)).cast("string"), "-0123456789", "zabcdefghij") for k in range(25)))
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60, F.concat(F.lit(common + "\n"), own)).otherwise(own).alias("text"), F.lit("h").alias("source"))
    assert {(r["doc_id"] < 60, r["n_removed_words"]) for r in quality_rules.decide(df).collect()} == {(True, 10), (False, 0)}


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    definition = packing.tokenizer_definition()
    tokenizer = Tokenizer.from_str(definition)
    got = packing.pack(docs, definition, keep_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) // 4 <= 4096 and zlib.crc32(r["ids"]) == r["ids_crc32"]
    for i, t in rows:
        whole = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        copies = sum(1 for j, _ in rows if j == i)
        mine = [r for r in by[i] if r["piece"] == 0 or copies == 1]
        assert len([r for r in mine if r["piece"] == 0]) == copies
        if copies == 1:
            ids = b"".join(bytes(r["ids"]) for r in sorted(mine, key=lambda r: r["piece"]))
            assert ids == b"".join(x.to_bytes(4, "little") for x in whole)
            assert [r["start"] for r in sorted(mine, key=lambda r: r["piece"])] == list(range(0, len(whole), 4096))
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= math.ceil(sum(r["length"] for r in got) / 4096) + 2
    assert packing.pack(none, definition).count() == 0


def test_packing_ids_are_the_librarys():
    """Distinct chunks against whole texts, on hostile strings: dotted capitals, marks, controls, special tokens, contractions, other white space."""
    from tokenizers import Tokenizer

    definition = packing.tokenizer_definition()
    tokenizer, rng = Tokenizer.from_str(definition), random.Random(1)
    assert packing.chunked(definition) and not packing.chunked(definition.replace('"Lowercase"', '"NFKC"'))
    pool = [*"ab\u0130Ii\u0131ßéÉüΣςσ.,;!'s \t\n\x0b\x0c\r\x1c\x85\xa0\u2028\u0338\u0301\u0307=<>|1٣５ǅ가가ʰ_-~ﬁ🙂", "<|endoftext|>", "'ll", " the ", " The,", " Straße. ", "\u0130,"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    for kind in (packing.Ids(tokenizer, most=2000), packing.WholeTexts(tokenizer)):
        got = [x for k in range(0, 6000, 300) for x in kind.whole([t.encode() for t in texts[k : k + 300]])]
        assert all(g == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids) for t, g in zip(texts, got))


def test_sum_of_squares_takes_the_smallest_sum():
    rng = random.Random(3)
    lengths = [rng.randint(1, 12) for _ in range(300)]
    sequence, offset = packing.sum_of_squares(lengths, 12)
    gaps: dict[int, int] = {}
    for s, q, o in zip(lengths, sequence.tolist(), offset.tolist()):
        total = lambda g: sum(v * v for v in collections.Counter(x for x in g.values() if x).values())
        choices = [total({**gaps, k: g - s}) for k, g in gaps.items() if g >= s] + [total({**gaps, "new": 12 - s})]
        assert o == 12 - gaps.get(q, 12)
        gaps[q] = gaps.get(q, 12) - s
        assert total(gaps) == min(choices)


def test_token_counts(docs, none, rows):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in rows)
    assert collections.Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(none, path).count() == 0
    counter, rng = token_counts.Counter(token_counts.vocabulary(path)), random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("ab e▁ \n\t é🙂ﬁ<s></s><unk>0x0A>　\x00梦 thetion\r") for _ in range(rng.randint(0, 30)))
        assert counter(t) == len(sp.encode(t)), repr(t)


def test_byte_bpe(docs, none, rows):
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((i, ",".join(map(str, known.encode_ordinary(t or ""))), (t or "").encode()) for i, t in rows)
    for native in (False, True):
        assert collections.Counter((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in byte_bpe.encode_decode(docs, ranks, P.PATTERN, native=native).collect()) == want
    coded, rng = byte_bpe.Coded({}, ranks), random.Random(8)
    for _ in range(2000):
        w = "".join(rng.choice("abthe ning\u00e9\U0001f642.,!12") for _ in range(rng.randint(1, 25)))
        got = coded[w]
        assert got == (",".join(map(str, known._encode_single_piece(w))), w.encode())
    assert byte_bpe.encode_decode(none, ranks, P.PATTERN).count() == 0


def test_lm_scoring(docs, none, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 40_000)
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    got = lm_scoring.score(docs, fold(docs["doc_id"], 7) != 2).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_scoring.score(none, fold(none["doc_id"], 7) != 2).count() == 0
    empty = lm_scoring.score(docs, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["score"] == 0 and r["train_tokens"] == 0 for r in empty)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scoring_by_brute_force(docs, rows, monkeypatch, order):
    """The score of each text by all counted n-grams, however rare, with many blocks and hash ranges."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 30_000)
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    train = [t for i, t in tokens if i is not None and i % 7 != 2]
    counts = [collections.Counter(tuple(t[k : k + size]) for t in train for k in range(len(t) - size + 1)) for size in range(1, order + 1)]
    c = counts[0]
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(k == x for k in c.values()) for x in (1, 2))
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
    letters = collections.Counter(x for t in train for w in t[:-1] for x in [*w, 256])
    whole = sum(letters.values()) + 257

    def weight(history, w):
        if not history:
            return (c[w,] - d) / n if c[w,] else d * v / n * math.prod((letters[x] + 1) / whole for x in [*w, 256])
        seen = counts[len(history) - 1][history]
        lower = weight(history[1:], w)
        return (counts[len(history)][*history, w] + lm_scoring.PRIOR * lower) / (seen + lm_scoring.PRIOR) if seen else lower

    log = lambda t: sum(math.log10(weight(tuple(t[max(0, k - order + 1) : k]), w)) for k, w in enumerate(t))
    assert min(counts[1].values()) == 1
    want = sorted((i is None, i or 0, round(log(t), 6)) for i, t in tokens)
    got = lm_scoring.score(docs, docs["doc_id"] % 7 != 2, order=order).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in got) == want


def test_lm_scoring_tells_texts_apart(spark):
    """Random letters fall below every document, held-out documents below training ones, and passages of the corpus rise above new text."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    text = lambda n: " ".join(vocabulary[min(799, int(rng.expovariate(0.01)))] for _ in range(n))
    known = [text(100) for _ in range(300)]
    odd = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(30)]
    rows = [(i, t, True) for i, t in enumerate(known)] + [(1000 + i, text(98) + " " + odd[i], False) for i in range(30)]
    rows += [(2000 + i, known[i], False) for i in range(30)] + [(3000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(100)), False) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.score(df, F.col("train")).collect()}
    group = lambda k: [got[i] for i, _, _ in rows if i // 1000 == k]
    mean = lambda k: sum(group(k)) / len(group(k))
    assert max(group(3)) < min(group(0) + group(1) + group(2))
    assert mean(1) < mean(0) and max(group(1)) < min(group(2))


def test_automaton_is_a_distribution():
    """From every state the weights of all words and the unknown mass sum to 1."""
    import numpy as np

    rng = np.random.default_rng(0)
    text = rng.integers(0, 6, 500)
    c = np.bincount(text, minlength=6)
    pairs = collections.Counter((int(a), int(b)) for a, b in zip(text, text[1:]))
    c[text[-1]] -= 1  # as a history, the last token has no follower
    p = np.r_[(c - 0.5) / c.sum(), 0.5 * 6 / c.sum()]
    for state in range(6):
        total = 0.0
        for w in range(7):
            arcs = [np.array([c[state], c[w] if w < 6 else 0]), np.array([0, pairs[state, w]])]
            total += 10 ** lm_scoring.traverse(np.array([1.0, p[w]]), np.array([0, 1]), arcs)[1]
        assert abs(total - 1) < 1e-9
    keys = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_scoring.unpack_keys(lm_scoring.pack_keys(keys)) == keys).all() and (lm_scoring.unpack_counts(lm_scoring.pack_counts(text)) == text).all()


def test_language_id(spark, none):
    en, de = "the quick brown fox jumps over the lazy dog and runs", "der schnelle braune fuchs springt über den faulen hund und läuft"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(60)] + [(100, None, None), (101, "12 !? ½", None), (102, "", "en"), (None, en, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_id.predict(df, language_id.fit(df.select("doc_id", "text", "lang"))).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    assert language_id.fit(none) is None
    assert language_id.predict(df, None).filter("lang_pred <> 'und'").count() == 0


def test_toxicity_grammar():
    words, begins = toxicity.learn_lexicon({}, (0, 0), 0)
    tags = toxicity.Tags(words, begins)
    out = lambda t: {(k - 1) for k in toxicity.matches(t, tags)}
    assert out("you are an idiot") == {2}
    assert out("he said: that clown") == {8} and out("he said. that clown") == {0}
    assert out("that is not stupid") == {4}
    assert out("i will kill you") == {1} and out("i will kill time") == set()
    assert out(None) == out("") == set()


def test_toxicity_scores_by_the_four_rules():
    """The composed table against a plain reading of the rules, token by token, on random clauses."""
    rng = random.Random(12)
    model = toxicity.learn_lexicon({}, (0, 0), 0)
    tags, pool = toxicity.Tags(*model), ["idiot", "trash", "kill", "hurt", "you", "dir", "not", "nie", "said", "the", "tree", "runs", ".", '"', "!"]
    for _ in range(3000):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        want, clause = set(), []
        for w in [*words, "."]:
            if w not in ".!":
                clause.append(tags[w])
                continue
            waits = 0  # tokens that a threat verb still waits for its target
            for i, tag in enumerate(clause):
                threat = waits > 0 and tag == toxicity.TARGET
                if tag == toxicity.INSULT or threat:
                    recent = lambda what, reach: what in clause[max(0, i - reach) : i]  # noqa: B023, E731
                    want.add(1 + threat + 2 * recent(toxicity.TARGET, 4) + 4 * recent(toxicity.NEGATION, 3) + 8 * (toxicity.REPORT in clause[:i]) + 16 * (toxicity.INSULT in clause[:i]))
                waits = 0 if threat else 4 if tag == toxicity.THREAT else max(0, waits - 1)
            clause = []
        assert set(toxicity.matches(" ".join(words), tags)) == want, words


def test_toxicity_lone_insults_need_labels():
    weights, quiet = toxicity.class_weights({})
    tags = toxicity.Tags(*toxicity.learn_lexicon({}, (0, 0), 0))
    score = lambda t: toxicity.score_of(toxicity.matches(t, tags), weights, quiet)
    assert score("that clown " * 1) < toxicity.THRESHOLD and score("the clown. " * 500) < toxicity.THRESHOLD
    assert score("you are an idiot") >= toxicity.THRESHOLD and score("i will kill you") >= toxicity.THRESHOLD
    assert score("you are not an idiot") < score("you are an idiot")
    learned, _ = toxicity.class_weights({1: (50, 49), 0: (100, 1)})
    assert learned[1] > 0.9


def test_drawn_does_not_depend_on_partitions(spark):
    from tessella.llm.common import drawn

    df = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    got = [sorted(tuple(r) for r in drawn(df.repartition(n), "lang", 50, "doc_id").collect()) for n in (3, 7)]
    assert got[0] == got[1] and collections.Counter(x for x, _ in got[0]) == {"0": 50, "1": 50, "2": 50}
    assert drawn(df, "lang", 10**6, "doc_id").count() == 20000


def test_toxicity_learns(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(400):
        w = [word() for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["grumzel", "grumzelhaft", "grumzeln", "grumzelig"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    extra = spark.createDataFrame([(900, None), (901, ""), (None, "the idiot")], "doc_id long, text string")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").unionByName(df.select("doc_id", F.lit(None).cast("int").alias("toxic"))))
    got = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score_toxicity(df.select("doc_id", "text").unionByName(extra), model).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400)) and not got[900] and not got[901] and got[None]
    kept = toxicity.keep_clean(df.withColumn("score", F.lit("clash")), model)
    assert kept.count() == 300 and kept.columns == [*df.columns, "score"]
    assert toxicity.score_toxicity(none, model).count() == 0


def test_url_filter(spark):
    urls = {
        "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.COM/en/2?x": ("a.example.com", "/en/2", "example.com/en/", "block"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.com/a#b": ("x.com", "/a", "com/", "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://casinowin.org/x": ("casinowin.org", "/x", None, "block"),
        "http://citylibrary.org/x": ("citylibrary.org", "/x", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_filter.Model().words("cheapcasinowin") == ("cheap", "casino", "win")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_filter_counts_words(spark):
    """Ordinary words of the texts outbid the listed words inside them; listed words still tell where they stand alone."""
    ordinary = ["canada", "madrid", "essex", "window", "cambridge", "hotels", "alphabet", "trading", "badger", "museo", "winter"]
    names = [*ordinary, "winterhotels", "wintercasino", "cheap-pills", "x" * 200 + "casino"]
    df = spark.createDataFrame([(i, f"https://www.{w}.org/a/1") for i, w in enumerate(names)], "page_id long, url string")
    texts = spark.createDataFrame([(" ".join(w.title() for w in ordinary) + ", den 12.",), (None,), ("",)], "html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, texts=texts).collect()}
    assert [got[i] for i in range(len(names))] == ["allow"] * 12 + ["block"] * 3
    page = spark.createDataFrame([("<p class='win'>Win<b>dow</b></p><script>var casino;</script> <style>p{}</style>end",)], "html string")
    assert page.select(url_filter.visible(F.col("html"))).first()[0].split() == ["Win", "dow", "end"]
    assert {r["w"]: r["n"] for r in url_filter.counted_words(texts, url_filter.Model()).collect()}["essex"] == 1


def test_ngram_jaccard_passage_in_many_unlinked_documents(spark):
    """One passage of 60 words in 5,000 documents that are linked with none, and in 20 that are: no pair of the former is compared."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join([passage, *(word() for _ in range(16))])) for i in range(5000)] + [(5000 + i, f"{passage} {word()}") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(5000)) and {got[i] for i in range(5000, 5020)} == {5000}


def test_url_filter_learns_from_decided_urls(spark):
    """A word of urls that the rules block tells of other urls; words that the rules name, and words of both verdicts, don't."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:04d}")
    rows = [f"http://zork.{word(k)}.example.com/en/{word(k)}" for k in range(200)] + [f"http://{word(k)}.shop{'' if k % 2 else '.sub'}.com/de/both" for k in range(200)]
    rows += ["http://zork.fine.org/x/1", "http://www.fine.org/en/both", "http://shop.fine.org/en/1"]
    texts = spark.createDataFrame([("zork shop sub fine both " * 50,)], "text string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), texts=texts).collect()}
    assert [got[i] for i in (400, 401, 402)] == ["block", "allow", "allow"] and len(got) == 403
    repeated = spark.createDataFrame([(1, "http://zork.fine.org/1"), (1, "http://zork.fine.org/1"), (None, "http://" + "x" * 3000 + ".org/" + "y" * 30000)], "page_id long, url string")
    assert url_filter.judge(repeated).count() == 3
