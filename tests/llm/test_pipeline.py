"""The pipeline over a small corpus with planted cases."""

import random

import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(80)) for i in range(100)]
    base = rows[0][1].split()
    rows += [(200, rows[5][1]), (201, rows[5][1] + "  "), (300, " ".join([*base[:40], "swap", *base[41:]])), (400, text(30) + " you idiot"), (500, text(5)), (600, None), (601, ""), (700, text(6000))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 400)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "exact_dedup", "ngram_jaccard", "best_fit_packing"]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == {*range(100), 700, 201} - {5}  # of equal texts the one with most code points stays
    assert max(r["offset"] + r["length"] for r in got) <= 4096


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
