"""The pipeline's stages over a small table, and the registration of the queries."""

import random

import pytest
from brute import jaccard_components

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"en": "the and that with from this have there which".split(), "de": "der und nicht über schön große für wäre".split()}
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choices(words[lang], k=40)) + f" tail{i}"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(100, rows[0][1], "en", "s0", 1), (101, None, "en", None, None), (102, "12345 ###", "en", "s1", 9), (103, rows[2][1] + " token=abcdefghijklmnop", "en", "s0", 5)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    def stage(name, docs):
        stages[name](spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stage("language_id", docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.join(kept, "doc_id", "left_anti").collect()} == {101, 102}
    single = stage("ngram_join", kept)
    where = jaccard_components([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in where.items() if c == d}
    masked = stage("secret_scan", kept)
    assert masked.columns == docs.columns and masked.count() == kept.count()
    row = masked.where("doc_id = 103").first()
    assert "abcdefghijklmnop" not in row.text and row.n_chars == len(row.text)
    assert masked.join(kept, ["doc_id", "text"]).count() == kept.count() - 1
    mixed = stage("mixing", kept)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == kept.count()


def test_near_duplicates_with_null_and_repeated_ids(spark, tmp_path):
    text = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(None, text[0]), (None, text[1]), (7, text[1]), (5, text[2]), (5, text[2]), (5, text[3]), (4, text[3]), (None, text[4]), (None, text[4]), (9, text[5]), (9, None), (None, None), (None, "")]
    spark.createDataFrame([(d, t, "en", f"row{i}", 1) for i, (d, t) in enumerate(rows)], DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted((r.text or "", r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    want = [(None, text[0]), (7, text[1]), (5, text[2]), (4, text[3]), (None, text[4]), (9, text[5]), (9, None), (None, None), (None, "")]
    assert got == sorted((t or "", d is None, d or 0) for d, t in want)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)
    assert not {100, 101, 102} & {r.doc_id for r in out.select("doc_id").collect()}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
