"""Fusion, boosts and orders against a direct simulation, on random cases with ties and repeated keys."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import rounded, terms
from quarry.functions.vectors import cosine_score
from quarry.operators import fts, ranking

SCHEMA = "file_path string, line_start int, content string, score double, rank int"
NOW = 1_000_000.0


def simulate(vector, keyword, files, limit, weight=0.5, least=0.3):
    merged, order = {}, []
    for path, line, content, score, _ in vector:
        if (path, line) not in merged:
            order.append((path, line))
        merged[path, line] = [content, weight * score]
    for path, line, content, score, _ in keyword:
        if (path, line) in merged:
            merged[path, line][1] = min(1.0, merged[path, line][1] + (1 - weight) * score)
        else:
            order.append((path, line))
            merged[path, line] = [content, (1 - weight) * score]
    hits = [(*k, *merged[k]) for k in order]
    hits = sorted(hits, key=lambda h: -h[3])[: 2 * limit]
    hits = [h for h in hits if h[3] >= least]

    def boost(h):
        if h[0] not in files:
            return h[3]
        age = max(NOW - files[h[0]], 0)
        return min(1.0, h[3] + (0.05 * (1 - age / 604800) if age < 604800 else 0))

    hits = sorted(hits, key=lambda h: -boost(h))[:limit]
    groups = {}
    for h in hits:
        groups.setdefault(h[0], []).append(h)
    return [h for g in sorted(groups.values(), key=lambda g: -max(h[3] for h in g)) for h in g]


@pytest.mark.parametrize("seed", range(6))
def test_pipeline_matches_the_simulation(spark, seed):
    rng = random.Random(seed)

    def leg(tag):
        rows = [(f"f{rng.randrange(4)}", rng.randrange(3), f"{tag}{i}", rng.randrange(1, 9) / 8) for i in range(rng.randrange(0, 12))]
        return [(*r, i + 1) for i, r in enumerate(sorted(rows, key=lambda r: -r[3]))]

    vector, keyword, limit = leg("v"), leg("k"), rng.randrange(0, 7)
    files = {f"f{i}": NOW - rng.choice([0, 1e5, 3e5, 1e6, -50]) for i in range(3)}
    v, k = (spark.createDataFrame(x, SCHEMA) for x in (vector, keyword))
    got = ranking.pipeline(v, k, spark.createDataFrame(list(files.items()), "file_path string, mtime double"), limit, NOW, payload=["content"]).orderBy("place").collect()
    want = simulate(vector, keyword, files, limit)
    assert [(r.file_path, r.line_start, r.content) for r in got] == [h[:3] for h in want]
    assert [r.score for r in got] == pytest.approx([h[3] for h in want])


def test_negative_limit(spark):
    with pytest.raises(ValueError):
        ranking.top(spark.range(3), -1, "id")


def test_cosine_scores(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5, 0.0]


def test_terms_and_rounding(spark):
    row = spark.createDataFrame([("getUser duration_ms É1!",)], "t string")
    assert row.select(terms(F.col("t"))).first()[0] == ["getuser", "duration_ms", "é1"]
    assert row.select(terms(F.col("t"), parts=True)).first()[0] == ["getuser", "duration_ms", "é1", "get", "user", "duration", "ms"]
    assert [row.select(rounded(F.lit(x), 3)).first()[0] for x in (0.12345, 0.6784)] == [0.123, 0.678]


def test_keyword_search(spark):
    docs = spark.createDataFrame([("a", "duration_ms of a call"), ("b", "nothing here"), ("c", None)], "chunk_id string, content string")
    assert [r.chunk_id for r in fts.bm25(docs, "duration_ms").collect()] == ["a"]
    assert fts.bm25(docs, "absent").count() == 0 and fts.bm25(docs, "...").count() == 0
    stored = fts.bm25_indexed(fts.postings(docs), fts.doc_lengths(docs), "duration_ms call")
    assert stored.first().raw == pytest.approx(fts.bm25(docs, "duration_ms call").first().raw)
    assert docs.select(fts.keyword_score(F.lit(None).cast("double"))).first()[0] == 0.05
