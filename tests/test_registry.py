"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import pytest
from oracle import assert_same

from quarry.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, FOLDER), registry.ORACLE_SQL[name], FOLDER)


def test_response_is_json(spark):
    import json

    (row,) = registry.QUERIES["search_response"](spark, FOLDER).collect()
    got = json.loads(row["response"])
    assert [r["place"] for r in got["results"]] == list(range(1, len(got["results"]) + 1))
    debug = got["debug"]
    assert debug["stats"]["results_count"] == len(got["results"])
    assert debug["timings"]["indexing_ms"] is None
    assert debug["index_status"] == {"files_count": 0, "chunks_count": 0, "was_stale": False}
    assert debug["index_result"] == {"files_indexed": 0, "chunks_indexed": 0}


def test_entry_and_keys():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
