"""Every registered query of the library against its DuckDB SQL on the smallest given tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)


def test_every_family_is_registered():
    assert {name.split("_")[0][0] for name in registry.QUERIES} >= set("abcdefghi")
    by_hand = "c3_slugs_of_numbered_names c11_suggest_aliases c12_align_by_similarity c12_best_by_similarity f2_linkify f3_proximity_matches f4_evaluate_evidence f5_verify_claims f5_verified_facts f7_prove_claims"
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(by_hand.split())  # test_brute_force.py and test_ranges.py have these
    assert set(registry.ORACLES) <= set(registry.QUERIES)
