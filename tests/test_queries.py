"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from triplewright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7)
    return x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    want = sql.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert mine == theirs
    assert mine


@pytest.mark.parametrize("name", ["rank_literal_exact", "fold_sizes", "train_pairs", "maximal_mention_sets", "answer_type_model"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert rows and all(r["name"] for r in rows)
