"""Where intermediate tables are written, and that they go."""

from __future__ import annotations

import os

import pytest

from triplewright.llm import common


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_needs_a_shared_folder():
    assert common.shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    assert common.shared_dir(Session(spark_master="yarn", **{"spark_sql_warehouse_dir": "hdfs://w"})) == "hdfs://w/_triplewright"
    for warehouse in ("file:/here/spark-warehouse", "/here/spark-warehouse"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(spark_master="yarn", **{"spark_sql_warehouse_dir": warehouse}))


def test_temporary_tables_are_deleted(spark):
    df = spark.range(5)
    with common.temporary_tables(spark):
        gone = common.materialise(df, "gone")
        with common.temporary_tables(spark):
            inner = common.materialise(gone, "inner")
            kept = common.materialise(inner, "kept", keep=True)
        assert gone.count() == 5
    paths = [t.inputFiles()[0].removeprefix("file://").removeprefix("file:") for t in (kept,)]
    assert kept.count() == 5 and all(os.path.exists(p) for p in paths)
    root = common.shared_dir(spark).removeprefix("file://") + "/triplewright"
    assert not [n for n in os.listdir(root) if n.startswith(("gone-", "inner-"))]
    # nothing is remembered outside
    assert common.materialise(df, "later").count() == 5
