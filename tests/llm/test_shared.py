from __future__ import annotations

import os

import pytest

from lumentide.llm import shared
from lumentide.llm.shared import HOT_LEAST, Shared, free, release, scope, shared_folder, with_facts


def there(root: str) -> bool:
    return os.path.isdir(root.removeprefix("file://").removeprefix("file:"))


def test_tables_go_with_their_scope_and_by_release(spark):
    kept = Shared(spark, "kept")
    kept.write(spark.range(3), "a")
    with scope(spark):
        inner = Shared(spark, "inner")
        inner.write(spark.range(3), "a")
        assert there(inner.root)
    assert there(kept.root) and not there(inner.root)
    release(spark)
    assert not there(kept.root)


def test_tables_are_written_without_processes_for_permissions(spark):
    """Hadoop's file system with checksums starts a process for each file and each checksum, which shows the JVM's memory twice."""
    tables = Shared(spark, "plain")
    assert tables.write(spark.range(9), "a").count() == 9
    files = os.listdir(f"{tables.root.removeprefix('file://').removeprefix('file:')}/a")
    assert [f for f in files if f.endswith(".parquet")] and not [f for f in files if f.endswith(".crc")]


def test_short_tables_get_few_files(spark):
    tables = Shared(spark, "few")
    assert tables.write(spark.range(900).repartition(9), "a", 900).count() == 900
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{tables.root.removeprefix('file://').removeprefix('file:')}/a")) == 1


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


def test_free_names():
    assert free("x", ["X", "x_"]) == "x__" and free("y", ["x"]) == "y"


@pytest.mark.parametrize(("written", "few"), [(True, 0), (False, 0), (True, 100)])
def test_facts_meet_hot_rare_null_and_unknown_keys(spark, monkeypatch, written, few):
    monkeypatch.setattr(shared, "FEW", few)
    rows = [(1, k) for k in range(HOT_LEAST + 9)] + [(2, 0), (3, 1), (None, 2)]
    facts = spark.createDataFrame([(1, "hot", HOT_LEAST + 9), (2, "rare", 1), (9, "none", 1)], "key long, told string, n long")
    got = with_facts(spark.createDataFrame(rows, "key long, v long"), facts, ["key"], "n", len(rows), written)
    want = [(k, v, {1: "hot", 2: "rare"}.get(k)) for k, v in rows]
    assert sorted((tuple(r) for r in got.select("key", "v", "told").collect()), key=repr) == sorted(want, key=repr)
