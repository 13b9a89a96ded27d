"""Stored tables: merges touch what changes, a merge that dies changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from rostrum.operators import merging
from rostrum.operators.table_store import TableStore


def people(spark, ids, name="n"):
    return spark.createDataFrame([(i, f"{name}{i}") for i in ids], "id long, name string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def upsert(old, new):
    return merging.upsert(old, new, ["id"])


def test_a_merge_writes_touched_buckets_only(spark, tmp_path):
    old, new = people(spark, [*range(500), None]), people(spark, [3, 700, None], "new")
    store = TableStore(spark, f"{tmp_path}/t").create(old, ["id"], buckets=16)
    before = store.manifest()
    after = store.merge(new, upsert)
    changed = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    touched = {str(r[0]) for r in new.select(F.pmod(F.xxhash64("id"), F.lit(16))).collect()}
    assert changed == touched and 0 < len(touched) <= 3 and after.version == 1
    assert rows(store.read()) == rows(upsert(old, new)) and rows(store.read(0)) == rows(old)
    assert store.merge(new.limit(0), upsert).version == 1
    again = store.merge(new, upsert)
    assert again.version == 2 and rows(store.read()) == rows(store.read(1))


def test_a_merge_that_dies_between_buckets_leaves_the_old_version(spark, tmp_path):
    old, new = people(spark, range(300)), people(spark, range(0, 400, 2), "new")
    store = TableStore(spark, f"{tmp_path}/t").create(old, ["id"], buckets=8)
    files = sum(len(f) for *_, f in os.walk(tmp_path))

    def dies(a, b):
        return upsert(a, b).withColumn("name", F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))

    with pytest.raises(Exception, match="killed"):
        store.merge(new, dies)
    assert store.versions() == [0] and rows(TableStore(spark, f"{tmp_path}/t").read()) == rows(old)
    store.merge(new, upsert)
    assert rows(store.read()) == rows(upsert(old, new))
    store.vacuum(keep=1)
    assert store.versions() == [1] and rows(store.read()) == rows(upsert(old, new)) and sum(len(f) for *_, f in os.walk(tmp_path)) <= files + 4
    with pytest.raises(FileNotFoundError):
        store.read(0)


def test_a_manifest_that_was_not_published_is_not_read(spark, tmp_path, monkeypatch):
    store = TableStore(spark, f"{tmp_path}/t").create(people(spark, range(50)), ["id"], buckets=4)

    def crash(self, m):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(TableStore, "_publish", crash)
        with pytest.raises(KeyboardInterrupt):
            store.merge(people(spark, range(10), "new"), upsert)
    assert rows(store.read()) == rows(people(spark, range(50)))
    assert len(os.listdir(f"{tmp_path}/t/data")) == 2
    store.vacuum()
    assert len(os.listdir(f"{tmp_path}/t/data")) == 1 and rows(store.read()) == rows(people(spark, range(50)))


def test_children_are_replaced_by_parent_and_buckets_may_become_empty(spark, tmp_path):
    kinds = "parent long, id long, name string"
    old = spark.createDataFrame([(p, i, "old") for p in range(20) for i in range(5)], kinds)
    new = spark.createDataFrame([(3, 1, "new"), (4, 9, "new"), (4, 9, "new")], kinds)
    store = TableStore(spark, f"{tmp_path}/t").create(old, ["parent"], buckets=32)
    store.merge(new, lambda a, b: merging.replace_children(a, b, ["parent"], ["id"]))
    assert rows(store.read()) == sorted([(p, i, "old") for p in range(20) for i in range(5) if p not in (3, 4)] + [(3, 1, "new"), (4, 9, "new")], key=str)
    store.merge(spark.createDataFrame([(7, 0, "")], kinds), lambda a, b: a.join(b.select("parent").distinct(), "parent", "left_anti"))
    assert store.read().filter("parent = 7").count() == 0 and store.read().count() == 87
    with pytest.raises(ValueError, match="do not touch"):
        store.merge(new, lambda a, b: a.withColumn("parent", F.col("id") + 100))
    assert store.read().count() == 87


def test_an_empty_table_and_one_that_is_there(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/t").create(people(spark, []), ["id"])
    assert store.read().count() == 0 and store.read().columns == ["id", "name"]
    with pytest.raises(FileExistsError):
        store.create(people(spark, [1]), ["id"])
    store.merge(people(spark, [1]), upsert)
    assert rows(store.read()) == [(1, "n1")]
    with pytest.raises(FileNotFoundError):
        TableStore(spark, f"{tmp_path}/none").read()
