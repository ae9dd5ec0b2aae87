"""The snapshot store, order in time, and digests of tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from treesift.functions.digests import table_digest
from treesift.operators import intelligence
from treesift.sources import json_tree, manifests
from treesift.sources.snapshots import SnapshotStore, as_of, order_of

TODAY = date(2026, 3, 10)


def test_publish_update_and_roll_back(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="no active"):
        store.active()
    with pytest.raises(ValueError, match="no previous"):
        store.rollback()
    first = store.update(docs.where("doc_id < 100"), "2026.03.09.2", TODAY)
    reader = store.active()
    second = store.update(docs, "2026.03.10.1", TODAY)
    assert first != second and store.active().count() == docs.count() and store.version() == "2026.03.10.1"
    assert reader.count() == 100  # one that began before goes on
    assert store.update(docs.orderBy(F.rand()).repartition(5), "2026.03.10.1", TODAY) == second
    assert store.pointer("previous") == first
    for version in ("2026.03.10.0", "2026.03.09.9"):
        with pytest.raises(ValueError, match="older"):
            store.update(docs, version, TODAY)
    with pytest.raises(ValueError, match="future"):
        store.update(docs, "2026.03.12.1", TODAY)
    assert store.rollback() == first and store.version() == "2026.03.09.2" and store.pointer("previous") == second
    assert store.rollback() == second


def test_changed_objects_are_refused(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    digest = store.update(spark.range(10), "2026.03.01.1", TODAY)
    spark.range(11).write.mode("overwrite").parquet(f"{store.root}/objects/{digest}")
    with pytest.raises(ValueError, match="digest"):
        store.active()
    store._replace("active", "x")
    with pytest.raises(ValueError, match="invalid"):
        store.pointer()


def test_digests_depend_on_rows_and_not_on_their_order(spark):
    df = spark.range(3000).select((F.col("id") % 2900).alias("id"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v"))
    digest = table_digest(df)
    for ranges in (1, 16, 5000):
        assert table_digest(df, ranges) == table_digest(df.repartition(7), ranges)
    assert digest != table_digest(df.limit(2999)) and digest != table_digest(df.fillna("")) and digest != table_digest(df.unionAll(df.where("id = 5")))
    assert table_digest(df.where("false")) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    hot = spark.range(200_000).select(F.lit(1).alias("id"))
    assert table_digest(hot) == table_digest(hot.repartition(3))


def test_order_and_last_versions(spark):
    assert order_of("2026.01.02.10") > order_of("2026.01.02.9") > order_of("2026.01.01.99")
    with pytest.raises(ValueError, match="version"):
        order_of("2026.1.2")
    rows = [("a", "2026.01.01.1", 1), ("a", "2026.01.01.10", 2), ("a", "2026.01.01.9", 3), ("a", "2026.02.01.1", 4), ("b", "2026.01.15.1", 5), ("b", "none", 6)]
    history = spark.createDataFrame(rows, "name string, version string, v int")
    days = [("a", "2025-12-31"), ("a", "2026-01-01"), ("a", "2026-01-31"), ("a", "2026-02-01"), ("b", "2026-01-14"), ("b", "2027-01-01"), ("c", "2026-01-01")]
    dates = spark.createDataFrame(days, "name string, day string").withColumn("day", F.col("day").cast("date"))
    found = {(r.name, str(r.day)): r.v for r in as_of(history, dates, "name").collect()}
    assert found == dict(zip(days, (None, 2, 2, 4, None, 5, None), strict=True))


def nested(depth):
    text = "{}"
    for i in range(depth, 0, -1):
        text = f'{{"n{i}": {{"version": "1.{i}.0", "dependencies": {text}}}}}'
    return f'{{"dependencies": {text}}}'


def test_trees_of_any_depth(spark):
    files = spark.createDataFrame([("r", "package-lock.json", nested(60)), ("s", "package-lock.json", '{"dependencies": {"a": 1}} x')], "repo_id string, path string, text string")
    assert sorted(int(r.name[1:]) for r in manifests.npm_lock(files.where("repo_id = 'r'")).collect()) == list(range(1, 61))
    assert [(r.repo_id, r.reason) for r in manifests.unreadable(files).collect()] == [("s", "unreadable JSON manifest")]


def test_snapshots_are_read_strictly(spark):
    good = '{"snapshot_version": "2026.01.01.1", "snapshot_date": "2026-01-01", "packages": [{"ecosystem": "npm", "name": "a", "aliases": ["x"], "affected_versions": ["= 1.0.0"]}], "file_hashes": [{"sha256": "00"}]}'
    texts = [
        (1, good), (2, good + "{}"), (3, good.replace('"name"', '"nam"')), (4, good.replace('{"sha256": "00"}', "")), (5, good.replace('"snapshot_date"', '"extra": {"y": 1}, "snapshot_date"')), (6, None),
    ]
    packages, problems = intelligence.read_snapshots(spark.createDataFrame(texts, "id long, json string"))
    assert [(r.id, r.name, r.affected) for r in packages.collect()] == [(1, "a", ["= 1.0.0"])]
    assert sorted((r.id, r.field, r.problem) for r in problems.collect()) == [
        (2, "$", "not JSON"), (3, "$.packages[].nam", "unknown field"), (4, "$.file_hashes", "invalid number of rows"), (5, "$.extra", "unknown field"), (6, "$", "not JSON"),
    ]
    assert json_tree.fields(spark.createDataFrame([(1, "[[1], {\"a\": []}]")], "id long, json string").select("id", "json")).count() == 4


def test_lock_trees_are_walked_without_a_shuffle(spark):
    flat = '{"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1"}, "node_modules/b/node_modules/@s/c": {"version": "2"}, "node_modules/d": {}}}'
    wide = '{"dependencies": {"x": {"version": "1", "dependencies": {"y": {"version": "{"}, "z": {"dependencies": {"w": {"version": "3"}}}}}, "v": {"version": 4}, "u": 5, "t": {"version": "6", "dependencies": [{"q": {"version": "7"}}]}}}'
    texts = [flat, wide, nested(300), '{"dependencies": []}', '{"dependencies": {}}', "{}", "[1]", "{", "", None, '{"packages": {}, "dependencies": {"k": {"version": "8"}}}']
    files = spark.createDataFrame([(str(i), "package-lock.json", t) for i, t in enumerate(texts)], "repo_id string, path string, text string")
    out = manifests.npm_lock(files)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and "UnionLoop" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r.repo_id, r.name, r.version) for r in out.collect()]
    assert sorted(r for r in rows if r[0] != "2") == [("0", "@s/c", "2"), ("0", "a", "1"), ("1", "t", "6"), ("1", "v", "4"), ("1", "w", "3"), ("1", "x", "1"), ("1", "y", "{"), ("10", "k", "8")]
    assert len({r for r in rows if r[0] == "2"}) == 300
