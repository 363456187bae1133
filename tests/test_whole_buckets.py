"""Queries on the files of buckets hold where a bucket is larger than what a task is to take."""

import pytest

from panelweave import catalog


@pytest.fixture
def small_tasks(spark):
    """Tasks and pieces of files of a few KB: what buckets of several hundred MB meet by default."""
    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.files.maxPartitionBytes": "8KB", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["A-05_storage_profile", "I-01_change_scope", "I-01_change_scope_removed_bucket", "S-06_manifest", "S-07_manifest_diff", "L-03_storage_order"])
def test_a_large_bucket_is_one_file(name, small_tasks, same):
    same(catalog.QUERIES[name], catalog.SQL[name])
