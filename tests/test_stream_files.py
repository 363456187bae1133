"""Streams whose batches are of several files, as large panels are."""

import functools
from pathlib import Path

import pytest

from panelweave import catalog
from panelweave.catalog import tables
from panelweave.session import shared_folder


@pytest.mark.parametrize("name", ["I-09_stream_newest", "I-09_stream_refresh_versions"])
def test_versions_come_in_files_that_tasks_share(name, spark, sf_dir, same, monkeypatch):
    monkeypatch.setattr(tables, "_stored_panel", functools.partial(tables._stored_panel, rows_per_file=2000))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    same(catalog.QUERIES[name], catalog.SQL[name])
    panel, n = tables._stored_panel(spark, sf_dir)
    assert n > 1 and panel.count() >= 2000 * n
    new = set(folder.iterdir()) - before
    assert [3 * n] == [k for p in new if (k := len(list(p.glob("*.parquet")))) > n]  # the source: three versions of n files
    assert not [q for p in new if p.name.startswith("shelf-") for q in p.iterdir()]  # batches are released
