"""Folders of the shared store go when they are no longer needed."""

from __future__ import annotations

import os

from marketloom.sources import fixtures as fx


def test_clear_removes_what_was_written(spark):
    before = list(fx._MADE)
    fx._MADE.clear()
    table = fx.stored(spark.range(5), "gone")
    path = fx._MADE[0][1].removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    fx.clear()
    assert not os.path.exists(path) and not fx._MADE
    fx._MADE.extend(before)
