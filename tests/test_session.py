"""Staged folders and their removal."""

import os

from hearthlog.session import cut, discard_staged, release, scratch_dir, staging


def test_staged_folders_can_be_discarded(spark):
    discard_staged(spark)
    staged = [cut(spark.range(n + 1)) for n in range(3)]
    with staging(spark, "kept"):
        kept = cut(spark.range(9))
    assert [df.count() for df in staged] == [1, 2, 3]
    before = set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    assert discard_staged(spark) == 3 and discard_staged(spark) == 0
    gone = before - set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    assert len(gone) == 3 and kept.count() == 9


def test_staged_tables_can_be_released_one_by_one(spark):
    first, second = cut(spark.range(3)), cut(spark.range(4))
    release(spark, first)
    assert second.count() == 4 and not os.path.exists(first.staged_at.removeprefix("file:"))
    discard_staged(spark)
