"""Stored tables: written once, discarded one by one, by refreshing, and all together."""

from pathlib import Path

from palmares.store import discard, discard_all, shared_dir, stored, stored_once


def folders(spark):
    top = Path(shared_dir(spark).removeprefix("file://"), "palmares", spark.sparkContext.applicationId)
    return sorted(p.name for p in top.iterdir()) if top.exists() else []


def test_tables_are_discarded(spark):
    before = folders(spark)
    one, two = stored(spark.range(5).toDF("x"), "one"), stored(spark.range(6).toDF("x"), "two")
    assert len(folders(spark)) == len(before) + 2
    discard(one)
    assert two.count() == 6
    assert [f for f in folders(spark) if f not in before] == [Path(two.stored_path).name]
    discard(two)
    assert folders(spark) == before


def test_kept_tables_are_built_once_and_replaced(spark):
    before, built = folders(spark), []

    def build():
        built.append(1)
        return spark.range(len(built)).toDF("x")

    key = ("folder", "kept")
    assert stored_once(spark, key, build).count() == stored_once(spark, key, build).count() == 1
    assert stored_once(spark, key, build, refresh=True).count() == 2
    assert len(folders(spark)) == len(before) + 1


def test_nothing_is_left_after_the_session_clean_up(spark):
    stored_once(spark, ("folder", "kept"), lambda: spark.range(3).toDF("x"))
    stored(spark.range(2).toDF("x"))
    discard_all(spark)
    assert folders(spark) == []
    assert stored_once(spark, ("folder", "kept"), lambda: spark.range(4).toDF("x")).count() == 4
