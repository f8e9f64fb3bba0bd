"""Sources and sinks, the preparation from files, and plan shape."""

import pytest
from pyspark.sql import functions as F

import compare
from palmares.catalog import QUERIES, SQL
from palmares.jobs import load, prepare_table
from palmares.operators.filters import apply_filters, expand_values
from palmares.operators.joins import attach
from palmares.plans.defaults import DOUBLE_FILTERS, FLOW_FILTERS
from palmares.plans.etl import prepare, prepare_early
from palmares.plans.medals import medal_groups
from palmares.schemas import PREPARED
from palmares.sources.files import export_csv, read_fact_csv, read_lookup_csv
from palmares.sources.jdbc import Split, scan_options
from palmares.sources.tables import (
    append_table, create_database, database_exists, drop_database, list_databases, list_tables, overwrite_table, peek,
)
from palmares.store import new_path, shared_dir, stored

FACT = """ID,Name,Sex,Age,Height,Weight,Team,NOC,Games,Year,Season,City,Sport,Event,Medal
1,Anna,F,24,180,70,Poland,POL,1992 Summer,1992,Summer,Barcelona,Rowing,Single,NA
1,Anna,F,28,180,NA,Poland,POL,1996 Summer,1996,Summer,Atlanta,Rowing,Single,Gold
2,Bob,M,19,NA,NA,Poland-1,POL,2002 Winter,2002,Winter,Salt Lake City,Luge,Single,B
3,Cid,NA,30,175,66,Nowhere,ZZZ,1992 Summer,1992,Summer,Barcelona,Rowing,Eight,Silver
4,Dan,M,NA,175,66,Nowhere,ZZZ,1992 Summer,1992,Summer,Barcelona,Rowing,Eight,S
5,Eve,F,60,165,55,Nowhere,ZZZ,1992 Summer,1992,Summer,Barcelona,Rowing,Eight,
6,Fay,F,40,165,55,Nowhere,ZZZ,1896 Summer,1896,Summer,Athens,Rowing,Eight,Silver
"""
CODES = "IOC,Continent\nPOL,EU\nUSA,NA\n,\n\u00a0,AN\nGER,EU\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "fact.csv").write_text(FACT, encoding="utf-8")
    (folder / "codes.csv").write_text(CODES, encoding="utf-8")
    return folder


def test_preparation_from_files(spark, files):
    raw = read_fact_csv(spark, str(files / "fact.csv"))
    codes = read_lookup_csv(spark, str(files / "codes.csv"))
    assert {tuple(r) for r in codes.collect()} == {("POL", "EU"), ("USA", "NA"), ("GER", "EU")}
    rows = prepare(raw, codes)
    assert sorted(rows.columns) == sorted(PREPARED.fieldNames())
    found = {(r["name"], r["year"]): r for r in rows.collect()}
    assert set(found) == {("Anna", 1992), ("Anna", 1996), ("Bob", 2002), ("Fay", 1896)}
    anna, bob, fay = found[("Anna", 1996)], found[("Bob", 2002)], found[("Fay", 1896)]
    assert (anna["sex"], anna["medal"], anna["century"], anna["age_bin"], anna["continent"]) == ("Female", "Gold", 20, "26-30", "Europe")
    assert (bob["medal"], bob["season"], bob["century"], bob["age_bin"]) == ("Bronze", "Winter", 21, "1-20")
    assert (fay["century"], fay["age_bin"], fay["continent"]) == (19, "41-60", "North America")
    assert found[("Anna", 1992)]["medal"] == "No medal"


def test_load_and_prepare_jobs(spark, files):
    name, path = "palmares_jobs_test", new_path(spark, "export")
    create_database(spark, name, new_path(spark, name))
    load(spark, str(files / "fact.csv"), name)
    prepare_table(spark, name, str(files / "codes.csv"), export_path=path)
    assert spark.table(f"{name}.participation_raw").count() == 7 and spark.table(f"{name}.participation").count() == 4
    exported = read_fact_csv(spark, path, spark.table(f"{name}.participation").schema)
    assert sorted(r["continent"] for r in exported.collect()) == ["Europe", "Europe", "Europe", "North America"]
    drop_database(spark, name)


def test_empty_choices_take_the_default_lists(spark):
    rows = spark.createDataFrame(
        [("Summer", "2", "GER", "Male", 2), ("Summer", "6", "GER", "Male", 2), ("Winter", "S.Y.", "USA", "Female", 7)],
        "season string, years_to_two string, noc string, sex string, gold_count bigint",
    )
    assert apply_filters(rows, {}, DOUBLE_FILTERS).count() == 1
    assert apply_filters(rows, {"noc": expand_values(["GER"]), "years_to_two": ["6"]}, DOUBLE_FILTERS).count() == 1
    assert apply_filters(rows, {}, FLOW_FILTERS).count() == 2
    assert apply_filters(rows, {"sex": ["Female", "7"], "gold_count": ["Female", "7"]}).count() == 1


def test_early_preparation_from_files(spark, files):
    rows = prepare_early(read_fact_csv(spark, str(files / "fact.csv")), read_lookup_csv(spark, str(files / "codes.csv")))
    found = {(r["name"], r["year"]): r for r in rows.collect()}
    assert ("Bob", 2002) not in found and ("Dan", 1992) not in found and ("Cid", 1992) in found
    anna = found[("Anna", 1996)]
    assert (anna["weight"], anna["age_group"], anna["medal_count"], anna["average_age"]) == (70.0, "21-30", 1, 28.0)
    assert (found[("Cid", 1992)]["medal_count"], found[("Eve", 1992)]["age_group"]) == (2, "51-60")


def test_csv_export_restores_nulls(spark, files):
    raw = read_fact_csv(spark, str(files / "fact.csv"))
    path = new_path(spark, "export")
    export_csv(raw, path)
    assert read_fact_csv(spark, path).exceptAll(raw).count() == 0 and raw.exceptAll(read_fact_csv(spark, path)).count() == 0


def test_catalog(spark, files):
    name = "palmares_catalog_test"
    assert not database_exists(spark, name)
    create_database(spark, name, new_path(spark, name))
    create_database(spark, name)
    assert database_exists(spark, name) and name in [r["database"] for r in list_databases(spark).collect()]
    raw = read_fact_csv(spark, str(files / "fact.csv"))
    append_table(raw, f"{name}.fact", ["season"])
    append_table(raw, f"{name}.fact", ["season"])
    assert spark.table(f"{name}.fact").count() == 14 and peek(spark, f"{name}.fact").count() == 5
    overwrite_table(raw, f"{name}.fact", ["season"])
    assert spark.table(f"{name}.fact").count() == 7
    assert [tuple(r) for r in list_tables(spark, name).collect()] == [(name, "fact")]
    drop_database(spark, name)
    drop_database(spark, name)
    assert not database_exists(spark, name)


def test_jdbc_options_carry_the_split():
    options = scan_options("jdbc:x://h/db", "fact", {"user": "u"}, Split("id", "1", "100", 8))
    assert options == {
        "url": "jdbc:x://h/db", "dbtable": "fact", "user": "u", "partitionColumn": "id", "lowerBound": "1",
        "upperBound": "100", "numPartitions": "8",
    }


def test_stored_tables_lie_in_the_shared_folder(spark):
    assert new_path(spark, "x").startswith(shared_dir(spark)) and new_path(spark, "x") != new_path(spark, "x")
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "k int, s string")
    assert sorted(map(str, stored(rows, partition_by=["k"]).collect())) == sorted(map(str, rows.collect()))


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})

    with pytest.raises(ValueError):
        shared_dir(Session("yarn"))
    assert shared_dir(Session("local[2]")) == shared_dir(Session("local[2]"))


LAZY = sorted(n for n in QUERIES if not n.startswith(("io", "ml", "q0b", "q1e", "q2e", "q3", "q4f")))


@pytest.mark.parametrize("name", LAZY)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    frame = QUERIES["pf10_conjunction"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(medal,Gold)" in plan and "LessThan(age,26.0)" in plan and "EqualTo(continent,EUROPE)" in plan
    assert "weight" not in plan and "team" not in plan


def test_entry_is_the_medal_table(spark):
    from __spark_entry__ import entry

    rows = entry(spark)
    assert rows.columns == ["continent", "season", "gold", "silver", "bronze", "medals"]
    assert all(r["gold"] + r["silver"] + r["bronze"] == r["medals"] for r in rows.collect())


def test_medal_groups_sum_to_all_medals(spark):
    from palmares.plans.roles import participation

    rows = participation(spark, "/root/testdata/sf0.001")
    assert medal_groups(rows).agg(F.sum("medals")).first()[0] == rows.filter("medal <> 'No medal'").count()


@pytest.fixture
def large_scale(spark):
    """Settings under which small data is planned like large data: no broadcast, tiny partitions, skew found early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_key_is_split_when_values_are_too_large_to_broadcast(spark, large_scale):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id") % 5000)).alias("name"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    joined = attach(rows, rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "inner")
    hot = (F.col("name") == "hot") & (F.col("n") == 20000)
    checked = joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hot).alias("hot"), F.max("payload").alias("payload"))
    assert tuple(checked.collect()[0])[:2] == (60000, 20000)
    assert "SortMergeJoin(skew=true)" in checked._jdf.queryExecution().executedPlan().toString()


SCALE = [
    "jn07_lookup_default", "jn08_semi_top_k", "jn14_range_lookup", "jn05_distinct_per_key", "im01_three_stage", "ag16_hierarchy", "ag18_share",
    "q2c_mean_age_medal", "q3b_body_hierarchy", "q4a_double_winners", "q4e_winner_hierarchy", "ml02_exact_sample", "en01_label_index",
]


@pytest.mark.parametrize("name", SCALE)
def test_rows_without_broadcast(spark, large_scale, name):
    frame = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert compare.differences(frame, compare.connect("/root/testdata/sf0.001"), SQL[name]) == []
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
