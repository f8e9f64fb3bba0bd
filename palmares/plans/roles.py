"""Participation roles on the order tables: raw rows, code lookup and the prepared table.

One line item stands for one participation: customer = athlete, nation = country, part type = sport. Every
measure is an integer-valued double, so sums and means do not depend on the order of the rows. Missing values
come from column values: no discount hides the sex, no tax the age, returned goods the height, urgent orders
the weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.plans.etl import prepare
from palmares.schemas import SUMMER, WINTER
from palmares.sources.files import NON_BREAKING_SPACE, clean_lookup, table
from palmares.store import stored_once

DEFAULT_CODE = "AM"
CONTINENT_CODES = {"AF": "AFRICA", "AM": "AMERICA", "AS": "ASIA", "EU": "EUROPE", "MI": "MIDDLE EAST"}


def _once(spark: SparkSession, folder: str, label: str, build, refresh: bool = False, partition_by=()) -> DataFrame:
    """The table of this session, folder and label, written at first use."""
    return stored_once(spark, (folder, label), lambda: build(spark, folder), refresh, partition_by)


def join_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows as a plan over the tables.

    Orders meet their customers before the line items, and line items their parts before the orders: once parts are too
    large to broadcast, line items are shuffled by part while they are narrow, not with the columns of orders and
    customers. Orders and line items grow together, so their join is a sort-merge: left alone, the planner overrates
    the size of the joined orders and broadcasts the line items while these are below its threshold.
    """
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    season = F.when(F.month("o_orderdate") <= 6, F.lit(WINTER)).otherwise(F.lit(SUMMER))
    turn = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    return rows.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("l_discount") != 0, F.when(F.col("l_linestatus") == "F", F.lit("F")).otherwise(F.lit("M"))).alias("sex"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity") + 12).alias("age"),
        F.when(F.col("l_returnflag") != "R", (F.col("p_size") + 150).cast("double")).alias("height"),
        F.when(F.col("o_orderpriority") != "1-URGENT", (F.col("l_partkey") % 60 + 50).cast("double")).alias("weight"),
        F.when(F.col("l_linenumber") == 7, F.concat("n_name", F.lit("-1"))).otherwise(F.col("n_name")).alias("team"),
        F.col("n_name").alias("noc"),
        F.concat_ws(" ", F.year("o_orderdate").cast("string"), season).alias("games"),
        F.col("c_mktsegment").alias("city"),
        F.col("p_type").alias("sport"),
        F.col("p_brand").alias("event"),
        F.when(turn == 0, F.lit("G")).when(turn == 1, F.lit("S")).when(turn == 2, F.lit("B")).alias("medal"),
    )


def code_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Code lookup as it may come from a file: one key is blank and one is a non-breaking space."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = (
        F.when(F.col("n_name") == "NATION_24", F.lit(""))
        .when(F.col("n_name") == "NATION_6", F.lit(NON_BREAKING_SPACE))
        .otherwise(F.col("n_name"))
    )
    return nations.select(key.alias("ioc"), F.substring("r_name", 1, 2).alias("continent"))


def raw_participation(spark: SparkSession, folder: str, refresh: bool = False) -> DataFrame:
    """The raw table, loaded once per session and folder. ``refresh`` loads it anew after the tables have changed."""
    return _once(spark, folder, "raw", join_tables, refresh)


def code_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned lookup, stored so that the planner knows its size."""
    return _once(spark, folder, "codes", lambda s, f: clean_lookup(code_rows(s, f), blank=DEFAULT_CODE))


def prepare_roles(spark: SparkSession, folder: str) -> DataFrame:
    """The prepared rows as a plan over the raw table."""
    return prepare(raw_participation(spark, folder), code_lookup(spark, folder), CONTINENT_CODES, DEFAULT_CODE)


def participation(spark: SparkSession, folder: str, refresh: bool = False) -> DataFrame:
    """The prepared table, written once per session and folder and read by every scenario.

    It is partitioned by century, so a scenario of one century reads only its folder. ``refresh``
    writes it anew, also the raw table.
    """
    if refresh:
        raw_participation(spark, folder, refresh)
    return _once(spark, folder, "prepared", prepare_roles, refresh, ["century"])
