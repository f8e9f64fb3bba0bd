"""The order in which the raw participation rows are joined."""

import re

from palmares.plans.roles import join_tables


def test_line_items_meet_their_parts_before_the_wide_orders(spark):
    folder = "/root/testdata/sf0.001"
    plan = join_tables(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    orders, parts = (re.search(rf"Join Inner, \({left}#\d+L? = {right}#\d+L?\)", plan) for left, right in (("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey")))
    assert orders.start() < parts.start()
