"""Query names, their Spark functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The participation roles of palmares.plans.roles in SQL: raw rows, cleaned code lookup, prepared rows.
ROLES = """
raw AS (
  SELECT c_custkey AS id, c_name AS name,
    CASE WHEN l_discount = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS sex,
    CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity + 12 END AS age,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(150 + p_size AS DOUBLE) END AS height,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(50 + l_partkey % 60 AS DOUBLE) END AS weight,
    CASE WHEN l_linenumber = 7 THEN n_name || '-1' ELSE n_name END AS team, n_name AS noc,
    CAST(year(o_orderdate) AS VARCHAR) || ' ' || CASE WHEN month(o_orderdate) <= 6 THEN 'Winter' ELSE 'Summer' END AS games,
    c_mktsegment AS city, p_type AS sport, p_brand AS event,
    CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'S' WHEN 2 THEN 'B' ELSE NULL END AS medal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
),
codes AS (
  SELECT n_name AS ioc, substr(r_name, 1, 2) AS cc FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_name NOT IN ('NATION_24', 'NATION_6')
),
names AS (SELECT substr(r_name, 1, 2) AS cc, r_name AS continent FROM region),
rv AS (
  SELECT raw.id, raw.name, CASE sex WHEN 'F' THEN 'Female' ELSE 'Male' END AS sex, age, height, weight, team, noc, games,
    city, sport, event,
    CASE medal WHEN 'G' THEN 'Gold' WHEN 'S' THEN 'Silver' WHEN 'B' THEN 'Bronze' ELSE 'No medal' END AS medal,
    CAST(split_part(games, ' ', 1) AS INTEGER) AS year, split_part(games, ' ', 2) AS season,
    CASE WHEN CAST(split_part(games, ' ', 1) AS INTEGER) <= 2000 THEN 20 ELSE 21 END AS century,
    CASE WHEN age < 20 THEN '1-20' WHEN age < 25 THEN '21-25' WHEN age < 30 THEN '26-30' WHEN age < 40 THEN '31-40'
         ELSE '41-60' END AS age_bin,
    names.continent
  FROM raw LEFT JOIN codes ON noc = ioc LEFT JOIN names ON names.cc = coalesce(codes.cc, 'AM')
  WHERE sex IS NOT NULL AND age >= 0 AND age < 60
)"""


def over_roles(select: str, *parts: str) -> str:
    """SQL over ``raw``, ``codes`` and ``rv``; ``parts`` are further named subqueries."""
    return "WITH " + ",\n".join([ROLES, *parts]) + "\n" + select


def half_up(value: str, digits: int = 2) -> str:
    """Round the shortest decimal text of a double half up, as Spark does; DuckDB rounds its binary value."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


BMI = half_up("weight / pow(height / 100, 2)")


def equal_width(source: str) -> tuple[str, str]:
    """``ends`` with the nine edges of ``bmi`` in ``source``, and ``binned`` with the label of the first seven bins."""
    inner = [f"round_even((lo + (hi - lo) / 8 * {i}) * 100, 0) / 100" for i in range(8)]
    reached = [f"CAST(bmi >= edges[{i}] AS INTEGER)" for i in range(1, 9)]
    low = "CASE WHEN b = 1 THEN edges[1] ELSE round_even((edges[b] + 0.01) * 100, 0) / 100 END"
    return (
        f"ends AS (SELECT [{', '.join(inner)}, hi] AS edges FROM (SELECT min(bmi) AS lo, max(bmi) AS hi FROM {source}))",
        f"""binned AS (SELECT *, CAST({low} AS VARCHAR) || '-' || CAST(edges[b + 1] AS VARCHAR) AS bmi_bin
  FROM (SELECT *, CAST({' + '.join(reached)} AS BIGINT) AS b FROM {source}, ends) WHERE b BETWEEN 1 AND 7)""",
    )


def query(name: str, select: str | None = None, *parts: str, roles: bool = True) -> Callable[[Query], Query]:
    """Register a Spark query and, where SQL can express it, the SQL with the same columns and rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if select:
            SQL[name] = over_roles(select, *parts) if roles else select
        return function

    return register
