"""A census-shaped person table derived from an order, line and customer star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans.survey import Survey
from tallyspark.session import spread
from tallyspark.sources.rules import RuleSet

# Person columns as SQL text that reads the same in Spark and in the oracle engine.
CENSUS_COLUMNS = {
    "YEAR": "CASE WHEN year(o_orderdate) <= 1996 THEN 1989 WHEN year(o_orderdate) <= 1998 THEN 1999 "
            "WHEN year(o_orderdate) <= 2000 THEN 2009 ELSE 2019 END",
    "SERIAL": "CAST(o_orderkey AS STRING)",
    "PERNUM": "l_linenumber",
    "HHWT": "CAST(1 + o_custkey % 7 AS DOUBLE)",
    "PERWT": "CAST(1 + l_partkey % 9 AS DOUBLE)",
    "URBAN": "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '1' ELSE '2' END",
    "GEO1_VN": "CAST(c_nationkey AS STRING)",
    "OWNERSHIP": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1' WHEN '2' THEN '2' WHEN '3' THEN '2' ELSE '3' END",
    "ELECTRIC": "CASE WHEN o_custkey % 10 = 0 THEN '99' WHEN o_custkey % 10 < 6 THEN '1' ELSE '2' END",
    "WATSUP": "CASE WHEN o_custkey % 17 = 0 THEN '99' WHEN year(o_orderdate) >= 2001 AND o_custkey % 5 = 0 THEN '30' "
              "WHEN o_orderstatus = 'P' THEN '10' WHEN o_orderstatus = 'O' THEN '11' ELSE '20' END",
    "SEWAGE": "CAST(10 + o_custkey % 3 AS STRING)",
    "WALL": "CAST(1 + o_custkey % 4 AS STRING)",
    "ROOF": "CAST(1 + o_orderkey % 3 AS STRING)",
    "LIVEAREA": "CASE WHEN o_custkey % 37 = 0 THEN 9999 ELSE CAST(floor(o_totalprice / 1000) AS INT) END",
    "ROOMS": "CAST(1 + o_orderkey % 6 AS INT)",
    "BEDROOMS": "CAST(1 + o_orderkey % 7 AS INT)",
    "AUTOS": "CASE WHEN o_custkey % 41 = 0 THEN 999 ELSE CAST(o_custkey % 13 % 3 AS INT) END",
    "MOTORCYCLE": "CAST(o_orderkey % 4 AS INT)",
    "AGE": "CAST(l_quantity * 2 + 12 AS INT)",
    "SEX": "CASE WHEN l_linestatus = 'O' THEN '1' ELSE '2' END",
    "MARST": "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END",
    "EDATTAIN": "CASE WHEN l_partkey % 23 = 0 THEN '99' ELSE CAST(l_partkey % 5 AS STRING) END",
    "CLASSWK": "CASE WHEN l_suppkey % 11 = 0 THEN '99' ELSE CAST(l_suppkey % 4 AS STRING) END",
    "CHBORN": "CASE WHEN l_partkey % 29 = 0 THEN 999 ELSE CAST(l_linenumber AS INT) END",
    "NCHILD": "CAST(l_linenumber - 1 AS INT)",
}

# One year-specific missing rule and one year-specific mapping besides the general ones.
CENSUS_RULES = RuleSet.default().extended(
    missing=[("WATSUP", "2019", "30|99")], harmonization=[("SEX", "2019", "1", "M")]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def census(lines: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Person rows: one per order line, with its order as household."""
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(*[F.expr(sql).alias(name) for name, sql in CENSUS_COLUMNS.items()])


def read_census(spark: SparkSession, folder: str) -> DataFrame:
    needed = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag"]
    lines = spread(table(spark, folder, "lineitem").select(*needed))
    return census(lines, table(spark, folder, "orders"), table(spark, folder, "customer"))


_surveys: dict[tuple[str, str], Survey] = {}


def survey(spark: SparkSession, folder: str) -> Survey:
    """The survey of a folder; its stored tables are shared by all queries of one application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _surveys:
        _surveys[key] = Survey(read_census(spark, folder), CENSUS_RULES)
    return _surveys[key]
