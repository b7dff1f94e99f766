"""A ledger over the star-schema tables, in both engines, and the registry of queries.

=================  ==========================================================================
ledger concept     expression
=================  ==========================================================================
transaction        ``orders``: id, account (customer), date, signed amount, nullable category
currency           the customer's market segment, one of them null
description        priority, status and clerk-like text made of the order's own columns
account            ``customer``, archived while its balance is below zero
line               ``lineitem`` of an order
observation        ``events`` of type ``purchase``: value per user and day
=================  ==========================================================================
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: CTEs that every oracle may use.
CTES = """txn AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS transaction_date,
         CAST(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS category, NULLIF(c_mktsegment, 'MACHINERY') AS currency_code,
         o_orderstatus AS status, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey),
account AS (
  SELECT c_custkey AS account_id, c_name AS account_name, c_nationkey AS institution_id, CAST(c_acctbal AS DECIMAL(18,2)) AS balance,
         c_acctbal < 0 AS archived, NULLIF(c_mktsegment, 'MACHINERY') AS currency_code FROM customer),
line AS (
  SELECT l_orderkey AS transaction_id, l_linenumber AS line_number, l_partkey AS part_id, l_suppkey AS merchant_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_discount AS DECIMAL(18,2)) AS discount,
         l_returnflag AS flag, l_linestatus AS status, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with the SQL that gives the same rows (the CTEs above in front of it)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            ORACLES[name] = f"WITH RECURSIVE {CTES}, {text[5:]}" if text.startswith("WITH ") else f"WITH {CTES} {text}"
        return f

    return add


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def txn(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    amount = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("transaction_date"),
        money(amount).alias("amount"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("category"),
        F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("currency_code"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def account(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account_name"), F.col("c_nationkey").alias("institution_id"), money("c_acctbal").alias("balance"),
        (F.col("c_acctbal") < 0).alias("archived"), F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("currency_code"),
    )


def line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("merchant_id"),
        money("l_extendedprice").alias("amount"), money("l_quantity").alias("quantity"), money("l_discount").alias("discount"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("ship_date"),
    )
