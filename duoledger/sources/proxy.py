"""Ledger relations as views of the star-schema tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents

#: Chart of accounts: (category_id, code, name, kind, dre_group, sort_order). The groups are fixed values.
CHART = [
    (0, "3.01", "Retainers", "revenue", "receita_bruta", 10),
    (1, "3.02", "Projects", "revenue", "receita_bruta", 20),
    (2, "4.01", "Sales taxes", "tax", "deducoes", 30),
    (3, "5.01", "Delivery", "cost", "custos_diretos", 40),
    (4, "6.02", "Salaries", "expense", "pessoal", 50),
    (5, "7.01", "Software", "expense", "ferramentas", 60),
    (6, "7.02", "Contractors", "expense", "servicos", 70),
    (7, "7.03", "Travel", "expense", "viagem", 80),
    (8, "7.09", "Other", "expense", "outras", 90),
    (9, "8.01", "Bank fees", "expense", "financeiras", 100),
    (10, "9.01", "Distributions", "owner_draw", "socios", 110),
    (11, "99.02", "Card bill", "transfer", "transferencias", 120),
    (12, "99.03", "Investments", "transfer", "transferencias", 130),
    (13, "7.99", "Unsorted", "expense", None, 140),
]
CHART_SCHEMA = "category_id long, code string, name string, kind string, dre_group string, sort_order int"

SQL_CHART = "chart(category_id, code, name, kind, dre_group, sort_order) AS (VALUES " + ", ".join(
    f"({i}, '{code}', '{name}', '{kind}', {repr(group) if group else 'NULL'}, {order})" for i, code, name, kind, group, order in CHART) + ")"
SQL_ACCOUNTS = """accounts AS (
  SELECT s_suppkey AS account_id, n_regionkey AS entity_id, CAST(round(s_acctbal * 100) AS BIGINT) AS opening_cents,
    CASE s_suppkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'cash' ELSE 'investment' END AS type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
SQL_ENTRIES = """entries AS (
  SELECT o_custkey % 10 AS account_id, CAST(o_orderdate AS DATE) AS occurred_on, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 'in' AS direction,
    o_custkey % 2 AS category_id, o_custkey AS client_id, n_regionkey AS entity_id, CAST(NULL AS DATE) AS competence_period
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT l_suppkey, CAST(l_shipdate AS DATE), CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT), 'out',
    CASE WHEN l_partkey % 15 < 14 THEN l_partkey % 15 END, NULL, n_regionkey,
    CASE WHEN l_returnflag = 'R' THEN CAST(date_trunc('month', l_shipdate) - INTERVAL 1 MONTH AS DATE) END
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
SQL_LEDGER = f"WITH {SQL_CHART}, {SQL_ACCOUNTS}, {SQL_ENTRIES}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHART, CHART_SCHEMA)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("entity_id"))
    kind = F.element_at(F.array(*map(F.lit, ("bank", "credit_card", "cash", "investment"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey").select(
        F.col("s_suppkey").alias("account_id"), "entity_id", cents(F.col("s_acctbal")).alias("opening_cents"), kind.alias("type"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash entries: orders come in, line items go out; those returned are of the month before."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("entity_id")))
    clients = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("nk")).join(nation, "nk")
    came = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "client_id").join(clients, "client_id").select(
        (F.col("client_id") % 10).alias("account_id"), F.col("o_orderdate").cast("date").alias("occurred_on"), cents(F.col("o_totalprice")).alias("cents"),
        F.lit("in").alias("direction"), (F.col("client_id") % 2).alias("category_id"), "client_id", "entity_id", F.lit(None).cast("date").alias("competence_period"))
    holders = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account_id"), F.col("s_nationkey").alias("nk")).join(nation, "nk")
    shipped = F.col("l_shipdate").cast("date")
    went = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "account_id").join(holders, "account_id").select(
        "account_id", shipped.alias("occurred_on"), cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cents"), F.lit("out").alias("direction"),
        F.when(F.col("l_partkey") % 15 < 14, F.col("l_partkey") % 15).alias("category_id"), F.lit(None).cast("long").alias("client_id"), "entity_id",
        F.when(F.col("l_returnflag") == "R", F.add_months(F.trunc(shipped, "MM"), -1)).alias("competence_period"))
    return came.unionByName(went)
