"""The flat business table and the question table, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SALES_ORDER = [
    "order_id", "line_number", "customer_name", "ship_date", "quantity",
    "net_amount", "tax_rate", "discount", "brand",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One denormalised row per order line, with gaps injected in two columns.

    Everything an order brings with it is joined before its lines are, and lines meet the two
    columns of their part first, so no shuffle moves the wide rows.
    """
    line = table(spark, sf_dir, "lineitem")
    orders, customer, nation, region, part = (
        table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region", "part")
    )
    buyer = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    ordered = orders.join(buyer, orders.o_custkey == customer.c_custkey)
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(ordered, line.l_orderkey == orders.o_orderkey)
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("part_type"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("order_status"),
            F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("return_flag"),
            F.col("l_linestatus").alias("line_status"),
            F.concat("r_name", F.lit("-"), "c_mktsegment").alias("region_segment"),
            F.col("l_shipdate").alias("ship_date"),
            F.col("o_orderdate").alias("order_date"),
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_quantity") != 50, F.col("l_extendedprice")).alias("sales_amount"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax_rate"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_amount"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked of ``sales``: user turns of the conversations, and one question per
    customer that names the customer, its nation, region or segment."""
    turns = (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select(
            F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("question_id"),
            F.col("text").alias("query_text"),
        )
    )
    kind = F.col("c_custkey") % 8
    wording = (
        F.when(kind == 0, F.concat(F.lit("What are the top regions by sales amount for "), "c_name", F.lit(" and why?")))
        .when(kind == 1, F.concat(F.lit("Compare net-amount by segment versus last year in "), "n_name"))
        .when(kind == 2, F.concat(F.lit("Show the distribution of discount by return flags for "), "c_mktsegment"))
        .when(kind == 3, F.concat(F.lit("Lowest quantity for "), "r_name", F.lit(" by month")))
        .when(kind == 4, F.concat(F.lit("Rank priorities by sales_amount in a week for "), F.lower("c_name")))
        .when(kind == 5, F.concat(F.lit("How is it going today, "), "c_name", F.lit("?")))
        .when(kind == 6, F.substring("c_name", 1, 2))
        .otherwise(F.concat(F.lit("Prior quarter: tax rates by brand and nations for "), "n_name"))
    )
    per_customer = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat_ws("-", F.lit("customer"), "c_custkey").alias("question_id"), wording.alias("query_text"))
    )
    return turns.unionByName(per_customer)
