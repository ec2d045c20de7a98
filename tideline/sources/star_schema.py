"""Retail transaction lines derived from the star-schema tables.

Cancelled, anonymous, administrative and zero-price lines and a time of day are
assigned by fixed rules on the keys, so every later predicate has rows on both
sides. All rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.loaders import cast_identifiers, normalise_headers

SOURCES = ("first", "second")
SOURCE_SPLIT = "1998-07-01"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(key: str, step: int):
    return F.col(key) % step == 0


def transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both sources, with loosely written headers and no provenance yet."""
    line = read_table(spark, sf_dir, "lineitem")
    order = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    part = read_table(spark, sf_dir, "part")
    joined = (
        line.join(order, line.l_orderkey == order.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    cancelled = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    key_text = F.col("l_partkey").cast("string")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    return joined.select(
        F.concat(F.when(cancelled, "C").otherwise(""), F.col("o_orderkey").cast("string")).alias(
            "Invoice"
        ),
        F.when(_every("l_partkey", 89), " post ")
        .when(_every("l_partkey", 97), "ADJUST")
        .when(F.col("l_partkey") < 100000, F.lpad(key_text, 5, "0"))
        .otherwise(key_text)
        .alias("StockCode"),
        F.when(~_every("l_partkey", 50), F.col("p_name")).alias("Description"),
        F.when(cancelled, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        (
            F.col("o_orderdate")
            + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
        ).alias("InvoiceDate"),
        F.when(_every("l_partkey", 101), F.lit(0.0))
        .otherwise(F.floor(price * 100 + 0.5) / F.lit(100.0))
        .alias("Price"),
        F.when(~_every("o_orderkey", 10), F.col("o_custkey")).alias("Customer ID"),
        F.col("n_name").alias("Country"),
        F.col("o_orderdate").alias("_ordered"),
    )


def _early():
    return F.col("_ordered") < F.lit(SOURCE_SPLIT).cast("timestamp_ntz")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines under canonical names with their source, in one scan."""
    lines = transaction_lines(spark, sf_dir)
    source = F.when(_early(), SOURCES[0]).otherwise(SOURCES[1])
    tagged = lines.withColumn("_source", source).drop("_ordered")
    named = normalise_headers(tagged).withColumnRenamed("source", "source_sheet")
    return cast_identifiers(named)


def source_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = transaction_lines(spark, sf_dir)
    return {
        SOURCES[0]: lines.filter(_early()).drop("_ordered"),
        SOURCES[1]: lines.filter(~_early()).drop("_ordered"),
    }
