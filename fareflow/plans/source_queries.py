"""Queries that write and read files: formats, fallbacks, partitions, reports. Files go to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import shared_folder
from ..sources import tables as T
from .adapters import Catalogue, rounded, table

query = Catalogue()


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CUSTOMER = StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType()), StructField("c_acctbal", DoubleType())])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_fallback(spark, sf):
    """Neither the Parquet file nor the first CSV is there; the compressed monthly ones are."""
    at = _folder(spark, "customer")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    for month in (1, 2):
        c.where(F.col("c_custkey") % 2 == month - 1).write.option("header", True).option("compression", "gzip").csv(f"{at}/customer_2024-0{month}.csv.gz")
    return T.first_source(spark, [("parquet", f"{at}/customer.parquet"), ("csv", f"{at}/customer.csv"), ("csv", f"{at}/customer_*.csv.gz")], CUSTOMER)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 3")
def csv_scan(spark, sf):
    at = _folder(spark, "customer")
    table(spark, sf, "customer").where("c_nationkey < 3").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(at)
    return T.read_csv(spark, at, CUSTOMER)


@query("SELECT n_nationkey, n_name FROM nation")
def folder_scan(spark, sf):
    """Of a folder with all tables, the files of one pattern."""
    return T.read_folder(spark, sf, pattern="nation*.parquet").select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region")
def recursive_scan(spark, sf):
    at, r = _folder(spark, "region"), table(spark, sf, "region")
    r.where("r_regionkey < 2").write.parquet(f"{at}/a")
    r.where("r_regionkey >= 2").write.parquet(f"{at}/b/deeper")
    return T.read_folder(spark, at, recursive=True).select("r_regionkey", "r_name")


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199811 AND 199902 GROUP BY 1, 2")
def monthly_files(spark, sf):
    at = _folder(spark, "orders")
    T.write_partitioned(T.monthly(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate"), at, ["year", "month"])
    found = T.read_months(spark, at, (1998, 11), (1999, 2))
    return rounded(found.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1")
def appended_partitions(spark, sf):
    """Years that are there are left alone; the missing ones are added, twice over without doubling them."""
    at = _folder(spark, "orders")
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    T.write_partitioned(o.where("year < 1998"), at, ["year"])
    for _ in range(2):
        T.write_partitioned(T.missing_partitions(o, spark.read.parquet(at), ["year"]), at, ["year"], "append")
    return spark.read.parquet(at).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(CASE WHEN year(o_orderdate) = 1997 THEN 1 ELSE count(*) END AS BIGINT) AS n FROM orders GROUP BY year(o_orderdate)")
def overwritten_partition(spark, sf):
    at = _folder(spark, "orders")
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    T.write_partitioned(o, at, ["year"])
    T.write_partitioned(o.where("year = 1997").limit(1), at, ["year"])
    return spark.read.parquet(at).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n_rows, CAST(sum(CAST(l_quantity > 25 AS INT)) AS BIGINT) AS n_long FROM lineitem GROUP BY 1")
def json_report(spark, sf):
    at = _folder(spark, "report")
    T.write_report(T.audit(table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).cast("int").alias("long")), ["l_returnflag"], ["long"]), at)
    return spark.read.schema("l_returnflag string, n_rows long, n_long long").json(at)


@query("SELECT n_regionkey, count(*) AS n, 1 AS n_files FROM nation GROUP BY 1")
def single_file(spark, sf):
    at = _folder(spark, "nation")
    T.write_single(table(spark, sf, "nation").repartition(4), at)
    found = spark.read.parquet(at).withColumn("_file", F.input_file_name())
    files = found.agg(F.count_distinct("_file").cast("int").alias("n_files"))
    return found.groupBy("n_regionkey").agg(F.count("*").alias("n")).crossJoin(F.broadcast(files))  # one row


ORDER = StructType([StructField("key", LongType()), StructField("price", DoubleType()), StructField("day", DateType()), StructField("absent", IntegerType())])


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CAST(NULL AS INT) AS absent FROM orders")
def conformed(spark, sf):
    """Columns under other names and as text; what can't be read is null."""
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    day = F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate").cast("string")).otherwise("soon")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("KEY"), price.alias("amount"), day.alias("Day"), "o_custkey")
    return T.conform(o, ORDER, {"price": ["cost", "amount"]})


@query("SELECT false AS fresh, 2 AS n_new, 1 AS n_gone")
def snapshot_freshness(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("snapshot"), F.concat(F.lit("http://x/"), "r_name").alias("url"))
    return T.up_to_date(r.where("snapshot <> 4"), r.where("snapshot >= 2"))
