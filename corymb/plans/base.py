"""The specimen hierarchy on the driver's tables: region (island), nation (site), customer (plant), order (flower)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAITS = ("price", "top_price", "balance", "flowers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flowers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order, with its customer, nation and region.  Only the columns in use are read."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer: the mean of its orders, and the share of its decided orders that are pending."""
    phase = F.when(F.col("o_orderstatus") == "P", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    return (
        flowers(spark, sf_dir)
        .groupBy(F.col("r_name").alias("island"), F.col("n_name").alias("site"), F.col("c_custkey").alias("plant"), F.col("c_nationkey").alias("lat"), F.col("r_regionkey").alias("ord"))
        .agg(F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("top_price"), F.max("c_acctbal").alias("balance"), F.count("*").cast("double").alias("flowers"), F.avg(phase).alias("frac_female"), F.min(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))).alias("segment"))
    )


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(island, site, plant, lat, ord, trait, value)"""
    return plants(spark, sf_dir).unpivot(["island", "site", "plant", "lat", "ord"], list(TRAITS), "trait", "value")


PLANTS = """f AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
plants AS (SELECT r_name AS island, n_name AS site, c_custkey AS plant, c_nationkey AS lat, r_regionkey AS ord, avg(o_totalprice) AS price, max(o_totalprice) AS top_price, max(c_acctbal) AS balance, CAST(count(*) AS DOUBLE) AS flowers,
  avg(CASE o_orderstatus WHEN 'P' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END) AS frac_female, min(c_mktsegment) FILTER (WHERE c_acctbal >= 0) AS segment FROM f GROUP BY ALL)"""
LONG = PLANTS + ",\ntraits AS (" + " UNION ALL ".join(f"SELECT island, site, plant, lat, ord, '{t}' AS trait, {t} AS value FROM plants" for t in TRAITS) + ")"


def pst_sql(keys: str, group: str, value: str, source: str, least: int = 2, prefix: str = "q") -> str:
    """CTEs that end in ``{prefix}p`` (keys, n, k, msb, msw, pst)."""
    k = f"{keys}, " if keys else ""
    return f"""{prefix}s AS (SELECT {k}{group} AS g, count({value}) AS n, avg({value}) AS m, var_pop({value}) * count({value}) AS ss FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL HAVING count({value}) >= {least}),
{pst_of_sums_sql(keys, prefix)}"""


def pst_of_sums_sql(keys: str, prefix: str = "q") -> str:
    """The same from ``{prefix}s`` (keys, g, n, m, ss) on."""
    k, on = (f"{keys}, ", f"USING ({keys})") if keys else ("", "ON true")
    return f"""{prefix}t AS (SELECT {k}sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS grand, sum(ss) AS ssw, sum(n * n) AS n2 FROM {prefix}s {'GROUP BY ' + keys if keys else ''}),
{prefix}b AS (SELECT {k}sum(n * (m - grand) * (m - grand)) AS ssb FROM {prefix}s JOIN {prefix}t {on} {'GROUP BY ' + keys if keys else ''}),
{prefix}v AS (SELECT {k}nn AS n, t.k, CASE WHEN t.k >= 2 AND nn > t.k THEN ssb / (t.k - 1) END AS msb, CASE WHEN t.k >= 2 AND nn > t.k THEN ssw / (nn - t.k) END AS msw, CASE WHEN t.k >= 2 THEN (nn - n2 / nn::DOUBLE) / (t.k - 1) END AS n0 FROM {prefix}t t JOIN {prefix}b {on}),
{prefix}p AS (SELECT {k}n, k, msb, msw, CASE WHEN msb IS NULL THEN NULL WHEN greatest((msb - msw) / n0, 0) + msw > 0 THEN greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + 2 * msw) ELSE 0 END AS pst FROM {prefix}v)"""
