"""Queries through zip archives: each supplier's line items packed as CSV files, read without unpacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corymb.plans.base import table
from corymb.plans.registry import query
from corymb.sources import archives, tables
from corymb.sources.scratch import scratch


def _packed(spark, sf_dir) -> str:
    """A folder of archives, one a supplier: a CSV file for each return flag, and a note that nobody wants."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("supplier"), "l_returnflag", F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("line"))
    csv = d.groupBy("supplier", F.concat("l_returnflag", F.lit(".csv")).alias("member")).agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("body"))
    notes = d.select("supplier").distinct().select("supplier", F.lit("docs/note.txt").alias("member"), F.lit("not,a,row").alias("body"))
    path = scratch(spark, "archives")
    tables.write_files(archives.packed(csv.unionByName(notes), "supplier", "member", "body"), path)
    return path


@query("archived_items", "SELECT l_returnflag AS flag, count(DISTINCT l_suppkey) AS archives, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, sum(l_orderkey)::BIGINT AS orders FROM lineitem GROUP BY 1")
def archived_items(spark, sf_dir):
    """All CSV members of all archives, line by line."""
    m = archives.members(spark, _packed(spark, sf_dir), ".csv")
    line = m.select("archive", F.regexp_extract("member", r"^(\w+)\.csv$", 1).alias("flag"), F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    part = F.split("line", ",")
    return line.groupBy("flag").agg(F.count_distinct("archive").alias("archives"), F.count("*").alias("n"), F.sum(part[2].cast("long")).alias("quantity"), F.sum(part[0].cast("long")).alias("orders"))


@query("archived_returns", "SELECT l_suppkey::VARCHAR || '.zip' AS archive, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def archived_returns(spark, sf_dir):
    """One member of each archive, chosen by a filter that planning sees."""
    m = archives.members(spark, _packed(spark, sf_dir)).where("member = 'R.csv'")
    part = F.split(F.col("line"), ",")
    return m.select("archive", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).groupBy("archive").agg(F.count("*").alias("n"), F.sum(part[2].cast("long")).alias("quantity"))
