"""Queries of joins, projections, windows and formats on the driver's tables, and of the streaming twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corymb.functions import scalars as sc
from corymb.operators import divergence as dv
from corymb.operators import matching, ranks
from corymb.operators import relational as rel
from corymb.plans.base import PLANTS, plants, pst_sql, table
from corymb.plans.registry import query
from corymb.streaming import phases


def _hand(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").cast("string").alias("corolla_id"), F.when(F.col("o_orderstatus") == "O", "opened_full").otherwise("folded_half").alias("fold_state"), F.round(F.col("o_totalprice") / 1000, 2).alias("corolla_length_mm"),
        F.round(F.col("o_totalprice") / 2000, 2).alias("corolla_width_obs_mm"), F.round(F.col("o_totalprice") / 100, 1).alias("corolla_area_obs_mm2"), F.concat(F.lit("manual_axis|"), F.when(F.col("o_orderkey") % 3 == 0, "roi_open_outline").otherwise("roi_area_reconstructed")).alias("qc_flag"),
    )


_HAND_SQL = """h AS (SELECT o_orderpriority AS sheet, o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'opened_full' ELSE 'folded_half' END AS fold_state, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS f, round(o_totalprice / 1000, 2) AS len, round(o_totalprice / 2000, 2) AS wid, round(o_totalprice / 100, 1) AS area, CASE WHEN o_orderkey % 3 = 0 THEN 'manual_axis|roi_open_outline' ELSE 'manual_axis|roi_area_reconstructed' END AS flag FROM orders),
l AS (SELECT l_orderkey AS k, max(l_quantity) AS len, min(l_quantity) AS wid, sum(l_quantity) AS area FROM lineitem WHERE {where} GROUP BY 1), g AS (SELECT l_orderkey AS k, sum(l_discount) AS cov, max(CASE WHEN l_linestatus = 'F' THEN l_tax * 100 END) AS organ FROM lineitem GROUP BY 1)
SELECT sheet, h.k::VARCHAR AS corolla_id, fold_state, coalesce(l.len, h.len) AS p_length, coalesce(l.wid, h.wid) AS width_obs, round(coalesce(l.wid, h.wid) * f, 2) AS width_fulleq, round(coalesce(l.area, h.area) * f, 1) AS area_fulleq, CASE WHEN l.k IS NULL THEN 'hand' ELSE 'iphone' END AS roi_source, round(g.cov, 6) AS guide, round(g.organ, 6) AS organ, CASE WHEN l.k IS NULL THEN flag ELSE 'manual_axis' END AS qc_flag FROM h LEFT JOIN l ON l.k = h.k LEFT JOIN g ON g.k = h.k"""


@query("merge_measurements", "WITH " + _HAND_SQL.format(where="l_returnflag = 'N'"))
def merge_measurements(spark, sf_dir):
    """Every order: lines not yet returned stand for its silhouette, and one without them keeps its hand measurements."""
    return _merged(spark, sf_dir, "l_returnflag = 'N'")


@query("merge_measurements_whole", "WITH " + _HAND_SQL.format(where="true"))
def merge_measurements_whole(spark, sf_dir):
    """Every order, with a silhouette wherever it has a line."""
    return _merged(spark, sf_dir)


def _merged(spark, sf_dir, photographed="true"):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("sheet"))
    key = [F.col("sheet"), F.col("l_orderkey").cast("string").alias("corolla_id")]
    # one pass over the lines makes all three tables of measurements
    seen = F.expr(photographed)
    of = lambda f, c: f(F.when(seen, F.col(c)))
    m = li.groupBy("l_orderkey").agg(of(F.max, "l_quantity").alias("corolla_length_mm"), of(F.min, "l_quantity").alias("corolla_width_obs_mm"), of(F.sum, "l_quantity").alias("corolla_area_obs_mm2"), F.count_if(seen).cast("double").alias("match_iou"), F.sum("l_discount").alias("guide_coverage_pct"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 100)).alias("organ_length_mm"))
    m = m.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(*key, *m.columns[1:], F.lit(1).alias("has_nectar_guide"))
    d = rel.merge_measurements(_hand(spark, sf_dir), m.where("match_iou > 0"), m, m)
    return d.select("sheet", "corolla_id", "fold_state", F.col("corolla_length_mm").alias("p_length"), F.col("corolla_width_obs_mm").alias("width_obs"), F.col("corolla_width_fulleq_mm").alias("width_fulleq"), F.col("corolla_area_fulleq_mm2").alias("area_fulleq"), "roi_source", F.round("guide_coverage_pct", 6).alias("guide"), F.round("organ_length_mm", 6).alias("organ"), "qc_flag")


@query("enforced_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def enforced_join(spark, sf_dir):
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return rel.enforced_join(table(spark, sf_dir, "nation"), r, ["n_regionkey"]).select("n_name", "r_name")


@query("fallback_join", "SELECT p_partkey, coalesce(a.s_name, b.s_name) AS supplier FROM part LEFT JOIN supplier a ON a.s_suppkey = p_partkey LEFT JOIN supplier b ON b.s_suppkey = p_size")
def fallback_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier"))
    return rel.left_with_fallback(p, s, F.col("p_partkey"), F.col("p_size"), "s_suppkey", ["supplier"]).select("p_partkey", "supplier")


@query("unique_lookup", "SELECT r_name, r_regionkey FROM region")
def unique_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return rel.unique_lookup(r.select("r_name"), r.select(F.upper("r_name").alias("r_name"), "r_regionkey"), "r_name", "r_regionkey")


@query("mapped_labels", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS label, CASE WHEN c_name LIKE 'Cust%' THEN 'customer' ELSE 'none' END AS prefix FROM customer")
def mapped_labels(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    return d.select("c_custkey", rel.mapped(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}, F.lit("other")).alias("label"), rel.by_prefix(F.col("c_name"), {"Cust": "customer", "": "none"}).alias("prefix"))


@query("numbered_in_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT), c_custkey) AS global_id FROM customer")
def numbered_in_order(spark, sf_dir):
    """Specimen numbers by nation, then by the integers in the name."""
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    return rel.running_number(d, F.col("c_nationkey"), sc.natural_key(F.col("c_name")), F.col("c_custkey")).select("c_custkey", F.col("global_id").cast("long").alias("global_id"))


@query("reading_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice / 20000), l_quantity, l_linenumber) AS place FROM lineitem")
def reading_order(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.floor(F.col("l_extendedprice") / 20000), "l_quantity", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("hash_sample", "WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('0:' || l_orderkey || '-' || l_linenumber), l_orderkey || '-' || l_linenumber) AS k FROM lineitem) SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE k <= 50")
def hash_sample(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return rel.hash_sample(d, ["l_returnflag"], F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 50)


@query("flag_lists", "SELECT p_partkey, list_aggregate(list_filter(string_split(p_type, ' '), lambda x: x <> '' AND x <> 'BRUSHED') || (CASE WHEN p_size > 25 THEN ['large'] ELSE [] END), 'string_agg', '|') AS flags FROM part")
def flag_lists(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_type"), F.lit(" "), F.lit("|")).alias("t"), "p_size")
    out = sc.edit_flags(F.col("t"), ["BRUSHED"], F.when(F.col("p_size") > 25, F.lit("large")))
    return d.select("p_partkey", F.when(out != "", out).alias("flags"))


@query("sorted_distinct_list", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1")
def sorted_distinct_list(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("segments"), F.count_distinct("c_mktsegment").alias("n"))


@query("guarded_ratios", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity - 10, 0) * pi(), 6) AS ratio, round(asin(sqrt(least(greatest(l_discount * 1000 / 100, 0), 1))), 6) AS angle, round(ln(greatest(l_tax, 2.2250738585072014e-308)), 6) AS log_tax, round(sqrt(l_quantity * l_extendedprice), 4) AS size FROM lineitem")
def guarded_ratios(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.ratio(p, q - 10) * F.pi(), 6).alias("ratio"), F.round(sc.arcsine_share(F.col("l_discount") * 1000), 6).alias("angle"), F.round(sc.floored_log(F.col("l_tax")), 6).alias("log_tax"), F.round(sc.body_size(q, p), 4).alias("size"))


@query("lenient_numbers", "SELECT p_partkey, try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS number, try_cast(p_type AS DOUBLE) AS none FROM part")
def lenient_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sc.lenient_double(F.regexp_extract("p_brand", r"(\d+)", 1)).alias("number"), sc.lenient_double(F.col("p_type")).alias("none"))


@query("angles", "SELECT s_suppkey, round(((s_acctbal % 180 + 180) % 180), 6) AS half, round(degrees(atan2(s_acctbal, s_suppkey)), 6) AS hue, round(sqrt(s_acctbal * s_acctbal + s_suppkey * s_suppkey), 4) AS chroma FROM supplier")
def angles(spark, sf_dir):
    a, k = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(sc.half_turn(a), 6).alias("half"), F.round(sc.hue(k, a), 6).alias("hue"), F.round(sc.chroma(k, a), 4).alias("chroma"))


@query("extreme_columns", f"WITH {PLANTS} SELECT plant, CASE WHEN price >= balance AND price >= flowers THEN 'price' WHEN balance >= flowers THEN 'balance' ELSE 'flowers' END AS most, CASE WHEN price <= balance AND price <= flowers THEN 'price' WHEN balance <= flowers THEN 'balance' ELSE 'flowers' END AS least FROM plants")
def extreme_columns(spark, sf_dir):
    c = ["price", "balance", "flowers"]
    return plants(spark, sf_dir).select("plant", rel.argmax_column(c).alias("most"), rel.argmax_column(c, False).alias("least"))


@query("pivot_means", "SELECT l_shipmode_year AS year, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS a, round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS r FROM (SELECT *, year(l_shipdate) AS l_shipmode_year FROM lineitem) GROUP BY 1")
def pivot_means(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), "l_returnflag", "l_quantity")
    p = d.groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return p.select("year", *(F.round(c, 6).alias(c.lower()) for c in "ANR"))


@query("exact_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 5) AS lo, round(median(l_extendedprice), 5) AS mid, round(quantile_cont(l_extendedprice, 0.975), 5) AS hi, round(avg((l_quantity > 25)::INTEGER), 7) AS share FROM lineitem GROUP BY 1")
def exact_quantiles(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    q = ranks.exact_quantiles(d, ["l_returnflag"], "l_extendedprice", [0.025, 0.5, 0.975])
    share = d.groupBy("l_returnflag").agg(F.round(F.avg((F.col("l_quantity") > 25).cast("double")), 7).alias("share"))
    return q.join(share, "l_returnflag").select("l_returnflag", *(F.round(F.col("q")[i], 5).alias(c) for i, c in enumerate(("lo", "mid", "hi"))), "share")


@query("mean_of_matrices", "SELECT l_linenumber AS i, l_returnflag AS j, round(avg(nullif(l_discount, 0)), 8) AS mean FROM lineitem GROUP BY ALL")
def mean_of_matrices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.round(F.avg(F.nullif(F.col("l_discount"), F.lit(0.0))), 8).alias("mean"))


@query("first_by_key", "SELECT c_nationkey, arg_min(c_acctbal, c_custkey) AS first_balance, arg_max(c_name, c_acctbal) AS richest FROM customer GROUP BY 1")
def first_by_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_acctbal", "c_custkey").alias("first_balance"), F.max_by("c_name", "c_acctbal").alias("richest"))


_PIECES = """f0 AS (SELECT n_regionkey AS sheet, s_suppkey AS corolla_id, s_acctbal AS cx, (s_suppkey % 7) * 1000.0::DOUBLE AS cy, 1500.0::DOUBLE AS height FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s0 AS (SELECT n_regionkey AS sheet, c_custkey AS stroke_id, c_acctbal AS cx, (c_custkey % 11) * 700.0::DOUBLE AS cy, (c_custkey % 97)::DOUBLE AS length_mm FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_ASSIGNED = """r AS (SELECT sheet, median(height) * 0.7 AS reach FROM f0 GROUP BY 1),
d AS (SELECT s.sheet, stroke_id, length_mm, corolla_id, row_number() OVER (PARTITION BY s.sheet, stroke_id ORDER BY CASE WHEN f.cx <= s.cx AND abs(s.cy - f.cy) <= reach THEN 0 ELSE 1 END, sqrt((s.cx - f.cx) * (s.cx - f.cx) + (s.cy - f.cy) * (s.cy - f.cy)), corolla_id) AS k FROM s JOIN f ON s.sheet = f.sheet JOIN r ON r.sheet = s.sheet),
l AS (SELECT *, row_number() OVER (PARTITION BY sheet, corolla_id ORDER BY length_mm DESC, stroke_id) AS l FROM d WHERE k = 1)
SELECT sheet, corolla_id, stroke_id, length_mm FROM l WHERE l = 1"""


def _pieces(spark, sf_dir):
    """A region's suppliers as flowers and its customers as strokes."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("sheet"))
    f = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("sheet", F.col("s_suppkey").alias("corolla_id"), F.col("s_acctbal").alias("cx"), (F.col("s_suppkey") % 7 * 1000.0).alias("cy"), F.lit(1500.0).alias("height"))
    s = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("sheet", F.col("c_custkey").alias("stroke_id"), F.col("c_acctbal").alias("cx"), (F.col("c_custkey") % 11 * 700.0).alias("cy"), (F.col("c_custkey") % 97).cast("double").alias("length_mm"))
    return s, f


@query("organ_assignment", f"WITH {_PIECES}, f AS (SELECT * FROM f0), s AS (SELECT * FROM s0), {_ASSIGNED}")
def organ_assignment(spark, sf_dir):
    return matching.assign_organs(*_pieces(spark, sf_dir))


@query("pinned_strokes", f"WITH {_PIECES}, p AS (SELECT sheet, corolla_id, stroke_id FROM f0 JOIN s0 USING (sheet) WHERE corolla_id = stroke_id), f AS (SELECT * FROM f0 ANTI JOIN p USING (sheet, corolla_id)), s AS (SELECT * FROM s0 ANTI JOIN p USING (sheet, stroke_id)), {_ASSIGNED}")
def pinned_strokes(spark, sf_dir):
    """Strokes that share a flower's number are pinned to it; what they and their flowers leave is assigned."""
    s, f = _pieces(spark, sf_dir)
    pins = f.join(s, (f["sheet"] == s["sheet"]) & (f["corolla_id"] == s["stroke_id"])).select(f["sheet"], "corolla_id", "stroke_id")
    return matching.assign_organs(s, f, pins)


@query(
    "greedy_pairs",
    """WITH RECURSIVE p AS (SELECT s_nationkey AS sheet, s_suppkey AS a, c_custkey AS b, (CAST('0x' || substr(md5(s_suppkey || ':' || c_custkey), 1, 8) AS BIGINT) % 1000)::DOUBLE AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey),
g AS (SELECT sheet, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::STRUCT(score DOUBLE, a BIGINT, b BIGINT) AS m FROM (SELECT DISTINCT sheet FROM p)
  UNION ALL SELECT sheet, list_append(ua, m.a), list_append(ub, m.b), m FROM (SELECT g.sheet, any_value(g.ua) AS ua, any_value(g.ub) AS ub, max(struct_pack(score := p.score, a := p.a::BIGINT, b := p.b::BIGINT)) AS m FROM g JOIN p ON p.sheet = g.sheet AND NOT list_contains(g.ua, p.a) AND NOT list_contains(g.ub, p.b) GROUP BY g.sheet))
SELECT sheet, m.a AS a, m.b AS b, m.score AS score FROM g WHERE m IS NOT NULL""",
)
def greedy_pairs(spark, sf_dir):
    """Suppliers and customers of a nation in one-to-one pairs, by a made-up score."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sheet"), F.col("s_suppkey").alias("a"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), F.col("c_custkey").alias("b"))
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b")  # a small file, many pairs: every task has its share of a nation
    return matching.greedy_pairs(s.join(c, "sheet").withColumn("score", sc.hash_draw(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")), F.lit(1000)).cast("double")), "sheet", "a", "b", "score")


@query("evidence_filter", f"WITH {PLANTS}, s AS (SELECT site, count(*) AS n, avg(price) AS m FROM plants GROUP BY 1) SELECT site, n, round(m, 4) AS m FROM s WHERE n >= 50")
def evidence_filter(spark, sf_dir):
    return plants(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("m")).where("n >= 50")


@query("rank_of_sites", f"WITH {PLANTS}, s AS (SELECT site, avg(price) AS m FROM plants GROUP BY 1) SELECT site, rank() OVER (ORDER BY m DESC) AS place FROM s")
def rank_of_sites(spark, sf_dir):
    s = plants(spark, sf_dir).groupBy("site").agg(F.avg("price").alias("m"))
    return s.select("site", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("m"))).cast("long").alias("place"))


@query("cline_fit", f"WITH {PLANTS} SELECT island, round(regr_slope(price, lat) / 1000, 6) AS slope, round(regr_intercept(price, lat) / 1000, 5) AS intercept FROM plants GROUP BY island HAVING count(DISTINCT lat) > 1")
def cline_fit(spark, sf_dir):
    d = plants(spark, sf_dir).groupBy("island").agg(F.round(F.regr_slope("price", "lat") / 1000, 6).alias("slope"), F.round(F.regr_intercept("price", "lat") / 1000, 5).alias("intercept"), F.count_distinct("lat").alias("n"))
    return d.where("n > 1").drop("n")


@query("density_profile", "SELECT least(floor(l_discount * 25 / 0.11), 24)::INTEGER AS bin, round(count(*) * 25.0::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS density FROM lineitem GROUP BY 1")
def density_profile(spark, sf_dir):
    from corymb.operators.pixels import histogram

    return histogram(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 25 / 0.11 / 25).alias("v")), [], "v").withColumn("density", F.round("density", 6))


@query("pst_of_events", "WITH e AS (SELECT event_type, user_id % 10 AS g, value * (1 + user_id % 10) AS value FROM events),\n" + pst_sql("event_type", "g", "value", "e") + "\nSELECT event_type, k::BIGINT AS k, n::BIGINT AS n, round(pst, 6) AS pst FROM qp")
def pst_of_events(spark, sf_dir):
    """Groups of users that are made to differ."""
    d = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("g"), (F.col("value") * (1 + F.col("user_id") % 10)).alias("value"))
    return dv.pst(d, ["event_type"], "g", "value").select("event_type", "k", "n", F.round("pst", 6).alias("pst"))


@query("stream_user_means", "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_user_means(spark, sf_dir):
    """The batch result, by Structured Streaming over the same files."""
    return phases.drained(phases.user_means(phases.event_stream(spark, f"{sf_dir}/events.parquet")), "user_id", "event_type").withColumn("mean", F.round("mean", 6))


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    return phases.drained(phases.windowed(phases.event_stream(spark, f"{sf_dir}/events.parquet")), "start", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("centred_ranks", f"WITH {PLANTS}, c AS (SELECT plant, island, round(price - avg(price) OVER (PARTITION BY island), 6) AS d FROM plants) SELECT plant, rank() OVER (PARTITION BY island ORDER BY d) + (count(*) OVER (PARTITION BY island, d) - 1) / 2.0::DOUBLE AS r FROM c")
def centred_ranks(spark, sf_dir):
    d = plants(spark, sf_dir).select("plant", "island", F.round(ranks.centred("price", "island"), 6).alias("d"))
    return d.select("plant", ranks.average_rank("d", "island").alias("r"))
