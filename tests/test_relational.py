import math
import random

import pytest
from pyspark.sql import functions as F

from corymb.functions import scalars as sc
from corymb.operators import matching
from corymb.operators import relational as rel
from corymb.sources import tables


def test_csv_dialect(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("﻿date,island,no,lat,lon,id,collar,organ,status\r\n2026.7.4,north,1,34.7,nan,1,1,,s\r\n".encode())
    r = tables.read_csv(spark, f"file://{p}", "field_metadata").first()
    assert (r["date"], r["no"], r["lon"], r["organ"]) == ("2026.7.4", 1, None, None)
    assert tables.optional_csv(spark, f"file://{tmp_path}/none.csv", "guide_traits").count() == 0
    assert tables.first_existing(spark, f"file://{tmp_path}/none.csv", f"file://{p}").endswith("m.csv")
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, f"file://{tmp_path}/none.csv")


def test_write_and_read_back(spark, tmp_path):
    d = spark.createDataFrame([("s", "1", 4.5, 1), ("s", "2", None, 0)], "sheet string, corolla_id string, guide_coverage_pct double, has_nectar_guide int")
    tables.write_csv(d, f"file://{tmp_path}/out", bom=True)
    back = tables.read_csv(spark, f"file://{tmp_path}/out", "guide_traits")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))


def test_joins_that_must_match(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        rel.enforced_join(a, b, ["k"]).collect()
    t = spark.createDataFrame([("A", "1"), ("a", "2")], "name string, path string")
    with pytest.raises(Exception, match="exactly one"):
        rel.unique_lookup(spark.createDataFrame([("a",)], "name string"), t, "name", "path").collect()
    with pytest.raises(Exception, match="no prefix"):
        spark.createDataFrame([("zz",)], "s string").select(rel.by_prefix(F.col("s"), {"a": "x"})).collect()


def test_scalars(spark):
    d = spark.createDataFrame([("a10b2", "x||y|z", "nan", 120.0), (None, None, "7", -90.0)], "n string, f string, v string, deg double")
    r = d.select(sc.natural_key(F.col("n")).alias("k"), sc.edit_flags(F.col("f"), ["y"], F.lit("w")).alias("f"), sc.lenient_double(F.col("v")).alias("v"), sc.wrap_axis(F.col("deg")).alias("w")).collect()
    assert tuple(r[0]) == ([10, 2], "x|z|w", None, -60.0) and tuple(r[1]) == (None, "w", 7.0, 90.0)


def test_greedy_pairs_take_the_best_first(spark):
    d = spark.createDataFrame([("s", 1, 1, 0.9), ("s", 1, 2, 0.95), ("s", 2, 2, 0.9), ("s", 2, 1, 0.1)], "sheet string, a int, b int, iou double")
    assert sorted((r["a"], r["b"]) for r in matching.greedy_pairs(d, "sheet", "a", "b", "iou").collect()) == [(1, 2), (2, 1)]


def test_organs_go_left_and_pins_come_first(spark):
    f = spark.createDataFrame([("s", "1", 10.0, 10.0, 20.0), ("s", "2", 50.0, 10.0, 20.0)], "sheet string, corolla_id string, cx double, cy double, height double")
    o = spark.createDataFrame([("s", 1, 40.0, 12.0, 5.0), ("s", 2, 70.0, 9.0, 6.0), ("s", 3, 71.0, 9.0, 8.0)], "sheet string, stroke_id int, cx double, cy double, length_mm double")
    assert sorted((r["corolla_id"], r["stroke_id"]) for r in matching.assign_organs(o, f).collect()) == [("1", 1), ("2", 3)]
    pins = spark.createDataFrame([("s", "2", 1)], "sheet string, corolla_id string, stroke_id int")
    assert sorted((r["corolla_id"], r["stroke_id"]) for r in matching.assign_organs(o, f, pins).collect()) == [("1", 3)]


def test_every_order_is_merged(spark, tmp_path):
    import duckdb

    from corymb import catalog

    orders = [(1, "O", 98765.0, "a"), (2, "F", 2000.0, "a"), (3, "F", 5000.0, "b"), (4, "O", 7000.0, "b"), (6, "P", 1000.0, "c")]
    lines = [(1, 3.0, 0.1, 0.02, "F", "N"), (1, 7.0, 0.2, 0.04, "F", "R"), (2, 5.0, 0.0, 0.01, "O", "A"), (6, 1.5, 0.05, 0.0, "O", "N")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.queries()["merge_measurements_whole"](spark, str(tmp_path))
    rows = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    assert [(r[1], r[7]) for r in rows] == [("1", "iphone"), ("2", "iphone"), ("3", "hand"), ("4", "hand"), ("6", "iphone")]
    assert rows[2] == ("b", "3", "folded_half", 5.0, 2.5, 5.0, 100.0, "hand", None, None, "manual_axis|roi_open_outline")
    assert rows[0] == ("a", "1", "opened_full", 7.0, 3.0, 3.0, 10.0, "iphone", 0.3, 4.0, "manual_axis")
    part = sorted(map(tuple, catalog.queries()["merge_measurements"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert [r[7] for r in part] == ["iphone", "hand", "hand", "hand", "iphone"] and part[1][8:10] == (0.0, None) and part[0][3] == 3.0
    with duckdb.connect() as db:
        for name in ("orders", "lineitem"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        for query, want in (("merge_measurements_whole", rows), ("merge_measurements", part)):
            twin = db.sql(catalog.oracle_sql()[query])
            assert twin.columns == out.columns and sorted(twin.fetchall(), key=lambda r: r[1]) == want


def test_lookup_counts_rows_not_values(spark):
    t = spark.createDataFrame([("A", "1"), ("a", None)], "name string, path string")
    with pytest.raises(Exception, match="exactly one"):
        rel.unique_lookup(spark.createDataFrame([("a",)], "name string"), t, "name", "path").collect()


def test_metadata_is_integrated(spark):
    metadata = spark.createDataFrame([(1, "s", 7), (2, "na", 8), (3, "p", 9)], "id int, status string, collar int")
    index = spark.createDataFrame([(7, "a", "1"), (8, "a", "2"), (9, "b", "1")], "global_id int, sheet string, sheet_corolla_id string")
    flowers = spark.createDataFrame([("a", "1", 4.0), ("a", "2", 5.0)], "sheet string, corolla_id string, organ_length_mm double")
    pollination = spark.createDataFrame([("b", "1", 2.0)], "sheet string, corolla_id string, throat double")
    out = sorted(map(tuple, rel.integrate_metadata(metadata, index, flowers, pollination, ["organ_length_mm"], ["throat"]).collect()))
    assert out == [(1, "s", 7, "a", "1", 4.0, None, ""), (2, "na", 8, "a", "2", 5.0, None, "measured_but_status_na"), (3, "p", 9, "b", "1", None, 2.0, "status_but_no_measurement")]
    with pytest.raises(Exception, match="no match"):
        rel.integrate_metadata(metadata, index.where("global_id < 9"), flowers, pollination, ["organ_length_mm"], ["throat"]).collect()


def test_formats(spark):
    d = spark.createDataFrame([(0.125, 956.5), (0.375, 0.000123456), (None, None), (2.0, 0.0), (-0.125, -1e300)], "a double, p double")
    assert [tuple(r) for r in tables.formatted(d, {"a": 2}, ("p",)).collect()] == [(0.12, "9.56e+02"), (0.38, "1.23e-04"), (None, None), (2.0, "0.00e+00"), (-0.12, "-1.00e+300")]


def test_catalogue_is_complete():
    from corymb import catalog

    q, s = catalog.queries(), catalog.oracle_sql()
    assert len(q) > 80 and set(s) <= set(q) and len(s) > 50


def plain_nearest(points, targets, reach=None):
    out = {}
    for k, x, y in points:
        ok = [(math.hypot(x - u, y - v), t) for t, u, v in targets if reach is None or (u <= x and abs(y - v) <= reach)]
        if ok:
            out[k] = min(ok)
    return out


@pytest.mark.parametrize("reach", [None, 0.0, 35.0])
def test_nearest_equals_comparing_all(spark, reach):
    rng = random.Random(6)
    spread = lambda n: [(i, rng.choice([rng.uniform(0, 900), rng.gauss(300, 5)]), rng.choice([rng.uniform(-50, 400), 120.0])) for i in range(n)]
    points, targets = spread(250) + [(900, -500.0, 2000.0), (901, 5000.0, 120.0)], spread(90) + [(500, 300.0, 120.0), (501, 300.0, 120.0)]
    p = spark.createDataFrame([("s", *r, reach if reach is not None else 0.0) for r in points], "sheet string, p int, x double, y double, reach double")
    t = spark.createDataFrame([("s", *r) for r in targets] + [("other", 1, 0.0, 0.0)], "sheet string, t int, x double, y double")
    got = {r["p"]: (r["distance"], r["t"]) for r in matching.nearest(p, t, "sheet", "p", "t", reach=reach is not None).collect()}
    want = plain_nearest(points, targets, reach)
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_nearest_looks_at_few_pairs(spark):
    rng = random.Random(3)
    each = []
    for n in (500, 1000, 2000):
        make = lambda m: [("s", i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(m)]
        p, t = spark.createDataFrame(make(n), "sheet string, p int, x double, y double"), spark.createDataFrame(make(n), "sheet string, t int, x double, y double")
        each.append(matching.nearest(p, t, "sheet", "p", "t").agg(F.avg("examined")).first()[0])
    assert max(each) < 40 and each[-1] < 1.2 * each[0]


def test_nearest_of_one_place_and_of_nothing(spark):
    p = spark.createDataFrame([("s", 1, 5.0, 5.0), ("s", 2, None, 1.0), ("u", 3, 0.0, 0.0)], "sheet string, p int, x double, y double")
    t = spark.createDataFrame([("s", 7, 1.0, 1.0), ("s", 6, 1.0, 1.0)], "sheet string, t int, x double, y double")
    assert [(r["p"], r["t"]) for r in matching.nearest(p, t, "sheet", "p", "t").collect()] == [(1, 6)]
    assert matching.nearest(p, t.where("false"), "sheet", "p", "t").collect() == []


def test_pairs_by_rounds_equal_the_sequential_choice(spark):
    rng = random.Random(5)
    rows = [(s, a, b, rng.choice([rng.random(), 0.5])) for s in "xy" for a in range(25) for b in range(30) if rng.random() < 0.7]
    want = []
    used = set()
    for s, a, b, v in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if not {(s, 0, a), (s, 1, b)} & used:
            used |= {(s, 0, a), (s, 1, b)}
            want.append((s, a, b, v))
    got = matching.greedy_pairs(spark.createDataFrame(rows + rows[:9], "sheet string, a int, b int, iou double"), "sheet", "a", "b", "iou")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert matching.greedy_pairs(spark.createDataFrame([], "sheet string, a int, b int, iou double"), "sheet", "a", "b", "iou").collect() == []


def test_greedy_pairs_of_many_settle_the_best_first(spark):
    """Bands of scores give the sequential choice, and pairs whose ends are taken aren't written down."""
    rows = [("s" if i % 3 else "t", i % 23, i % 37, float(i * 7919 % 50)) for i in range(3000)] + [("u", 1, 1, 0.5), ("u", 1, 2, 0.5), ("v", None, 1, 1.0)]
    d = spark.createDataFrame(rows, "sheet string, a int, b int, iou double")
    want, used = set(), set()
    for r in sorted({r for r in rows if r[1] is not None}, key=lambda r: (-r[3], -r[1], -r[2])):
        if not {(r[0], "a", r[1]), (r[0], "b", r[2])} & used:
            want.add(r)
            used |= {(r[0], "a", r[1]), (r[0], "b", r[2])}
    got = matching.greedy_pairs(d, "sheet", "a", "b", "iou", many=100)
    assert sorted(map(tuple, got.collect())) == sorted(want)
