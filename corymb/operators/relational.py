"""Joins, filters and keyed lookups of the specimen tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corymb.functions.scalars import edit_flags
from corymb.sources.scratch import scratch


def merge_measurements(hand: DataFrame, photo: DataFrame, guide: DataFrame, organ: DataFrame, key: tuple[str, str] = ("sheet", "corolla_id")) -> DataFrame:
    """Flowers with their photo silhouette, guide and organ measurements, all by left joins on the key.

    Where a silhouette was matched it replaces length, width and area, and the two flags about a
    reconstructed outline no longer apply.  Width and area are doubled for folded flowers.
    """
    k = list(key)
    p = photo.select(*k, *(F.col(c).alias(f"p_{c}") for c in ("corolla_length_mm", "corolla_width_obs_mm", "corolla_area_obs_mm2", "match_iou")))
    g = guide.select(*k, "guide_coverage_pct", "has_nectar_guide")
    o = organ.select(*k, "organ_length_mm")
    d = hand.drop("guide_coverage_pct", "has_nectar_guide", "organ_length_mm").join(p, k, "left").join(g, k, "left").join(o, k, "left")
    matched = F.col("p_corolla_length_mm").isNotNull()
    factor = F.when(F.col("fold_state") == "opened_full", F.lit(1.0)).otherwise(F.lit(2.0))
    width = F.when(matched, F.col("p_corolla_width_obs_mm")).otherwise(F.col("corolla_width_obs_mm"))
    area = F.when(matched, F.col("p_corolla_area_obs_mm2")).otherwise(F.col("corolla_area_obs_mm2"))
    dropped = F.when(matched, edit_flags(F.col("qc_flag"), ["roi_open_outline", "roi_area_reconstructed"], F.lit(None).cast("string"))).otherwise(F.col("qc_flag"))
    return d.select(
        *k, "fold_state", F.coalesce("p_corolla_length_mm", "corolla_length_mm").alias("corolla_length_mm"), width.alias("corolla_width_obs_mm"), area.alias("corolla_area_obs_mm2"),
        F.round(width * factor, 2).alias("corolla_width_fulleq_mm"), F.round(area * factor, 1).alias("corolla_area_fulleq_mm2"), F.when(matched, "iphone").otherwise("hand").alias("roi_source"),
        F.col("p_match_iou").alias("match_iou"), "has_nectar_guide", "guide_coverage_pct", "organ_length_mm", dropped.alias("qc_flag"),
    )


def enforced_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails if a row of ``left`` has no partner."""
    marked = left.join(right.withColumn("_found", F.lit(True)), on, "left")
    check = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no match for key "), F.concat_ws(",", *(F.col(c).cast("string") for c in on))))).otherwise(F.lit(True))
    return marked.withColumn("_found", check.cast("boolean")).where("_found").drop("_found")


def integrate_metadata(metadata: DataFrame, index: DataFrame, flowers: DataFrame, pollination: DataFrame, flower_columns: list[str], pollination_columns: list[str]) -> DataFrame:
    """Field records with what was measured on their flower, one row a record.

    ``collar`` must be a ``global_id`` of the index; measurements may be missing.  ``organ_status_check`` says
    where a recorded status (s or p) and a measured organ contradict each other, and is empty elsewhere.
    """
    i = index.select(F.col("global_id").alias("collar"), "sheet", "sheet_corolla_id")
    key = [F.col("corolla_id").alias("sheet_corolla_id"), "sheet"]
    d = enforced_join(metadata, i, ["collar"])
    d = d.join(flowers.select(*key, *flower_columns), ["sheet", "sheet_corolla_id"], "left").join(pollination.select(*key, *pollination_columns), ["sheet", "sheet_corolla_id"], "left")
    stated, measured = F.coalesce(F.col("status").isin("s", "p"), F.lit(False)), F.col("organ_length_mm").isNotNull()
    check = F.when(stated & ~measured, "status_but_no_measurement").when(~stated & measured, "measured_but_status_na").otherwise("")
    return d.select(*metadata.columns, "sheet", "sheet_corolla_id", *flower_columns, *pollination_columns, check.alias("organ_status_check"))


def with_spatial(master: DataFrame, spatial: DataFrame) -> DataFrame:
    """The master table with where each flower's guide lies; null where that wasn't measured."""
    s = spatial.select("sheet", F.col("corolla_id").alias("sheet_corolla_id"), F.col("basal_frac_prox_third").alias("guide_basal_frac"), F.col("midline_ratio_distal").alias("guide_midline_ratio"))
    return master.join(s, ["sheet", "sheet_corolla_id"], "left").select(*master.columns, "guide_basal_frac", "guide_midline_ratio")


def side_roles(long_side: Column, short_side: Column, hand_length: Column, hand_width: Column) -> tuple[Column, Column]:
    """Length and width of a silhouette: its sides take the roles that they have in the hand mask."""
    as_is = F.coalesce(hand_length >= hand_width, F.lit(True))
    return F.when(as_is, long_side).otherwise(short_side), F.when(as_is, short_side).otherwise(long_side)


def significant(df: DataFrame, p: str = "p_adjusted", below: float = 0.05) -> DataFrame:
    """Rows whose (adjusted) p is below the threshold; a missing p never is."""
    return df.where(F.col(p) < below)


def left_with_fallback(left: DataFrame, right: DataFrame, first: Column, second: Column, right_key: str, values: list[str]) -> DataFrame:
    """Left join by one key, or by a second one where the first finds nothing."""
    a = right.select(F.col(right_key).alias("_k1"), *(F.col(v).alias(f"_a_{v}") for v in values), F.lit(1).alias("_hit"))
    b = right.select(F.col(right_key).alias("_k2"), *(F.col(v).alias(f"_b_{v}") for v in values))
    d = left.join(a, first == F.col("_k1"), "left").join(b, second == F.col("_k2"), "left")
    picked = [F.when(F.col("_hit") == 1, F.col(f"_a_{v}")).otherwise(F.col(f"_b_{v}")).alias(v) for v in values]
    return d.select(*left.columns, *picked)


def unique_lookup(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's one value, by lower-cased key; fails unless exactly one row matches."""
    t = table.select(F.lower(key).alias("_k"), F.col(value).alias("_v"))
    d = keys.join(t, F.lower(F.col(key)) == F.col("_k"), "left").groupBy(key).agg(F.count("_k").alias("n"), F.min("_v").alias(value))
    ok = F.when(F.col("n") == 1, F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not exactly one match for "), F.col(key))))
    return d.select(key, ok.alias(value))


def mapped(column: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """Labels for keys; a plain expression, so small tables need no join."""
    out = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column) if table else F.lit(None).cast("string")
    return F.coalesce(out, otherwise) if otherwise is not None else out


def by_prefix(column: Column, table: dict[str, str]) -> Column:
    """The label of the first prefix that fits; an error if none does."""
    cases = reduce(lambda c, kv: c.when(column.startswith(kv[0]), kv[1]), list(table.items())[1:], F.when(column.startswith(next(iter(table))), next(iter(table.values()))))
    return cases.otherwise(F.raise_error(F.concat(F.lit("no prefix fits "), column)))


def leave_one_out(df: DataFrame, group: str, name: str = "omitted") -> DataFrame:
    """Every row once for each *other* group: the input of leave-one-group-out runs.

    The list of groups is small by nature (one row each) and broadcast by Catalyst only if it is.
    """
    groups = df.select(F.col(group).alias(name)).distinct()
    return df.join(groups, F.col(group) != F.col(name))


def unordered_pairs(groups: DataFrame, key: str, order: str) -> DataFrame:
    """Pairs (a, b) of groups with a before b."""
    a = groups.select(F.col(key).alias(f"{key}_a"), F.col(order).alias("_oa"))
    b = groups.select(F.col(key).alias(f"{key}_b"), F.col(order).alias("_ob"))
    return a.join(b, F.col("_oa") < F.col("_ob")).drop("_oa", "_ob")


def common_support(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (lo, hi): the band of values that every group reaches."""
    per = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return per.agg(F.max("_lo").alias("lo"), F.min("_hi").alias("hi"))


def shortfalls(n: Column, targets: tuple[int, ...] = (3, 5, 8, 10), name: str = "additional_to") -> list[Column]:
    return [F.greatest(F.lit(t) - n, F.lit(0)).alias(f"{name}_{t}") for t in targets]


def top_by(df: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(order), *ties).limit(n)


def hash_sample(df: DataFrame, group: list[str], key: Column, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group, those whose seeded hash comes first: repeatable anywhere.

    Each of many parts of a group keeps its own first ``n`` before they meet, so a hot group isn't one task's work.
    """
    d = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))).withColumn("_part", F.pmod(F.xxhash64("_hash"), F.lit(64)))
    order = [F.col("_hash"), key]
    for part in (["_part"], []):
        d = d.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, *part).orderBy(*order))).where(F.col("_rank") <= n)
    return d.drop("_rank", "_part", "_hash")


def running_number(df: DataFrame, *order: Column, name: str = "global_id") -> DataFrame:
    """Numbers from 1 in a global order, without a global task.

    Rows are dealt to ranges of the order, sorted there and written with their place; a range's numbers
    begin after the rows of the ranges before it.
    """
    spark = df.sparkSession
    path = scratch(spark, "numbered")
    placed = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed.write.parquet(path)
    d = spark.read.schema(placed.schema).parquet(path).withColumn("_at", F.shiftright("_id", 33))
    sizes = d.groupBy("_at").agg(F.count("*").alias("_n"))  # a row a range
    starts = sizes.select("_at", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return d.join(starts, "_at").withColumn(name, (F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).cast("long")).select(*df.columns, name)


def argmax_column(columns: list[str], greatest: bool = True) -> Column:
    """Name of the column with the extreme value; the first one on ties."""
    best = (F.greatest if greatest else F.least)(*columns)
    out = F.when(F.col(columns[0]) == best, columns[0])
    for c in columns[1:]:
        out = out.when(F.col(c) == best, c)
    return out


#: Fixed text: what each trait of a flower is and how it is read off.
TRAIT_DEFINITIONS = (
    ("corolla_length_mm", "side of the oriented box nearer vertical"),
    ("corolla_width_fulleq_mm", "other side of the box, doubled for folded flowers"),
    ("corolla_area_fulleq_mm2", "pixels of the repaired region, doubled for folded flowers"),
    ("throat_width_mm", "median width from 4 to 16 % of the upright height"),
    ("mouth_width_mm", "median width from 72 to 88 % of the upright height"),
    ("lobe_incision_mm", "98th minus 15th percentile of the lower edge"),
    ("organ_length_mm", "skeleton length of the organ's stroke"),
    ("guide_coverage_pct", "guide pixels in 100 pixels of the region"),
)


def trait_definitions(spark) -> DataFrame:
    return spark.createDataFrame(TRAIT_DEFINITIONS, "trait string, definition string")


def manual_rows(sheets: DataFrame, manual: DataFrame, key: str = "sheet") -> DataFrame:
    """Hand-made rows of the sheets at hand; a small table, joined by key."""
    return manual.join(sheets.select(key).distinct(), key, "left_semi")
