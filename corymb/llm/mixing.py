"""Mixing sources to target weights by capped water-filling.

Sources get a weight each and share a budget of words; a source stops at ``max_epochs`` times its
size, and what it can't take is shared again among the others by weight until none is above its
cap.  A document is then taken a whole number of times, and a seeded order of the documents of each
source decides which of them are taken once more.  The last of those is taken in part, so that a
source's words come to its target, less than a word away.

All of it is aggregates and windows.  Sources reach their caps in order of size by weight, so which of
them are capped follows from running sums over the table of sources, which is small by nature: one row
each.  The seeded order is cut into buckets by the first digits of the hash, as many as the rows need,
and a document's place is the sum of earlier buckets plus a running sum inside its own, so no task sorts
a whole source, even one with all rows.  The order is that of the hash, however many buckets there are.

Nulls: a null source is a source of its own, ordered last; a null or empty text has size 0 and takes
nothing; a null id hashes as the word ``null``.  An empty table gives no rows.  Repeated rows count as
often as they occur.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corymb.llm.shared import free_name, hex_bits, materialise, need

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    r"""Number of runs of characters other than space and \t to \r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, *, share: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """Adds ``target`` to rows of (``size``, ``weight``, ``name``): ``share`` (a fraction) of the total size, dealt by weight.

    A source is capped if the level that remains without those of a lesser size by weight is above its cap.
    Amounts are whole numbers of ``1/share[1]`` words until the last division, so the comparison is exact.
    """
    up, down = share
    big = "decimal(38,0)"
    size, weight = F.col("size").cast(big), F.col("weight").cast(big)
    order = Window.orderBy(F.col("size").cast("double") / F.col("weight"), "name")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(big))
    rest = F.lit(up) * F.sum(size).over(Window.partitionBy()) - F.lit(down * max_epochs) * before
    open_weight = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = sources.withColumns({"rest": rest.cast(big), "open": open_weight.cast(big), "place": F.row_number().over(order)})
    free = (F.col("weight").cast("decimal(9,0)") * F.col("rest").cast("decimal(28,0)")) <= (F.lit(down * max_epochs).cast("decimal(9,0)") * F.col("size").cast("decimal(18,0)") * F.col("open").cast("decimal(9,0)"))
    # from the first source that isn't above its cap on, all share what is left by weight
    first = F.min(F.when(free, F.struct("place", "rest", "open"))).over(Window.partitionBy())
    level = F.col("weight").cast("double") * F.col("first.rest").cast("double") / (F.lit(float(down)) * F.col("first.open").cast("double"))
    capped = F.lit(float(max_epochs)) * F.col("size").cast("double")
    target = F.when(F.col("place") >= F.col("first.place"), level).otherwise(capped)
    return ranked.withColumn("first", first).withColumn("target", target).drop("rest", "open", "place", "first")


def mix(df: DataFrame, size: Column, *, source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: str = "mix-1", bucket_rows: int = 20_000) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``taken`` (words) and ``repeats`` (whole copies to emit)."""
    out = ["size", "source_size", "target", "taken", "repeats"]
    kept = [c for c in df.columns if c not in out]
    key, bucket, order, base, whole, extra = (free_name(df, f"mx_{c}") for c in ("key", "bucket", "order", "base", "whole", "extra"))
    # the key keeps null apart from '' and sorts it last
    keyed = df.withColumn("size", size).withColumn(key, F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))))
    order_text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    buckets = min(1 << 20, 1 << max(8, (df.count() // bucket_rows).bit_length()))
    keyed = keyed.withColumns({order: F.md5(order_text.cast("binary")), bucket: F.shiftright(hex_bits(order_text, 5), 21 - buckets.bit_length()).cast("int")})
    sums = materialise(keyed.groupBy(key, bucket).agg(F.sum("size").alias("size")), "mix_buckets")
    totals = sums.groupBy(F.col(key).alias("name")).agg(F.sum("size").alias("size"))
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy("name")) - 1, F.lit(len(weights))) + 1).cast("int")))
    filled = water_fill(materialise(ranked, "mix_sources"), share=share, max_epochs=max_epochs)
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.select(key, bucket, F.coalesce(F.sum("size").over(before), F.lit(0)).alias(base)).join(filled.select(F.col("name").alias(key), F.col("size").alias("source_size"), "target"), key)
    running = Window.partitionBy(key, bucket).orderBy(order, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn(extra, F.coalesce(F.sum("size").over(running), F.lit(0))).join(plan, [key, bucket])
    placed = placed.withColumn(whole, F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    quota = F.round(F.col("target")).cast("long") - F.col(whole) * F.col("source_size") - F.col(base) - F.col(extra)
    placed = placed.withColumn(extra, F.greatest(F.lit(0), F.least(quota, F.col("size"))))
    return placed.select(
        *kept, "size", "source_size", "target", (F.col(whole) * F.col("size") + F.col(extra)).cast("long").alias("taken"), (F.col(whole) + F.when((F.col("size") > 0) & (F.col(extra) * 2 >= F.col("size")), 1).otherwise(0)).cast("int").alias("repeats")
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows; words are counted once and only counts are shuffled."""
    docs = need(docs, doc_id="long", text="string", source="string")
    narrow = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix_sizes")
    return mix(narrow, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS o FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS s, CASE (row_number() OVER (ORDER BY encode(k)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY k),
r AS (SELECT *, 3 * sum(s) OVER () - coalesce(sum(4 * s) OVER (ORDER BY 4 * s::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num, sum(w) OVER (ORDER BY 4 * s::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den, row_number() OVER (ORDER BY 4 * s::DOUBLE / w, k) AS j FROM s),
f AS (SELECT coalesce(min(j) FILTER (WHERE w * num <= 4 * s * den), 9223372036854775807) AS j FROM r),
l AS (SELECT r.num AS num, r.den AS den FROM r, f WHERE r.j = f.j),
t AS (SELECT k, s AS source_size, CASE WHEN r.j < f.j THEN 2.0::DOUBLE * s::DOUBLE ELSE w::DOUBLE * (SELECT num::DOUBLE FROM l) / (SELECT (2 * den)::DOUBLE FROM l) END AS target FROM r, f),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(round(target)::BIGINT - whole * source_size - before, size)) AS BIGINT) AS taken FROM p"""
