"""Sharding along a Hilbert curve over quantised metadata.

Several metadata dimensions are quantised to ``bits`` bits each, each row gets the index of its
grid cell on the Hilbert curve, the rows are ordered by that index, and the order is cut into
``n_shards`` runs whose row counts differ by at most one.  Rows that are close in *every* dimension
stay close on the curve, so a filter on any dimension touches few runs.

The rank of a row is found without a global sort: it is the number of rows in earlier cells, plus
the rows in earlier sub-buckets of the cell, plus the row number within (cell, sub-bucket).  Sub-buckets
are leading bits of a hash of the id, as many as the rows need, and split a hot cell, even one with all
rows.  Only the table of cells (at most ``2 ** (bits * dims)`` rows, whatever the input) meets in one
task, and the offsets of sub-buckets are broadcast only if they are few.

Nulls: a null dimension is quantised to 0; a null id hashes as the word ``null``; a null text has
size 8 and the CRC of the empty text.  An empty table gives no rows.  Repeated rows get slots of
their own.  Columns of the input are kept unless they are named ``shard`` or ``slot``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corymb.llm.shared import fits, free_name, hex_bits, materialise, need


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with ``bits`` bits in each coordinate (Skilling 2004).

    The steps run as one SQL ``aggregate`` over a literal list, so that the expression stays small.
    """
    n = len(dims)
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))
    point = F.array(*(d.cast("int") for d in dims))

    def step(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        low, head, own = q - F.lit(1), F.element_at(x, 1), F.element_at(x, s["i"] + F.lit(1))
        swap = head.bitwiseXOR(own).bitwiseAND(low)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        exchanged = F.transform(x, lambda v, j: F.when((j == 0) & (i == 0), v).when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(q) != 0, inverted).otherwise(exchanged)

    def grey(x: Column) -> Column:
        """Prefix XOR of the coordinates, then the correction by the last of them."""
        empty = F.array().cast("array<int>")
        mixed = F.aggregate(x, empty, lambda out, v: F.concat(out, F.array(F.when(F.size(out) == 0, v).otherwise(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)).bitwiseXOR(v)))))
        last = F.element_at(mixed, n)
        turn = reduce(lambda t, b: t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0)), range(1, bits), F.lit(0))
        return F.transform(mixed, lambda v: v.bitwiseXOR(turn))

    places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i + 1).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    done = F.aggregate(steps, point, step)
    coded = F.transform(F.array(done), grey)  # evaluates the walk once
    return F.aggregate(places, F.lit(0).cast("long"), lambda out, p: F.shiftleft(out, 1).bitwiseOR(F.call_function("shiftright", F.element_at(F.element_at(coded, 1), p["i"]), p["b"]).bitwiseAND(1).cast("long")))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def document_dims(df: DataFrame, bits: int = 3) -> list[Column]:
    """Quantised id range, source, language and size class of a documents table."""
    cells = 1 << bits
    low, high = df.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, span = (low or 0), max(1, (high or 0) - (low or 0) + 1)
    age = F.floor((F.col("doc_id") - F.lit(low)).cast("double") / F.lit(float(span)) * F.lit(float(cells)))
    return [
        F.coalesce(F.greatest(F.least(age.cast("int"), F.lit(cells - 1)), F.lit(0)), F.lit(0)),
        F.coalesce(hex_bits(F.col("source"), 2) % cells, F.lit(0)).cast("int"),
        F.coalesce(hex_bits(F.col("lang"), 2) % cells, F.lit(0)).cast("int"),
        F.greatest(F.least(F.floor((F.length(F.bin(text_size(F.col("text")))) - 5) * cells / 16).cast("int"), F.lit(cells - 1)), F.lit(0)),
    ]


def hilbert_shards(df: DataFrame, dims: list[Column], *, n_shards: int = 24, bits: int = 3, id_col: str = "doc_id", tie_cols: tuple[str, ...] = (), bucket_rows: int = 20_000, broadcast_rows: int = 100_000) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards - 1``) and ``slot`` (gapless from 0 in each shard).

    Rows of a cell are ordered by a hash of the id and the first of ``tie_cols``, then by these columns.
    """
    df = df.drop("shard", "slot")
    cell, sub, at, curve, order = (free_name(df, f"hx_{c}") for c in ("cell", "sub", "at", "curve", "order"))
    packed = reduce(lambda out, d: out * (1 << bits) + d.cast("long"), dims, F.lit(0).cast("long"))
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), *(F.col(c).cast("string") for c in tie_cols[:1]))
    bits_used = min(20, max(8, (df.count() // bucket_rows).bit_length()))  # so many that a cell with all rows is dealt over enough tasks
    placed = df.withColumns({cell: packed, order: F.md5(name.cast("binary")), sub: F.shiftright(hex_bits(name, 5), 20 - bits_used).cast("int")})
    counts = materialise(placed.groupBy(cell, sub).agg(F.count("*").alias("n")), "hilbert_cells")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # the curve is walked once for each cell, not for each row
    points = [F.shiftright(F.col(cell), bits * (len(dims) - 1 - i)).bitwiseAND((1 << bits) - 1) for i in range(len(dims))]
    curved = materialise(counts.groupBy(cell).agg(F.sum("n").alias("n")).withColumn(curve, hilbert_index(points, bits)), "hilbert_curve")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    cells = curved.select(F.col(cell), F.coalesce(F.sum("n").over(before.orderBy(curve)), F.lit(0)).alias("base"))
    small = lambda d: F.broadcast(d) if fits(d, broadcast_rows) else d
    offsets = counts.join(small(cells), cell).select(cell, sub, (F.col("base") + F.coalesce(F.sum("n").over(before.partitionBy(cell).orderBy(sub)), F.lit(0))).alias(at))
    ranked = placed.withColumn("slot", F.row_number().over(Window.partitionBy(cell, sub).orderBy(order, id_col, *tie_cols)) - 1)
    ranked = ranked.join(small(offsets), [cell, sub])
    rank, each, more = F.col(at) + F.col("slot"), total // n_shards, total % n_shards
    ranked = ranked.withColumn(at, rank).withColumn("shard", F.floor(F.when(F.col(at) < more * (each + 1), F.col(at) / F.lit(each + 1)).otherwise(more + (F.col(at) - more * (each + 1)) / F.lit(max(1, each)))).cast("int"))
    start = F.col("shard").cast("long") * each + F.least(F.col("shard"), F.lit(more)).cast("long")
    return ranked.withColumn("slot", F.col(at) - start).select(*df.columns, "shard", "slot")


def shard_digest(docs: DataFrame, n_shards: int = 24, bits: int = 3) -> DataFrame:
    """The contract's rows for a documents table; the text itself is never shuffled."""
    docs = need(docs, doc_id="long", text="string", lang="string", source="string")
    names = ["d0", "d1", "d2", "d3"]
    narrow = docs.select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), *(d.alias(c) for d, c in zip(document_dims(docs, bits), names, strict=True))
    )
    out = hilbert_shards(materialise(narrow, "hilbert_rows"), [F.col(c) for c in names], n_shards=n_shards, bits=bits, tie_cols=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_sql(n_shards: int = 24, bits: int = 3) -> str:
    """DuckDB SQL for :func:`shard_digest`; DuckDB has no CRC function, so a list fold computes it."""
    cells, n = 1 << bits, 4
    steps, last = [], "q0"
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            q, low = 1 << b, (1 << b) - 1
            name = f"s{len(steps)}"
            swap = f"(xor(x0, x{i}) & {low})"
            own = {j: f"CASE WHEN x{i} & {q} <> 0 THEN {f'xor(x0, {low})' if j == 0 else f'x{j}'} ELSE {f'xor(x{j}, {swap})' if i and j in (0, i) else f'x{j}'} END AS x{j}" for j in range(n)}
            steps.append(f"{name} AS (SELECT * EXCLUDE (x0, x1, x2, x3), {', '.join(own.values())} FROM {last})")
            last = name
    steps.append(f"g0 AS (SELECT * EXCLUDE (x0, x1, x2, x3), x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2, xor(xor(xor(x0, x1), x2), x3) AS x3 FROM {last})")
    turn = "0"
    for b in range(1, bits):
        turn = f"xor({turn}, CASE WHEN x3 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append(f"g1 AS (SELECT *, {turn} AS turn FROM g0)")
    index = "0"
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = f"({index} * 2 + ((xor(x{i}, turn) >> {b}) & 1))"
    md5 = "CAST(('0x' || substr(md5({0}), 1, 2)) AS BIGINT)"
    return f"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(i))),
lim AS (SELECT min(doc_id) AS lo, greatest(1, max(doc_id) - min(doc_id) + 1) AS span FROM documents),
p AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, coalesce(text, '') AS body, source, lang, lo, span FROM documents, lim),
q0 AS (SELECT doc_id, size, body,
  CAST(coalesce(greatest(least(floor(CAST(doc_id - lo AS DOUBLE) / CAST(span AS DOUBLE) * {cells}.0::DOUBLE), {cells - 1}), 0), 0) AS BIGINT) AS x0,
  coalesce({md5.format('source')} % {cells}, 0) AS x1, coalesce({md5.format('lang')} % {cells}, 0) AS x2,
  CAST(greatest(least(floor((length(bin(size)) - 5) * {cells} / 16.0::DOUBLE), {cells - 1}), 0) AS BIGINT) AS x3 FROM p),
{', '.join(steps)},
r AS (SELECT doc_id, size, body, row_number() OVER (ORDER BY {index}, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size), doc_id NULLS FIRST, size) - 1 AS rk, count(*) OVER () // {n_shards} AS each, count(*) OVER () % {n_shards} AS more FROM g1),
t AS (SELECT *, CASE WHEN rk < more * (each + 1) THEN rk // (each + 1) ELSE more + (rk - more * (each + 1)) // greatest(each, 1) END AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CASE WHEN body = '' THEN 0 ELSE xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda p: CAST('0x' || p AS BIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(rk - shard * each - least(shard, more) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM t, tab"""
