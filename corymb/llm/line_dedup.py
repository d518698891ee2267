"""Line removal by site-relative frequency.

For each host, the share of its pages that hold a line is the number of pages with the line by the
number of pages of the host.  A line is boilerplate of its host if more than ``max_ratio`` of the
host's pages and at least ``min_pages`` pages hold it; every occurrence on that host goes.

Pages are counted over (host, line hash) with a partial sum on each task, so neither a host with a
third of all pages nor a line on every page meets in one task.  Boilerplate is few by nature: a host
has at most ``lines a page / max_ratio`` such lines.  It goes back to the pages as shelves of a few lines each, an array a host:
broadcast while it is small (its rows are counted first), else joined with the host salted.

A line is what ``\\n`` separates, without the spaces (x20) at its ends; lines of spaces alone are kept
and counted on no side.  Nulls: a null host is a host of its own; a null text has no lines and stays null.  An empty
table gives no rows.  Repeated rows are pages of their own.  Columns named ``n_lines`` or ``n_dropped``
are replaced; others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corymb.llm.shared import fits, free_name, materialise, need


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.md5(F.trim(line).cast("binary"))


#: Lines of a host that are looked through for one line.
NEAR = 4


def _shelves(found: DataFrame, keys: list[str], line: str, out: str) -> DataFrame:
    """(``keys``, ``out``): each host's lines on shelves, an array of lists; a line's own shelf is told by its hash.

    A host has a shelf for each ``NEAR`` lines, so a look takes as long whatever the number of lines.
    """
    shelf, shelves = (free_name(found, f"ld_{c}") for c in ("shelf", "shelves"))
    sizes = found.groupBy(*keys).agg(F.ceil(F.count("*") / NEAR).cast("int").alias(shelves))
    held = found.join(sizes, keys).groupBy(*keys, F.pmod(F.xxhash64(line), F.col(shelves)).cast("int").alias(shelf)).agg(F.collect_list(line).alias(out))
    every = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.col(shelves) - 1)).alias(shelf))
    filled = every.join(held, [*keys, shelf], "left").select(*keys, F.struct(F.col(shelf), F.coalesce(F.col(out), F.array().cast("array<string>")).alias(out)).alias(out))
    return filled.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(out)), lambda s: s[out]).alias(out))


def boilerplate(df: DataFrame, *, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """Rows (host, line): the hashes of each host's boilerplate lines."""
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")).alias("host")
    pages = df.groupBy(host).agg(F.count("*").alias("pages"))
    lines = df.select(host, F.explode(F.array_distinct(F.transform(F.filter(F.split(F.col(text_col), "\n"), lambda x: F.trim(x) != ""), _key))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return often.join(pages, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages")).select("host", "line")


def drop_boilerplate(df: DataFrame, *, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.05, min_pages: int = 3, broadcast_rows: int = 10_000, salts: int = 64) -> DataFrame:
    """``df`` with boilerplate lines cut from its text, and the numbers ``n_lines`` and ``n_dropped``."""
    host, salt, bad = (free_name(df, f"ld_{c}") for c in ("host", "salt", "bad"))
    found = materialise(boilerplate(df, text_col=text_col, host_col=host_col, max_ratio=max_ratio, min_pages=min_pages), "boilerplate").withColumnsRenamed({"host": host, "line": bad})
    keyed = df.drop("n_lines", "n_dropped").withColumn(host, F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")))
    small, found = fits(found, broadcast_rows), _shelves(found, [host], bad, bad)
    if small:
        joined = keyed.join(F.broadcast(found), host, "left")
    else:
        spread = materialise(found, "shelves").withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(salts)).cast("int")).join(spread, [host, salt], "left")
    lines = F.split(F.col(text_col), "\n")
    good = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.get(F.col(bad), F.pmod(F.xxhash64(_key(x)), F.size(bad)).cast("int")), _key(x)), F.lit(False)))
    none = F.col(bad).isNull()
    kept = F.when(none, F.col(text_col)).otherwise(F.array_join(good, "\n"))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    n_left = F.coalesce(F.size(F.filter(F.split(kept, "\n"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    return joined.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines), "n_dropped": F.when(F.col(text_col).isNull() | none, 0).otherwise(n_lines - n_left)}).withColumn(text_col, kept).drop(host, salt, bad)


def line_digest(docs: DataFrame) -> DataFrame:
    out = drop_boilerplate(need(docs, doc_id="long", text="string", source="string"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.length(kept).cast("long").alias("n_chars_kept"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


LINE_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, text, coalesce('=' || source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT id, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d WHERE text IS NOT NULL),
p AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
b AS (SELECT host, key FROM (SELECT host, trim(line) AS key, count(DISTINCT id) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL) JOIN p USING (host) WHERE n >= 3 AND n > 0.05::DOUBLE * pages),
k AS (SELECT l.id, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE b.key IS NOT NULL) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.key IS NULL) AS kept FROM l LEFT JOIN b ON b.host = l.host AND b.key = trim(l.line) GROUP BY l.id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(kept, '')) AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (id)"""
