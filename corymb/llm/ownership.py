r"""Secret scan with corpus-wide ownership frequency.

Three patterns find candidate secrets in whole texts; every hit is reported.  A fourth pattern finds
long mixed-case tokens, which are mostly harmless: those are judged over the whole corpus.  Each
candidate's hash is counted by distinct repositories and distinct owners.  A value that more than one
owner has, or that its owner has in over ``most_repositories`` repositories, is a widely copied example;
any other looks live.  Live-looking tokens are added to the spans with kind ``token``; base hits get the
same judgement in ``n_live`` and ``n_example``.

Texts are scanned where they lie: only the few candidates are shuffled.  A text's matches become rows, so a
text with any number of them costs in proportion.  They are reduced to distinct (hash, owner, repository) on each
task, then counted.  The counts are written before they go back to
the candidates, so both sides of that join are plain shuffles and a value that a third of all rows hold
is split over tasks.

Nulls: a null text is empty; a null owner or repository counts as one owner or repository; ids may be
null or repeated (rows are told apart by id and text hash; equal rows get equal results).  An empty
table gives no rows.  Only the columns named are read, so others can't clash; a missing one raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corymb.llm.shared import materialise, need

#: Fixed patterns of the contract: kind, pattern, group that holds the value, least length of the value.
BASE = (
    ("assign", "((?i)password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
#: What must be in a text before the exact pattern is worth running; it never rejects a text with a hit.
HINTS = {"assign": "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "token": "[A-Za-z0-9_-]{32}"}
TOKEN = ("token", "[A-Za-z0-9_-]+", 0, 32)
KINDS = tuple(k for k, *_ in BASE) + ("token",)
SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def matches(text: Column, kind: int, pattern: str, group: int, hint: Column) -> Column:
    """All leftmost non-overlapping matches as (kind, i, gap, hit, value): lengths of the gap before and of the match."""
    rx = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, rx, 0).alias("hit"), F.regexp_extract_all(text, rx, group).alias("value"))
    row = lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["gap"]).cast("long").alias("gap"), F.length(p["hit"]).cast("long").alias("hit"), p["value"].alias("value"))
    found = F.filter(F.transform(parts, row), lambda p: p["hit"].isNotNull())  # the last gap ends the text
    return F.when(hint, found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,hit:bigint,value:string>>"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, owner, repository, start, kind, end, value) of base spans, and of long mixed-case tokens that overlap none.

    Spark has no match positions, so they are running sums over the lengths of a text's gaps and matches.
    Whether a token overlaps a base span is seen by two sweeps in order of the starts: how far the base
    spans before it reach, and where the next one begins.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(matches(text, i, p, g, text.rlike(HINTS[k])) for i, (k, p, g, _) in enumerate((*BASE, TOKEN))))
    key = ["doc_id", "th", "owner", "repository"]
    # a text is hashed below the explode, once, and goes no further
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), "owner", "repository", found.alias("found")).select(*key, F.explode("found").alias("m")).select(*key, "m.*").distinct()
    so_far = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("doc_id", "th").withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far)).withColumn("start", F.col("end") - F.col("hit"))
    long = F.element_at(F.array(*(F.lit(n) for *_, n in (*BASE, TOKEN))), F.col("kind") + 1)
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    rows = rows.where((F.length("value") >= long) & ((F.col("kind") < 3) | mixed))
    base = lambda c: F.when(F.col("kind") < 3, F.col(c))
    before = Window.partitionBy(*key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"reach": F.max(base("end")).over(before)}).withColumns({"next": F.min(base("start")).over(after)})
    clear = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return rows.where((F.col("kind") < 3) | clear).select(*key, "start", "kind", "end", "value")


def span_text(column: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, owner: Column, repository: Column, most_repositories: int = 2) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) as (doc_id, base, added, n_live, n_example)."""
    owned = docs.select("doc_id", "text", owner.alias("owner"), repository.alias("repository"))
    some = materialise(candidates(owned), "secrets").withColumn("hash", F.xxhash64("value"))
    counts = some.select("hash", "owner", "repository").distinct().groupBy("hash").agg(F.count_distinct(F.struct("owner")).alias("owners"), F.count("*").alias("repositories"))
    # merged, never broadcast: the counts grow with the corpus
    judged = some.join(materialise(counts, "owners").hint("merge"), "hash")
    live = (F.col("owners") == 1) & (F.col("repositories") <= most_repositories)
    span, is_base = F.struct("start", "kind", "end", "value"), F.col("kind") < 3
    listed = lambda which: F.sort_array(F.collect_list(F.when(which, span)))
    each = judged.select("doc_id", "th", "start", "kind", "end", "value", live.alias("live")).distinct().groupBy("doc_id", "th").agg(
        listed(is_base).alias("base"), listed(~is_base & F.col("live")).alias("added"), F.count_if(is_base & F.col("live")).alias("n_live"), F.count_if(is_base & ~F.col("live")).alias("n_example")
    )  # one document's spans
    r, e = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).alias("r"), materialise(each, "spans").alias("e")
    joined = r.join(e, F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.th") == F.col("e.th")), "left")
    none = F.array().cast(SPAN)
    return joined.select("r.doc_id", F.coalesce("e.base", none).alias("base"), F.coalesce("e.added", none).alias("added"), F.coalesce("e.n_live", F.lit(0)).alias("n_live"), F.coalesce("e.n_example", F.lit(0)).alias("n_example"))


def scan_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows for a documents table: its source is the owner, source and language the repository."""
    docs = need(docs, doc_id="long", text="string", lang="string", source="string")
    out = scan(docs, owner=F.col("source"), repository=F.struct("source", "lang"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.sort_array(F.concat("base", "added"))).alias("spans"), "n_live", "n_example"
    )


def _sql_kind(kind: int) -> str:
    name, pattern, group, least = (*BASE, TOKEN)[kind]
    rx = pattern.replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))").replace("'", "''")
    return f"""SELECT id, source, lang, {kind} AS kind, g.i AS i, len(hits[g.i]) AS n, vals[g.i] AS v,
  list_sum(list_transform(gaps[1:g.i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:g.i - 1], lambda x: length(x))), 0) AS a
FROM (SELECT id, source, lang, string_split_regex(body, '{rx}') AS gaps, regexp_extract_all(body, '{rx}') AS hits, regexp_extract_all(body, '{rx}', {group}) AS vals FROM d WHERE regexp_matches(body, '{rx}')), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i) AS g WHERE length(vals[g.i]) >= {least}"""


SCAN_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body, source, lang FROM documents),
c AS ({' UNION ALL '.join(f'SELECT * FROM ({_sql_kind(k)})' for k in range(4))}),
u AS (SELECT id, source, lang, kind, a::BIGINT AS a, (a + n)::BIGINT AS b, v FROM c WHERE kind < 3 OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]'))),
k AS (SELECT * FROM u WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM u AS o WHERE o.kind < 3 AND o.id = u.id AND o.a < u.b AND u.a < o.b)),
f AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) = 1 AND count(DISTINCT [source, lang]) <= 2 AS live FROM k GROUP BY v),
j AS (SELECT k.*, live, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || a || ':' || b AS t FROM k JOIN f USING (v)),
r AS (SELECT id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(t, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(t, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR live) AS spans, count(*) FILTER (WHERE kind < 3 AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND NOT live) AS n_example FROM j GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN r USING (id)"""
