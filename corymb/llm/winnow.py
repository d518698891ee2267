"""Benchmark decontamination by winnowing.

Texts are taken as words.  Each text's k-gram hashes are winnowed: of every ``window`` consecutive
ones the least is kept, the last of equal ones.  Two texts that share ``span = k + window - 1`` words
share one of the kept hashes there, so joining document fingerprints with benchmark fingerprints
misses no shared span.  Each hit is extended word by word along its diagonal, up to ``window - 1``
words each way: whatever run of ``span`` words holds the fingerprint lies within.  Runs of ``span``
words and more count, and overlapping runs are one.  Fingerprints of an item that look alike that far
are kept once, so an item of one repeated word has a few, not one a word, and all hits are compared at
once.  A benchmark item of fewer words counts where it occurs as a whole; such items are looked up at
every position by a hash of their own length.

The benchmark is broadcast while its text is under ``broadcast_bytes``, which is measured first.
Beyond that, the distinct fingerprints of each document are joined with those of the items by a
shuffle, and each document is compared with the surroundings of the fingerprints it shares, never
with whole items.

Nulls: a null text has no words; a null item id is named ``null``; null document ids are kept.  Texts
of any length are taken whole.  Repeated rows are judged each; repeated item ids count once.  Without
documents there are no rows; without a benchmark nothing is hit.  Input columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corymb.llm import tokens
from corymb.llm.batches import append_columns
from corymb.llm.shared import free_name, materialise, need

K, WINDOW = 8, 6
SPAN = K + WINDOW - 1
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])


def winnow(hashes: np.ndarray, bounds: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams of consecutive texts."""
    grams = tokens.combine(hashes, k)
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    whole = np.arange(n) + (k + window - 1) <= ends
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window):
        now = grams[j : j + n]
        place = np.where(now <= least, np.arange(j, j + n), place)
        np.minimum(least, now, out=least)
    at = np.unique(place[whole])
    return at, grams[at]


def _around(words: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each fingerprint's surroundings, and a hash of what they hold."""
    first, last = np.maximum(at - reach, lo), np.minimum(at + k + reach, hi)
    sign = (at - first).astype(np.uint64)
    for j in range(k + 2 * reach):
        p = first + j
        sign = np.where(p < last, tokens.mix(sign * np.uint64(31) + words[np.minimum(p, len(words) - 1)]), sign)
    return first, last, sign


class Benchmark:
    """Fingerprints of benchmark items with their surroundings, to be joined with those of documents.

    ``words`` holds the surroundings, from ``lo`` to ``hi`` for a fingerprint at ``at``; ``short`` has
    (length, hash, name) of the items of fewer than ``span`` words.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, prints: np.ndarray, names: list[str], short: list[tuple[int, int, str]], k: int = K, window: int = WINDOW):
        self.k, self.window, self.span = k, window, k + window - 1
        self.ids = sorted({*names, *(x[2] for x in short)})
        number = {x: i for i, x in enumerate(self.ids)}
        order = np.argsort(prints, kind="stable")
        self.words, self.prints, self.at, self.lo, self.hi = words, prints[order], at[order], lo[order], hi[order]
        self.item = np.array([number[x] for x in names], np.int64)[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({x[0] for x in short}):
            rows = sorted({(key, number[name]) for m, key, name in short if m == n})
            self.short[n] = np.array([x[0] for x in rows], np.uint64), np.array([x[1] for x in rows], np.int64)

    @classmethod
    def of_texts(cls, ids: list[str], texts: list[str], k: int = K, window: int = WINDOW) -> Benchmark:
        words, at, lo, hi, prints, item, short = fingerprint_items(texts, k, window)
        return cls(words, at, lo, hi, prints, [ids[i] for i in item.tolist()], [(n, key, ids[i]) for i, n, key in short], k, window)

    def match(self, hashes: np.ndarray, bounds: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, list[list[str]]]:
        """For consecutive documents: how many of their words are hit, and by which items."""
        n_docs, reach = len(bounds) - 1, self.window - 1
        marks, pairs = np.zeros(len(hashes) + 1, np.int64), [np.zeros(0, np.int64)]

        def note(start: np.ndarray, stop: np.ndarray, doc: np.ndarray, item: np.ndarray) -> None:
            np.add.at(marks, start, 1)
            np.add.at(marks, stop, -1)
            pairs.append(np.unique(doc * len(self.ids) + item))

        at, prints = winnow(hashes, bounds, self.k, self.window)
        lo, hi = (np.searchsorted(self.prints, prints, side) for side in ("left", "right"))
        hit = np.flatnonzero(hi > lo)
        at, lo, each = at[hit], lo[hit], (hi - lo)[hit]
        sums, a = np.cumsum(each), 0
        while a < len(at):  # about ``most`` hits at a time
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right")))
            n = each[a:b]
            q = np.repeat(lo[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
            p = np.repeat(at[a:b], n)
            doc = np.searchsorted(bounds, p, "right") - 1
            item_at, item_lo, item_hi, doc_lo, doc_hi = self.at[q], self.lo[q], self.hi[q], bounds[doc], bounds[doc + 1]

            def same(j: int, p: np.ndarray = p, item_at: np.ndarray = item_at, item_lo: np.ndarray = item_lo, item_hi: np.ndarray = item_hi, doc_lo: np.ndarray = doc_lo, doc_hi: np.ndarray = doc_hi) -> np.ndarray:
                x, y = p + j, item_at + j
                inside = (x >= doc_lo) & (x < doc_hi) & (y >= item_lo) & (y < item_hi)
                return inside & (hashes[np.where(inside, x, 0)] == self.words[np.where(inside, y, 0)])

            left, right, go, on = (np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.ones(len(p), bool), np.ones(len(p), bool))
            for j in range(1, reach + 1):
                go &= same(-j)
                on &= same(self.k + j - 1)
                left += go
                right += on
            long = np.flatnonzero(left + right + self.k >= self.span)
            note((p - left)[long], (p + self.k + right)[long], doc[long], self.item[q[long]])
            a = b
        for n, (keys, items) in self.short.items():
            grams = tokens.combine(hashes, n)
            lo, hi = (np.searchsorted(keys, grams, side) for side in ("left", "right"))
            p = np.flatnonzero(hi > lo)
            doc = np.searchsorted(bounds, p, "right") - 1
            fit = p + n <= bounds[doc + 1]
            p, doc = p[fit], doc[fit]
            _, one = np.unique(np.stack([doc, lo[p]], 1), axis=0, return_index=True)  # a document and a short text once
            each = hi[p[one]] - lo[p[one]]
            q = np.repeat(lo[p[one]] - np.cumsum(each) + each, each) + np.arange(each.sum())
            np.add.at(marks, p, 1)
            np.add.at(marks, p + n, -1)
            pairs.append(np.repeat(doc[one], each) * len(self.ids) + items[q])
        inside = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
        n_hit, items = inside[bounds[1:]] - inside[bounds[:-1]], [[] for _ in range(n_docs)]
        for pair in np.unique(np.concatenate(pairs)).tolist():
            items[pair // len(self.ids)].append(self.ids[pair % len(self.ids)])
        return n_hit, items


def fingerprint_items(texts: list[str], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(words, at, lo, hi, prints, item) of the items' fingerprints, those that look alike once, and (item, n, hash) of the short ones."""
    data, offsets = tokens.text_bytes(pa.array(texts, pa.large_string()))
    words, bounds = tokens.words(data, offsets, tokens.ALNUM)
    at, prints = winnow(words, bounds, k, window)
    item = np.searchsorted(bounds, at, "right") - 1
    lo, hi, sign = _around(words, at, bounds[item], bounds[item + 1], k, window - 1) if len(at) else (at, at, prints)
    _, one = np.unique(np.stack([item.astype(np.uint64), prints, sign], 1), axis=0, return_index=True)
    short = [(i, n, int(tokens.combine(words[bounds[i] : bounds[i + 1]], n)[0])) for i, n in enumerate(np.diff(bounds).tolist()) if 0 < n < k + window - 1]
    return words, at[one], lo[one], hi[one], prints[one], item[one], short


def _judge(column: pa.Array, benchmark: Benchmark) -> list[pa.Array]:
    data, offsets = tokens.text_bytes(column)
    n_words, n_hit, items = [], [], []
    for lo, hi in tokens.runs(offsets):
        hashes, bounds = tokens.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tokens.ALNUM)
        hit, which = benchmark.match(hashes, bounds)
        n_words.append(np.diff(bounds))
        n_hit.append(hit)
        items += which
    join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return [join(n_words), join(n_hit), pa.array(items, pa.list_(pa.string()))]


#: A fingerprint on its way to documents: n is 0, or the length of a short item; place is where it is among its surroundings.
_PRINT = "n int, print long, name string, place int, around binary"


def _item_prints(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("name").to_pylist()
            words, at, lo, hi, prints, item, short = fingerprint_items(b.column("text").to_pylist())
            around = [words[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            cols = [
                (pa.array([0] * len(at) + [n for _, n, _ in short], pa.int32())), pa.array(np.concatenate([prints, np.array([key for *_, key in short], np.uint64)]).view(np.int64)), pa.array([names[i] for i in item.tolist()] + [names[i] for i, *_ in short], pa.string()),
                pa.array((at - lo).tolist() + [0] * len(short), pa.int32()), pa.array(around + [b""] * len(short), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["n", "print", "name", "place", "around"])

    return items.mapInArrow(run, _PRINT).distinct()


def _shared_prints(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(key, shared): the items' fingerprints that a text shares, joined by a shuffle; a text's fingerprints go once each."""
    lengths = [r[0] for r in prints.where("n > 0").select("n").distinct().collect()]  # at most SPAN - 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_bytes(batch.column("text"))
            keys = np.asarray(batch.column("key"))
            for lo, hi in tokens.runs(offsets):
                hashes, bounds = tokens.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tokens.ALNUM)
                parts = [(0, *winnow(hashes, bounds))]
                for n in lengths:
                    grams = tokens.combine(hashes, n)
                    p = np.arange(len(grams))
                    fit = p + n <= bounds[np.searchsorted(bounds, p, "right")]
                    parts.append((n, p[fit], grams[fit]))
                for n, at, found in parts:
                    row = np.searchsorted(bounds, at, "right") - 1 + lo
                    pair = np.unique(np.stack([keys[row].view(np.uint64), found], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(np.full(len(pair), n, np.int32)), pa.array(pair[:, 1].view(np.int64))], names=["key", "n", "print"])

    left = texts.mapInArrow(run, "key long, n int, print long")
    shared = left.join(prints, ["n", "print"]).groupBy("key").agg(F.collect_set(F.struct("n", "print", "name", "place", "around")).alias("shared"))  # what one text holds
    return materialise(shared, "shared_prints")  # written, so that the join of a text that many documents have can be split


def _benchmark_of(shared: pa.Array) -> Benchmark:
    """The fingerprints that the documents of a batch share."""
    rows = {(x["n"], x["print"], x["name"], x["place"], x["around"]) for part in shared.to_pylist() for x in part or ()}
    long, short = [x for x in rows if not x[0]], [(n, p & (2**64 - 1), name) for n, p, name, *_ in rows if n]
    words = np.frombuffer(b"".join(x[4] for x in long), np.uint64)
    ends = np.cumsum([0] + [len(x[4]) // 8 for x in long])
    return Benchmark(words, ends[:-1] + np.array([x[3] for x in long], np.int64), ends[:-1], ends[1:], np.array([x[1] for x in long], np.int64).view(np.uint64), [x[2] for x in long], short)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` (with a ``text``) plus ``n_words``, ``n_hit`` and ``items``, the sorted ids of items that occur."""
    spark = docs.sparkSession
    items = need(benchmark, item_id="string", text="string").select(F.coalesce("item_id", F.lit("null")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    size, n = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("name")), F.lit(0)), F.count("*")).first()
    names = tuple(ADDED.names)
    if size + 16 * n <= broadcast_bytes:
        rows = items.collect()  # under broadcast_bytes, measured
        whole = spark.sparkContext.broadcast(Benchmark.of_texts([r["name"] for r in rows], [r["text"] for r in rows]))
        return append_columns(docs, lambda b: _judge(b.column("text"), whole.value), ADDED, drop=names)
    key, shared = free_name(docs, "wn_key"), free_name(docs, "wn_shared")
    text = F.coalesce("text", F.lit(""))
    pairs = _shared_prints(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), materialise(_item_prints(items), "item_prints"))
    joined = docs.drop(*names).withColumn(key, F.xxhash64(text)).join(pairs.withColumnsRenamed({"key": key, "shared": shared}), key, "left")

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        parts = []
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            parts.append(_judge(part.column("text"), _benchmark_of(part.column(shared))))
        return [pa.concat_arrays([p[j] for p in parts]) if parts else pa.array([], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))]

    return append_columns(joined, judge, ADDED, drop=(key, shared))


def contaminated(least: int = 20):
    """A document is contaminated if one in ``least`` of its words or more is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * least >= F.col("n_words"))


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(need(docs, doc_id="long", text="string"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, coalesce({_WORDS}, []) AS w FROM benchmark),
i AS (SELECT item, least(len(w), {SPAN}) AS n, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS p, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM i),
n AS (SELECT DISTINCT n FROM g),
e AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, n WHERE len(w) >= n),
h AS (SELECT id, p, e.n, item FROM e JOIN g ON e.n = g.n AND array_to_string(w[p:p + e.n - 1], ' ') = g.t),
x AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS k FROM h) GROUP BY id),
y AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x USING (id) LEFT JOIN y USING (id)"""
