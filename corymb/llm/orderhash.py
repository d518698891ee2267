"""Document fingerprints by Order MinHash.

A text's k-mers (``K`` characters) are numbered by occurrence, so a k-mer that occurs thrice counts as
three elements.  Each of ``SKETCHES`` sketches has an order of its own on all elements; the two that come
first in it are put back into text order and hashed as a pair.  The fingerprint is the list of these
hashes, 16 bits each in hexadecimal.  Texts agree on a sketch if they share its first k-mers *in the
same order*, so the share of sketches that agree follows edit distance, where plain MinHash would ignore
rearrangement.

For the edit test each text is followed by its successor in order of (id, text).  Rows are dealt to
ranges of the id, and the first row of a range is also sent to the range before it, so every range
finds all successors by itself; the last range gets the first row of all.  One shuffle moves each
text once, compressed.

Nulls: a null text is empty; a null id sorts first.  Repeated ids follow each other in order of their
texts' MD5, and rows that are equal in both are alike; ids that repeat without end are one range.  A text
of fewer than ``K`` characters is one k-mer; an empty text has an empty fingerprint, which is like only
itself.  A single row is its own successor.  An empty table gives no rows.  Only ``doc_id`` and ``text``
are read by the edit test; :func:`fingerprints` replaces a column of the name it adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corymb.llm.batches import append_columns
from corymb.llm.shared import need, small_batches
from corymb.llm.tokens import mix

K, SKETCHES = 6, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def _kmers(points: np.ndarray, k: int) -> np.ndarray:
    n = len(points) - k + 1
    x = points.astype(np.uint64) * _STEP
    if n <= 0:
        return mix(np.array([np.sum(x * np.arange(1, 2 * len(x), 2, dtype=np.uint64))], np.uint64)) if len(x) else x
    out = x[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += x[j : j + n]
    return mix(out)


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number), in text order; equal k-mers are told by all 64 bits."""
    order = sorted_ = None
    if len(kmers) < 1 << 24:  # 40 bits and the place fit one number, which sorts fast; where they don't tell k-mers apart, all bits are sorted
        packed = np.sort((kmers & ~_LOW) | np.arange(len(kmers), dtype=np.uint64))
        order = (packed & _LOW).astype(np.int64)
        sorted_ = kmers[order]
        if ((sorted_[1:] != sorted_[:-1]) & (((sorted_[1:] ^ sorted_[:-1]) & ~_LOW) == 0)).any():
            order = None
    if order is None:
        order = np.argsort(kmers, kind="stable")
        sorted_ = kmers[order]
    again = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
    if not len(again):
        return kmers
    first = np.ones(len(kmers), bool)
    first[again] = False
    starts = np.flatnonzero(first)
    number = again - starts[np.searchsorted(starts, again, "right") - 1]
    out = kmers.copy()
    out[order[again]] = mix(sorted_[again] + number.astype(np.uint64) * _STEP)
    return out


#: An odd factor for each sketch: the order of its products with an element's high half, modulo 2**32, is the sketch's own.
_FACTORS = (mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Elements that all sketches look at together: products of a block fit a core's cache.
_BLOCK = 2048


def _least_two(elements: np.ndarray, sketches: int) -> np.ndarray:
    """Places of the two elements that each sketch orders first, in text order; one place twice if there is one element."""
    best = np.zeros((2, sketches), np.int64)
    value = np.full((2, sketches), 2**32 - 1, np.uint32)
    factors, rows, high = _FACTORS[:sketches, None], np.arange(sketches), (elements >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(elements), _BLOCK):
        order = high[None, lo : lo + _BLOCK] * factors
        for _ in range(2 if order.shape[1] > 1 else 1):
            at = order.argmin(1)
            new = order[rows, at]
            order[rows, at] = 2**32 - 1
            first, second = new < value[0], (new >= value[0]) & (new < value[1])
            value[1], best[1] = np.where(first, value[0], np.where(second, new, value[1])), np.where(first, best[0], np.where(second, at + lo, best[1]))
            value[0], best[0] = np.where(first, new, value[0]), np.where(first, at + lo, best[0])
    if len(elements) == 1:
        best[1] = best[0]
    best.sort(0)
    return best


def fingerprint(text: str, k: int = K, sketches: int = SKETCHES) -> np.ndarray:
    """One 16-bit hash for each sketch, never 0; all 0 for an empty text."""
    elements = _numbered(_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k))
    if not len(elements):
        return np.zeros(sketches, np.uint16)
    first, second = _least_two(elements, sketches)
    h = mix(mix(elements[first]) * _STEP + elements[second] + np.arange(sketches, dtype=np.uint64))
    return np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the sketches used by either that agree; 1 for two empty fingerprints."""
    used = (a != 0) | (b != 0)
    return float(np.count_nonzero((a == b) & used) / np.count_nonzero(used)) if used.any() else 1.0


def _hex(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex() if f.any() else ""


def fingerprints(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text."""
    at = df.columns.index(text_col)
    make = lambda b: [pa.array([_hex(fingerprint(t or "")) for t in b.column(at).to_pylist()], pa.string())]
    return append_columns(df, make, T.StructType([T.StructField(name, T.StringType())]), drop=(name,))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, id, text); rows marked as a tail only serve as successor."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows: list[tuple] = []
    last = None

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    for b in batches:
        for doc_id, part, tail, raw in zip(b.column("k").to_pylist(), b.column("part").to_pylist(), b.column("tail").to_pylist(), b.column("packed"), strict=True):
            text = unpack(raw.as_buffer()).decode("utf-8", "surrogatepass")
            now = fingerprint(text)
            if last is not None and last[0] == part:
                _, before, old, was = last
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                changed = fingerprint(edited)
                rows.append((None if before == _LEAST_ID else before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(was), _hex(changed), likeness(was, changed), likeness(was, now)))
                if len(rows) >= 2000:
                    yield emit()
                    rows = []
            last = None if tail else (part, doc_id, text, now)
    if rows:
        yield emit()


_LEAST_ID = -(1 << 63)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LEAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def edit_digest(docs: DataFrame, parts_each: int = 4) -> DataFrame:
    """The contract's rows: each text against its edited form and its successor.

    ``parts_each`` ranges of the id for each shuffle partition; their bounds and first ids are all that
    the driver sees.
    """
    docs = need(docs, doc_id="long", text="string")
    spark = docs.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * parts_each
    quantiles = docs.select(F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts = spark.sparkContext.broadcast(np.unique(np.array(quantiles, float)))
    number = lambda k: np.searchsorted(cuts.value, k.astype(float), "right")

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = _ids(b.column(0))
            order = np.argsort(k)
            part = number(k[order])
            new = np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(part[new], pa.int32()), pa.array(k[order][new])], names=["part", "k"])

    found = sorted((r["part"], r["k"]) for r in docs.select("doc_id").mapInArrow(lowest, "part int, k long").groupBy("part").agg(F.min("k").alias("k")).collect())  # a row for each range
    # the first row of each range also ends the range before it; the very first ends the last
    ends = spark.sparkContext.broadcast({k: found[i - 1][0] for i, (_, k) in enumerate(found)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            k = _ids(b.column("doc_id"))
            part = number(k)
            for lo in range(0, len(k), 512):
                cols: list[list] = [[], [], [], [], []]
                for i, text in enumerate(b.column("text").slice(lo, 512).cast(pa.large_string()).cast(pa.large_binary()), lo):
                    raw = text.as_buffer() if text.is_valid else b""
                    row = (int(k[i]), pack(raw), hashlib.md5(raw, usedforsecurity=False).digest())
                    for where, tail in ((int(part[i]), False), (ends.value.get(int(k[i])), True)):
                        if where is not None:
                            for c, v in zip(cols, (where, tail, *row), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "tail", "k", "packed", "tie"])

    dealt = docs.mapInArrow(deal, "part int, tail boolean, k long, packed binary, tie binary")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "tail", "k", "tie").mapInArrow(_compare, OUT)
