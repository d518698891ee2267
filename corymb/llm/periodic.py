"""Runs of repeated word sequences, found on a harmonic grid.

A *run* is a stretch of words with smallest period ``q`` (words ``q`` apart are equal), at least
``exponent`` periods and ``least`` words long, that no neighbouring word extends.  So it has at least
``max(least, exponent * q) - q`` places in a row where a word equals the one ``q`` further on, and a grid of
that step meets one of them.  All periods' grids together have a harmonic number of points, ``n log n`` for
``n`` words.

For all (period, grid point) pairs of many texts at once, in numpy: pairs whose words differ are dropped,
then a binary search over prefix hashes finds how far the equality reaches to either side.  Words are
numbered exactly, a text at a time; what the hashes found is compared word by word, and a text whose hashes
lied is done again by comparing alone.  Of pairs that found one stretch, the least period counts: a longer period
of a stretch of four of its lengths is a multiple of the smallest one, which spans the same stretch.

Nulls: a null text has no words; a null id changes nothing.  Repeated rows get equal results, whatever
their order; an empty table gives no rows.  Whole texts are taken; pairs are made ``BLOCK`` at a time, so a
very long text costs memory in proportion to its words only.  Other columns of the same names are
replaced by :func:`find_runs`; :func:`run_digest` reads ``doc_id`` and ``text`` only, and raises without them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corymb.llm.batches import append_columns
from corymb.llm.shared import need, small_batches
from corymb.llm.tokens import mix, powers

#: Pairs that are looked at together, and words of short texts that are.
BLOCK, WORDS = 1 << 18, 1 << 15
EXPONENT, LEAST = 4, 6
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def numbered(words: list[bytes]) -> np.ndarray:
    """The words' numbers in order of their first places."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _pairs(bounds: np.ndarray, exponent: int, least: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of all grid points of all periods, at most about ``block`` together.

    The rows of the grid, one a text and period, are counted first and dealt out in order.
    """
    sizes = np.diff(bounds)
    most = np.where(sizes >= least, sizes // exponent, 0)
    ends = np.cumsum(most)  # rows of the grid up to and with each text
    for lo in range(0, int(ends[-1]) if len(ends) else 0, block):
        row = np.arange(lo, min(lo + block, int(ends[-1])))
        text = np.searchsorted(ends, row, "right")
        q = row - (ends[text] - most[text]) + 1
        step = np.maximum(least, exponent * q) - q
        points = (sizes[text] - q + step - 1) // step
        done = np.concatenate([[0], np.cumsum(points)])
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(done, done[at] + block, "right")) - 1)
            if to > at + 1 or done[to] - done[at] <= block:
                r = np.repeat(np.arange(at, to), points[at:to])
                yield text[r], bounds[text[r]] + (np.arange(done[at], done[to]) - done[r]) * step[r], q[r]
            else:  # a single row that is longer than a block
                for first in range(0, int(points[at]), block):
                    p = np.arange(first, min(first + block, int(points[at])))
                    r = np.full(len(p), at)
                    yield text[r], bounds[text[at]] + p * step[at], q[r]
            at = to


def _reach(sums: np.ndarray, i: np.ndarray, q: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``i`` on (with ``back``: before ``i``) equal those ``q`` further on, ``room`` at most; by prefix hashes."""
    up = powers(len(sums) + 1)[0]
    lo, hi = np.zeros(len(i), np.int64), room.copy()
    power = up[q]
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        a = i - mid if back else i
        b = a + mid
        same = (sums[b] - sums[a]) * power == sums[b + q] - sums[a + q]
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def _compared(ids: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs of one text, by comparing its words for every period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-q] == ids[q:], [False]])))
        for start, stop in zip(edges[::2].tolist(), (edges[1::2] + q).tolist(), strict=True):
            if stop - start >= max(least, exponent * q):
                found.setdefault((start, stop), q)
    return [(*span, q) for span, q in found.items()]


def _fewest(rows: np.ndarray) -> np.ndarray:
    """Rows (text, start, stop, period, place) without repeats and without multiples of a stretch's least period, in order."""
    rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
    if len(rows) < 2:
        return rows
    new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
    first = rows[np.flatnonzero(new)[np.cumsum(new) - 1], 3]
    return rows[new | (rows[:, 3] % first != 0)]


def runs_of(ids: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT, least: int = LEAST, block: int = BLOCK) -> np.ndarray:
    """(text, start, length, period) of all runs of consecutive texts, by text, start and period; places count from a text's first word."""
    n = len(ids)
    if not n or len(bounds) < 2:
        return np.zeros((0, 4), np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers(n + 1)[0][:n], out=sums[1:])
    found, kept = [], 0
    for text, i, q in _pairs(bounds, exponent, least, block):
        keep = ids[i] == ids[i + q]
        text, i, q = text[keep], i[keep], q[keep]
        # most pairs that agree by chance agree nowhere beside: a stretch holds its grid point's left or right neighbour
        begin, end = bounds[text], bounds[text + 1]
        right = (i + q + 1 < end) & (ids[np.minimum(i + 1, n - 1)] == ids[np.minimum(i + q + 1, n - 1)])
        left = (i > begin) & (ids[np.maximum(i - 1, 0)] == ids[np.maximum(i - 1, 0) + q])
        keep = right | left
        text, i, q, begin, end = text[keep], i[keep], q[keep], begin[keep], end[keep]
        if not len(i):
            continue
        start = i - _reach(sums, i, q, i - begin, True)
        stop = i + q + _reach(sums, i, q, end - q - i, False)
        long = stop - start >= np.maximum(least, exponent * q)
        found.append(_fewest(np.stack([text, start, stop, q, i], 1)[long]))
        kept += len(found[-1])
        if kept > 4 * block:
            found = [_fewest(np.concatenate(found))]
            kept = len(found[0]) // 2
    if not found:
        return np.zeros((0, 4), np.int64)
    out, lied = [], set()
    for text, start, stop, q, _ in _fewest(np.concatenate(found)).tolist():
        lo, hi = int(bounds[text]), int(bounds[text + 1])
        same = text not in lied and bool((ids[start : stop - q] == ids[start + q : stop]).all())
        if not same or (start > lo and ids[start - 1] == ids[start - 1 + q]) or (stop < hi and ids[stop] == ids[stop - q]):
            lied.add(text)
        out.append((text, start - lo, stop - lo, q))
    if lied:
        out = [r for r in out if r[0] not in lied] + [(t, *r) for t in lied for r in _compared(ids[bounds[t] : bounds[t + 1]], exponent, least)]
    spans: dict[tuple[int, int, int], int] = {}
    for *span, q in out:
        spans[tuple(span)] = min(q, spans.get(tuple(span), q))
    rows = sorted(((t, start, stop - start, q) for (t, start, stop), q in spans.items()), key=lambda r: (r[0], r[1], r[3]))
    return np.array(rows, np.int64).reshape(-1, 4)


def batches_of(texts: Iterator[tuple[list[bytes], np.ndarray]], most: int = WORDS) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
    """Texts' words and numbers, as many together as have about ``most`` words; a longer text alone."""
    words, ids, n = [], [], 0
    for w, i in texts:
        if words and n + len(i) > most:
            yield words, ids
            words, ids, n = [], [], 0
        words.append(w)
        ids.append(i)
        n += len(i)
    if words:
        yield words, ids


def _by_text(rows: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(1, n)))


def find_runs(df: DataFrame, text_col: str = "text", *, exponent: int = EXPONENT, least: int = LEAST, name: str = "runs") -> DataFrame:
    """``df`` with the runs of each text: an array of (start, length, period), by start, then period."""
    at = df.columns.index(text_col)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        out = []
        words = ((t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in b.column(at).cast(pa.large_string()).cast(pa.large_binary()))
        for group, ids in batches_of((w, numbered(w)) for w in words):
            bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            for rows in _by_text(runs_of(np.concatenate(ids), bounds, exponent, least), len(group)):
                out.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()])
        return [pa.array(out, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))]

    return append_columns(df, make, T.StructType([T.StructField(name, RUNS)]), drop=(name,))


def repeated_words(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of a text's ``n`` words some run repeats: those after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, rows[:, 0] + rows[:, 2], 1)
    np.add.at(steps, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a text of ``n`` words that the contract makes periodic; None if it stays."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: runs of the words of each text, some of which are made periodic by their id."""
    docs = need(docs, doc_id="long", text="string")
    small_batches(docs.sparkSession)

    def changed(doc_id: int | None, raw: bytes) -> tuple[list[bytes], np.ndarray]:
        words = raw.split()  # of bytes: at spaces and at 09 to 0D
        ids = numbered(words)
        order = looped(doc_id, len(words))
        return (words, ids) if order is None else ([words[i] for i in order.tolist()], ids[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            raw = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text").cast(pa.large_string()).cast(pa.large_binary()))
            out: list[tuple] = []
            for group, ids in batches_of(map(changed, doc_ids, raw)):
                bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                for words, rows in zip(group, _by_text(runs_of(np.concatenate(ids), bounds), len(group)), strict=True):
                    best = min(rows.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
                    if best:
                        words = [w for w, gone in zip(words, repeated_words(len(words), rows).tolist(), strict=True) if not gone]
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows.tolist())
                    out.append((len(rows), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            cols = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.mapInArrow(run, DIGEST)
