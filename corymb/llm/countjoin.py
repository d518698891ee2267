"""Exact n-gram Jaccard join with count vectors and R-trees.

A text's set of word shingles is hashed into groups, and the number of shingles in each group makes it a
point.  The sum of the smaller coordinates of two points bounds the intersection of their sets from above,
at a single point as well as at a box's upper corner, and for coarse groups as well as for fine ones.  So two
sets can only have Jaccard ``num/den`` if their summed minima reach ``num / (num + den) * (|A| + |B|)``.

1. Equal sets become one class, so copies cost nothing further.
2. Directory, the upper levels of the tree, on blocks of coordinates.  If the sets of two points are linked,
   the points differ by at most ``D = (den - num) / (den + num) * (|A| + |B|)`` over all coordinates, hence
   in at most ``D`` of ``3 * D`` blocks of the hash space.  All blocks' counts (*cells*) stand in one order, rare
   ones first; a class is filed under its first ``D + 1`` cells, so linked classes are filed under a common
   one, whatever the order.  Sizes are taken in overlapping ranges, so that ``D`` is known.  A block is a few
   coordinates, so texts that share passages seldom agree on one; and rare first means that texts of one
   template, which agree in its words and differ in the rest, are filed under the rest and don't meet.  How
   rare a cell is, is counted over all classes in ``2 ** SKETCH`` counters of which only the logarithm is
   broadcast: its size is fixed, and counts that run together cost time, never a link.  Classes of one cell
   are tied to the least of them (a *star*).
3. Lower levels: a star's points, summed to ``GROUPS`` coordinates, are packed in an R-tree and searched
   with the bound of summed minima; what is in reach is bounded once more in the finer coordinates that
   large sets have.  Only points are dealt for that; a class that has no other in reach is dropped.  Stars that share classes become one if they are no larger than a chunk together.  The sets of
   those that are left are dealt, searched in the same way and verified.  A star of over ``chunk``
   classes is cut, and its sets are dealt at once: each chunk meets the star's least class and itself, and only classes that are then
   still apart from it meet all chunks.  So the copies of sets stay in proportion to a star of near
   copies, and no star meets in one task.
4. Connected components of the verified links.

:func:`jaccard_links` verifies and returns every link between classes instead.

Nulls: a null or empty text has no shingles and links with nothing; a row with a null id keeps it and
gets a null component.  Texts of fewer words than a shingle are one shingle.  Repeated rows get the
same component.  An empty table gives no rows.  Texts are taken whole.  Only ``doc_id`` and ``text``
are read, so other columns can't clash; without one of them a ValueError is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corymb.llm import tokens
from corymb.llm.components import components
from corymb.llm.shared import broadcast_rows as rows_that_fit
from corymb.llm.shared import fits, materialise, need, small_batches

GROUPS, LEAF = 64, 16
#: Counters of the rarity sketch (a power of two), one byte each when broadcast, and the parts that they are summed in.
SKETCH, PARTS = 24, 64
#: Bits of a cell that are sent (cells that run together cost time, never a link), and cells that a task packs at once.
CELL_BITS, HELD = 48, 1 << 20
_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each of consecutive texts."""
    for lo, hi in tokens.runs(offsets):
        hashes, bounds = tokens.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tokens.NOT_SPACE)
        grams = tokens.combine(hashes, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(grams[a : b - width + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield tokens.combine(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    total = np.array([len(s)], np.uint64) * _SALT + tokens.mix(s ^ _SALT).sum(dtype=np.uint64)
    return int(tokens.mix(total).view(np.int64)[0])


@lru_cache(4)
def size_ranges(num: int, den: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping ranges of set sizes, and the greatest difference of two linked sets in each.

    Two sizes a <= b can only link if b * num <= a * den; every such pair lies in one range at least.
    """
    lows, highs = [1], []
    while lows[-1] < top:
        edge = lows[-1]
        for _ in range(2):
            edge = edge * den // num + 1
        highs.append(edge * den // num)  # whatever links with a size below the next range's low
        lows.append(edge)
    lows, highs = np.array(lows[:-1], np.int64), np.array(highs, np.int64)
    return lows, highs, (den - num) * 2 * highs // (den + num)


def block_cells(s: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """For each range of sizes that a set is in: by how many blocks linked sets may differ, and the cells of all its blocks."""
    lows, highs, most = size_ranges(num, den)
    n, out = len(s), []
    if not n:
        return out
    # the sum of a block's mixed coordinates stands for its counts
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(s + _SALT), dtype=np.uint64)])
    last = int(np.searchsorted(lows, n, "right")) - 1
    for r in range(max(0, last - 2), last + 1):
        d = int(most[r])
        if n > highs[r] or not d:
            continue  # without any difference only equal sets link
        k = 3 * d
        # block j holds the hashes from j/k to (j+1)/k of all numbers; the set is sorted, so each is a run of it
        edges = np.searchsorted(s, ((np.arange(1, k, dtype=np.uint64) << np.uint64(32)) // np.uint64(k)) << np.uint64(32))
        edges = np.concatenate([[0], edges, [n]])
        names = tokens.mix(np.arange(k, dtype=np.uint64) + np.uint64((r + 1) << 32))
        out.append((d, tokens.mix(sums[edges[1:]] - sums[edges[:-1]] + names)))
    return out


def cells(s: np.ndarray, rarity: np.ndarray, num: int, den: int) -> np.ndarray:
    """The directory cells that a set is filed under: in each range of sizes the first ones by (rarity, cell)."""
    shift, low, out = np.uint64(64 - _bits(rarity)), np.uint64((1 << 56) - 1), []
    for d, own in block_cells(s, num, den):
        key = (rarity[(own >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (own & low)
        out.append(np.partition(key, d)[: d + 1] if d + 1 < len(key) else key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _bits(rarity: np.ndarray) -> int:
    return len(rarity).bit_length() - 1


def _counters(docs: DataFrame, width: int, num: int, den: int, bits: int, buffer: int = 1 << 21) -> np.ndarray:
    """How often each counter's cells occur in all classes, as twice the binary logarithm.

    A task sends its counts in ``PARTS`` parts, as compressed steps from counter to counter; each part is summed by
    itself, and the driver gets one byte a counter.
    """
    low = bits - PARTS.bit_length() + 1  # bits of a counter's number in its part

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        seen: set[int] = set()
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            at, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(at, np.arange(PARTS + 1, dtype=np.uint32) << np.uint32(low))
            raw = [(i, np.diff(at[a:b], prepend=np.uint32(i << low)).astype("<u4").tobytes(), counts[a:b].astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in raw], pa.int32()), *(pa.array([pack(r[k]) for r in raw], pa.binary()) for k in (1, 2))], names=["part", "steps", "counts"])

        for b in batches:
            for s in shingle_sets(*tokens.text_bytes(b.column("text")), width):
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    for _, own in block_cells(s, num, den):
                        held.append((own >> np.uint64(64 - bits)).astype(np.uint32))
                        n += len(own)
                    if n > buffer:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, steps, counts in zip(b.column("part").to_pylist(), b.column("steps"), b.column("counts"), strict=True):
                at = np.cumsum(np.frombuffer(unpack(steps.as_buffer()), "<u4"))
                sums.setdefault(part, np.zeros(1 << low, np.int64))[at] += np.frombuffer(unpack(counts.as_buffer()), "<u4")
        for part, total in sums.items():
            levels = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.ZstdCompressor().compress(levels.tobytes())], pa.binary())], names=["part", "levels"])

    sent = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(count, "part int, steps binary, counts binary")
    rows = sent.repartition(PARTS, "part").mapInArrow(add, "part int, levels binary").collect()  # a row a part
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:
        out[r["part"] << low : (r["part"] + 1) << low] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["levels"])), np.uint8)
    return out


class CountTree:
    """A packed R-tree over count vectors: each box has its upper corner and its least set size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.counts, self.sizes, self.leaf = counts, sizes, leaf
        self.order = np.lexsort((*counts.T[:3], sizes))
        self.levels = []
        top, low = counts[self.order], sizes[self.order]
        while len(top) > leaf:
            starts = np.arange(0, len(top), leaf)
            top, low = np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts)
            self.levels.append((top, low))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Numbers of the points whose summed minima with ``point`` allow a Jaccard of num/den."""

        def allowed(corner: np.ndarray, low: np.ndarray) -> np.ndarray:
            # |A & B| >= num / (num + den) * (|A| + |B|)
            return (num + den) * np.minimum(corner, point).sum(1, dtype=np.int64) >= num * (size + low)

        at = None
        for top, low in reversed(self.levels):
            at = np.arange(len(top)) if at is None else at[at < len(top)]
            at = at[allowed(top[at], low[at])]
            at = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        at = self.order if at is None else self.order[at[at < len(self.order)]]
        return at[allowed(self.counts[at], self.sizes[at])]


def star_links(keys: list[int], sets: list[np.ndarray], side: np.ndarray, num: int, den: int, labels: list[int] | None = None, every: bool = False) -> list[tuple[int, int]]:
    """With ``every``, all links with Jaccard >= num/den; with two sides, only across them.

    Else pairs that connect the same classes: each to the least of those it is connected with.  What is
    connected already, by links or by equal labels, isn't verified.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    counts = np.stack([point(s) for s in sets])
    two = bool(side.any() and not side.all())
    inner = np.flatnonzero(side) if two else np.arange(len(keys))
    outer = np.flatnonzero(~side) if two else inner
    first: dict[int, int] = {}
    root = [first.setdefault(x, i) for i, x in enumerate(labels or range(len(keys)))]
    tree, links = CountTree(counts[inner], sizes[inner]), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in outer.tolist():
        for j in inner[tree.search(counts[i], int(sizes[i]), num, den)].tolist():
            if (j > i or two) and keys[i] != keys[j] and ((a := find(i)) != (b := find(j)) or every):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (int(sizes[i]) + int(sizes[j]) - both):
                    root[a] = b
                    links.append((keys[i], keys[j]))
    if every:
        return links
    groups: dict[int, list[int]] = {}
    for i in first.values():
        groups.setdefault(find(i), []).append(keys[i])
    return [(least, key) for least, g in ((min(g), g) for g in groups.values()) for key in g if key != least]


def point(s: np.ndarray) -> np.ndarray:
    """A set's counts in ``GROUPS`` coordinates."""
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def groups_of(n: int) -> int:
    """Coordinates of a large set's own point: so many that unrelated sets of its size fall short of the bound."""
    return max(GROUPS, 1 << max(0, (n >> 4).bit_length()))


def packed(s: np.ndarray) -> bytes:
    """A set's counts in ``groups_of`` its size, in 16 bits each if they suffice."""
    groups = groups_of(len(s))
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * groups_of(n) else "<u4").astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same point in fewer coordinates."""
    return counts.reshape(-1, groups).sum(0)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, points = [], [], []
            for s in shingle_sets(*tokens.text_bytes(b.column("text")), width):
                sizes.append(len(s))
                keys.append(set_key(s))
                points.append(packed(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(points, pa.binary())], names=["doc_id", "th", "n", "sid", "point"])

    return docs.select("doc_id", "text", text_hash(F.col("text")).alias("th")).mapInArrow(run, "doc_id long, th long, n long, sid long, point binary")


def _in_reach(num: int, den: int):
    """(star, sid) of the points of a star that the bound lets another one of it link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by star; one star's points are held at a time."""
        now, keys, sizes, points = None, [], [], []

        def flush() -> list[tuple[int, int]]:
            if len(keys) < 2:
                return []
            counts, n = np.stack([folded(p, GROUPS) for p in points]).astype(np.int32), np.array(sizes, np.int64)
            tree = CountTree(counts, n)

            def near(i: int, j: int) -> bool:
                groups = min(len(points[i]), len(points[j]))
                both = np.minimum(folded(points[i], groups), folded(points[j], groups)).sum(dtype=np.int64)
                return i != j and (num + den) * both >= num * (sizes[i] + sizes[j])

            return [(now, keys[i]) for i in range(len(keys)) if any(near(i, j) for j in tree.search(counts[i], sizes[i], num, den).tolist())]

        for b in batches:
            out = []
            for star, key, n, raw in zip(*(b.column(c).to_pylist() for c in ("star", "sid", "n", "point")), strict=True):
                if star != now:
                    out += flush()
                    now, keys, sizes, points = star, [], [], []
                keys.append(key)
                sizes.append(n)
                points.append(unpacked(raw, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], names=["star", "sid"])
        out = flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], names=["star", "sid"])

    return run


def text_hash(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _steps(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed steps, byte by byte: all first bytes, all second ones and so on."""
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _planes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return flat.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed_cells(cell: np.ndarray, sid: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ascending cells with their classes: steps of cells, steps of the classes named, and the number of each cell's class."""
    names, which = np.unique(sid.view(np.uint64), return_inverse=True)
    return _steps(cell), _steps(names), _planes(which.astype("<u4"))


def unpacked_cells(cells: bytes, names: bytes, which: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unplaned(cells, "<u8"), dtype=np.uint64), np.cumsum(_unplaned(names, "<u8"), dtype=np.uint64).view(np.int64)[_unplaned(which, "<u4")]


def _filed(docs: DataFrame, width: int, num: int, den: int, bits: int, held_cells: int = HELD) -> DataFrame:
    """(cell, sid) for each cell of each set that another set is filed under too.

    A task packs its cells by parts of the cells' range, so that what is shuffled takes about half of what rows take;
    in a part the cells with one class only, nearly all, are dropped.  Of a cell's classes in a task the least and the
    greatest are enough to tell that it is shared; those between them are dealt evenly, so a hot cell is in no one task.
    """
    rarity = docs.sparkSession.sparkContext.broadcast(_counters(docs, width, num, den, bits))  # 2 ** bits bytes, whatever the input
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, n // 2)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cs, ks, rows = [], [], 0

        def flush() -> pa.RecordBatch:
            cell, sid = np.concatenate(cs) & np.uint64((1 << CELL_BITS) - 1), np.concatenate(ks)
            order = np.lexsort((sid, cell))
            cell, sid = cell[order], sid[order]
            new = np.concatenate([[True], cell[1:] != cell[:-1]])
            ends = new | np.concatenate([new[1:], [True]])
            between = cell[~ends], sid[~ends]
            cell, sid = cell[ends], sid[ends]
            cuts = np.searchsorted((cell >> np.uint64(CELL_BITS - 32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            out = [(p, False, *packed_cells(cell[a:b], sid[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            for lo in range(0, len(between[0]), 1 << 14):
                own = tuple(x[lo : lo + (1 << 14)] for x in between)
                out.append((int(own[1].view(np.uint64).sum(dtype=np.uint64) % np.uint64(parts)), True, *packed_cells(*own)))
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "shared", "cells", "names", "which"])

        for b in batches:
            for s in shingle_sets(*tokens.text_bytes(b.column("text")), width):
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    cs.append(cells(s, rarity.value, num, den))
                    ks.append(np.full(len(cs[-1]), key, np.int64))
                    rows += len(ks[-1])
                    if rows > held_cells:
                        yield flush()
                        cs, ks, rows = [], [], 0
        if rows:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; one part's cells are held at a time."""
        now, held = None, []

        def rows(cell: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(cell), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 200_000]) for x in (cell.view(np.int64), sid)], names=["cell", "sid"])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                cell, sid = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((sid, cell))
                cell, sid = cell[order], sid[order]
                new = np.concatenate([[True], cell[1:] != cell[:-1]])
                starts = np.append(np.flatnonzero(new), len(cell))
                shared = np.repeat(sid[starts[:-1]] != sid[starts[1:] - 1], np.diff(starts))
                shared &= new | np.concatenate([[True], sid[1:] != sid[:-1]])
                yield from rows(cell[shared], sid[shared])

        for b in batches:
            for part, shared, *raw in zip(*(b.column(c).to_pylist() for c in ("part", "shared", "cells", "names", "which")), strict=True):
                if part != now:
                    yield from flush()
                    now, held = part, []
                if shared:
                    yield from rows(*unpacked_cells(*raw))
                else:
                    held.append(unpacked_cells(*raw))
        yield from flush()

    sent = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(file, "part int, shared boolean, cells binary, names binary, which binary")
    return sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(meet, "cell long, sid long")


def _payload(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                sets = list(shingle_sets(*tokens.text_bytes(part.column("text")), width))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), part.column("cut")], names=["sid", "hashes", "cut"])

    return docs.select("text", "cut").mapInArrow(run, "sid long, hashes binary, cut boolean")


def _search(num: int, den: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; one task's rows are held at a time."""
        now, keys, sets, side, labels = None, [], [], [], []

        def flush() -> list[tuple[int, int]]:
            return star_links(keys, sets, np.array(side, bool), num, den, labels, every) if len(keys) > 1 else []

        def rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            links = []
            for task, key, raw, right, label in zip(*(batch.column(c).to_pylist() for c in ("task", "sid")), batch.column("hashes"), *(batch.column(c).to_pylist() for c in ("right", "label")), strict=True):
                if task != now:
                    links += flush()
                    now, keys, sets, side, labels = task, [], [], [], []
                keys.append(key)
                sets.append(np.frombuffer(raw.as_buffer(), np.uint64).copy())
                side.append(right)
                labels.append(label)
            if links:
                yield rows(links)
        if links := flush():
            yield rows(links)

    return run


class _Join:
    """The steps that components and links share."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int, chunk: int, broadcast_rows: int | None, bits: int = SKETCH):
        self.num, self.den, self.chunk = num, den, chunk
        docs = need(docs, doc_id="long", text="string")
        self.spark = docs.sparkSession
        small_batches(self.spark)
        small = lambda d, row_bytes: F.broadcast(d) if fits(d, rows_that_fit(self.spark, row_bytes) if broadcast_rows is None else broadcast_rows) else d
        self.members = materialise(_sets(docs, width), "sets")
        self.classes = self.members.where("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("first"))

        filed = materialise(_filed(docs, width, num, den, bits), "filed")
        met = materialise(filed.groupBy("cell").agg(F.min("sid").alias("star"), F.max("sid").alias("last"), F.count("*").alias("n")).where("star < last"), "cells", few=True)
        # most cells that are shared hold two classes; the others are joined back, in parts if one is hot, and never broadcast: they grow with the corpus
        more = met.where("n > 2").select("cell", "star")
        many = filed.join(more.hint("merge"), "cell").where("sid <> star")
        self.stars = materialise(met.where("n = 2").select("star", F.col("last").alias("sid")).unionByName(many.select("star", "sid")).distinct(), "stars")
        inside = self.stars.unionByName(self.stars.select("star", F.col("star").alias("sid")).distinct())
        # written before the join, so that a large star is counted where its rows lie and its join can be split
        parts = materialise(inside.groupBy("star").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")), "parts")
        placed = materialise(inside.join(parts, "star"), "inside")
        whole = placed.where("parts = 1").select("star", "sid")
        some = whole.select("sid").distinct()
        points = self.members.join(small(some, 8), "sid", "left_semi").select("sid", "n", "point").dropDuplicates(["sid"])
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pointed = whole.join(points, "sid").select("star", "sid", "n", "point").repartition(n, "star").sortWithinPartitions("star")
        near = self._joined(materialise(pointed.mapInArrow(_in_reach(num, den), "star long, sid long"), "near", few=True)).withColumn("parts", F.lit(1))
        self.inside = materialise(near.unionByName(placed.where("parts > 1").select("star", "sid", "parts")), "reach").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
        self.cut = parts.where("parts > 1")

        dealt = self.inside.groupBy("sid").agg(F.max(F.col("parts") > 1).alias("cut")).join(self.classes, "sid")
        wanted = materialise(dealt.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.max("cut").alias("cut")), "wanted", few=True)
        chosen = docs.join(small(wanted, 9), "doc_id")
        self.payload = materialise(_payload(chosen, width), "payload")

    def _joined(self, near: DataFrame) -> DataFrame:
        """Stars that share classes as one, where all their classes together are a chunk at most: each set is dealt once."""
        found = components(near.select(F.col("sid").alias("a"), F.col("star").alias("b")))
        named = near.select("sid").distinct().join(found.withColumnRenamed("node", "sid"), "sid", "left").select(F.coalesce("root", "sid").alias("root"), "sid")
        named = materialise(named.join(named.groupBy("root").agg(F.count("*").alias("n")), "root"), "groups", few=True)
        few = named.where(F.col("n") <= self.chunk).select(F.col("root").alias("star"), "sid")
        many = near.join(named.where(F.col("n") > self.chunk).select("sid"), "sid", "left_semi").select("star", "sid")
        return few.unionByName(many)

    def search(self, tasks: DataFrame, every: bool = False) -> DataFrame:
        """The links of tasks; those with a column ``cut`` are all of cut stars, and only such stars' sets are read."""
        payload = (self.payload.where("cut") if "cut" in tasks.columns else self.payload).dropDuplicates(["sid"])
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = tasks.join(payload, "sid").select("task", "sid", "hashes", "right", "label").repartition(n, "task").sortWithinPartitions("task")
        return materialise(dealt.mapInArrow(_search(self.num, self.den, every), "a long, b long"), "links", few=True)

    def connecting_links(self) -> DataFrame:
        """Links with the same components as all links."""
        centre = F.col("sid") == F.col("star")
        at = F.explode(F.when(centre, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))).alias("at")
        near = self.inside.select("star", "sid", at).select("sid", F.xxhash64("star", "at").alias("task"), F.lit(False).alias("right"), F.col("sid").alias("label"))
        links = self.search(near)
        if not self.cut.limit(1).count():
            return links
        # of the stars that were cut: what isn't connected with the least class meets every chunk
        joined = components(links)
        cut = self.inside.where("parts > 1").join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid"))
        cut = materialise(cut.select("star", "sid", "parts", "own", "label"), "cut")
        centres = materialise(cut.where(centre).select("star", F.col("label").alias("main")), "centres")
        marked = cut.join(centres, "star")
        apart = materialise(marked.where("label <> main"), "apart")
        links = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if not apart.limit(1).count():
            return links
        groups = materialise(apart.groupBy("star").agg(F.ceil(F.count("*") / self.chunk).cast("int").alias("groups")), "groups")
        left = apart.join(groups, "star").withColumn("g", F.pmod(F.xxhash64("sid"), F.col("groups")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = cut.join(groups, "star").withColumn("p", F.col("own")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        form = lambda d, side: d.select("sid", F.xxhash64("star", "g", "p").alias("task"), F.lit(side).alias("right"), "label")
        return links.unionByName(self.search(form(left, False).unionByName(form(right, True)).withColumn("cut", F.lit(True))))

    def all_links(self) -> DataFrame:
        """Every link between classes; each chunk of a star meets each other, and itself, in a task of its own."""
        tasks = self.inside.select("star", "sid", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        tasks = tasks.select("sid", F.xxhash64("star", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).alias("right"), F.col("sid").alias("label"))
        return self.search(tasks, every=True).distinct()


def jaccard_classes(docs: DataFrame, *, width: int = 3, num: int = 9, den: int = 10, chunk: int = 256, broadcast_rows: int | None = None, bits: int = SKETCH) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, component_th) for each row; links are Jaccard >= num/den.

    What is broadcast has ``broadcast_rows`` rows at most, as many as fit the session's bound unless stated.
    ``th`` tells texts with one id apart; the least (id, th) of a component stands for it.
    """
    join = _Join(docs, width, num, den, chunk, broadcast_rows, bits)
    joined = components(join.connecting_links())
    named = join.classes.join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = named.groupBy("root").agg(F.min("first").alias("kept"))
    m, c = join.members.alias("m"), named.join(lowest, "root").select("sid", "kept").alias("c")
    out = m.join(c, F.col("m.sid") == F.col("c.sid"), "left")
    of = lambda whole, own: F.when(F.col("m.doc_id").isNull(), F.lit(None).cast("long")).when(F.col("m.n") == 0, own).otherwise(whole)
    return out.select("m.doc_id", "m.th", F.col("m.n").alias("n_shingles"), of(F.col("c.kept.doc_id"), F.col("m.doc_id")).alias("component_id"), of(F.col("c.kept.th"), F.col("m.th")).alias("component_th"))


def jaccard_components(docs: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    return jaccard_classes(docs, **how).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, *, width: int = 3, num: int = 9, den: int = 10, chunk: int = 256, broadcast_rows: int | None = None, bits: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """All links as pairs (a, b) of class ids, and the membership (doc_id, class_id) of rows that have shingles."""
    join = _Join(docs, width, num, den, chunk, broadcast_rows, bits)
    return join.all_links(), join.members.where("n > 0").select("doc_id", F.col("sid").alias("class_id"))


def join_digest(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


_SHINGLES = r"""d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT id, doc_id, CASE WHEN len(w) > 2 THEN list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d)"""
#: Equal sets are one class; classes meet in shared shingles, and the least id spreads along links.
JOIN_SQL = f"""
WITH RECURSIVE {_SHINGLES},
r AS (SELECT id, doc_id, len(s) AS n, array_to_string(s, chr(10)) AS k, s FROM g),
c AS (SELECT row_number() OVER () AS c, k, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS low FROM r WHERE n > 0 AND doc_id IS NOT NULL GROUP BY k),
x AS (SELECT c, n, unnest(s) AS t FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
z AS (SELECT c, c AS z FROM c UNION SELECT l.b, z.z FROM z JOIN l ON l.a = z.c),
m AS (SELECT z.c, min(low) AS low FROM z JOIN c ON c.c = z.z GROUP BY z.c)
SELECT r.doc_id, r.n AS n_shingles, CASE WHEN r.doc_id IS NULL THEN NULL WHEN r.n = 0 THEN r.doc_id ELSE m.low END AS component_id FROM r LEFT JOIN c ON r.k = c.k AND r.n > 0 LEFT JOIN m USING (c)"""
