"""Large scans as square tiles: (image, ty, tx, data), one byte a pixel, rows of ``tile`` pixels.

Filters and morphology of a bounded radius need a pixel's neighbourhood only.  Each tile hands the strips along its
border to the neighbours that they touch (the *halo*), and a tile with its halo is worked on by itself: a task
holds one of them at a time, whatever the scan's size.  A tile without a pixel above 0 has no row; what lies beyond
the scan is 0.

Nulls in a coordinate drop the pixel; an empty table gives no tiles.  Repeated pixels count once, with the
greatest value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels of a tile's side unless stated: a tile with its halo is about a megabyte.
TILE = 1024
_KEYS = ("image", "ty", "tx")
_LONG = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _schema(image: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("image", image), T.StructField("ty", T.LongType()), T.StructField("tx", T.LongType()), T.StructField("data", T.BinaryType())])


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[*_KEYS, "data"])


def from_pixels(pixels: DataFrame, tile: int = TILE, value: str | None = None) -> DataFrame:
    """Tiles of the pixels (image, y, x), 1 each or ``value`` (1 to 255); a tile's pixels meet in one row."""
    v = F.lit(1) if value is None else F.col(value)
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    p = pixels.select("image", y.alias("y"), x.alias("x"), v.cast("int").alias("v")).dropna(subset=["y", "x", "v"]).groupBy("image", "y", "x").agg(F.max("v").alias("v"))
    cell = [F.floor(F.col(c) / tile).alias(t) for c, t in (("y", "ty"), ("x", "tx"))]
    place = (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile))).cast("int").alias("place")
    g = p.select("image", *cell, F.struct(place, "v").alias("p")).groupBy(*_KEYS).agg(F.collect_list("p").alias("p"))  # one tile's pixels
    kind = _LONG[pixels.schema["image"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own = b.column("p")[i].values
                data = np.zeros(tile * tile, np.uint8)
                data[own.field("place").to_numpy()] = own.field("v").to_numpy()
                yield _rows([(*(b.column(c)[i].as_py() for c in _KEYS), data.tobytes())], kind)

    return g.mapInArrow(run, _schema(pixels.schema["image"].dataType))


def from_arrays(images: DataFrame, decode: Callable[[bytes], np.ndarray], tile: int = TILE) -> DataFrame:
    """Tiles of images (image, content): ``decode`` gives a file's grey values, which are cut up strip by strip."""
    kind = _LONG[images.schema["image"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("image").to_pylist(), b.column("content"), strict=True):
                whole = decode(content.as_py())
                for ty in range(-(-whole.shape[0] // tile)):
                    strip, rows = whole[ty * tile : (ty + 1) * tile], []
                    for tx in range(-(-whole.shape[1] // tile)):
                        part = strip[:, tx * tile : (tx + 1) * tile]
                        if part.any():
                            rows.append((name, ty, tx, np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]))).astype(np.uint8).tobytes()))
                    yield _rows(rows, kind)

    return images.select("image", "content").mapInArrow(run, _schema(images.schema["image"].dataType))


def _strip(d: int, tile: int, halo: int) -> tuple[slice, slice]:
    """Which pixels of a tile its neighbour in direction ``d`` sees, and where they lie in that neighbour with its halo."""
    if d == 0:
        return slice(0, tile), slice(halo, halo + tile)
    return (slice(tile - halo, tile), slice(0, halo)) if d > 0 else (slice(0, halo), slice(halo + tile, tile + 2 * halo))


def worked(tiles: DataFrame, work: Callable[[np.ndarray], np.ndarray], halo: int, tile: int = TILE) -> DataFrame:
    """``work`` on every tile with its halo; it gives an array of the same shape, of which the tile's own part is kept.

    ``halo`` must be as wide as ``work`` looks, and no wider than a tile.  A tile that only has neighbours is worked on too.
    """
    if not 0 <= halo <= tile:
        raise ValueError("a halo is at most as wide as a tile")
    image = tiles.schema["image"].dataType
    kind, side = _LONG[image.simpleString()], tile + 2 * halo

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ty, tx, raw in zip(*(b.column(c).to_pylist() for c in _KEYS), b.column("data"), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint8).reshape(tile, tile)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        piece = own[_strip(dy, tile, halo)[0], _strip(dx, tile, halo)[0]]
                        if piece.any():
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((name, kind), (ty + dy, pa.int64()), (tx + dx, pa.int64()), (dy * 3 + dx, pa.int32()), (piece.tobytes(), pa.binary()))], names=[*_KEYS, "way", "data"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; one tile is held at a time."""
        now, padded = None, None

        def done() -> list[tuple]:
            out = np.ascontiguousarray(work(padded)[halo : halo + tile, halo : halo + tile]).astype(np.uint8)
            return [(*now, out.tobytes())] if out.any() else []

        for b in batches:
            for *key, way, raw in zip(*(b.column(c).to_pylist() for c in (*_KEYS, "way")), b.column("data"), strict=True):
                if now != tuple(key):
                    if now is not None:
                        yield _rows(done(), kind)
                    now, padded = tuple(key), np.zeros((side, side), np.uint8)
                dy = (way + 4) // 3 - 1
                (sy, py), (sx, px) = _strip(dy, tile, halo), _strip(way - 3 * dy, tile, halo)
                padded[py, px] = np.frombuffer(raw.as_buffer(), np.uint8).reshape(sy.stop - sy.start, sx.stop - sx.start)
        if now is not None:
            yield _rows(done(), kind)

    given = T.StructType([*_schema(image).fields[:3], T.StructField("way", T.IntegerType()), T.StructField("data", T.BinaryType())])
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.mapInArrow(hand, given).repartition(n, *_KEYS).sortWithinPartitions(*_KEYS)
    return dealt.mapInArrow(join, _schema(image))


def _kernel(size: int):
    from corymb.operators import masks

    return masks.ellipse(size)


def morphed(tiles: DataFrame, how: str, size: int, tile: int = TILE) -> DataFrame:
    """``dilated``, ``eroded``, ``opened`` or ``closed`` masks, by a filled ellipse of an odd size."""
    from corymb.operators import masks

    work = {"dilated": masks.dilate, "eroded": masks.erode, "opened": masks.opened, "closed": masks.closed}[how]
    kernel = _kernel(size)
    return worked(tiles, lambda a: work(a > 0, kernel), (size // 2) * (1 if how in ("dilated", "eroded") else 2), tile)


def thresholded(tiles: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    return worked(tiles, lambda a: a >= least, 0, tile)


def blurred(tiles: DataFrame, size: int, tile: int = TILE) -> DataFrame:
    """The mean over an odd square around each pixel, rounded down, by running sums."""

    def work(a: np.ndarray) -> np.ndarray:
        sums = np.pad(a.astype(np.int64), ((size // 2 + 1, size // 2), (size // 2 + 1, size // 2))).cumsum(0).cumsum(1)
        return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) // (size * size)

    return worked(tiles, work, size // 2, tile)


def to_runs(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """The run table (image, y, x0, x1) of the tiles' pixels above 0; runs are joined across tiles."""
    from corymb.operators.runs import merged

    image = tiles.schema["image"].dataType
    kind = _LONG[image.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ty, tx, raw in zip(*(b.column(c).to_pylist() for c in _KEYS), b.column("data"), strict=True):
                edge = np.diff(np.pad(np.frombuffer(raw.as_buffer(), np.uint8).reshape(tile, tile) > 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                y, a = np.nonzero(edge == 1)
                b_ = np.nonzero(edge == -1)[1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(y), kind), *(pa.array(c, pa.int64()) for c in (y + ty * tile, a + tx * tile, b_ + tx * tile))], names=["image", "y", "x0", "x1"])

    return merged(tiles.mapInArrow(run, T.StructType([T.StructField("image", image), *(T.StructField(c, T.LongType()) for c in ("y", "x0", "x1"))])))
