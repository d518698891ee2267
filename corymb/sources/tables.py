"""Sources and sinks of the specimen tables: CSV dialects, image files, optional inputs, exact lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corymb.functions.scalars import half_even, lenient_double
from corymb.functions.scalars import scientific as as_scientific

#: Fixed schemas of the published tables; all text on disk, blank for missing.
SCHEMAS = {
    "field_metadata": "date string, island string, no int, lat double, lon double, id int, collar int, organ string, status string",
    "medial_traits": "sheet string, corolla_id string, fold_state string, corolla_length_mm double, corolla_width_obs_mm double, corolla_area_obs_mm2 double, corolla_width_fulleq_mm double, corolla_area_fulleq_mm2 double, roi_angle_deg double, roi_fill_ratio double, nectar_guide_px int, has_nectar_guide int, qc_flag string",
    "photo_traits": "sheet string, corolla_id string, iphone_file string, match_iou double, corolla_length_mm double, corolla_width_obs_mm double, corolla_area_obs_mm2 double, corolla_width_fulleq_mm double, corolla_area_fulleq_mm2 double, fold_state string",
    "guide_traits": "sheet string, corolla_id string, guide_coverage_pct double, has_nectar_guide int",
    "organ_traits": "sheet string, corolla_id string, organ_length_mm double, organ_skeleton_mm double, organ_width_mm double, has_organ int",
    "flowers": "sheet string, corolla_id string, fold_state string, corolla_length_mm double, corolla_width_obs_mm double, corolla_area_obs_mm2 double, corolla_width_fulleq_mm double, corolla_area_fulleq_mm2 double, roi_source string, match_iou double, has_nectar_guide int, guide_coverage_pct double, organ_length_mm double, qc_flag string",
    "index": "global_id int, island string, sheet string, sheet_corolla_id string, corolla_length_mm double, corolla_width_obs_mm double, guide_coverage_pct double, organ_length_mm double",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_csv(spark: SparkSession, path: str, kind: str | T.StructType) -> DataFrame:
    """CSV with a header, with or without a byte-order mark, either line end; blanks and ``nan`` are null."""
    wanted = schema(kind) if isinstance(kind, str) else kind
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
    d = spark.read.schema(text).csv(path, header=True, enforceSchema=True)
    cast = lambda f: lenient_double(F.col(f.name)) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).try_cast(f.dataType)
    return d.select(*(cast(f).alias(f.name) for f in wanted))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def first_existing(spark: SparkSession, *paths: str) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def optional_csv(spark: SparkSession, path: str, kind: str | T.StructType) -> DataFrame:
    """The table, or one without rows where the file is missing."""
    wanted = schema(kind) if isinstance(kind, str) else kind
    return read_csv(spark, path, wanted) if exists(spark, path) else spark.createDataFrame([], wanted)


def images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "ppm", "pgm")) -> DataFrame:
    """(stem, path, content) of image files below a folder; bytes are decoded where they are used."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = d.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("_s"), "path", "content")
    return named.where(F.col("_s").isin(*suffixes)).drop("_s")


def exif_orientation(head: bytes) -> int:
    """The orientation (1 to 8) that a JPEG's first bytes state; 1 if they state none."""
    at = 2
    while head[:2] == b"\xff\xd8" and at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] != 0xDA:
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            body = head[at + 10 : at + 2 + size]
            order = "little" if body[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(body[i : i + n], order)  # noqa: E731, B023
            first = number(4, 4)
            for i in range(number(first, 2)):
                entry = first + 2 + 12 * i
                if number(entry, 2) == 0x0112:
                    found = number(entry + 8, 2)
                    return found if 1 <= found <= 8 else 1
        at += 2 + size
    return 1


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """An array as its EXIF orientation wants it seen."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path, h, w, rgb) of JPEG, PNG, GIF and BMP files: Spark's image source decodes, EXIF turns.

    ``rgb`` is three bytes a pixel, row by row.  Files that can't be decoded are left out.  HEIC has no decoder here.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    decoded = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path).select(plain("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(plain("path").alias("path"), F.substring("content", 1, 1 << 16).alias("head"))
    both = decoded.join(heads, "path").select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "path", "h", "w", "n", "data", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["n"])
                rgb = oriented(np.repeat(a, 3, 2) if r["n"] == 1 else a[..., 2::-1], exif_orientation(r["head"]))
                yield pa.RecordBatch.from_pylist([{"stem": r["stem"], "path": r["path"], "h": rgb.shape[0], "w": rgb.shape[1], "rgb": rgb.tobytes()}], pa.schema([("stem", pa.string()), ("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("rgb", pa.binary())]))

    return both.mapInArrow(run, "stem string, path string, h int, w int, rgb binary")


def write_csv(df: DataFrame, path: str, *, bom: bool = False, files: int | None = 1) -> None:
    """One CSV file with a header, for tables of published size; ``bom`` marks it as UTF-8 for spreadsheets.

    Without ``files`` each task writes its own, for tables of any size: what makes the rows isn't drawn into one task.
    """
    out = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
    (out.coalesce(files) if files else out).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet, replaced as a whole: stale output never survives a run."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """A file for each row of bytes, in parallel, in a folder that all executors reach: a shared path, HDFS or an object store."""

    def put(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for r in rows:
            target = f"{root}/{r[name]}"
            store.create_dir(target.rpartition("/")[0], recursive=True)
            with store.open_output_stream(target) as f:
                f.write(bytes(r[content]))

    df.select(name, content).foreachPartition(put)


def formatted(df: DataFrame, fixed: dict[str, int], scientific: tuple[str, ...] = ()) -> DataFrame:
    """Numbers as a report shows them, rounded half to even; only at the very end."""
    return df.withColumns({**{c: half_even(F.col(c), n) for c, n in fixed.items()}, **{c: as_scientific(F.col(c)) for c in scientific}})
