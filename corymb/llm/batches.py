"""Columns made in Python from whole record batches; everything else passes through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corymb.llm.shared import small_batches


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], added: T.StructType, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop``, with the columns that ``make`` builds from each batch of all its columns."""
    small_batches(df.sparkSession)
    gone = {c.lower() for c in drop}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    schema = T.StructType([df.schema[i] for i in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *make(b)], names=schema.names)

    return df.mapInArrow(run, schema)
