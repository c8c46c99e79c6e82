"""Helpers shared by the operators: folds, blocks of texts, tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arboris.storage import shared_dir, staged  # noqa: F401  the operators take them from here

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that Spark hands to Python at a time; a longer row is alone.
BATCH = 4 << 20


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python at most BATCH bytes of rows at a time. Spark's
    own bound of 64 MB is held several times over by each task, outside the heap and in its worker."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = conf.get(name).lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH:
        conf.set(name, str(BATCH))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with more underscores that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The C library's way to give idle memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Memory that Arrow and the C library hold idle goes back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_blocks(column: pa.Array, size: int = 400_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """A column of texts in runs (start, end, texts) of about ``size`` bytes, so that what is made of
    them stays in a few MB; a longer text is alone. Memory that Arrow holds idle is given back."""
    length = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = total = 0
    for i, n in enumerate(length.tolist()):
        if total and total + n > size:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(length):
        yield start, len(length), column.slice(start).to_pylist()
    give_back()
