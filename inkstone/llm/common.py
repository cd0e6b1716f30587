"""Shared helpers: scratch tables, word splitting, ordered numbering, text buffers.

Words everywhere are maximal runs of characters other than space and the controls 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where that is unset, a fresh folder of this machine, but only if
    all of Spark runs in this process; a cluster could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/inkstone"


_TEMPORARY: list[list[str]] = []


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many marks behind it as make it none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls and their places included; columns that hold maps by their text."""
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*cols, F.array(*[F.col(f"`{c}`").isNull() for c in docs.columns]))


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize made and that nothing will read again."""
    _delete(tables[0].sparkSession, {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()})


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize makes within are deleted at the end: nothing that is used later may read them."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        _delete(spark, _TEMPORARY.pop())


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where lambdas inside body use it many times."""
    return F.transform(F.array(value), body)[0]


def with_position(df: DataFrame, order: list[str], position: str, label: str) -> DataFrame:
    """Number all rows 0, 1, ... by the order columns (nulls first) without gathering them: ranges are numbered
    in parallel and then shifted by the sizes of the ranges before them. Ties are numbered in any order."""
    seq, part, before = (unused(n, [*df.columns, position]) for n in ("seq", "part", "before"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(seq, F.monotonically_increasing_id())
    numbered = materialize(ranged, label).withColumn(part, F.shiftright(seq, 33))
    sizes = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))  # one row for each range
    return numbered.join(F.broadcast(starts), part).withColumn(position, F.col(before) + F.col(seq).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, seq, before)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Hand memory that Arrow and the C library hold free to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(job: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A mapInArrow function that gives memory back when a task ends: Spark's Python workers live on, and what they hold free counts as long."""

    @wraps(job)
    def run(batches: Batches) -> Batches:
        try:
            yield from job(batches)
        finally:
            give_back()

    return run


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow string column, and the offsets of each (one more than rows); nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offs) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes; a longer row has a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def doc_crc32(column: Column) -> Column:
    """crc32 of the decimal text of an id, as the fold rules ask for; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
