"""Helpers around ``mapInArrow`` that keep memory to a slice of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed to a Python function at a time, and characters after which a slice ends early.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most SLICE_ROWS rows and about SLICE_BYTES of column ``text``."""
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            rows = min(SLICE_ROWS, n - at)
            part = batch.slice(at, rows)
            while text is not None and rows > 1 and part.column(text).nbytes > SLICE_BYTES:
                rows = (rows + 1) // 2
                part = batch.slice(at, rows)
            yield part
            at += rows


def tidy(run: Callable, *clear: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which at a task's end empties caches and gives memory back.

    Python workers live on between tasks and stages; what one operator remembers must not add to the next
    one's needs.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            for c in clear:
                c()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return tidied


def map_slices(df: DataFrame, fn: Callable, schema: StructType, text: str | None = None) -> DataFrame:
    """Apply ``fn(slice as dict of lists) -> dict of columns`` to each slice of ``df``."""
    arrow = to_arrow_schema(schema)
    names = df.columns
    text_at = names.index(text) if text else None

    def run(batches):
        for part in slices(batches, text_at):
            out = fn({k: c.to_pylist() for k, c in zip(names, part.columns)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def held_out(doc_id):
    """True for documents whose labels must not be learned from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def size_checked(small: DataFrame, limit: int) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows; else left to a shuffled join."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """A column name for each of ``bases`` that no column of ``df`` has, in either case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in bases:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
