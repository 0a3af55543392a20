"""Text outputs: one ordered file with its header, written aside and moved into place."""

from __future__ import annotations

import gzip
import os
import shutil
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, OutputError, PublicationError


def distinct_paths(*paths: str) -> None:
    real = [os.path.realpath(p) for p in paths if p]
    if len(set(real)) != len(real):
        raise ConfigurationError("inputs and outputs must be different files")


def matrix_paths(path: str) -> tuple[str, str]:
    """Where the level and the count matrix go when both are asked for: the word stands before the
    suffix (.bed, .gz, .bgz, or .bed.gz and so on)."""
    stem, tail = path, ""
    for suffix in (".gz", ".bgz"):
        if stem.endswith(suffix):
            stem, tail = stem[: -len(suffix)], suffix
            break
    if stem.endswith(".bed"):
        stem, tail = stem[:-4], ".bed" + tail
    return f"{stem}.level{tail}", f"{stem}.count{tail}"


def write_text(rows: DataFrame, path: str, order: list, header: Iterable[str] = (), compress: bool = False) -> None:
    """Rows (one string column ``row`` besides those of ``order``) as one sorted file.

    Sorting and rendering are distributed: range-partitioned parts are written in parallel, and the
    driver only strings the finished parts together behind the header. The old file is replaced in one
    step or not at all.
    """
    aside = f"{path}.{uuid.uuid4().hex}"
    parts = aside + ".parts"
    try:
        rows.orderBy(*order).select(F.col("row").alias("value")).write.text(parts)
        opened = gzip.open(aside, "wb", 1) if compress else open(aside, "wb")
        with opened as out:
            for line in header:
                out.write(line.encode() + b"\n")
            for name in sorted(os.listdir(parts)):
                if name.startswith("part-"):
                    with open(f"{parts}/{name}", "rb") as part:
                        shutil.copyfileobj(part, out)
        os.replace(aside, path)
    except OSError as error:
        raise OutputError(str(error)) from error
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        if os.path.exists(aside):
            os.remove(aside)


def publish(staged: list[tuple[str, str]]) -> None:
    """Move several finished files into place together; on failure those moved are put back."""
    done: list[tuple[str, str | None]] = []
    try:
        for source, target in staged:
            kept = None
            if os.path.exists(target):
                kept = f"{target}.{uuid.uuid4().hex}"
                os.replace(target, kept)
            done.append((target, kept))
            os.replace(source, target)
    except OSError as error:
        for target, kept in reversed(done):
            if kept:
                os.replace(kept, target)
            elif os.path.exists(target):
                os.remove(target)
        raise PublicationError(str(error)) from error
    for _, kept in done:
        if kept:
            os.remove(kept)


def tabbed(*columns) -> Column:
    return F.concat_ws("\t", *[c.cast("string") if not isinstance(c, str) else F.col(c).cast("string") for c in columns]).alias("row")
