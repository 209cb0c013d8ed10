"""Sinks: tables as JSON lines or Parquet, small documents, write-once outputs, one writer at a time.

Cases and their results:
- an output that exists is never overwritten: FileExistsError or the engine's own error;
- a document appears whole or not at all;
- texts in a page cannot close its script element.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, *by: str) -> None:
    """JSON lines, in a folder per value of the given columns."""
    out = df.write.mode("errorifexists")
    (out.partitionBy(*by) if by else out).json(path)


def write_partitions(df: DataFrame, path: str, by: str = "partition") -> None:
    """Parquet with a folder per partition; rows are dealt by partition and a salt, so a large one is many files."""
    salted = df.repartition(by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(32)))
    salted.write.mode("errorifexists").partitionBy(by).parquet(path)


def partition_digests(df: DataFrame, by: str = "partition") -> DataFrame:
    """(by, rows, digest) of each partition, whatever the order and number of its files: the sum of the digests of its rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    number = F.conv(F.left(row, F.lit(15)), 16, 10).cast("decimal(38,0)")
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(number).cast("string").alias("digest"))


def write_document(path: str, value, write_once: bool = True) -> str:
    """A small value as JSON, put in place in one step; its SHA-256 comes back."""
    if write_once and os.path.exists(path):
        raise FileExistsError(path)
    data = json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True, default=str).encode()
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    return hashlib.sha256(data).hexdigest()


@contextlib.contextmanager
def single_writer(folder: str) -> Iterator[None]:
    """Only one holder at a time; a second one gets FileExistsError."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "writer.lock")
    os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    try:
        yield
    finally:
        os.unlink(path)


def fill_page(template: str, data, gallery: bool = True) -> str:
    """A template with its __DATA__ filled in; without gallery the examples are left blank."""
    if not gallery:
        data = data | {k: [] for k in ("gallery", "retry_examples") if k in data}
    text = json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/").replace("�", "?")
    return template.replace("__DATA__", text)


def document(frames: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """Small result tables (counts, rankings, samples) as one nested value for a report."""
    return {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in frames.items()}
