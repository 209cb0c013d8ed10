"""Files as tables: numbered lines, inventories, snapshots by content, and what changed since the last run.

Cases and their results:
- a path without files: no rows, and an issue in `issues`;
- an empty file has no lines; a last line without line end counts;
- gzip files are read as their content and are one split each;
- a file that is listed twice counts once.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, file_name, line, value) of all lines below the paths, with their physical numbers from 1.

    A large file is read in splits. The lines of a split are numbered as they come, and the lines of the splits before
    it in its file are added, so the texts themselves are never shuffled: the two scans differ only in that the first
    one counts. Only line feeds end a line, as a carriage return may stand inside a text.
    """
    paths = [paths] if isinstance(paths, str) else paths
    scan = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(paths)
    at = scan.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value"
    )
    counts = at.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per split
    start = counts.select(F.col("file").alias("_f"), F.col("split").alias("_s"), (before - F.col("first")).alias("shift"))
    out = at.join(start, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    return out.select("file", "file_name", (F.col("id") + F.col("shift") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def session_name(file_name: Column) -> Column:
    """The session of a transcript: its file's name without the ending."""
    return F.regexp_replace(file_name, r"\.jsonl(\.gz)?$", "")


def marked_files(rows: DataFrame, marker: str) -> DataFrame:
    """(file, instructed): whether any line of a file holds a sentence."""
    return rows.groupBy("file").agg(F.bool_or(F.contains("value", F.lit(marker))).alias("instructed"))


def older_than(names: Iterable[str], before: str, prefix: str = "rollout-") -> list[str]:
    """The file names whose date, if their name begins with the prefix, is before a day; other files are all kept. Pruning by name, ahead of any scan."""
    return [n for n in names if not os.path.basename(n).startswith(prefix) or os.path.basename(n)[len(prefix) : len(prefix) + 10] < before]


def inventory(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """(kind, path, size, modified_us) of the files below the roots of each kind; a path counts once, for the first kind in order of name. Contents are not read."""
    out = None
    for kind in sorted(roots):
        there = [r for r in roots[kind] if os.path.exists(r) or "://" in r]
        if there:
            one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select(F.lit(kind).alias("kind"), "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "kind string, path string, size long, modified_us long")
    return out.groupBy("path").agg(F.min_by(F.struct("kind", "size", "modified_us"), "kind").alias("_x")).select("_x.kind", "path", "_x.size", "_x.modified_us")


def issues(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """(kind, root, issue): roots that are missing or hold no file."""
    found = [(k, r, "missing_source_root" if not os.path.exists(r) else "no_matching_files") for k in sorted(roots) for r in roots[k] if not os.path.exists(r) or os.path.isdir(r) and not any(f for _, _, f in os.walk(r))]
    return spark.createDataFrame(found, "kind string, root string, issue string")


FINGERPRINT = ["path", "size", "modified_us"]


def changed(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files of an inventory that no run has seen as they are: a changed size or time makes a file new."""
    return now.join(manifest.select(*FINGERPRINT).distinct(), FINGERPRINT, "left_anti")


def snapshot(spark: SparkSession, paths: list[str], out: str | None = None) -> DataFrame:
    """(path, size, sha256): the files by their content; with out, each distinct content is written once under its hash.

    The hash is taken over the bytes that were read, so a file that grows meanwhile is a consistent prefix of itself.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    hashed = files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    if out:
        hashed.groupBy("sha256").agg(F.min_by("content", "path").alias("content")).write.mode("errorifexists").parquet(out)
    return hashed.drop("content")


def verified(spark: SparkSession, path: str, expected: str) -> str:
    """The path of a (gzip) file whose content has the expected SHA-256; ValueError otherwise. The content is read in pieces."""
    sha, unzip = hashlib.sha256(), zlib.decompressobj(31)
    with open(path, "rb") as f:
        zipped = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        while piece := f.read(1 << 20):
            sha.update(unzip.decompress(piece) if zipped else piece)
    if zipped:
        sha.update(unzip.flush())
    if sha.hexdigest() != expected:
        raise ValueError(f"content of {path} is not what was recorded")
    return path


# ---- SQLite stores

#: tables that may be exported; all others, such as those of credentials, never are
TABLES = ("session", "session_v2", "message", "part", "session_message", "blobs")
ROWS = "file string, tbl string, place long, id string, row string"


def _export(path: str, tables: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of one store in one read transaction; messages and parts in one order of time, table and id."""
    import json
    import sqlite3

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        con.execute("BEGIN")
        there = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}

        def read(t: str) -> Iterator[dict]:
            cur = con.execute(f'SELECT * FROM "{t}"')
            names = [c[0] for c in cur.description]
            for r in cur:
                yield {n: v.decode("utf-8", "replace") if isinstance(v, bytes) else v for n, v in zip(names, r)}

        place = 0
        for t in (t for t in tables if t in there and t not in ("message", "part")):
            for row in read(t):
                yield path, t, place, str(row.get("id")), json.dumps(row, ensure_ascii=False)
                place += 1
        both = [(row.get("time_created") or 0, t, str(row.get("id")), row) for t in ("message", "part") if t in there and t in tables for row in read(t)]
        for _, t, i, row in sorted(both, key=lambda x: x[:3]):
            yield path, t, place, i, json.dumps(row, ensure_ascii=False)
            place += 1
    finally:
        con.close()


def sqlite_rows(spark: SparkSession, paths: list[str], tables: tuple[str, ...] = TABLES) -> DataFrame:
    """(file, tbl, place, id, row) of the allowed tables of SQLite files on a shared path, a task per file; row is JSON."""
    wrong = set(tables) - set(TABLES)
    if wrong:
        raise ValueError(f"tables that are not exported: {sorted(wrong)}")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held: list[tuple] = []
                for r in _export(path, tables):
                    held.append(r)
                    if len(held) == 10_000:
                        yield pack(held)
                        held = []
                yield pack(held)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=[x.split()[0] for x in ROWS.split(", ")])

    files = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    return files.repartition(max(1, len(paths)), "path").mapInArrow(go, ROWS)


def gather(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all sources in the order given, failures): a source that cannot be planned, such as one whose folder is missing, leaves the others alone.

    Columns that a source lacks are null there.
    """
    out, failed = None, {}
    for name, read in readers.items():
        try:
            rows = read()
        except Exception as e:  # whatever keeps one source from being read is reported
            failed[name] = f"{type(e).__name__}: {e}".splitlines()[0][:200]
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, failed
