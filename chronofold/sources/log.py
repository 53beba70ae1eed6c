"""The event log and its snapshots as Parquet, and framed record files."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.model import event_schema

#: Events after which a snapshot is due.
SNAPSHOT_EVENTS = 10_000
SNAPSHOT_VERSION = 8
FRAME_VERSION = 5
#: Longest record that is read.
FRAME_BYTES = 256 << 20


class SequenceError(ValueError):
    """Events that do not come after those in the log."""


def read_log(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """Events, those after a sequence only: Parquet statistics prune what lies before."""
    log = spark.read.schema(event_schema()).parquet(path)
    return log if after is None else log.where(F.col("sequence") > after)


def append(events: DataFrame, path: str, strict: bool = False) -> None:
    """Adds events whose sequences are new and beyond the log's; ``strict`` allows no gap.

    The check is two aggregates; nothing is written if it fails.
    """
    spark = events.sparkSession
    try:
        last = spark.read.schema(event_schema()).parquet(path).agg(F.max("sequence")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    first, top, n, distinct = events.agg(F.min("sequence"), F.max("sequence"), F.count(F.lit(1)), F.count_distinct("sequence")).first()
    if n == 0:
        return
    if n != distinct or last is not None and first <= last:
        raise SequenceError(f"sequence {first} to {top} does not come after {last}")
    if strict and (first != (last or 0) + 1 or top - first + 1 != n):
        raise SequenceError(f"sequence {first} to {top} leaves a gap after {last}")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in event_schema()]
    events.select(*columns).sortWithinPartitions("sequence").write.mode("append").parquet(path)


def write_snapshot(tables: dict[str, DataFrame], path: str, sequence: int, taken_at: int) -> None:
    """A version directory of one Parquet table per entity, published last by a row that names it."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{path}/at-{sequence:020d}"
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{version}/{name}")
    row = [(SNAPSHOT_VERSION, sequence, taken_at, sorted(tables))]
    spark.createDataFrame(row, "schema_version int, sequence bigint, taken_at bigint, tables array<string>").coalesce(1).write.mode("append").parquet(f"{path}/published")


def read_snapshot(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame]] | None:
    """(sequence, tables) of the latest snapshot; none where there is none or it is of another version."""
    try:
        row = spark.read.parquet(f"{path}/published").orderBy(F.desc("sequence")).first()
        if row is None or row["schema_version"] != SNAPSHOT_VERSION:
            return None
        return row["sequence"], {t: spark.read.parquet(f"{path}/at-{row['sequence']:020d}/{t}") for t in row["tables"]}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None  # the log alone is enough
        raise


def snapshot_due(latest: int, taken: int | None, threshold: int = SNAPSHOT_EVENTS) -> bool:
    return latest - (taken or 0) >= threshold


# -- framed files ---------------------------------------------------------------------------------

_HEAD = struct.Struct("<III")
FRAMES = "file string, offset long, sequence long, event string, problem string"


def frame(sequence: int, event: dict) -> bytes:
    """A record: version, length and CRC-32 as little-endian numbers, then JSON."""
    body = json.dumps({"sequence": sequence, **event}, sort_keys=True).encode()
    return _HEAD.pack(FRAME_VERSION, len(body), zlib.crc32(body)) + body


def frames(data: bytes) -> Iterator[tuple[int, int | None, str | None, str | None]]:
    """(offset, sequence, event, problem) of each record; a problem ends the file."""
    at, last = 0, None
    while at < len(data):
        if at + _HEAD.size > len(data):
            yield at, None, None, "partial_header"
            return
        version, size, crc = _HEAD.unpack_from(data, at)
        body = data[at + _HEAD.size : at + _HEAD.size + size]
        if version != FRAME_VERSION:
            problem = "version"
        elif size > FRAME_BYTES:
            problem = "too_long"
        elif len(body) < size:
            problem = "partial_payload"
        elif zlib.crc32(body) != crc:
            problem = "crc"
        else:
            problem = None
        if problem is None:
            try:
                sequence = json.loads(body)["sequence"]
                problem = "sequence" if last is not None and sequence <= last else None
            except (ValueError, KeyError, TypeError):
                problem = "decode"
        if problem:
            yield at, None, None, problem
            return
        yield at, sequence, body.decode(), None
        last, at = sequence, at + _HEAD.size + size


def scan_frames(spark: SparkSession, path: str) -> DataFrame:
    """Records of framed files, one file to a row at first; the tail after a problem is one row that names it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, *r) for r in frames(bytes(data))]
                yield pd.DataFrame(rows, columns=["file", "offset", "sequence", "event", "problem"]).astype({"sequence": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, FRAMES)


def repaired(scanned: DataFrame, strict: bool = True) -> DataFrame:
    """Valid records. ``strict`` raises on any problem; else the tail behind one is left out."""
    if strict:
        scanned = scanned.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("damaged log: "), "problem", F.lit(" at "), F.col("offset").cast("string")))).otherwise(F.lit(True)))
    return scanned.where("problem is null")


def tail(scanned: DataFrame) -> DataFrame:
    """Per file: last valid sequence and, of a damaged file, where its valid part ends and why."""
    return scanned.groupBy("file").agg(
        F.max("sequence").alias("last_sequence"), F.max(F.when(F.col("problem").isNotNull(), F.col("offset"))).alias("valid_bytes"), F.max("problem").alias("problem")
    )
