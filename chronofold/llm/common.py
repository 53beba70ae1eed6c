"""Reading tables, shared scratch space and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that with_groups broadcasts all, at most.
FEW_GROUPS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in local mode, where one machine has all, a temporary one is set if none is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronofold-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronofold/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again, which cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """A broadcast hint only below a counted number of narrow rows; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, few: int | None = None) -> DataFrame:
    """``rows`` with the columns of their group, null where there is none; no task gets a hot group whole.

    ``groups`` has one row per key, with the number of its rows in ``size``. Up to ``few`` groups
    (FEW_GROUPS where it is None) are broadcast. Of more, only those are that hold over a quarter of a partition's share of all
    grouped rows (four per partition at most); the others are joined by a shuffle that none of
    them can make uneven. Both tables are read twice, so they should be stored ones.
    """
    n, total = groups.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n <= (FEW_GROUPS if few is None else few):
        return rows.join(F.broadcast(groups), key, "left")
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(groups.where(F.col(size) * parts > total))
    cold = groups.where(F.col(size) * parts <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
