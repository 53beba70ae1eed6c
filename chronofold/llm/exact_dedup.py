"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import broadcast_if_small, fresh_name, materialize, text_or_empty, with_groups


def content_hash(text: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def _keeper(rows: DataFrame, keys: list[str], largest: bool) -> DataFrame:
    """Per group of equal texts: the row that stays and the group's size.

    Partial aggregation runs before the shuffle, so a hot group arrives as a row per task.
    Null ids stay only where a group has no other; of rows that repeat an id, the first.
    """
    order = F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), (-F.col("_row")).alias("row"))
    if not largest:
        order = F.struct(F.col("_id").isNull().alias("known"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    best = F.max(order) if largest else F.min(order)
    return rows.groupBy(*keys).agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))


def _assign(rows: DataFrame, key: str, largest: bool) -> DataFrame:
    groups = materialize(_keeper(rows, [key], largest).where("group_size > 1"), "exact-groups")
    joined = with_groups(rows, groups, key, "group_size")
    kept_row = F.abs(F.col("_best.row"))
    return joined.select(
        F.col("_row"), F.col("_id"),
        F.when(F.col("_best").isNull(), F.col("_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1).cast("long")).alias("group_size"),
        (F.col("_best").isNull() | (F.col("_row") == kept_row)).alias("kept"),
        F.col("text_sha256"),
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. ``keep`` names which
    id of a group stays, smallest or largest. Null ids lose to any id; of rows that repeat
    both id and text one stays. Other columns of ``docs`` are ignored; an empty table gives
    no rows.

    The groups form on the hash alone, over narrow rows. Then the texts of groups with more
    than one row are grouped by hash *and* bytes, with partial aggregation, which shows any
    hash that stands for two texts; the rows of such a hash are grouped by their bytes.
    """
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return _verdicts(texts, keep, hash_of).drop("_row").withColumnRenamed("_id", id_col)


def _verdicts(texts: DataFrame, keep: str, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The verdict on each row (_id, _text, _row), with its _row."""
    largest = keep == "largest"
    hashed = texts.withColumn("_hash", hash_of(F.col("_text")))
    rows = materialize(hashed.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"), "_row"), "exact-rows")
    repeated = materialize(rows.groupBy("_hash").count().where("count > 1").select("_hash"), "exact-hashes")
    members = hashed.join(broadcast_if_small(repeated, repeated.count()), "_hash", "left_semi")
    collided = (
        members.groupBy("_hash", "_text").agg(F.lit(1).alias("one"))
        .groupBy("_hash").agg(F.count(F.lit(1)).alias("texts"))
        .where("texts > 1").select("_hash")
    )
    collided = materialize(collided, "exact-collisions")
    if collided.isEmpty():
        return _assign(rows, "_hash", largest)
    clean = materialize(rows.join(collided, "_hash", "left_anti"), "exact-clean")
    mixed = hashed.join(collided, "_hash", "left_semi").select("_id", "_text", F.sha2("_text", 256).alias("text_sha256"), "_row")
    return _assign(clean, "_hash", largest).unionByName(_assign(materialize(mixed, "exact-mixed"), "_text", largest))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Repeated rows (the same id and text) are dropped to one as well.
    """
    row = fresh_name(docs, "_row")
    rows = materialize(docs.select("*", F.monotonically_increasing_id().alias(row)), "exact-docs")
    texts = rows.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.col(row).alias("_row"))
    gone = materialize(_verdicts(texts, keep).where(~F.col("kept")).select(F.col("_row").alias(row)), "exact-gone")
    return rows.join(broadcast_if_small(gone, gone.count(), 2_000_000), row, "left_anti").drop(row)
