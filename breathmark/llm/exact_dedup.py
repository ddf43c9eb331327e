"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty


def content_hash(sha256_hex: Column) -> Column:
    """The first 128 bits of a SHA-256."""
    return F.unhex(F.substring(sha256_hex, 1, 32))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the smallest
    (``keep='min'``) or largest (``'max'``) id stays. Rows that repeat an id together with its text are one
    document: they count in ``group_size`` and share ``kept``. A null id never stays unless its whole group has
    none, and then ``keep_id`` is null and ``kept`` false. Other columns of ``df`` are not read. An empty table
    gives an empty result.

    The texts are shuffled once, by hash, and only after each task has merged its own copies, so a group of any
    size sends one row per task. The grouping key is (hash, text): equality of bytes is what forms a group, the
    hash only deals the groups out. Rows find their group again by the hash alone, as a slim join that adaptive
    execution can split. Should two texts ever share a hash, the rows of those hashes join on their bytes.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_t"), F.sha2(text, 256).alias("_sha"))
    rows = rows.withColumn("_h", hash_of(F.col("_sha")))
    pick = F.min if keep == "min" else F.max
    groups = durable(
        rows.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep")).drop("_t")
    )
    shared = groups.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_h")
    copied = groups.where("_n > 1")
    slim = rows.select("_id", "_h", "_sha")
    if shared.isEmpty():
        linked = slim.join(copied, "_h", "left")
    else:
        apart = slim.join(shared, "_h", "left_anti").join(copied, "_h", "left")
        exact = rows.join(shared, "_h", "left_semi")
        whole = exact.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep"))
        linked = apart.select("_id", "_sha", "_n", "_keep").unionByName(
            exact.join(whole, ["_h", "_t"]).select("_id", "_sha", "_n", "_keep")
        )
    alone = F.col("_n").isNull()
    keep_id = F.when(alone, F.col("_id")).otherwise(F.col("_keep"))
    return linked.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == keep_id, F.lit(False)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
