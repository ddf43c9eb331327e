"""As-of join: each row with the last row of another table at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathmark.operators.stretches import STRETCH, carried


def asof_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], at: str, right_at: str, within: int | None = None, block: int = STRETCH
) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` at or before it, of the same key; nulls where there is none.

    Places are whole numbers. Of rows of ``right`` at one place the greatest counts. ``within``: how far back it may lie. Columns of ``right`` other than the key
    follow those of ``left``, whose names they must not share. Rows of ``left`` that repeat stay.

    No join of places: both tables run side by side in blocks of ``block`` places, and each block's last row of ``right`` is carried on to the next ones.
    """
    more = [c for c in right.columns if c not in key]
    clash = set(more) & set(left.columns)
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}")
    row = F.struct(*left.columns)
    found = F.struct(F.col(right_at).alias("place"), F.struct(*more).alias("own"))
    kinds = {"row": left.select(row.alias("r")).schema["r"].dataType, "found": right.select(found.alias("r")).schema["r"].dataType}
    one = left.select(*key, F.col(at).cast("long").alias("at"), F.lit(1).alias("side"), row.alias("row"), F.lit(None).cast(kinds["found"]).alias("found"))
    two = right.where(F.col(right_at).isNotNull()).select(
        *key, F.col(right_at).cast("long").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(kinds["row"]).alias("row"), found.alias("found")
    )
    both = one.unionByName(two).withColumn("block", F.coalesce(F.floor(F.col("at") / F.lit(block)), F.lit(-(1 << 60))))
    last = carried(both, key, "block", ["at", "side", "found"], last=("last", F.col("found"))).where("side = 1")
    if within is not None:
        last = last.withColumn("last", F.when(F.col("at") - F.col("last.place") <= within, F.col("last")))
    return last.select("row.*", *[F.col(f"last.own.{c}").alias(c) for c in more])
