"""Line deduplication by overlapping three-line windows that repeat anywhere in the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Consecutive lines that make a window.
WINDOW = 3


def _windows(text: Column) -> Column:
    """array<struct<at, lines, h1, h2>>: each window of WINDOW consecutive lines that are not blank."""
    lines = F.filter(
        F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("x"))),
        lambda p: p.x.rlike(r"[^\x20\x09-\x0D]"),
    )

    def window(j: Column, all_lines: Column) -> Column:
        own = [F.get(all_lines, j + k) for k in range(WINDOW)]
        texts = [p.x for p in own]
        return F.struct(
            j.alias("at"),
            F.array(*[p.i for p in own]).alias("lines"),
            F.xxhash64(*texts).alias("h1"),
            F.xxhash64(texts[-1], F.lit(1), *texts[:-1]).alias("h2"),
        )

    # A one-element array carries the lines into the lambda, so that they are built once for each text.
    made = F.transform(
        F.array(lines),
        lambda all_lines: F.when(
            F.size(all_lines) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(all_lines) - WINDOW), lambda j: window(j, all_lines)),
        ),
    )
    return F.get(made, F.lit(0))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` cut down, and the number of lines ``lines_removed`` from it.

    A window is three consecutive lines of a text, blank lines passed over; windows are equal when their lines'
    bytes are (by a 128-bit hash). Of equal windows the one first by (id, place) is the first occurrence. All lines that
    later ones cover go, but for lines that the same window's first occurrence shares with them; also where another window's
    first occurrence covers them. Each such line has an equal one earlier, and the earliest of these is covered by no
    later occurrence, so no line's content is lost. Blank lines always stay. Texts of fewer than three lines have no window and never change; a
    null text stays null; a text all of whose lines go becomes empty. Rows that repeat an id and its text are one
    document and are all cut alike; a null id sorts first. An empty table gives an empty result. Other columns pass
    through; ``lines_removed`` replaces a column of that name.

    Texts of any length are looked at whole. Window hashes are merged within each task before they are dealt out, and the
    join back is one that adaptive execution splits where a window is hot. Texts move once, to meet their covered lines.
    """
    own = [c for c in df.columns if c != "lines_removed" or c == text_col]
    # The row is one value while it is joined, so names of its columns can't clash with those made here.
    keyed = df.select(
        F.struct(*[quoted(c) for c in own]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k"),
    )
    windows = keyed.select("_id", "_k", F.inline(_windows(F.col("_text")))).select(
        F.struct("_id", "_k", "at").alias("_place"), "lines", "h1", "h2"
    )
    repeated = (
        windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")).where("_n > 1")
    )
    later = windows.join(repeated, ["h1", "h2"]).where(~F.col("_place").eqNullSafe(F.col("_first")))
    one_text = F.col("_place._id").eqNullSafe(F.col("_first._id")) & (F.col("_place._k") == F.col("_first._k"))
    shared = F.when(one_text, F.greatest(F.lit(0), F.col("_first.at") + WINDOW - F.col("_place.at"))).otherwise(0)  # lines of both
    later = later.select("_place", F.slice("lines", shared + 1, WINDOW).alias("lines"))
    covered = (
        later.groupBy(F.col("_place._id").alias("_cid"), F.col("_place._k").alias("_ck"))
        .agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("_cut")).where(F.size("_cut") > 0)
    )
    joined = keyed.select("_row", "_id", "_k").join(covered, (F.col("_k") == F.col("_ck")) & F.col("_id").eqNullSafe(F.col("_cid")), "left")
    lines = F.split(F.col("_row").getField(text_col), "\n", -1)
    joined = joined.select("_row", "_cut", F.when(F.col("_cut").isNotNull(), lines).alias("_lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cut")), lambda i: F.get(F.col("_lines"), i))
    text = F.when(F.col("_cut").isNull(), F.col("_row").getField(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in own],
        F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut")).alias("lines_removed"),
    )
