"""Reading recordings from numeric text files, and writing results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breathmark.config import Config
from breathmark.operators import stretches
from breathmark.schema import CHANNELS, LABEL, LABELS, REC

#: Splits up to which a row for each is broadcast, and the most that one task of a scan holds.
SPLITS, FILES = 1_000_000, 64
#: Lines of a part of a recording that is written in parts.
PART = 1 << 18
#: Names of files, or of the folders that they lie in, carry the recording's key; the last one counts.
NAME = r".*Sub(\d+)_Pom(\d+)"
#: Folders of a recording's parts, which follow one another by number.
PART_NAME = r"-part(\d+)/[^/]*$"


def file_name(subject: int | str, condition: int | str) -> str:
    return f"ECG1_ECG2_SpO2_RespL_BP_RespD_fs200_Sub{subject}_Pom{condition}_DeTr_Norm.dat"


def file_names(subjects: Iterable[int], conditions: Iterable[int]) -> list[str]:
    """Every subject under every condition."""
    own = list(conditions)
    return [file_name(s, c) for s in subjects for c in own]


def clean(x: Column) -> Column:
    """NaN becomes null, so that aggregates leave it out and comparisons are not true."""
    return F.nanvl(x, F.lit(None).cast("double"))


def read_recordings(spark: SparkSession, paths: str | list[str], layout: str = "wide") -> DataFrame:
    """``signals`` of headerless numeric text files, one recording each.

    ``layout``: ``wide`` has a row of six numbers for each sample, ``channel_major`` all samples of the first channel,
    then of the second, and so on. Fields are parted by white space or commas; what isn't a number is null. A file
    whose numbers don't fill six channels fails. Order within a file is the order of its lines. Two files of one
    subject and condition are an error, since nothing says which goes first, unless they are numbered parts (PART_NAME) as write_recordings makes them.

    A file is read in splits, by as many tasks as it has: each split numbers its own lines, or numbers, and starts from how many the splits
    before it hold. So the files are read twice, the first time to be counted.
    """
    if layout not in ("wide", "channel_major"):
        raise ValueError(f"unknown layout {layout!r}")
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.where(F.trim("value") != "") if layout == "wide" else lines
    fields = F.filter(F.split("value", r"[\s,]+"), lambda x: x != "")
    items = lines.select("path", "at", fields.alias("f")) if layout == "wide" else lines.select("path", "at", F.explode(fields).alias("f"))
    rows = _numbered(items)
    width = len(CHANNELS)
    if layout == "wide":
        checked = F.when(F.size("f") == width, F.col("f")).otherwise(F.raise_error(F.lit("a line does not have six numbers")))
        rows = rows.select(*REC, "k", checked.alias("f"))
        return rows.select(*REC, "k", *[clean(F.col("f")[i].try_cast("double")).alias(c) for i, c in enumerate(CHANNELS)])
    n = F.when(F.col("n") % width == 0, (F.col("n") / width).cast("long")).otherwise(F.raise_error(F.lit("numbers do not fill six channels")))
    spread = rows.select(*REC, (F.col("k") % n).alias("k"), F.floor(F.col("k") / n).alias("channel"), clean(F.col("f").try_cast("double")).alias("x"))
    # Dealt out first: a split is of one channel or two, so a task that merged its rows before would hold a row for each number and send as many.
    return stretches.spread(spread, *REC, "k").groupBy(*REC, "k").agg(*[F.max(F.when(F.col("channel") == i, F.col("x"))).alias(c) for i, c in enumerate(CHANNELS)])


def _numbered(items: DataFrame) -> DataFrame:
    """``items`` of a text scan with their recording's key, their number ``k`` in the file and how many ``n`` it has.

    A split's items stand together in the order of the scan's running ids. There is a row of some fifty bytes for each split; up to SPLITS of them are
    broadcast, told by the scan's tasks, which hold FILES splits each at most.
    """
    items = items.withColumn("id", F.monotonically_increasing_id())
    splits = items.groupBy("path", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    part = F.coalesce(F.regexp_extract("path", PART_NAME, 1).try_cast("long"), F.lit(-1))  # -1: a whole file
    keyed = splits.select(*_key("path"), part.alias("part"), "path", "at", "first", "size")
    order = Window.partitionBy(*REC).orderBy("part", "at")
    whole = Window.partitionBy(*REC)
    own = Window.partitionBy(*REC, "part")
    one = (F.min("path").over(own) == F.max("path").over(own)) & ((F.min("part").over(whole) >= 0) | (F.max("part").over(whole) < 0))
    same = F.when(one, F.lit(0)).otherwise(
        F.raise_error(F.format_string("more than one file of subject %d, condition %d, one of them %s", *REC, F.min("path").over(own)))
    )
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keyed.select(*REC, F.xxhash64("path").alias("file"), F.col("at").alias("split"), (before - F.col("first") + same).alias("shift"), F.sum("size").over(whole).alias("n"))
    if items.rdd.getNumPartitions() * FILES <= SPLITS:
        starts = F.broadcast(starts)
    found = items.join(starts, (F.xxhash64("path") == F.col("file")) & (F.col("at") == F.col("split")))
    return found.select(*REC, (F.col("id") + F.col("shift")).alias("k"), "n", "f")


def _key(path: str) -> list[Column]:
    return [F.regexp_extract(F.col(path), NAME, i + 1).cast("int").alias(c) for i, c in enumerate(REC)]


def write_recordings(signals: DataFrame, folder: str, layout: str = "wide", part_lines: int = PART) -> None:
    """Recordings in parts, each in a folder named as the recording and the part's number, as read_recordings reads them; nulls become NaN.

    A part is one file of ``part_lines`` lines at most, of one channel where ``layout`` puts channels after one another, so that no task sorts or writes a whole recording.
    """
    values = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in CHANNELS]
    rows = with_channels(signals).select(*REC, "k", *[v.alias(c) for v, c in zip(values, CHANNELS, strict=True)])
    part = F.floor(F.col("k") / F.lit(part_lines))
    if layout == "wide":
        lines = rows.select(*REC, part.alias("part"), "k", F.concat_ws(" ", *CHANNELS).alias("line"))
    else:  # all of one channel, then of the next
        spread = F.array(*[F.struct(F.lit(i).cast("long").alias("channel"), F.col(c).alias("line")) for i, c in enumerate(CHANNELS)])
        lines = rows.select(*REC, "k", F.inline(spread)).select(*REC, (F.col("channel") * (1 << 40) + part).alias("part"), "k", "line")
    lines = lines.repartition(int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions")), *REC, "part")
    name = F.format_string(file_name("%d", "%d").replace(".dat", "-part%d"), *REC, "part").alias("name")
    lines.select(name, "k", "line").sortWithinPartitions("name", "k").drop("k").write.partitionBy("name").text(folder)


def with_channels(signals: DataFrame) -> DataFrame:
    """Adds the channels that a table lacks as nulls."""
    return signals.select(*REC, "k", *[clean(F.col(c)).alias(c) if c in signals.columns else F.lit(None).cast("double").alias(c) for c in CHANNELS])


def write_results(folder: str, tables: dict[str, DataFrame], config: Config) -> None:
    """One Parquet table each, by recording, and the configuration and the labels as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*REC).parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(config.to_json(),)], "config string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    spark.createDataFrame(LABELS, LABEL).coalesce(1).write.mode("overwrite").json(f"{folder}/labels")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LABEL).json(f"{folder}/labels")


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
