"""The driver's ``events`` table read as recordings: one for each event type, one sample a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breathmark.schema import REC

#: Subject numbers of the event types.
SUBJECTS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def signals_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject, condition, k, spo2, resp_l, resp_d``: belts in whole hundredths, so that sums are exact.

    Samples are numbered within hours, from how many the recording's hours before have, and the oxygen mean's rows at an hour's edges come from the
    hours beside it: one row an hour meets by recording alone. What has no time comes last.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    subject = F.lit(0)
    for name, number in SUBJECTS.items():
        subject = F.when(F.col("event_type") == name, number).otherwise(subject)
    hour = F.unix_date(F.to_date("ts")).cast("long") * 24 + F.hour("ts")
    # 1, but no constant: one would be taken out of windows' keys, and what was dealt by all keys would be dealt out again for each window.
    condition = F.least(F.lit(1), F.col("subject") + 1)
    rows = events.withColumn("subject", subject.cast("int")).select(
        "subject", condition.alias("condition"), F.coalesce(hour, F.lit(1 << 40)).alias("hour"), "ts", "event_id",
        F.round(F.col("value") * 100).cast("double").alias("resp_l"), F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("d"),
    )
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *REC, "hour")  # few bytes, but much work each
    local = Window.partitionBy(*REC, "hour").orderBy(F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    rows = rows.withColumns(
        {"i": F.row_number().over(local), "d1": F.lag("d").over(local), "d2": F.lag("d", 2).over(local), "next": F.lead("d").over(local)}
    )
    hours = rows.groupBy(*REC, "hour").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("d", "i").alias("first"), F.max_by("d", "i").alias("last"), F.max_by("d1", "i").alias("second")
    )
    chain = Window.partitionBy(*REC).orderBy("hour")
    hours = hours.select(
        *REC, "hour", "n", F.coalesce(F.sum("n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("last").over(chain).alias("b1"), F.lead("first").over(chain).alias("a1"),
        F.when(F.lag("n").over(chain) == 1, F.lag("last", 2).over(chain)).otherwise(F.lag("second").over(chain)).alias("b2"),
    )
    joined, i = rows.join(hours, [*REC, "hour"]), F.col("i")
    near = [
        F.col("d"), F.when(i == 1, F.col("b1")).otherwise(F.col("d1")), F.when(i == 1, F.col("b2")).when(i == 2, F.col("b1")).otherwise(F.col("d2")),
        F.when(i == F.col("n"), F.col("a1")).otherwise(F.col("next")),
    ]
    total, there = (sum(f(x) for x in near) for f in (lambda x: F.coalesce(x, F.lit(0)), lambda x: x.isNotNull().cast("int")))
    spo2 = F.when(there > 0, F.lit(100.0) - total.cast("double") / (there * F.lit(5.0)))
    return joined.select(
        *REC, (F.col("before") + i - 1).cast("long").alias("k"), spo2.alias("spo2"), "resp_l", (F.col("d") * 100).cast("double").alias("resp_d")
    )
