"""Column names, schemas and the label dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A recording's key, by which all windows are partitioned.
REC = ["subject", "condition"]
#: Channels of a recording in file order.
CHANNELS = ["ecg1", "ecg2", "spo2", "resp_l", "bp", "resp_d"]
#: Belts and their channels.
BELTS = {"lungs": "resp_l", "diaph": "resp_d"}

SIGNALS = "subject int, condition int, k long, " + ", ".join(f"{c} double" for c in CHANNELS)
EVENTS = "subject int, condition int, type string, start_idx long, end_idx long, start_t double, end_t double"

# The eight labels (fixed values).
LABELS = [
    (1, "ShallowBreathing", "ShB"),
    (2, "IrregularBreathing", "IrB"),
    (3, "SlowBreathing", "SlB"),
    (4, "Rapid Breathing", "RaB"),
    (5, "RespiratoryAsynchrony", "ReA"),
    (6, "Desaturation", "Des"),
    (7, "Apnea", "Apn"),
    (8, "Sigh", "Sig"),
]
SHORT = [short for _, _, short in LABELS]
LABEL = "idx int, long_name string, short_name string"


def label_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, LABEL)


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENTS)
