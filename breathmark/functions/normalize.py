"""Canonical labels and modifiers of raw event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, prefixes, equal strings, contained strings, in the order in which they are tried (fixed values).
RULES = [
    ("ShB", "shallow_breathing", "shb", ("shallowbreathing",)),
    ("IrB", "irregular_breathing", "irb", ("irregularbreathing",)),
    ("SlB", "slow_breathing", "slb", ("slowbreathing",)),
    ("RaB", "rapid_breathing", "rab", ("rapidbreathing", "tachypnea")),
    ("ReA", "respiratory_asynchrony", "rea", ("asynchron",)),
    ("Des", "desaturation", "des", ("hypoxia",)),
    ("Apn", "apnea", "apn", ()),
    ("Sig", "sigh", "sig", ()),
]


def plain(raw: Column) -> Column:
    return F.translate(F.lower(F.trim(raw)), " -", "__")


def base_label(raw: Column) -> Column:
    s = plain(raw)
    out = None
    for label, prefix, equal, parts in RULES:
        hit = s.startswith(prefix) | (s == equal)
        for part in parts:
            hit = hit | s.contains(part)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(s)


def normalize(events: DataFrame) -> DataFrame:
    """``type`` becomes the label; ``raw_type``, ``desat`` and ``depth`` are added."""
    s = plain(F.col("type"))
    depth = F.when(s.contains("shallow"), "shallow").when(s.contains("deep"), "deep").otherwise("")
    return events.select(
        *[base_label(F.col("type")).alias("type") if c == "type" else F.col(c) for c in events.columns],
        F.col("type").alias("raw_type"), s.contains("desat").alias("desat"), depth.alias("depth"),
    )
