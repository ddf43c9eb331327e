"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder is made in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), "breathmark-checkpoints"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the checkpoint folder that all executors share, with the lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def give_back() -> None:
    """Returns freed memory of this worker, which stays for later tasks, to the system where its C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def whole_groups(columns: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: hands rows that come sorted by ``columns`` (numbers) to ``work`` so that rows of one group are never apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c].to_numpy() for c in columns]
            if held and tuple(k[0] for k in keys) != last:
                yield from work(pa.Table.from_batches(held))
                held = []
            last = tuple(k[-1] for k in keys)
            changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held))
        give_back()

    return run


def starts_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and their sizes."""
    if not len(keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1])
    return starts, np.diff(np.append(starts, len(keys[0])))
