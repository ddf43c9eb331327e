"""Importance resampling towards a target: hashed n-grams, counted by DuckDB in each partition, merged and scored by Spark."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, shared_folder, text_or_empty

#: Buckets of features.
BUCKETS = 10_000
#: Characters of texts that DuckDB counts at once, and of one part of a longer text.
BATCH, PART = 2_000_000, 500_000

# What words have none of: ASCII characters other than digits and letters (fixed value).
OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_WORD, _BETWEEN = re.compile(f"[^{OTHER}]+"), re.compile(f"[{OTHER}]")
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: How often each bucket comes in each row, and in how many of these cases as a single word. A part of a text that goes on with it
#: starts with the last word of the part before, which counts for the run of two only.
COUNTS = f"""
WITH parts AS (SELECT row, carried, part, regexp_extract_all({LOWERED}, '[^{OTHER}]+') AS words FROM batch),
placed AS (SELECT row, part, carried, unnest(range(len(words))) AS i, unnest(words) AS word FROM parts),
followed AS (SELECT row, carried AND i = 0 AS again, word, lead(word) OVER (PARTITION BY part ORDER BY i) AS next FROM placed),
runs AS (
  SELECT row, word AS feature, 1 AS size FROM followed WHERE NOT again
  UNION ALL SELECT row, word || ' ' || next, 2 FROM followed WHERE next IS NOT NULL),
counted AS (SELECT row, feature, size, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT feature, crc(feature) % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM counted))
SELECT row, bucket, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (WHERE size = 1), 0)::BIGINT AS words
FROM counted JOIN hashed USING (feature) GROUP BY row, bucket ORDER BY row, bucket
"""


def checksums(features: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The CRC-32 of the UTF-8 bytes of each string."""
    out: list[int] = []
    for chunk in getattr(features, "chunks", [features]):
        chunk = chunk.cast(pa.binary())
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset).tolist()
            data = memoryview(chunk.buffers()[2] or b"")
            out += [crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.array(out, pa.int64())


def counter():
    """A DuckDB connection of one thread that knows ``crc``; it stays in memory, and ``BATCH`` bounds what it gets at once."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.create_function("crc", checksums, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def parts_of(text: str, most: int = PART) -> Iterator[tuple[bool, str]]:
    """A text in parts of some ``most`` characters, cut between words; (True, part) where it starts with the word before it."""
    at, tail = 0, ""
    while True:
        cut = _BETWEEN.search(text, at + most) if len(text) - at > most else None
        end = cut.start() if cut else len(text)
        part = text[at:end]
        yield bool(tail), f"{tail} {part}" if tail else part
        if end == len(text):
            return
        tail, at = ([tail, *_WORD.findall(part)])[-1], end


def bucket_counts(con, texts: list[str], part: int = PART, batch: int = BATCH) -> tuple[np.ndarray, ...]:
    """Sorted arrays row, bucket, n and words of the buckets that each text has."""
    keys, n, words = (np.empty(0, np.int64) for _ in range(3))
    held, size, numbered = [], 0, 0

    def run() -> None:
        nonlocal keys, n, words
        columns = zip(*held, strict=True)
        con.register("batch", pa.table(dict(zip(("row", "part", "carried", "text"), map(list, columns), strict=True))))
        found = con.execute(COUNTS).fetchnumpy()
        con.unregister("batch")
        keys, at = np.unique(np.concatenate([keys, found["row"] * BUCKETS + found["bucket"]]), return_inverse=True)
        sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
        for total, old, new in zip(sums, (n, words), (found["n"], found["words"]), strict=True):
            np.add.at(total, at, np.concatenate([old, new]))
        n, words = sums

    for row, text in enumerate(texts):
        for carried, piece in parts_of(text, part):
            held.append((row, numbered, carried, piece))
            numbered, size = numbered + 1, size + len(piece)
            if size >= batch:
                run()
                held, size = [], 0
    if held:
        run()
    return keys // BUCKETS, keys % BUCKETS, n, words


def _spilled(df: DataFrame, id_col: str | None, text_col: str, folder: str) -> DataFrame:
    """Bucket counts of each row, and the totals of each task in a row of their own, as a Parquet table at ``folder``."""
    own = F.col(id_col) if id_col else F.lit(0)
    rows = df.select(own.alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, totals, id_type = counter(), np.zeros(BUCKETS, np.int64), None

        def made(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            row, bucket, n, words = bucket_counts(con, texts)
            np.add.at(totals, bucket, n)
            ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
            per_row = np.bincount(row, words, len(texts)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (bucket, n)]
            return pa.RecordBatch.from_arrays([ids, pa.array(per_row), *lists, pa.nulls(len(texts), pa.list_(pa.int64()))], names)

        for batch in batches:
            id_type, at = batch.schema.types[0], 0
            sizes = np.cumsum(pa.compute.utf8_length(batch.column(1)).to_numpy())
            while at < batch.num_rows:  # as many rows as make some BATCH characters
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH)))
                yield made(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at).to_pylist())
                at = end
        if id_type is not None:
            empty = [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.list_(pa.int32()))] * 2]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([totals.tolist()], pa.list_(pa.int64()))], names)
        con.close()
        give_back()

    names = ["id", "words", "buckets", "counts", "totals"]
    shape = f"id {kind}, words long, buckets array<int>, counts array<int>, totals array<long>"
    rows.mapInArrow(count, shape).write.parquet(folder)
    return df.sparkSession.read.schema(shape).parquet(folder)


def _totals(spilled: DataFrame) -> list[int]:
    """How many features each bucket has in all: as many numbers as buckets."""
    out = [0] * BUCKETS
    by_task = spilled.where("totals is not null").select(F.posexplode("totals").alias("bucket", "n"))
    for r in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket speaks for the target, in thousandths of a natural logarithm, smoothed by one feature a bucket."""
    s_all, t_all = float(sum(own) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(own, target, strict=True)]


def _literal(numbers: list[int]) -> Column:
    """A constant array, folded once a plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def _ranked(df: DataFrame, drawn: int) -> DataFrame:
    """``df`` with ``rank`` 1 to ``drawn`` by falling score, then id; null beyond. Positions within sorted ranges, and the ranges' sizes summed up."""
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33).cast("int")
    sizes = dict(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0]
    for p in range(max(sizes, default=0) + 1):
        before.append(before[-1] + sizes.get(p, 0))
    rank = F.get(_literal(before), part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("rank", F.when(rank <= drawn, rank)).drop("_at")


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    share: int = 25,
    least: int = 20,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, 3 .. for the rows that are drawn, else null).

    Words are runs of digits, letters and characters beyond ASCII, capitals A-Z lowered; features are all runs of one and two words, dealt into BUCKETS by the
    CRC-32 of their bytes. A bucket's gain is ``gains`` of how often ``df`` and ``target`` have it, a row's weight the floored mean gain of its
    features (none: 0). The score adds Gumbel noise from the SHA-256 of seed and id, so the highest scores are a draw without replacement in proportion to
    the exponential of the weights. Of the rows with ``least`` words or more, ``share`` hundredths are drawn, rounded down; ties go to the smaller id.

    A null text has no word. A null id is hashed as an empty one and comes last among ties; rows that repeat an id share its noise, and those with equal
    scores too go by their features and weight. An empty ``df`` gives an empty result; an empty ``target`` counts nothing and smooths only.
    Other columns of either table are not read, whatever their names.

    DuckDB counts the buckets within each partition: SQL unnests words, joins each with the next in a window, and hashes by a registered function.
    It gets some BATCH characters at once, a longer text part by part. The counts of each row and task are spilled to Parquet in the shared folder; Spark
    merges the tasks' totals (as many numbers as buckets, for the driver too) and scores from the spilled counts, so texts are read once and never
    shuffled. Ranks come from a range sort and the sizes of its ranges; the driver holds a number for each range.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/resampling-{uuid4().hex}"
    own = _spilled(df, id_col, text_col, f"{folder}/own")
    gain = _literal(gains(_totals(own), _totals(_spilled(target, None, target_col, f"{folder}/target"))))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    worth = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get(gain, b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = own.where("totals is null").select("id", "words", n.alias("n_features"), worth.alias("_worth"))
    many = F.greatest("n_features", F.lit(1).cast("long"))
    mean = (F.col("_worth") - F.pmod("_worth", many)) / many
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    drawn = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(drawn)))
    weighed = rows.withColumn("weight", mean.cast("long"))
    scored = durable(weighed.select("id", "words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score")))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    enough = F.col("words") >= least
    ranked = _ranked(scored.where(enough), share * scored.where(enough).count() // 100)
    left = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(left).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
