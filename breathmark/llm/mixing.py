"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over permuted blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathmark.operators.stretches import carried

from .common import WORD, durable, quoted, text_or_empty

#: Blocks that each source is dealt into, a power of two.
BLOCKS = 4096
#: Least number of documents among which the last words of a quota are chosen one by one.
TAIL = 64
#: Changes of one document for another that bring a quota's last words nearer.
SWAPS = 16
#: Share of a source's words, as 1 / BIG, above which a document is tried by itself; documents from which a zone is looked at more closely.
BIG, ZONE = 1024, 1024


def targets(sizes: dict, weights: Sequence[float], limit: float = 3.0) -> dict:
    """Words that each source should give: all words shared by weight, none above ``limit`` times its own size.

    Sources come in the order of their names by code point, null last, and take the weights in turn. What a source
    can't give is shared by weight among the others, again and again.
    """
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    out, rest, free = {}, float(sum(sizes.values())), list(names)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(limit * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
        rest = max(rest, 0.0)
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts that add up to ``quotas``, shard totals within one of each other.

    A binary tree: at each node the blocks of the left half of its shards are a multivariate-hypergeometric draw from
    the node's blocks, drawn source by source from the hypergeometric marginals.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle, rng = (low + high) // 2, np.random.default_rng([seed, low, high])
        total = int(counts.sum())
        want, rest, left = total * (middle - low) // (high - low), total, np.zeros_like(counts)
        for i, n in enumerate(counts.tolist()):
            rest -= n
            left[i] = rng.hypergeometric(n, rest, want) if want and n + rest else 0
            want -= int(left[i])
        split(left, low, middle)
        split(counts - left, middle, high)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _permutation(seed: int, source: str | None) -> tuple[int, int]:
    """An odd factor and a shift: block b of the source stands at place (factor * b + shift) mod BLOCKS."""
    drawn = int.from_bytes(hashlib.sha256(f"{seed}:{source!r}".encode()).digest()[:8])
    return drawn % BLOCKS | 1, drawn // BLOCKS % BLOCKS


def choose(sizes: np.ndarray, left: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Which documents to take, in their order as long as they fit, so that their sizes come near ``left`` from below.

    Then one taken document (or none) is changed for a larger one that still fits, the best such change each time. With ``counts``, how many equal ones there
    are of each: how many to take.
    """
    if counts is None:
        return choose(sizes, left, np.ones(len(sizes), np.int64)).astype(bool)
    taken = np.zeros(len(sizes), np.int64)
    for i, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if 0 < size <= left:
            taken[i] = min(n, left // size)
            left -= int(taken[i]) * size
    for _ in range(SWAPS):
        out = np.flatnonzero(taken < counts)
        if not left or not len(out):
            break
        out = out[np.argsort(sizes[out], kind="stable")]
        have = np.concatenate([[-1], np.flatnonzero(taken)])
        worth = np.where(have < 0, 0, sizes[have])
        best = np.searchsorted(sizes[out], worth + left, side="right") - 1
        gain = np.where(best >= 0, sizes[out][best] - worth, 0)
        if gain.max() <= 0:
            break
        i = int(gain.argmax())
        left -= int(gain[i])
        taken[out[best[i]]] += 1
        if have[i] >= 0:
            taken[have[i]] -= 1
    return taken


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list:
    """Columns by which a row is placed: source, size, a 128-bit key of (id, text), and a place from 0 to 2^48 - 1 in the source's order.

    The upper 12 bits of a place are the block's number after the source's permutation, the others come from the key.
    """
    u, v = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.xxhash64(F.col(text_col), F.lit(seed), F.col(id_col))
    return [
        F.col(source_col).cast("string").alias("_s"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("_size"),
        u.alias("_u"), v.alias("_v"),
    ]


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with what the plan has for their source, their block ``_block`` and their place ``_p``."""
    block = F.pmod(F.col("_f") * F.shiftrightunsigned("_u", 52) + F.col("_g"), F.lit(BLOCKS))
    return (
        rows.join(F.broadcast(plan), F.col("_s").eqNullSafe(F.col("_ps"))).withColumn("_block", block.cast("int"))
        .withColumn("_p", F.col("_block") * F.lit(1 << 36) + F.shiftrightunsigned("_u", 16).bitwiseAND(F.lit((1 << 36) - 1)))
    )


_PICKS = "_s string, _u long, _v long, _take long, _equal long, _size long"


def _tried(group: pd.DataFrame) -> pd.DataFrame:
    """How many of each of one source's rows to take so that their sizes come near ``_left``; ``_equal`` rows are one here."""
    group = group.sort_values(["_p", "_u", "_v", "_size"], kind="stable")
    group = group.assign(_take=choose(group["_size"].to_numpy(), int(group["_left"].iloc[0]), group["_equal"].to_numpy()))
    return group.loc[group["_take"] > 0, ["_s", "_u", "_v", "_take", "_equal", "_size"]]


def _picked(rows: DataFrame) -> DataFrame:
    """What _tried takes of ``rows``, source by source, once those that are equal have been counted by tasks."""
    own = ["_s", "_u", "_v", "_p", "_size", "_left"]
    return rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_equal")).groupBy("_s").applyInPandas(_tried, _PICKS)


def _zones(small: DataFrame, rest: dict) -> dict:
    """By source: (lo, hi, words before lo) of the places around those where its small documents reach ``rest`` words.

    The blocks of all places are summed up first; where the zone has more than ZONE documents, the parts of its blocks
    are, and so on, so a source of any size ends with a zone of some hundred documents.
    """
    spark = small.sparkSession
    found = {}
    open_ones = {s: (0, 1 << 48, 0, left) for s, left in rest.items()}
    for shift in (36, 24, 12, 0):
        if not open_ones:
            break
        ranges = spark.createDataFrame([(s, *x) for s, x in open_ones.items()], "_ps string, _from long, _to long, _w long, _goal long")
        here = small.select("_s", "_p", "_size").join(F.broadcast(ranges), F.col("_s").eqNullSafe(F.col("_ps"))).where("_p >= _from and _p < _to")
        blocks = here.groupBy("_s", "_w", "_goal", F.shiftright("_p", shift).alias("_b")).agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        blocks = durable(
            blocks.withColumn("_w0", F.col("_w") + F.coalesce(F.sum("_words").over(before), F.lit(0))).withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        )
        # From the last block that begins within the goal on, TAIL documents, or the last TAIL ones.
        ends = blocks.groupBy("_s").agg(F.sum("_n").alias("_all"), F.max(F.when(F.col("_w0") <= F.col("_goal"), F.struct("_n0", "_b"))).alias("_end"))
        ends = ends.select(F.col("_s").alias("_es"), F.greatest(F.lit(0), F.least(F.col("_end._n0"), F.col("_all") - TAIL)).alias("_first"), F.col("_end._b").alias("_eb"))
        inside = (F.col("_n0") + F.col("_n") > F.col("_first")) & (F.col("_n0") < F.col("_first") + TAIL) | (F.col("_b") == F.col("_eb"))
        zones = (
            blocks.join(ends, F.col("_s").eqNullSafe(F.col("_es"))).where(inside)
            .groupBy("_s").agg(F.min("_b").alias("lo"), F.max("_b").alias("hi"), F.min("_w0").alias("w0"), F.sum("_n").alias("n")).collect()
        )
        still = {}
        for r in zones:
            lo, hi, w0 = r["lo"] << shift, (r["hi"] + 1) << shift, r["w0"]
            if r["n"] > ZONE and shift:
                still[r["_s"]] = (lo, hi, w0, open_ones[r["_s"]][3])
            else:
                found[r["_s"]] = (lo, hi, w0)
        open_ones = still
    return found


def _plan(slim: DataFrame, weights: Sequence[float], limit: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """One row per source, the picks among rows that are tried one by one, and the words of the whole mix.

    A row of over 1 / BIG of its source's words is tried by itself, since it can't be placed by sums: BIG rows a source at most.
    """
    spark = slim.sparkSession
    sizes = {r["_s"]: r["_w"] for r in slim.groupBy("_s").agg(F.sum("_size").alias("_w")).collect()}
    target = targets(sizes, weights, limit)
    rows = []
    for s, size in sorted(sizes.items(), key=lambda x: (x[0] is None, x[0])):
        factor, shift = _permutation(seed, s)
        whole = min(limit, floor(target[s] / size + 1e-12)) if size else 0
        rest = max(0, round(target[s] - whole * size)) if whole < limit and size else 0
        rows.append([s, size, target[s], factor, shift, whole, rest])
    shape = "_ps string, _source_size long, _target double, _f int, _g int, _whole int, _rest long"

    placed = _placed(slim, spark.createDataFrame([tuple(r) for r in rows], shape)).where("_rest > 0")
    is_big = F.col("_size") * BIG > F.col("_source_size")
    big = placed.where(is_big)
    big_words = {r["_s"]: r["_w"] for r in big.groupBy("_s").agg(F.sum("_size").alias("_w")).collect()}
    share = {}
    for s, size, _, _, _, _, rest in rows:
        words = big_words.get(s, 0)
        share[s] = max(rest - (size - words), rest * words // size if size else 0)
    quota = spark.createDataFrame(list(share.items()), "_qs string, _left long")
    picks = durable(_picked(big.join(F.broadcast(quota), F.col("_s").eqNullSafe(F.col("_qs")))))
    taken = {r["_s"]: r["_w"] for r in picks.groupBy("_s").agg(F.sum(F.col("_size") * F.col("_take")).alias("_w")).collect()}

    again, left = {}, {}  # where large ones don't fill the quota, the small ones are taken once or twice more
    for s, size, _, _, _, whole, rest in rows:
        if rest:
            words, n = size - big_words.get(s, 0), rest - taken.get(s, 0)
            again[s] = min(limit - whole, n // words) if words else 0
            left[s] = n - again[s] * words if whole + again[s] < limit and words else 0
    zone = _zones(placed.where(~is_big), {s: n for s, n in left.items() if n > 0})
    quotas = [(r[5] + again.get(r[0], 0)) * BLOCKS + (((zone[r[0]][1] - 1) >> 36) + 1 if r[0] in zone else 0) for r in rows]
    starts = split_quotas(quotas, shards, seed).cumsum(axis=0)
    full = []
    for i, r in enumerate(rows):
        lo, hi, gone = zone.get(r[0], (0, 0, 0))
        full.append((*r, again.get(r[0], 0), lo, hi, left.get(r[0], 0) - gone, [0, *starts[:-1, i].tolist()]))
    plan = spark.createDataFrame(full, f"{shape}, _again int, _lo long, _hi long, _left long, _starts array<long>")
    tail = _placed(slim, plan).where((F.col("_rest") > 0) & ~is_big & (F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi")))
    return plan, durable(picks.union(_picked(tail))), round(sum(target.values()))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_nr``: equal ones are numbered, by tasks and by how many the tasks before have, so that none of them sees all."""
    placed = rows.select(F.struct(*rows.columns).alias("row"), F.coalesce(F.concat(F.lit("s"), F.col("_s")), F.lit("")).alias("s"), "_u", "_v")
    placed = placed.withColumnsRenamed({"_u": "u", "_v": "v"}).withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftrightunsigned("at", 33))
    return carried(placed, ["s", "u", "v"], "task", ["at"], before=("sum", F.lit(1))).select("row.*", (F.col("before") + 1).alias("_nr"))


def _copied(rows: DataFrame, plan: DataFrame, picks: DataFrame) -> DataFrame:
    """``rows`` with ``_copies``, how often the mix takes each, and ``_shards``, the output shard of each copy."""
    big = (F.col("_rest") > 0) & (F.col("_size") * BIG > F.col("_source_size"))
    placed = _placed(rows, plan).withColumn("_whole", F.col("_whole") + F.when(big, 0).otherwise(F.col("_again")))
    alone = big | (F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi"))
    sure = placed.where(~alone).withColumn("_more", (F.col("_p") < F.col("_lo")).cast("int"))
    chosen = picks.select(F.col("_s").alias("_cs"), F.col("_u").alias("_cu"), F.col("_v").alias("_cv"), "_take", "_equal")
    same = F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_u") == F.col("_cu")) & (F.col("_v") == F.col("_cv"))
    tried = placed.where(alone).join(chosen, same, "left")
    some = F.coalesce(F.col("_take") < F.col("_equal"), F.lit(False))  # of equal rows only so many: these are numbered
    tried = (
        tried.where(~some).withColumn("_more", F.col("_take").isNotNull().cast("int"))
        .unionByName(_numbered(tried.where(some)).withColumn("_more", (F.col("_nr") <= F.col("_take")).cast("int")).drop("_nr"))
    )
    whole, copies = F.col("_whole"), F.col("_whole") + F.col("_more")
    at = lambda e: F.when(e <= whole, (e - 1) * BLOCKS + F.col("_block")).otherwise(whole * BLOCKS + F.col("_block"))
    shard = F.transform(F.sequence(F.lit(1), copies), lambda e: F.size(F.filter("_starts", lambda x: x <= at(e))) - 1)
    drawn = sure.unionByName(tried.select(sure.columns)).withColumn("_copies", copies)
    return drawn.withColumn("_shards", F.when(F.col("_copies") > 0, shard).otherwise(F.array().cast("array<int>")))


def mix_sources(
    df: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    limit: int = 3,
    shards: int = 16,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``df``: id, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``shards``.

    ``size``: words of the text (runs of other than ASCII white space; null: 0), whatever its length. ``target``: what
    ``targets`` gives the row's source. ``copies``: how often the mix takes the document, 0 to ``limit``, whole each
    time; ``taken``: copies times size; ``shards``: the output shard of each copy. No other columns of ``df`` are read,
    whatever their names. A null source is a source; one without words takes each of its documents 0 times. Equal rows
    are drawn each on its own. The same table and seed give the same result. An empty table gives an empty result.

    A hash deals each source into BLOCKS blocks and a keyed permutation orders them. A source gives every block once
    for each whole multiple in target / size, then blocks by place up to the rest; the documents around the last
    place, and those of over 1 / BIG of the source's words, are tried one by one. Block quotas fall to shards by
    ``split_quotas``; a shard's blocks are the next ones by place, so shards are disjoint. The text is read once; sizes are
    kept (some 40 bytes a row). The driver holds one row per source, as the weights do, and no task gets more of a source
    than some BIG or ZONE of its distinct rows; rows that repeat another are counted, and numbered by tasks where only some of them are taken. ``draw`` gives the mix itself.
    """
    slim = durable(df.select(F.col(id_col).alias("_id"), *_slim(df, id_col, text_col, source_col, seed)))
    plan, picks, _ = _plan(slim, weights, limit, shards, seed)
    return _copied(slim, plan, picks).select(
        F.col("_id").alias(id_col),
        F.col("_s").alias("source"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
        F.col("_shards").alias("shards"),
    )


def draw(
    df: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    limit: int = 3,
    shards: int = 16,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    task_words: int = 1_000_000,
) -> DataFrame:
    """The mix itself: one row of ``df`` per copy that mix_sources takes, with its ``shard`` (a column of that name is replaced).

    A row's copies are worked out where it is read, from the plan of its source; only copies move. A shard is dealt
    over tasks of some ``task_words`` words and shuffled within each. Nulls, repeated rows, ties and empty tables as in mix_sources.
    """
    own = [c for c in df.columns if c != "shard"]
    rows = df.select(F.struct(*[quoted(c) for c in own]).alias("_row"), *_slim(df, id_col, text_col, source_col, seed))
    plan, picks, words = _plan(durable(rows.drop("_row")), weights, limit, shards, seed)
    copies = _copied(rows, plan, picks).where("_copies > 0").select("_row", "_u", F.posexplode("_shards").alias("_epoch", "shard"))
    copies = copies.withColumn("_order", F.xxhash64(F.lit(seed), "_epoch", "_u"))
    tasks = words // (task_words * shards) + 1
    copies = copies.withColumn("_task", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(tasks)))
    return copies.repartition(shards * tasks, "shard", "_task").sortWithinPartitions("shard", "_task", "_order").select("_row.*", "shard")
