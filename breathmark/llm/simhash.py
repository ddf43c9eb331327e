"""SimHash near-duplicates with candidates from pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, starts_of, text_or_empty, whole_groups
from .components import connected_components

BITS = 64
#: Distinct fingerprints in a block up to which all its pairs are compared side by side, or as a matrix.
SMALL, MATRIX = 64, 4096


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64 bits; a bit is set where over half of the shingles' hashes have it.

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are joined by a space and hashed
    by XXH64 with seed 42. Fewer words than a shingle are one shingle; no words give 0.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), len(words) - shingle + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``_id`` and ``_fp`` of every row; a null text counts as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["_id", "_fp"])

    rows = df.select(F.col(id_col), text_or_empty(text_col))
    return rows.mapInArrow(compute, f"_id {df.schema[id_col].dataType.simpleString()}, _fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """Low bit and width of ``distance + 1`` consecutive segments of a fingerprint."""
    cuts = [BITS * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def chains(distance: int) -> list[dict]:
    """What two fingerprints within ``distance`` share, by the segment where their chain starts.

    On a ring of m segments whose differences add up to ``distance`` at most, some segment starts a chain whose first l
    segments differ in floor(l * distance / m) bits at most, for every l. With m = distance + 1 the first segment has
    no difference and the first two have one at most, so one half of the second has none: the first segment and
    that half are the key under which a pair meets. ``budgets``: (mask, bits) of each longer chain.
    """
    parts, out = segments(distance), []
    m = len(parts)
    for i in range(m):
        low, width = parts[(i + 1) % m]
        budgets, mask = [], 0
        for l in range(1, m + 1):
            mask |= _mask(*parts[(i + l - 1) % m])
            budgets.append((mask, l * distance // m))
        for half in ((low, width // 2), (low + width // 2, width - width // 2)):
            out.append({"key": _mask(*parts[i]) | _mask(*half), "budgets": budgets[1:]})
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least element that each of n elements reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _within(x: np.ndarray, budgets: list[tuple[int, int]]) -> np.ndarray:
    """Places where the differing bits x keep within each chain's budget, the longest chain being the whole ring."""
    at = np.arange(len(x))
    for mask, most in budgets:
        at = at[np.bitwise_count(x[at] & np.uint64(mask)) <= most]
    return at


def _large_block(fp: np.ndarray, key: int, distance: int) -> np.ndarray:
    """Labels as _forest's. Fingerprints that agree outside some ``distance`` free bits are close to one another."""
    differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
    free = [b for b in range(BITS) if differ >> b & 1 and not key >> b & 1]
    label = np.arange(len(fp))
    while True:
        old = label
        for bits in combinations(free, min(distance, len(free))):
            rest = fp & np.uint64(~sum(1 << b for b in bits) & (1 << BITS) - 1)
            order = np.argsort(rest, kind="stable")
            starts = np.flatnonzero(np.diff(rest[order], prepend=rest[order[0]] + np.uint64(1)))
            least = np.minimum.reduceat(label[order], starts)
            new = np.empty_like(label)
            new[order] = np.repeat(least, np.diff(np.append(starts, len(fp))))
            label = new
        label = label[label]
        if (label == old).all():
            return label


def _block_links(fp: np.ndarray, key: int, budgets: list, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what is close within one block, under one for each of its fingerprints."""
    n = len(fp)
    if n > MATRIX:
        label = _large_block(fp, key, distance)
    else:
        label = np.arange(n)
        for top in range(0, n, 512):
            x = fp[top : top + 512, None] ^ fp[None, :]
            found = _within(x.ravel(), budgets)
            a, b = found // n + top, found % n
            label = _forest(n, np.concatenate([a[a < b], np.arange(n)]), np.concatenate([b[a < b], label]))
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _parts(key: int, distance: int) -> list[int]:
    """Masks of ``distance + 1`` groups of the bits that ``key`` leaves free: a close pair agrees on one of them."""
    free = [b for b in range(BITS) if not key >> b & 1]
    cuts = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return [sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def links(nodes: DataFrame, distance: int = 2, most: int = MATRIX) -> DataFrame:
    """``a``, ``b``: edges that connect every two of ``nodes`` (``_fp`` distinct, ``_node``) within ``distance`` bits.

    Each fingerprint goes under two keys for each segment; a pair within the distance meets under one of them and is
    then held to the budgets of its chain. Within a block of up to SMALL fingerprints every close pair is an edge; in
    larger ones a forest stands for them. A block of more than ``most`` fingerprints is dealt out once more, by groups of
    the bits that its key leaves free, so what meets in one task agrees on all bits but some 21 (for 2 differing bits)
    and is bounded by these. Where such a part is still above MATRIX, fingerprints that agree on all but ``distance``
    bits are joined, for each choice of bits, which is as exact and linear.
    """
    ways = chains(distance)
    keys = F.array(*[
        F.struct(F.lit(i).alias("_way"), F.col("_fp").bitwiseAND(F.lit(_signed(w["key"]))).alias("_key"))
        for i, w in enumerate(ways)
    ])
    met = nodes.select(F.inline(keys), "_fp", "_node")
    hot = met.groupBy("_way", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_way", "_key", F.lit(True).alias("_hot"))
    hot = durable(hot)
    plain = met.withColumn("_part", F.lit(0)).withColumn("_sub", F.lit(0).cast("long"))
    if hot.isEmpty():
        blocks = plain
    else:
        parts = [_parts(w["key"], distance) for w in ways]
        deeper = F.array(*[
            F.array(*[
                F.struct(F.lit(k + 1).alias("_part"), F.col("_fp").bitwiseAND(F.lit(_signed(mask))).alias("_sub"))
                for k, mask in enumerate(own)
            ])
            for own in parts
        ])
        marked = met.join(hot, ["_way", "_key"], "left")
        blocks = plain.join(hot, ["_way", "_key"], "left_anti").unionByName(
            marked.where("_hot").select("_way", "_key", "_fp", "_node", F.inline(F.get(deeper, F.col("_way"))))
        )
    columns = ["_way", "_key", "_part", "_sub"]
    blocks = blocks.repartition(*columns).sortWithinPartitions(*columns, "_fp")
    kind = nodes.schema["_node"].dataType.simpleString()

    def pairs(starts: np.ndarray, sizes: np.ndarray, way: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, out = np.repeat(np.arange(len(starts)), sizes), []
        size_of = sizes[group]
        small = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
        for step in range(1, SMALL):
            small = small[small + step < len(fp)]
            small = small[group[small] == group[small + step]]
            if not len(small):
                break
            for w in np.unique(way[small]):
                own = small[way[small] == w]
                own = own[_within(fp[own] ^ fp[own + step], ways[w]["budgets"])]
                out.append((own, own + step))
        for g in np.flatnonzero(sizes > SMALL):
            a, w = starts[g], ways[way[starts[g]]]
            x, y = _block_links(fp[a : a + sizes[g]], w["key"], w["budgets"], distance)
            out.append((x + a, y + a))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, way = rows["_node"].combine_chunks(), rows["_way"].to_numpy()
        starts, sizes = starts_of(way, *(rows[c].to_numpy() for c in columns[1:]))
        a, b = pairs(starts, sizes, way, rows["_fp"].to_numpy().view(np.uint64))
        for at in range(0, len(a), 100_000):
            ends = [node.take(pa.array(x[at : at + 100_000])) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return blocks.mapInArrow(whole_groups(columns, found), f"a {kind}, b {kind}").distinct()


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` as 16 hex digits, ``component_id``.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest id that a row reaches
    over links, itself included. A null text counts as empty, and texts without words share fingerprint 0, linked
    like any other. Rows that repeat an id are one node of the graph under each of their fingerprints. A null id is
    never a component's smallest unless alone with its fingerprint. A text of any length is one fingerprint. An empty
    table gives an empty result. Other columns of ``df`` are not read.

    Copies collapse to their fingerprint before anything is compared, so a group of copies of any size is one node.
    Texts are read once; (id, fingerprint) is kept.
    """
    slim = durable(fingerprints(df, id_col, text_col, shingle))
    nodes = slim.groupBy("_fp").agg(F.min("_id").alias("_node"))
    component = connected_components(links(nodes.where("_node is not null"), distance))
    groups = nodes.join(component, nodes["_node"] == component["node"], "left").select(
        F.col("_fp").alias("_gfp"), F.coalesce("component", "_node").alias("_component")
    )
    return slim.join(groups, slim["_fp"] == groups["_gfp"], "left").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
