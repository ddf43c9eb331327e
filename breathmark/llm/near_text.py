"""Near-duplicate texts by the Jaccard similarity of their word shingles: SimHash links first, then an exact join for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, starts_of, text_or_empty, whole_groups
from .components import connected_components
from .simhash import fingerprint, links

#: Words of a shingle. Two texts are near when they share 4 of 5 shingles of both together, or more.
WORDS = 5
#: Words of a fingerprint's shingle, and differing bits up to which fingerprints make two texts candidates.
FINGERPRINT_WORDS, DISTANCE = 2, 3
#: Bits of the sketch that goes with a text under each shingle; a text's own sketch has more where it has more shingles.
SKETCH = 512
#: Members of a block up to which its pairs are compared at once, and members of a larger one that meet in one task.
SMALL, TILE = 64, 4096
#: Texts looked at to order shingles, in how many of them a shingle counts as frequent, and shingles so remembered.
SAMPLE, OFTEN, MOST = 10_000, 4, 100_000
#: Hashes of texts up to which they are broadcast (16 bytes each); more of them are joined by a shuffle.
BROADCAST = 1_000_000


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words as simhash has them, fewer than WORDS words are one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    made = [b" ".join(words)] if len(words) < WORDS else map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, made, repeat(42)), "<u8"))


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the hashes in cells, twice as many as hashes at least: sets differ in as many elements as sketches in bits, or more."""
    bits = max(SKETCH, 1 << (2 * len(found) - 1).bit_length())
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little")


def fold(made: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set in ``size`` bytes: cells whose numbers agree in their low bits are one."""
    return np.bitwise_xor.reduce(made.reshape(-1, size), axis=0)


def prefix(found: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first n - ceil(0.8 n) + 1 of n shingles, frequent ones last, and how many of them are not frequent.

    Near texts share one of theirs, in any order of all shingles.
    """
    n, rare = len(found), len(found)
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        count = np.where(often[at] == found, counts[at], 0)
        found, rare = found[np.lexsort((found, count))], int((count == 0).sum())
    return found[: n - (4 * n + 4) // 5 + 1], rare


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and their counts. They set an order only, no pair depends on them."""
    share = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod("_node", F.lit(share)) == 0).dropDuplicates(["_node"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py()).view(np.int64))], ["_s"])

    found = some.mapInArrow(each, "_s long").groupBy("_s").count().where(F.col("count") >= OFTEN)
    rows = found.orderBy(F.desc("count"), "_s").limit(MOST).collect()
    often, counts = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(often)
    return often[order], counts[order]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


class _Rows:
    """Shingle count, place of the shared shingle in the prefix, coarse sketch and component of some texts."""

    def __init__(self, n: np.ndarray, at: np.ndarray, bits: np.ndarray, label: np.ndarray):
        self.n, self.at, self.bits, self.label = n.astype(np.int64), at.astype(np.int64), bits, label

    def near(self, a: np.ndarray, other: _Rows, b: np.ndarray) -> np.ndarray:
        """Which pairs of own rows a and other rows b are of different components and can be near by sizes, places and sketches."""
        both = self.n[a] + other.n[b]
        # The first shingle that two texts share leaves both enough of theirs from there on.
        k = (self.label[a] != other.label[b]) & (9 * np.minimum(self.n[a] - self.at[a], other.n[b] - other.at[b]) >= 4 * both)
        found = np.flatnonzero(k)
        differ = np.bitwise_count(self.bits[a[found]] ^ other.bits[b[found]]).sum(axis=1, dtype=np.int64)
        return found[9 * differ <= both[found]]


def _rows(table: pa.Table) -> _Rows:
    return _Rows(*(table[c].to_numpy() for c in ("_n", "_at")), _bits(table["_coarse"]), table["_label"].to_numpy())


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _small_blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """All pairs of each block that can be near; no block has more than SMALL rows."""
    rows, node = _rows(table), table["_node"].to_numpy()
    starts, sizes = starts_of(table["_s"].to_numpy())
    group = np.repeat(np.arange(len(starts)), sizes)
    own, step = np.arange(len(node)), 0
    while True:
        step += 1
        own = own[own + step < len(node)]
        own = own[group[own] == group[own + step]]
        if not len(own):
            return
        k = own[rows.near(own, rows, own + step)]
        if len(k):
            yield _pairs(node[k], node[k + step])


def _tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of each tile, the pairs of a row marked ``_other`` and one that isn't that can be near."""
    rows, node, other = _rows(table), table["_node"].to_numpy(), table["_other"].to_numpy(zero_copy_only=False)
    starts, sizes = starts_of(*(table[c].to_numpy() for c in ("_s", "_chunk", "_group")))
    for start, size in zip(starts, sizes, strict=True):
        own = np.arange(start, start + size)
        ones, all_rows = own[other[own]], own[~other[own]]
        for top in range(0, len(ones), 256):
            some = ones[top : top + 256]
            a, b = np.repeat(some, len(all_rows)), np.tile(all_rows, len(some))
            k = rows.near(a, rows, b)
            if len(k):
                yield _pairs(node[a[k]], node[b[k]])


def _shared(small: int) -> Callable:
    """For mapInArrow over rows sorted by shingle and node: distinct rows whose shingle others have, ``_large`` where over ``small`` do.

    At most ``small`` rows of one shingle are held besides a batch, however many have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, current, large_now = None, None, False
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            s, node = batch["_s"].to_numpy(), batch["_node"].to_numpy()
            fresh = np.append(before != (s[0], node[0]), (s[1:] != s[:-1]) | (node[1:] != node[:-1]))
            before = (s[-1], node[-1])
            table = pa.Table.from_batches([*held, batch.filter(pa.array(fresh))])
            s = table["_s"].to_numpy()
            if not len(s):
                continue
            starts, sizes = starts_of(s)
            size_of = np.repeat(sizes, sizes)
            large = (size_of > small) | (large_now & (s == current))
            current, large_now = s[-1], bool(large[-1])
            end = len(s) if large_now else int(starts[-1])
            held = table.slice(end).combine_chunks().to_batches()
            kept = table.append_column("_large", pa.array(large)).slice(0, end).filter(pa.array(((size_of > 1) | large)[:end]))
            yield from kept.combine_chunks().to_batches()
        if held and held[0].num_rows > 1:
            yield held[0].append_column("_large", pa.array(np.zeros(held[0].num_rows, bool)))

    return run


def _meeting(dealt: DataFrame, small: int) -> DataFrame:
    """The rows of ``dealt`` (``_s``, ``_node``, ``_at``, ``_often``) whose shingle another node has too, with ``_large``.

    Shingles that are frequent in the sample are counted by tasks first and joined back, a join that adaptive execution
    splits where one is hot. All others are dealt out once.
    """
    often, rare = dealt.where("_often").drop("_often"), dealt.where("not _often").drop("_often")
    counts = often.groupBy("_s").agg(F.count(F.lit(1)).alias("_c"), F.min("_node").alias("_lo"), F.max("_node").alias("_hi"))
    counts = counts.where("_lo <> _hi").select(F.col("_s").alias("_ss"), (F.col("_c") > small).alias("_large"))
    hot = often.join(counts, F.col("_s") == F.col("_ss")).select("_s", "_node", "_at", "_large").distinct()
    rare = rare.select("_s", "_node", "_at").repartition("_s").sortWithinPartitions("_s", "_node")
    return hot.union(rare.mapInArrow(_shared(small), "_s long, _node long, _at int, _large boolean"))


def _chosen(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``_node`` is in ``needed`` (distinct, ``_need``): broadcast up to BROADCAST of them, else shuffled."""
    if needed.count() <= BROADCAST:
        needed = F.broadcast(needed)
    return texts.join(needed, F.col("_node") == F.col("_need"), "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return durable(pairs.select(F.col("a").alias("_need")).union(pairs.select("b")).distinct())


def _with_ends(pairs: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both ends, marked _a and _b."""
    one, two = (made.select(F.col("_node").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in columns]) for e in ("a", "b"))
    return pairs.join(two, "b").join(one, "a")


def _sketched(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """Those of ``pairs`` that can be near by their whole sketches, made equally long by folding."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            kept = []
            for i, (n, m, x, y) in enumerate(zip(*(batch[c].to_pylist() for c in ("_n_a", "_n_b", "_fine_a", "_fine_b")), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                if 9 * int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum(dtype=np.int64)) <= n + m:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).take(pa.array(kept, pa.int64()))

    made = _chosen(slim, _ends(pairs)).select("_node", "_n", F.coalesce("_fine", "_coarse").alias("_fine"))
    return _with_ends(pairs, made, ["_n", "_fine"]).select("a", "b", "_n_a", "_n_b", "_fine_a", "_fine_b").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, slim: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose texts are near: by their sketches first, then by their whole sets of shingles."""
    pairs = durable(_sketched(durable(pairs), slim))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 100):
            found = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["_node", "_set"])

    made = durable(_chosen(texts, _ends(pairs)).dropDuplicates(["_node"]).mapInArrow(sets, "_node long, _set array<long>"))
    same = F.size(F.array_intersect("_set_a", "_set_b"))
    return _with_ends(pairs, made, ["_set"]).where(9 * same >= 4 * (F.size("_set_a") + F.size("_set_b"))).select("a", "b")


def _pivoted(large: DataFrame) -> DataFrame:
    """Pairs of each text of a large block and one pivot of the block's largest component that can be near by sizes and places.

    The pivot has the fewest rare shingles before the shared one: of a group of near copies, the one in their midst.
    """
    one = F.struct("_at", F.xxhash64("_node").alias("h"), F.col("_node").alias("_node_p"), F.col("_n").alias("_n_p"), F.col("_label").alias("_label_p"))
    pivots = large.groupBy("_s", "_label").agg(F.count(F.lit(1)).alias("c"), F.min(one).alias("p"))
    pivots = pivots.groupBy("_s").agg(F.max(F.struct("c", "p")).alias("top")).select(
        F.col("_s").alias("_ps"), "top.p._node_p", "top.p._n_p", "top.p._label_p", F.col("top.p._at").alias("_at_p")
    )
    fits = 9 * F.least(F.col("_n") - F.col("_at"), F.col("_n_p") - F.col("_at_p")) >= 4 * (F.col("_n") + F.col("_n_p"))
    met = large.join(pivots, (F.col("_s") == F.col("_ps")) & (F.col("_label") != F.col("_label_p")) & fits)
    return met.select(F.least("_node", "_node_p").alias("a"), F.greatest("_node", "_node_p").alias("b"))


def _tiled(large: DataFrame, coarse: DataFrame, tile: int) -> DataFrame:
    """All pairs of a large block of different components that can be near, in tiles of some ``tile`` rows.

    Rows of the largest component are not compared with each other: every other row meets every row of the block once.
    """
    # A row that not even the block's shortest text and least place would let pass has no partner in the block.
    room = F.col("_n") - F.col("_at")
    ends = large.groupBy("_s").agg(F.min("_n").alias("_least"), F.max(room).alias("_most")).withColumnRenamed("_s", "_es")
    fits = 9 * F.least(room, F.col("_most")) >= 4 * (F.col("_n") + F.greatest(F.col("_least"), F.ceil(F.col("_n") * 4 / 5)))
    large = durable(large.join(ends, F.col("_s") == F.col("_es")).where(fits).drop("_es", "_least", "_most"))
    counts = large.groupBy("_s", "_label").agg(F.count(F.lit(1)).alias("c"))
    tops = counts.groupBy("_s").agg(F.sum("c").alias("all"), F.max(F.struct("c", "_label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    parts = lambda rows: F.ceil(rows / F.lit(tile)).cast("int")
    plan = tops.where("labels > 1").select(
        F.col("_s").alias("_ps"), F.col("top._label").alias("_top"), parts(F.col("all")).alias("_chunks"), parts(F.col("all") - F.col("top.c")).alias("_groups")
    )
    rows = durable(large.join(plan, F.col("_s") == F.col("_ps")).drop("_ps"))
    rows = rows.join(coarse, F.col("_node") == F.col("_k"))
    own = ["_s", "_node", "_n", "_at", "_coarse", "_label"]

    def part(of: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("_node", F.lit(seed)), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    all_rows = rows.select(*own, part("_chunks", 1).alias("_chunk"), every("_groups").alias("_group"), F.lit(False).alias("_other"))
    others = rows.where("_label <> _top").select(*own, part("_groups", 2).alias("_group"), every("_chunks").alias("_chunk"), F.lit(True).alias("_other"))
    keys = ["_s", "_chunk", "_group"]
    dealt = all_rows.unionByName(others).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(whole_groups(keys, _tiles), "a long, b long")


def keyed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``_node``, a 64-bit hash of the text by which equal texts are one; a null text counts as empty."""
    return df.withColumn("_node", F.xxhash64(text_or_empty(text_col)))


def near_texts(df: DataFrame, text_col: str = "text", small: int = SMALL, tile: int = TILE) -> DataFrame:
    """``node`` and ``component`` of every text (``_node`` of keyed()) that is near another one, or near one that is, and so on.

    Texts are near at a Jaccard similarity of 0.8 or more of their sets of five-word shingles, whatever their number,
    sizes and distance in ``df``: every pair is found, up to clashes of 64-bit hashes. Texts without words are near
    one another. No rows where no text is near another, or for an empty table. A very long text is one set of hashes.

    First SimHash fingerprints within DISTANCE bits, found by pigeonring chains, link what is nearest. What differs in
    more bits is found by a join: near texts share a shingle of their prefixes, so texts meet under the shingles of
    these; sizes, places and sketches rule out pairs that can't be near, and the whole sets of the others are compared.
    Blocks of up to ``small`` texts are compared at once. In larger ones a pivot of the largest component meets all others first;
    then what still is in different components is compared in tiles. Pairs that are linked already are passed over:
    components are all that is asked.
    """
    texts = keyed(df, text_col).select("_node", text_or_empty(text_col).alias("_text"))
    often, counts = _frequent(texts)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches, 500):
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                found = shingles(plain := text.as_py())
                head, rare = prefix(found, often, counts)
                fine = sketch(found)
                rows.append((
                    node, len(found), head.view(np.int64), rare, fold(fine, SKETCH // 8).tobytes(),
                    None if 8 * len(fine) == SKETCH else fine.tobytes(), fingerprint(plain, FINGERPRINT_WORDS),
                ))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    kinds = {"_node": pa.int64(), "_n": pa.int32(), "_prefix": pa.list_(pa.int64()), "_rare": pa.int32(), "_coarse": pa.binary(), "_fine": pa.binary(), "_fp": pa.int64()}
    shape = "_node long, _n int, _prefix array<long>, _rare int, _coarse binary, _fine binary, _fp long"
    by_task = durable(texts.mapInArrow(compute, shape))  # each text once a task
    slim = durable(by_task.drop("_prefix", "_rare").dropDuplicates(["_node"]))

    prints = slim.groupBy("_fp").agg(F.min("_node").alias("_node"))
    alike = slim.join(prints.select(F.col("_fp").alias("_f"), F.col("_node").alias("b")), F.col("_fp") == F.col("_f")).where("_node <> b")
    edges = links(prints, DISTANCE).union(alike.select(F.col("_node").alias("a"), "b"))
    component = durable(connected_components(_verified(edges, slim, texts)))

    dealt = by_task.select("_node", "_rare", F.posexplode("_prefix").alias("_at", "_s"))
    met = durable(_meeting(dealt.select("_s", "_node", "_at", (F.col("_at") >= F.col("_rare")).alias("_often")), small))

    coarse = slim.select(F.col("_node").alias("_k"), "_coarse")
    sizes = slim.select("_node", "_n")

    def labels(component: DataFrame) -> DataFrame:
        known = sizes.join(component, F.col("_node") == F.col("node"), "left")
        return durable(known.select(F.col("_node").alias("_l"), "_n", F.coalesce("component", "_node").alias("_label")))

    def labeled(rows: DataFrame, label: DataFrame) -> DataFrame:
        return rows.join(label, F.col("_node") == F.col("_l")).select("_s", "_node", "_at", "_n", "_label")

    label = labels(component)
    blocks = labeled(met.where("not _large"), label).join(coarse, F.col("_node") == F.col("_k")).drop("_k")
    pairs = blocks.repartition("_s").sortWithinPartitions("_s").mapInArrow(whole_groups(["_s"], _small_blocks), "a long, b long")
    large = met.where("_large")
    any_large = not large.isEmpty()
    if any_large:
        pairs = pairs.union(_pivoted(durable(labeled(large, label))))

    def joined(pairs: DataFrame) -> DataFrame:
        new = _verified(pairs.distinct(), slim, texts)
        return durable(connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)))

    component = joined(pairs)
    return joined(_tiled(labeled(large, labels(component)), coarse, tile)) if any_large else component
