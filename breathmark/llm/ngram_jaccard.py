"""Similarity join of texts by the Jaccard similarity of their word n-grams, on PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, starts_of, text_or_empty, whole_groups
from .components import connected_components

#: Parts into which each partition of the features is cut once more; a signature is the content of all parts of one but one.
PARTS = 3
#: Largest size of a band over its smallest.
BAND = 1.5
#: Bits of the sketch by which pairs of large blocks are looked through.
SKETCH = 512
#: Sets, and n-grams in all, up to which candidates that hang together are compared in one task.
CLUSTER, GRAMS = 512, 2_000_000
#: Sets that all of a larger cluster are compared with in a round, rounds, and sets of such a cluster in one task.
PIVOTS, ROUNDS, CHUNK = 64, 2, 4096
#: Sets of the sample in which frequent signatures are looked for, from how many of them on one is frequent, and signatures so found.
SAMPLE, OFTEN, MOST = 10_000, 8, 100_000
#: Hashes of texts up to which they are broadcast; more of them are joined by a shuffle.
BROADCAST = 1_000_000


class Likeness:
    """Sets are near when their common part is ``p / q`` of both together, or more."""

    def __init__(self, p: int = 9, q: int = 10):
        self.p, self.q = p, q

    def apart(self, both: int) -> int:
        """The most elements in which two near sets differ that have ``both`` elements, each counted in either."""
        return (self.q - self.p) * both // (self.q + self.p)

    def near(self, same: np.ndarray, both: np.ndarray) -> np.ndarray:
        return (self.p + self.q) * same >= self.p * both

    def largest(self, n: int) -> int:
        """The largest set that one of ``n`` elements can be near."""
        return self.q * n // self.p

    def least(self) -> int:
        """The smallest set that another than itself can be near."""
        n = 1
        while self.largest(n) == n:
            n += 1
        return n

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(number, largest size) of the bands under which a set of ``n`` elements meets near ones: its own, and the next where a larger set of that may be near."""
        low, number = self.least(), 0
        while n >= low:
            high = max(low, self.largest(low), int(low * BAND))
            if n <= high:
                bands = [(number, high)]
                if self.largest(n) > high:
                    low = high + 1
                    bands.append((number + 1, max(low, self.largest(low), int(low * BAND))))
                return bands
            low, number = high + 1, number + 1
        return []


def grams(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``words`` words, A-Z lowered; fewer words are one run, none give none."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    made = [b" ".join(own)] if len(own) < words else map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, made, repeat(42)), "<u8"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers, different for different ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(found: np.ndarray, like: Likeness) -> np.ndarray:
    """PartEnum signatures of a set: any two near sets of different content share one.

    Sets of one band differ in k elements at most. All possible elements are dealt into ceil((k + 1) / 2) + 1 partitions, so that two
    of them hold one difference or none, and each of these into PARTS parts, of which all but one are equal then. A signature is the content of
    PARTS - 1 parts of a partition. Contents without an element say little and are left out, unless two partitions of
    the set have such: then a near set might share no other.
    """
    out = []
    for number, high in like.bands(len(found)):
        partitions = (like.apart(2 * high) + 2) // 2 + 1
        cell = (found % np.uint64(partitions * PARTS)).astype(np.int64)
        sums = np.zeros(partitions * PARTS, np.uint64)
        np.add.at(sums, cell, _mixed(found))
        sizes = np.bincount(cell, minlength=partitions * PARTS).reshape(-1, PARTS)
        sums = sums.reshape(-1, PARTS)
        rest, left = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums, sizes.sum(axis=1, keepdims=True) - sizes
        names = np.arange(partitions * PARTS, dtype=np.uint64) + (np.uint64(number + 1) << np.uint64(40))
        made = _mixed(rest.ravel() + _mixed(names))
        hollow = left == 0
        out.append(made if hollow.any(axis=1).sum() > 1 else made[~hollow.ravel()])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the elements in SKETCH cells: sets differ in as many elements as sketches in bits, or more."""
    return np.packbits((np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(bool), bitorder="little")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n elements that each reaches over the pairs (a, b)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], np.int64)


def near_pairs(sets: list[np.ndarray], like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near sets, from the counts of their common elements: a product of 0-1 matrices, by columns that two sets have."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    own = place[column]
    owner, own = owner[own >= 0], own[own >= 0]
    order = np.argsort(own, kind="stable")
    owner, own = owner[order], own[order]
    same = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), 2048):
        a, b = np.searchsorted(own, [at, at + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[a:b], own[a:b] - at] = 1
        same += part @ part.T
    return np.nonzero(np.triu(like.near(same.astype(np.int64), sizes[:, None] + sizes[None, :]), 1))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy().view(np.uint64)
        out += [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


def _edges(a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and set, the distinct ones whose signature another set has too, with that ``other``: one before it or after it."""
    last: tuple | None = None  # signature, set, whether it is given out already
    for batch in batches:
        s, node = batch["s"].to_numpy(), batch["node"].to_numpy()
        given = False
        if last:
            s, node, given = np.append(last[0], s), np.append(last[1], node), last[2]
        new = np.append(True, (s[1:] != s[:-1]) | (node[1:] != node[:-1]))
        s, node = s[new], node[new]
        if not len(s):
            continue
        same = s[1:] == s[:-1]
        before, after = np.append(False, same), np.append(same, False)
        other = np.where(before, np.roll(node, 1), np.roll(node, -1))
        met = before | after
        if given:
            met[0] = False
        last = (s[-1], node[-1], bool(met[-1]) or (given and len(s) == 1))
        yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (s, node, other)], ["s", "node", "other"])


def _met(rows: DataFrame, sets: int) -> DataFrame:
    """``s, node, other`` of the rows (``s, node``) whose signature another set has too; ``sets``: how many sets there are.

    Signatures that many of a sample of sets have are summed up by tasks first and joined back, which adaptive execution splits where one is hot; all
    others are dealt out once.
    """
    often = rows.where(F.pmod("node", F.lit(max(1, sets // SAMPLE))) == 0).groupBy("s").agg(F.count_distinct("node").alias("c")).where(F.col("c") >= OFTEN)
    often = durable(often.orderBy(F.desc("c"), "s").limit(MOST).select(F.col("s").alias("hot")))
    marked = rows.join(F.broadcast(often), F.col("s") == F.col("hot"), "left")
    ends = marked.where("hot is not null").groupBy(F.col("s").alias("e")).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    hot = marked.where("hot is not null").select("s", "node").join(ends, F.col("s") == F.col("e"))
    hot = hot.select("s", "node", F.when(F.col("node") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other")).distinct()
    plain = marked.where("hot is null").select("s", "node").repartition("s").sortWithinPartitions("s", "node")
    return durable(plain.mapInArrow(_meeting, "s long, node long, other long").union(hot))


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cluster, node, m, set`` of the texts whose hash ``th`` is in ``wanted``, once a task."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                new = [i for i, node in enumerate(part.column(1).to_pylist()) if not (node in seen or seen.add(node))]
                part = part.take(pa.array(new, pa.int64()))
                found = [grams(x.as_py(), words).view(np.int64) for x in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["cluster", "node", "m", "set"])
        give_back()

    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, F.col("th") == F.col("wh")).select("cluster", "node", "m", "text")
    return rows.mapInArrow(make, "cluster long, node long, m long, set array<long>")


def _small(sets: DataFrame, like: Likeness) -> DataFrame:
    """``a, b``: links of each set with the least that it reaches in its cluster."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cluster, node, found = table["cluster"].to_numpy(), table["node"].to_numpy(), _lists(table["set"])
        for start, size in zip(*starts_of(cluster), strict=True):
            own, at = np.unique(node[start : start + size], return_index=True)  # a set may have come from several tasks
            if len(own) > 1:
                root = own[_roots(len(own), *near_pairs([found[start + i] for i in at], like))]
                yield _edges(own[root != own], root[root != own])

    dealt = sets.repartition("cluster").sortWithinPartitions("cluster")
    return dealt.mapInArrow(whole_groups(["cluster"], work), "a long, b long")


def _round(rows: DataFrame, pivots: DataFrame, like: Likeness) -> DataFrame:
    """``a, b``: links of the sets of each cluster with those of its pivots that they are near, one row for each set and what ties these pivots together."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, keys, owners, sizes, tied = None, [], None, None, None, set()
        held: list[np.ndarray] = []
        for batch in batches:
            a, b = [], []
            found = _lists(pa.chunked_array([batch["set"]]))
            for cluster, chunk, pivot, node, own in zip(*(batch[c].to_pylist() for c in ("cluster", "chunk", "pivot", "node")), found, strict=True):
                if (cluster, chunk) != key:
                    key, names, held, keys, tied = (cluster, chunk), [], [], None, set()
                if pivot:
                    if node not in names:
                        names.append(node)
                        held.append(own.copy())
                    continue
                if not names:
                    continue
                if keys is None:  # all pivots have come: sorted by this time are their elements and whose they are
                    keys, sizes = np.concatenate(held), np.array([len(x) for x in held])
                    order = np.argsort(keys, kind="stable")
                    keys, owners, held = keys[order], np.repeat(np.arange(len(names)), sizes)[order], []
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                count = high - low
                at = np.repeat(high - count.cumsum(), count) + np.arange(count.sum())
                same = np.bincount(owners[at], minlength=len(names))
                near = [names[i] for i in np.flatnonzero(like.near(same, sizes + len(own))) if names[i] != node]
                if near:
                    a.append(node)
                    b.append(near[0])
                for other in near[1:]:
                    if (near[0], other) not in tied:
                        tied.add((near[0], other))
                        a.append(near[0])
                        b.append(other)
            yield _edges(a, b)
        give_back()

    own = rows.select("cluster", F.pmod(F.xxhash64("node", F.lit(0)), F.ceil(F.col("m") / CHUNK)).alias("chunk"), F.lit(False).alias("pivot"), "node", "set")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / CHUNK) - 1))
    own = own.unionByName(pivots.select("cluster", spread.alias("chunk"), F.lit(True).alias("pivot"), "node", "set"))
    own = own.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", F.desc("pivot"))
    return own.mapInArrow(meet, "a long, b long")


def _blocks(rows: DataFrame, like: Likeness) -> DataFrame:
    """``a, b``: pairs of rows (``s, node, label, n, print``) of one signature and different labels that can be near, by sizes and sketches.

    Rows of a signature's largest label aren't compared with each other: each other row meets every row once, in tiles of CHUNK rows.
    """
    counts = rows.groupBy("s", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("s")
    plan = counts.agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    tiles = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    plan = plan.select(F.col("s").alias("ps"), F.col("top.label").alias("most"), tiles(F.col("all")).alias("chunks"), tiles(F.col("all") - F.col("top.c")).alias("groups"))
    planned = rows.join(plan, F.col("s") == F.col("ps"))

    def part(of: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    own = ["s", "node", "label", "n", "print"]
    everyone = planned.select(*own, part("chunks", 1).alias("chunk"), every("groups").alias("group"), F.lit(False).alias("other"))
    others = planned.where("label <> most").select(*own, part("groups", 2).alias("group"), every("chunks").alias("chunk"), F.lit(True).alias("other"))
    keys = ["s", "chunk", "group"]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, label, n = (table[c].to_numpy() for c in ("node", "label", "n"))
        bits = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
        other = table["other"].to_numpy(zero_copy_only=False)
        for start, size in zip(*starts_of(*(table[c].to_numpy() for c in keys)), strict=True):
            at = np.arange(start, start + size)
            ones, rest = at[other[at]], at[~other[at]]
            for i in ones:
                both = n[i] + n[rest]
                j = rest[(label[i] != label[rest]) & like.near(np.minimum(n[i], n[rest]), both)]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                j = j[(like.p + like.q) * differ <= (like.q - like.p) * (n[i] + n[j])]
                if len(j):
                    yield _edges(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))

    dealt = everyone.unionByName(others).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(whole_groups(keys, work), "a long, b long").distinct()


def _large(sets: DataFrame, met: DataFrame, like: Likeness, rounds: int) -> DataFrame:
    """``node, component`` of the sets of clusters that are too large for one task.

    A set that is near a pivot is linked, and pivots tie a group of near copies together, so work grows with the group and not with its pairs. What is
    then still apart is compared with all that shares a signature with it.
    """
    sets = durable(sets.dropDuplicates(["node"]))
    size = sets.select("cluster", "node")
    found = None

    def labels() -> DataFrame:
        if found is None:
            return size.withColumn("label", F.col("node"))
        known = found.select(F.col("node").alias("k"), F.col("component").alias("label"))
        return durable(size.join(known, F.col("node") == F.col("k"), "left").select("cluster", "node", F.coalesce("label", "node").alias("label")))

    def linked(edges: DataFrame) -> DataFrame:
        before = [] if found is None else [found.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        for more in before:
            edges = edges.union(more)
        return durable(connected_components(edges))

    for r in range(rounds):
        pivots = sets.where(F.pmod(F.xxhash64("node", F.lit(r + 1)), F.ceil(F.col("m") / PIVOTS)) == 0)
        rows = sets
        if r:
            label = labels()
            tops = label.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("top"))
            apart = label.join(tops.select(F.col("cluster").alias("tc"), F.col("top.label").alias("most")), F.col("cluster") == F.col("tc")).where("label <> most")
            rows = sets.join(apart.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_semi")
        found = linked(_round(rows, pivots, like))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _lists(pa.chunked_array([batch["set"]]))
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([len(x) for x in own], pa.int64()), pa.array([sketch(x).tobytes() for x in own], pa.binary())], ["k", "n", "print"])

    label = labels()
    marked = met.select("s", "node").join(label.select(F.col("node").alias("l"), "label"), F.col("node") == F.col("l")).select("s", "node", "label")
    mixed = marked.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("s").alias("ms"))
    marked = durable(marked.join(mixed, F.col("s") == F.col("ms"), "left_semi"))
    described = sets.select("node", "set").mapInArrow(prints, "k long, n long, print binary")
    pairs = _blocks(marked.join(described, F.col("node") == F.col("k")).select("s", "node", "label", "n", "print"), like)
    one, two = (sets.select(F.col("node").alias(f"k{e}"), F.col("set").alias(f"set{e}")) for e in ("a", "b"))
    both = pairs.join(one, F.col("a") == F.col("ka")).join(two, F.col("b") == F.col("kb"))
    same, total = F.size(F.array_intersect("seta", "setb")), F.size("seta") + F.size("setb")
    return linked(both.where((like.p + like.q) * same >= like.p * total).select("a", "b"))


def jaccard_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    like: Likeness | None = None,
    cluster: int = CLUSTER,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles`` (its distinct n-grams) and ``component_id``, the smallest id that it reaches over links.

    Two rows link when the n-grams that both have are ``like.p / like.q`` of those that either has, or more; n-grams are runs of ``words`` words (of other than ASCII
    white space, A-Z lowered), and a text of fewer words is one. A null text, or one without words, has none and links with nothing, not even its copies.
    Rows that repeat an id are rows of their own under each of their sets. A null id is never a component's smallest unless no row of it has one.
    A text of any length is one set. All links count, up to clashes of 64-bit hashes. An empty table gives an empty result. Other columns of ``df`` are not read.

    Equal sets are one from the start. ``signatures`` bring near sets together: what shares one is a candidate, and candidates that hang together over signatures are a
    cluster. A cluster of up to ``cluster`` sets goes to one task, which compares its sets exactly. In a larger one, as of very many near copies,
    sets are compared with ``rounds`` of some PIVOTS others, and what these leave apart with all that shares a signature, so no step works on all pairs of near copies.
    Only sets of clusters are made again from their texts; all others leave a few numbers and their signatures.
    """
    like = like or Likeness()
    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    texts = df.select(F.xxhash64(text).alias("th"), text.alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, nodes, sizes, signs = batch.slice(at, 500), [], [], []
                for x in part.column(2):
                    found = grams(x.as_py(), words)
                    node = int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
                    signs.append(None if node in seen else signatures(found, like).view(np.int64))
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(found))
                made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], ["id", "th", "node", "n", "signs"])
        give_back()

    read = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = durable(read.mapInArrow(compute, f"id {kind}, th long, node long, n long, signs array<long>"))
    fresh = rows.where("signs is not null")
    met = _met(fresh.select(F.explode("signs").alias("s"), "node"), fresh.count())
    clusters = durable(connected_components(met.select(F.col("node").alias("a"), F.col("other").alias("b"))))
    of = fresh.join(clusters.select(F.col("node").alias("k"), F.col("component").alias("cluster")), F.col("node") == F.col("k"))
    of = durable(of.groupBy("node", "cluster").agg(F.min("th").alias("wh"), F.min("n").alias("n")))
    sizes = of.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).select(F.col("cluster").alias("c"), "m", ((F.col("m") > cluster) | (F.col("all") > GRAMS)).alias("large"))
    wanted = durable(of.join(sizes, F.col("cluster") == F.col("c")).select("wh", "cluster", "node", "m", "large"))
    links = _small(_sets(texts, wanted.where("not large").drop("large"), words), like).select(F.col("a").alias("node"), F.col("b").alias("component"))
    large = wanted.where("large").drop("large")
    if not large.isEmpty():
        links = links.union(_large(_sets(texts, large, words), met.join(large.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_semi"), like, rounds))
    links = links.union(links.select("component", "component")).distinct().select(F.col("node").alias("k"), "component")

    ids = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("copies"))
    ids = ids.join(links, F.col("node") == F.col("k"), "left").where("copies > 1 or k is not null")
    tied = durable(ids.select("node", "own", F.coalesce("component", "node").alias("label")))
    least = tied.groupBy(F.col("label").alias("l")).agg(F.min("own").alias("least"))
    found = tied.join(least, F.col("label") == F.col("l")).select(F.col("node").alias("t"), "least")
    joined = rows.select("id", "n", "node").join(found, F.col("node") == F.col("t"), "left")
    component = F.when(F.col("t").isNull(), F.col("id")).otherwise(F.col("least"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
