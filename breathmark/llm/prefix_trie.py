"""Prefix trie of conversations: families are rebuilt and merged by themselves, then their nodes are merged over all."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

#: Conversations of a family: those of one base, the id less its remainder by this.
FAMILY = 20
#: Inherited turns are an id's checksum modulo this, so 0 to 3.
INHERITED = 4
#: Families whose ids are joined into one string before a node's ids are hashed in order.
BLOCK = 256
#: Rows of a batch that a worker makes.
ROWS = 20_000
#: The key of the root.
ROOT = bytes(16)

_PART = pa.schema([
    ("fam", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("conv", pa.int64()), ("n", pa.int64()),
    ("words", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
])
_PART_SQL = "fam long, depth long, key binary, parent binary, conv long, n long, words long, members array<long>, ends array<long>"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ROWS."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class _Conversation:
    """What is kept of a conversation while its family passes: how many turns it inherits, its depth and the key of its last node."""

    def __init__(self, conv: int):
        self.inherits, self.depth, self.key = crc32(str(conv).encode()) % INHERITED, 0, ROOT


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fam, nr, conv, turn, words) sorted by fam and nr, to the nodes of each family's trie and the ends of its conversations.

    Turn after turn, all conversations of a family take theirs: the base's while they inherit, then their own. Those that come to the same
    node make one row of it. A worker holds one key for each conversation of one family, whatever the number of turns.
    """

    def work() -> Iterator[tuple]:
        fam, nr = None, None
        known: dict[int, _Conversation] = {}
        turns: dict[int, tuple[bytes, int]] = {}

        def step() -> Iterator[tuple]:
            """The turns of number ``nr`` have all come."""
            if nr == 1:
                known.update({c: _Conversation(c) for c in sorted(turns)})
                yield fam, 0, ROOT, None, min(known), len(known), 0, sorted(known), None
            met: dict[bytes, list] = {}
            for conv, own in known.items():
                turn = turns.get(fam if own.inherits >= nr else conv)
                if turn:
                    before, own.depth = own.key, own.depth + 1
                    own.key = blake2b(before + turn[0], digest_size=16).digest()
                    met.setdefault(own.key, [own.depth, before, turn[1], []])[3].append(conv)
            for key, (depth, parent, words, members) in met.items():
                yield fam, depth, key, parent, min(members), len(members), words, sorted(members), None

        def close() -> Iterator[tuple]:
            ends = defaultdict(list)
            for conv, own in known.items():
                ends[own.depth, own.key].append(conv)
            for (depth, key), convs in ends.items():
                yield fam, depth, key, None, None, None, None, None, sorted(convs)

        for f, n, conv, turn, words in _rows(batches):
            if (f, n) != (fam, nr):
                if fam is not None:
                    yield from step()
                if f != fam:
                    if fam is not None:
                        yield from close()
                    known = {}
                fam, nr, turns = f, n, {}
            turns[conv] = (turn, words)
        if fam is not None:
            yield from step()
            yield from close()

    return _batches(work(), _PART)


_SUM = pa.schema([("key", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fam, depth, key, members, conv, leaf, saved) sorted by fam and falling depth, those with ``conv`` first, to sums below nodes.

    A row with ``conv`` is what a node of the whole trie is worth, brought to the family of its smallest member; the others are the family's
    own nodes. The nodes below one that a family brought in are those whose smallest members are among its own.
    """

    def work() -> Iterator[tuple]:
        fam = None
        leaves: dict[int, int] = {}
        saved: dict[int, int] = {}
        for f, _, key, members, conv, leaf, worth in _rows(batches):
            if f != fam:
                fam, leaves, saved = f, defaultdict(int), defaultdict(int)
            if conv is not None:
                leaves[conv] += leaf
                saved[conv] += worth
            else:
                below = sum(leaves[c] for c in members), sum(saved[c] for c in members)
                if any(below):  # where smaller members hold all nodes below in other families nothing is left to add
                    yield key, *below

    return _batches(work(), _SUM)


_HASH = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, ids) sorted by key and block to the SHA-256 of each key's ids; one hash state is held, not the ids."""

    def work() -> Iterator[tuple]:
        last, state = None, None
        for key, _, ids in _rows(batches):
            if key != last:
                if state:
                    yield last, state.hexdigest()
                last, state = key, sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if state:
            yield last, state.hexdigest()

    return _batches(work(), _HASH)


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def prefix_trie(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A conversation's turns go by ``turn_col``, null first; rows of one turn go by the SHA-256 of role and text, so rows that repeat a turn
    are turns of their own. A null role or text is empty. Rows without an id belong to no conversation. Conversation c takes the first h turns
    of its base c - c % 20, h its decimal id's CRC-32 modulo 4 (of a base that has fewer all, of one without rows none), then its own after its first h.
    The remainder of a negative id is negative or 0. A node is a distinct sequence of first turns, up to clashes of 128-bit hashes; ``conv_id``
    is its smallest member. The root has no parent. An empty table has no conversation, so no root and no rows. Texts of any length are
    hashed and counted where they are read. Other columns of ``df`` are not read, whatever their names.

    Family-first: turns, as hashes of 16 bytes, are brought together by base id; each family rebuilds its conversations and builds its small trie,
    turn after turn, in a few hundred bytes; then only the families' nodes are shuffled and merged, first within tasks, so a turn that all begin
    with is a row a task. A node's subtree is the sum of what lies below it in each family: every node of the whole trie counts in the family
    of its smallest member, which holds the whole path to it. So no step follows the depth, and none holds a node's members.
    A conversation of very many turns is numbered by a sort that spills. Ids that end at a node are joined by blocks of families, and
    their hash is carried from block to block.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(id_col).cast("long")
    turn = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = df.where(conv.isNotNull()).select(
        base_of(conv).alias("fam"), conv.alias("conv"), F.col(turn_col).alias("at"), turn.alias("turn"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("fam", "conv").orderBy(F.col("at").asc_nulls_first(), "turn")
    # Dealt by family once: the window over a family's conversations and the walk through the family need no other exchange.
    turns = rows.repartition("fam").withColumn("nr", F.row_number().over(order).cast("long"))
    turns = turns.select("fam", "nr", "conv", "turn", "words").sortWithinPartitions("fam", "nr")
    parts = durable(turns.mapInArrow(_family, _PART_SQL))
    own = parts.where("ends is null")

    merged = durable(own.groupBy("key").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words")
    ))
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("child_of")).agg(F.count(F.lit(1)).alias("children"))
    nodes = merged.join(children, F.col("key") == F.col("child_of"), "left")
    nodes = durable(nodes.select("key", "parent", "depth", "conv", "n", F.coalesce("children", F.lit(0)).alias("children"), "words"))

    worth = nodes.select(
        base_of(F.col("conv")).alias("fam"), "depth", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("array<long>").alias("members"), "conv",
        (F.col("children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("saved"),
    )
    nothing = [F.lit(None).cast("long").alias(c) for c in ("conv", "leaf", "saved")]
    walk = worth.unionByName(own.select("fam", "depth", "key", "members", *nothing)).repartition("fam")
    walk = walk.sortWithinPartitions("fam", F.desc("depth"), F.col("conv").asc_nulls_last())
    below = walk.mapInArrow(_subtrees, "key binary, leaves long, saved long").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = parts.where("ends is not null").groupBy("key", (F.col("fam") - F.pmod("fam", F.lit(BLOCK * FAMILY))).alias("block"))
    ids = F.transform(F.array_sort(F.flatten(F.collect_list("ends"))), lambda c: c.cast("string"))
    ends = ends.agg(F.array_join(ids, ",").alias("ids")).repartition("key").sortWithinPartitions("key", "block")
    hashes = ends.mapInArrow(_hashes, "key binary, ends_sha256 string")

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("key", name)

    # The parent of all first turns is the root, whose smallest member is one number; other parents are joined, where they are hot in split parts.
    root = nodes.where("depth = 0").select("conv").first()
    above = nodes.where("depth > 0").select(F.col("key").alias("above"), F.col("conv").alias("above_conv"))
    found = (
        nodes.join(above, (F.col("parent") == F.col("above")) & (F.col("depth") > 1), "left")
        .join(keyed(below, "below"), F.col("key") == F.col("below"), "left")
        .join(keyed(hashes, "ended"), F.col("key") == F.col("ended"), "left")
    )
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(root and root[0]).cast("long")).otherwise(F.col("above_conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
