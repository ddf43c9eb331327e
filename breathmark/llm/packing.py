"""Bulk-synchronous best-fit packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, give_back, text_or_empty

CAPACITY = 4096
#: The id that ends each document.
END_ID = 1
#: Words, and parts of words, whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Texts by which a tokenizer is tried: cases, contractions, digits, signs, letters beyond Latin-1, odd spaces.
TRIED = (
    "It's WE'LL I'd a1b23 x--y?! (don't) ÀÉß½²ªµ naïve", "a  b\tc\n\nd \x0b\x0c e", "ΑΣ Σ ό İI 梦🙂 ▁ \u00a0 \u0085", "'s'S 're 'x ''", " lead and trail ",
)

# The splitting pattern of the lower-casing word tokenizer (fixed value).
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _printable() -> dict[int, str]:
    """Byte-level alphabets write a byte that prints as itself, and the others, in order, from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds:
    """Token ids of whole texts by a lower-casing byte-level word tokenizer, tokenized word by word and remembered.

    Exact where the normalizer and the splitter never look across ASCII white space and give nothing for it. Words
    of Latin-1 characters are lower-cased and split here and only their parts go to the tokenizer's model, since
    most new words are known parts anew; all other words go through the whole tokenizer. A tokenizer that splits in
    another way is found out by TRIED texts, and then whole texts go through it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.bytes = self.whole.model, _printable()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.by_words = hasattr(self.model, "tokenize") and all(self._by_words(t) == self._whole(t) for t in TRIED)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.remembered:
                self.parts.clear()
            shown = part.encode().decode("latin-1").translate(self.bytes)
            found = self.parts[part] = struct.pack(f"<{len(t)}I", *t) if (t := [x.id for x in self.model.tokenize(shown)]) else b""
        return found

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if max(word) >= "\u0100" or any(t in word for t in self.special):
            return self._whole(word)
        lower = word.lower()
        return self._part(lower) if lower.isalpha() else b"".join(map(self._part, PARTS.findall(lower)))

    def forget(self) -> None:
        """Drops what is remembered: a worker that stays for other operators' tasks holds the tokenizer only."""
        self.words.clear()
        self.parts.clear()
        give_back()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self._by_words(text) if self.by_words else self._whole(text)

    def _by_words(self, text: str) -> bytes:
        known, out = self.words, []
        for raw in text.encode().split():
            found = known.get(raw)
            if found is None:
                if len(known) >= self.remembered:
                    known.clear()
                found = self._word(raw)
                if len(raw) <= 64:
                    known[raw] = found
            out.append(found)
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str, remembered: int = REMEMBERED) -> WordIds:
    return WordIds(path, remembered)


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit of sorted runs. Rows (length, low, high, wide, first, offset), sorted by length and low.

    ``counts``: pieces by length, each length from 1 to ``capacity``. The pieces of a length with ranks low to
    high - 1 go to the sequences first .. first + wide - 1: rank r to first + (r - low) % wide, at
    offset + (r - low) // wide * length.

    A superstep takes the longest pieces left, all at once. Gaps are kept in order; the pieces sweep over their
    successors, the smallest gap that holds them first, and each gap takes as many as fit, as best fit would one
    by one. Where pieces and gaps contend, ranks decide. Then the gaps are updated and the next length follows;
    what finds no gap opens sequences. Pieces and gaps of one size are one run, so the state depends on
    ``capacity`` and not on the number of pieces: a superstep splits at most two runs and adds two, and a run that
    takes pieces is left with under half its gap, so there are under 4 * capacity * log2(capacity) rows.
    """
    plan, opened = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def give(gap: int, first: int, wide: int) -> None:
        if gap and wide:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, wide))

    for length in sorted(counts, reverse=True):
        low, left = 0, counts[length]

        def place(gap: int, first: int, wide: int) -> int:
            """Puts what it can into a run of gaps; returns how many of the run's sequences stay untouched."""
            nonlocal low, left
            each = gap // length
            full = min(wide, left // each)
            if full:
                plan.append((length, low, low + full * each, full, first, capacity - gap))
                low, left = low + full * each, left - full * each
                give(gap - each * length, first, full)
            if left and full < wide:
                plan.append((length, low, low + left, 1, first + full, capacity - gap))
                give(gap - left * length, first + full, 1)
                low, left, full = low + left, 0, full + 1
            return wide - full

        while left and (at := bisect_left(order, length)) < len(order):
            gap = order[at]
            first, wide = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            rest = place(gap, first, wide)
            give(gap, first + wide - rest, rest)
        if left:
            need = -(-left // (capacity // length))
            place(capacity, opened, need)
            opened += need
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def pack_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its token ids, then ``end_id``; a null or empty text is ``end_id`` alone. Documents longer than
    ``capacity`` are cut into pieces of ``capacity`` and a rest; no other is cut. Pieces of one sequence lie side by
    side from offset 0. Rows that repeat an id are packed each. An empty table gives an empty result. Other columns
    of ``df`` are not read.

    A task remembers the ids of ``remembered`` words, and of as many parts of words, before it starts anew: memory
    against time, results don't depend on it.

    Tokenizing runs once and its pieces are kept (40 bytes each). Each task numbers its own pieces by length, and
    prefix sums over tasks make those numbers ranks within the length, so no length, however common, meets in one
    task. Only the histogram of lengths, ``capacity`` rows at most, goes to the driver, and only the plan made of it
    (``pack_plan``, bounded by ``capacity`` alone) goes back.
    """
    kind = df.schema[id_col].dataType.simpleString()
    parts = ["piece", "start", "length", "ids_crc32", "task", "nth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, task = load(path, remembered), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = words.ids(text.as_py()) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    length = len(own) // 4
                    rows.append(row)
                    out.append((piece, start // 4, length, zlib.crc32(own), task, seen[length]))
                    seen[length] += 1
            columns = np.array(out, np.int64).reshape(-1, len(parts)).T
            owners = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([owners, *(pa.array(np.ascontiguousarray(c)) for c in columns)], [id_col, *parts])
        words.forget()

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in parts)
    pieces = durable(df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(cut, schema))
    by_task = durable(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pack_plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    shared = df.sparkSession.sparkContext.broadcast(plan)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        lengths = rows[:, 0].copy()
        first_of = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.empty(len(length), np.int64)
            for size in np.unique(length):
                own = length == size
                a, b = first_of[size], first_of[size + 1]
                at[own] = a + np.searchsorted(rows[a:b, 1], rank[own], side="right") - 1
            row = rows[at]
            past = rank - row[:, 1]
            sequence, offset = row[:, 4] + past % row[:, 3], row[:, 5] + past // row[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.withColumn("piece", F.col("piece").cast("int")).mapInArrow(seat, out)
