"""Token counts of a unigram tokenizer by a Viterbi pass that carries scores and counts but no path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE = "▁"
#: What an unknown character scores below the least piece, as unigram tokenizers have it.
UNKNOWN_PENALTY = 10.0
#: Chunks whose counts a worker remembers before it starts anew.
REMEMBERED = 400_000


class Unigram:
    """Counts pieces as a unigram tokenizer does: a space before the text, spaces as pieces' marks, byte fallback.

    Tie rule: of paths to one place with equal scores, the one whose last piece is longest stays, since starts are
    tried in order and only a strictly better score replaces. An unknown character counts one piece for each of
    its bytes. Scores add up in double precision.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.least = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), float(score)))
        self.matches.make_automaton()
        # Where no piece has a mark after another character, a cut stands before each such mark on every path.
        self.cuts = SPACE in self.matches and not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.chunks = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.cuts else r"(?s).+")
        self.known: dict[str, tuple[float, int]] = {}

    def best(self, chunk: str) -> tuple[float, int]:
        """The best path's score and its number of pieces."""
        n = len(chunk)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # places up to here have their best path

        def unknown(end: int, have: float | None, have_count: int) -> tuple[float, int]:
            new = score[end - 1] + self.least
            if have is None or new > have:
                return new, count[end - 1] + len(chunk[end - 1].encode())
            return have, have_count

        at, have, have_count, single = 0, None, 0, False
        for last, (length, piece_score) in self.matches.iter(chunk):
            end = last + 1
            if end != at:
                while done < end - 1:
                    done += 1
                    if done != at:
                        have, have_count, single = None, 0, False
                    if not single:
                        have, have_count = unknown(done, have, have_count)
                    score[done], count[done] = have, have_count
                at, have, have_count, single = end, None, 0, False
            start = end - length
            new = score[start] + piece_score
            if have is None or new > have:
                have, have_count = new, count[start] + 1
            if length == 1:
                single = True
        while done < n:
            done += 1
            if done != at:
                have, have_count, single = None, 0, False
            if not single:
                have, have_count = unknown(done, have, have_count)
            score[done], count[done] = have, have_count
        return score[n], count[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces of the whole text, and the score of its best path."""
        if not text:
            return 0, 0.0
        total, pieces, known = 0.0, 0, self.known
        for chunk in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            found = known.get(chunk)
            if found is None:
                found = self.best(chunk)
                if len(chunk) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = found
            total += found[0]
            pieces += found[1]
        return pieces, total


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """The normal pieces of a sentencepiece file and their scores, read as a unigram model.

    Control, unknown, unused and byte pieces stand for no text of their own and match none.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    normal = [i for i in range(model.get_piece_size()) if not any(kind(i) for kind in special)]
    return Unigram([(model.id_to_piece(i), model.get_score(i)) for i in normal])


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``n_tokens`` long and ``best_score`` double.

    ``path``: a sentencepiece file that every worker can read. An Aho-Corasick automaton lists the pieces that end
    at each place, longest first; dynamic programming keeps the best score and its count. A null or empty text has
    0 tokens and score 0. Rows are independent: ties and repeated rows give equal values, an empty table none, and
    a very long text needs memory for its longest chunk only. Other columns of ``df`` are not read.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, best_score double"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            found = [model.count(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_tokens", "best_score"])

    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(counts, schema)
