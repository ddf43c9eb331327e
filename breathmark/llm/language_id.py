"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import give_back

#: Buckets of hashed n-gram features, a power of two, and the longest n-gram.
BUCKETS_LOG2, LONGEST = 17, 4
#: Words of a line that make one chain; a longer line is cut into chains.
CHAIN = 256
#: Characters of texts that are worked on together, and of the longest text that is worked on in one piece.
TOGETHER, PART = 1 << 17, 1 << 19
#: Documents of each language that the model is fitted on at most, and their longest text.
SAMPLE, SAMPLE_CHARS = 200, 100_000
#: Documents of the sample in all, and languages that are learned at most: the most frequent ones.
TOTAL, LABELS = 20_000, 1_000
#: Times a word is seen in the sample, and the share of them in one language, from which it enters the lexicon.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9

UNDETERMINED = "und"
_GROW = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The words of some texts, in order. ``key``: 64-bit hash; ``distinct``, ``which``: each word's distinct form."""

    doc: np.ndarray
    chain_starts: np.ndarray
    key: np.ndarray
    which: np.ndarray
    grams: np.ndarray  # feature of each n-gram of the distinct forms
    gram_starts: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters, lower-cased; their features are n-grams of up to LONGEST characters.

    Words are framed by marks, so n-grams at their ends are affixes.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    ends_of = np.cumsum([len(t) + 1 for t in lowered])
    letter = _letters()[points]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    size = ends - starts
    doc = np.searchsorted(ends_of, starts, side="right")
    line = np.searchsorted(np.flatnonzero(points == 10), starts)
    new_line = np.flatnonzero(np.diff(line, prepend=-1))
    within = np.arange(n) - np.repeat(new_line, np.diff(np.append(new_line, n)))
    chain_starts = np.flatnonzero(within % CHAIN == 0)

    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first - starts, size)
    place = at - np.repeat(starts, size)
    grown = _GROW ** np.arange(1, max(int(size.max(initial=0)), 1) + 1, dtype=np.uint64)
    key = np.add.reduceat(points[at].astype(np.uint64) * _MIX * grown[place], first) if n else np.empty(0, np.uint64)
    key = (key ^ (key >> np.uint64(29))) * _MIX
    distinct, example, which = np.unique(key, return_index=True, return_inverse=True)

    size, starts = size[example] + 2, starts[example]
    first = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(distinct)), size)
    place = np.arange(total) - first[owner]
    framed = np.ones(total, np.uint64)
    inner = (place > 0) & (place < size[owner] - 1)
    framed[inner] = points[starts[owner[inner]] + place[inner] - 1]
    framed[place == size[owner] - 1] = 2
    room = size[owner] - place  # characters from here to the word's end
    found, owners = [], []
    hashed = np.zeros(total, np.uint64)
    for length in range(1, LONGEST + 1):
        hashed = hashed[: total - length + 1] * _GROW + framed[length - 1 :] + np.uint64(length)
        ok = np.flatnonzero(room[: len(hashed)] >= length)
        found.append(((hashed[ok] * _MIX) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
        owners.append(owner[ok])
        if total < length + 1:
            break
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    gram_starts = np.searchsorted(owners[order], np.arange(len(distinct)))
    return Words(doc, chain_starts, distinct, which, found[order], gram_starts)


@dataclass
class Chains:
    """Positions of chains step by step: at step t the first active[t] of ``order`` still have a word."""

    order: np.ndarray
    starts: np.ndarray
    active: np.ndarray

    @classmethod
    def of(cls, starts: np.ndarray, n: int) -> Chains:
        size = np.diff(np.append(starts, n))
        order = np.argsort(-size, kind="stable")
        active = len(size) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0))), side="right")
        return cls(order, starts[order], active)


def forward_backward(scores: np.ndarray, move: np.ndarray, begin: np.ndarray, chains: Chains) -> tuple:
    """Label probabilities of each word, the forward and the backward messages, each scaled to add up to 1."""
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step, start = np.exp(move), np.exp(begin)
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    last = None
    for t, n in enumerate(chains.active):
        at = chains.starts[:n] + t
        last = emit[at] * (start if last is None else last[:n] @ step)
        last /= last.sum(axis=1, keepdims=True)
        forward[at] = last
    for t in range(len(chains.active) - 1, 0, -1):
        at = chains.starts[: chains.active[t]] + t
        back = (emit[at] * backward[at]) @ step.T
        backward[at - 1] = back / back.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), forward, backward, emit


@dataclass
class Model:
    """Weights of n-gram buckets and of the lexicon, transitions, and starts, by language."""

    languages: list[str]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    lexicon: np.ndarray  # sorted hashes of words
    lexicon_of: np.ndarray  # the language of each
    lexicon_weights: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        sums = np.add.reduceat(self.weights[words.grams], words.gram_starts, axis=0).astype(np.float64)
        at = np.minimum(np.searchsorted(self.lexicon, words.key), max(len(self.lexicon) - 1, 0))
        if len(self.lexicon):
            known = self.lexicon[at] == words.key
            sums[known] += self.lexicon_weights[self.lexicon_of[at[known]]]
        return sums[words.which]

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' label probabilities, and the number of words, of each text."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for part in _parts(text):
                parts.append(part)
                owners.append(i)
                size += len(part)
                if size >= TOGETHER:
                    self._add(parts, owners, sums, counts)
                    parts, owners, size = [], [], 0
        self._add(parts, owners, sums, counts)
        return sums, counts

    def _add(self, parts: list[str], owners: list[int], sums: np.ndarray, counts: np.ndarray) -> None:
        words = words_of(parts)
        if len(words):
            likely = forward_backward(self.scores(words), self.move, self.begin, Chains.of(words.chain_starts, len(words)))[0]
            owner = np.asarray(owners)[words.doc]
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(owner, likely[:, k], len(sums))
            counts += np.bincount(owner, minlength=len(counts))


def _parts(text: str) -> Iterator[str]:
    """The text, cut at spaces where it is longer than PART."""
    at = 0
    while len(text) - at > PART:
        cut = text.rfind(" ", at + PART // 2, at + PART) + 1 or at + PART
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def fit(texts: list[str], labels: list[str], epochs: int = 4, batch: int = 4000, rate: float = 0.06, decay: float = 1e-4) -> Model:
    """Maximises the likelihood of each text's words all being in its language, by adaptive gradient steps.

    The gradient is observed less expected counts, of n-grams and lexicon from label probabilities and of transitions
    from pairs of neighbours, both by forward-backward. Deterministic.
    """
    languages = sorted(set(labels))
    index = {x: i for i, x in enumerate(languages)}
    count = len(languages)
    words = words_of(texts)
    truth = np.array([index[x] for x in labels], np.int64)[words.doc] if len(words) else np.empty(0, np.int64)
    seen = np.zeros((len(words.key), count))
    np.add.at(seen, (words.which, truth), 1)
    often = seen.sum(axis=1)
    chosen = np.flatnonzero((often >= LEXICON_COUNT) & (seen.max(axis=1) >= LEXICON_SHARE * often))
    model = Model(
        languages, np.zeros((1 << BUCKETS_LOG2, count), np.float32), np.zeros((count, count)), np.zeros(count),
        words.key[chosen], seen[chosen].argmax(axis=1), np.zeros((count, count)),
    )
    squares = [np.full_like(x, 1e-6, dtype=np.float64) for x in (model.weights, model.move, model.begin, model.lexicon_weights)]
    starts, ends = words.chain_starts, np.append(words.chain_starts, len(words))[1:]
    entry = np.full(len(words.key), -1)
    entry[chosen] = np.arange(len(chosen))
    gram_ends = np.append(words.gram_starts, len(words.grams))[1:]
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(starts))
        cuts = np.flatnonzero(np.diff(np.cumsum((ends - starts)[order]) // batch)) + 1
        for some in np.split(order, cuts):
            size = ends[some] - starts[some]
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(starts[some] - first, size)
            which = words.which[at]
            lengths = (gram_ends - words.gram_starts)[which]
            gram_first = np.cumsum(lengths) - lengths
            grams = words.grams[np.arange(int(lengths.sum())) + np.repeat(words.gram_starts[which] - gram_first, lengths)]
            scores = np.add.reduceat(model.weights[grams], gram_first, axis=0).astype(np.float64)
            lex = entry[which]
            scores[lex >= 0] += model.lexicon_weights[model.lexicon_of[lex[lex >= 0]]]
            likely, forward, backward, emit = forward_backward(scores, model.move, model.begin, Chains.of(first, len(at)))
            error = np.eye(count)[truth[at]] - likely
            later = np.ones(len(at), bool)
            later[first] = False
            now = np.flatnonzero(later)
            pairs = forward[now - 1][:, :, None] * np.exp(model.move) * (emit[now] * backward[now])[:, None, :]
            pairs = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            observed = np.zeros((count, count))
            np.add.at(observed, (truth[at[now - 1]], truth[at[now]]), 1)
            each = np.repeat(error, lengths, axis=0)
            grams_slope = np.stack([np.bincount(grams, each[:, k], len(model.weights)) for k in range(count)], axis=1)
            lexicon_slope = np.zeros((count, count))
            np.add.at(lexicon_slope, model.lexicon_of[lex[lex >= 0]], error[lex >= 0])
            slopes = (grams_slope, observed - pairs, error[first].sum(axis=0), lexicon_slope)
            for x, g, s in zip((model.weights, model.move, model.begin, model.lexicon_weights), slopes, squares, strict=True):
                g = g / len(at) - decay * x
                s += g * g
                x += rate * g / np.sqrt(s)
    return model


def fit_on(df: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str) -> Model | None:
    """A model fitted on a bounded sample of the rows where ``usable``: SAMPLE documents of each language, by hash, and TOTAL in all.

    Rows without a language or a letter, or longer than SAMPLE_CHARS, are not in the sample. None without any. More languages share TOTAL; of more than LABELS
    the most frequent ones are learned.
    """
    good = usable & F.col(label_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS) & F.col(text_col).rlike(r"\p{L}")
    rows = df.where(good).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("h"),
    )
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LABELS).collect()
    if not counts:
        return None
    share = min(SAMPLE, TOTAL // len(counts))
    # Twice the sample by hash, of which the least hashes stay; where that is too few by chance, fewer do.
    bounds = [(r["label"], int((1 << 30) * min(1.0, 2 * share / r["count"]))) for r in counts]
    bounds = df.sparkSession.createDataFrame(bounds, "known string, most long")
    first = Window.partitionBy("label").orderBy("h", "text")
    sample = rows.join(F.broadcast(bounds), F.col("label") == F.col("known")).where(F.col("h") < F.col("most"))
    sample = sample.withColumn("r", F.row_number().over(first)).where(F.col("r") <= share)
    taken = sorted((r["label"], r["text"]) for r in sample.select("label", "text").collect())
    return fit([t for _, t in taken], [x for x, _ in taken])


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify_languages(
    df: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``df`` with the language of each whole text and its score from 0 to 1 as two more columns.

    A document's label probabilities are the means of its words'; the largest is the score. Texts that are null or
    have no letters, and all texts where there is no model, are ``und`` with score 0. Columns of ``df`` that have
    the new names are replaced. The model is some MB by its number of buckets, whatever it was fitted on.
    """
    rest = df.drop(*names)
    schema = StructType([*rest.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    columns = [*rest.columns, *names]
    where = columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [x or "" for x in part.column(where).to_pylist()]
                sums, counts = crf.label(texts) if crf else (np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64))
                best = sums.argmax(axis=1)
                found = [crf.languages[k] if n else UNDETERMINED for k, n in zip(best.tolist(), counts.tolist(), strict=True)]
                score = np.clip(sums[np.arange(len(texts)), best] / np.maximum(counts, 1), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(score)], columns)
        give_back()

    return rest.mapInArrow(label, schema)
