"""Near-duplicate texts by Jaccard similarity, against brute force."""

import random
from functools import partial

import corpus_pipeline
from breathmark.llm import near_text


def plain_kept(rows):
    """The smallest id of each group of texts that share four fifths of their five-word shingles."""

    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= 4 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "xa", "s0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def near_copies(rng, n):
    """Texts of some bases with more or fewer words changed, below and above the least similarity."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(rng.randint(3, 120))] for _ in range(n // 12)]
    texts = []
    for _ in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, 1 + len(own) // 25)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    return texts


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(4)
    texts = near_copies(rng, 240) + ["", "  ", None, "one two", "One  two"]
    rows = list(enumerate(texts))
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert got == plain_kept(rows)


def test_large_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "near_texts", partial(near_text.near_texts, small=4, tile=8))
    monkeypatch.setattr(near_text, "OFTEN", 3)
    rng = random.Random(8)
    rows = [(i, f"{t} every text ends with this very line of words") for i, t in enumerate(near_copies(rng, 240))]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert got == plain_kept(rows)


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(6)
    a, b, c, d = near_copies(rng, 48)[::12]
    a, b, c, d = (f"{t} {k * 8}" for t, k in zip((a, b, c, d), ("p ", "q ", "r ", "s ")))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (4, d)]
    got = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (2, b), (3, c), (4, d)]


def test_shared_rows_are_found_across_batches():
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.randrange(30) ** 2 // 30, rng.randrange(12), 0) for _ in range(300))
    table = pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("_s", "_node", "_at"))})
    for size in (1, 7, 300):
        out = [tuple(r.values()) for b in near_text._shared(5)(iter(table.to_batches(size))) for r in b.to_pylist()]
        nodes = {s: {n for k, n, _ in rows if k == s} for s, *_ in rows}
        assert sorted(out) == sorted((s, n, 0, len(own) > 5) for s, own in nodes.items() if len(own) > 1 for n in own)


def test_odd_tables(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, _node string, _s string, component string, node string"
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], columns), "").count() == 0
    rows = [(i, t, None, None, None, "x", "y", "z", "w") for i, t in enumerate([None, "", "a b", "a  b", "long " * 200_000, "A b"])]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, columns), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 4] and out.columns == corpus_pipeline.COLUMNS
