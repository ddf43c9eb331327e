"""Resampling, the prefix trie and the n-gram join against plain versions of themselves, and with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from breathmark.llm import ngram_jaccard, target_resampling
from breathmark.llm.ngram_jaccard import Likeness, grams, jaccard_groups, near_pairs, signatures
from breathmark.llm.prefix_trie import prefix_trie
from breathmark.llm.target_resampling import bucket_counts, checksums, counter, parts_of, resample

DOCS = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


# --- resampling ---------------------------------------------------------------------------------------------------------------


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(rows, target, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own, aim = Counter(), Counter()
    for _, text in rows:
        own.update(map(bucket, features(text)[1]))
    for text in target:
        aim.update(map(bucket, features(text)[1]))
    s, t = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in own}
    out = []
    for doc, text in rows:
        words, found = features(text)
        weight = math.floor(sum(gain[bucket(f)] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    enough = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = share * len(enough) // 100
    return out, [x[:4] for x in enough[:drawn]]


def test_resampling_by_brute_force(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "Été", "x1", "z", "naïve", "42", "ÖL"]
    texts = [rng.choice([" ", ", ", "\x00", "\n"]).join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "--", "one", *["a b c d e f g h " * 4] * 2]
    target = ["alpha beta alpha x1", None, "42 42 42", ""]
    rows = list(enumerate(texts))
    got = resample(docs(spark, texts), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"), share=40).collect()
    want, drawn = resampled(rows, target, 40, 20)
    assert sorted(tuple(r)[:4] for r in got) == sorted(x[:4] for x in want)
    assert [tuple(r)[:4] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_of_odd_rows(spark):
    extra = "id long, row int, text string, bucket string, `counts` int, doc_id long, score double"
    same = "w1 w2 w3 w4 " * 10
    rows = [(1, 2, same, "x", 3, None, 0.5), (1, 2, same, "x", 3, None, 0.5), (2, 2, same, "y", 3, 9, 0.1), (3, 2, same, None, None, 9, None)]
    got = resample(spark.createDataFrame(rows, extra), spark.createDataFrame([], "text string"), share=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4] and len({r["weight"] for r in got}) == 1
    nines = [r["score"] for r in got if r["doc_id"] == 9]
    assert nines[0] == nines[1]
    assert resample(spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")).count() == 0


def test_long_texts_are_counted_in_parts():
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", "C", "é", "1", " ", "; ", "\n\n"]) for _ in range(3000))
    for most in (1, 7, 100, 10_000):
        rejoined = [p for _, p in parts_of(text, most)]
        assert all(len(p) >= 1 for p in rejoined[:-1])
        con = counter()
        row, bucket, n, words = bucket_counts(con, ["x", text, ""], most, 50)
        own, found = features(text)
        want = Counter(zlib.crc32(f.encode()) % 10000 for f in found)
        assert dict(zip(bucket[row == 1].tolist(), n[row == 1].tolist(), strict=True)) == want
        assert words[row == 1].sum() == len(own) and set(row.tolist()) == {0, 1}
    assert list(parts_of("", 5)) == [(False, "")] and list(parts_of("x" * 20, 5)) == [(False, "x" * 20)]


def test_checksums_of_sliced_strings():
    import pyarrow as pa

    column = pa.array(["a", "é", "", "bc d"])
    assert checksums(column.slice(1)).to_pylist() == [zlib.crc32(x.encode()) for x in ("é", "", "bc d")]
    assert checksums(pa.chunked_array([column, column.slice(3)])).to_pylist()[-1] == zlib.crc32(b"bc d")


# --- prefix trie --------------------------------------------------------------------------------------------------------------


def trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += worth
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == n)
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_by_brute_force(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = []
        for c in rng.sample(range(-45, 130), 90):
            for t in rng.sample([None, 0, 1, 2, 3, 4, 5], rng.randint(1, 6)):
                for _ in range(rng.choice([1, 1, 1, 2])):  # rows of one turn
                    rows.append((c, t, rng.choice([None, "", "user", "bot"]), rng.choice([None, "", "hi", "a b  c", "long " * 50])))
        rows += [(None, 1, "user", "lost")] * 2
        rng.shuffle(rows)
        got = prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
        assert sorted((tuple(r) for r in got), key=str) == trie(rows)


def test_trie_of_many_equal_and_of_deep_conversations(spark):
    rows = [(c, t, "user", f"say {t}") for c in range(6000) for t in (1, 2)] + [(7, t, "user", f"deep {t}") for t in range(3, 400)]
    got = prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == trie(rows)
    extra = spark.createDataFrame([(3, 1, "u", "t", b"k", 5, 6)], f"{TURNS}, key binary, depth int, fam int")
    assert prefix_trie(extra).count() == len(trie([(3, 1, "u", "t")]))
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    # A conversation that inherits all it has from a base that isn't there is a member of the root alone.
    short = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert [tuple(r)[:7] for r in prefix_trie(spark.createDataFrame([(short, 1, "u", "t")], TURNS)).collect()] == [(short, 0, None, 1, 0, 1, 0)]


# --- n-gram join --------------------------------------------------------------------------------------------------------------


def sets_of(texts, words):
    out = []
    for text in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(own[i : i + words]) for i in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} if own else set())
    return out


def components(ids, sets, p, q):
    label = dict(enumerate(range(len(ids))))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def families(rng, groups, size, length, edits):
    """Texts of families: copies with a few words changed, cut or put in."""
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = rng.choice([[], [f"n{rng.randrange(9)}"]])
                own = own or ["w"]
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("words", "p", "q"), [(3, 9, 10), (2, 4, 5), (1, 19, 20)])
def test_near_sets_share_a_signature(words, p, q):
    rng, like = random.Random(6), Likeness(p, q)
    near = 0
    for _ in range(400):
        texts = families(rng, 1, 6, rng.choice([(1, 14), (8, 40), (100, 300)]), 4)
        sets = [grams(t, words) for t in texts]
        for i in range(len(sets)):
            for j in range(i):
                same, both = len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])
                if like.near(same, both):
                    near += 1
                    equal = len(sets[i]) == len(sets[j]) == same
                    assert equal or len(np.intersect1d(signatures(sets[i], like), signatures(sets[j], like)))
        pairs = {tuple(x) for x in np.array(near_pairs(sets, like)).T.tolist()}
        assert pairs == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like.near(len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j]))}
    assert near > 200


def test_bands_hold_all_near_sizes():
    for like in (Likeness(9, 10), Likeness(4, 5), Likeness(1, 2)):
        for n in range(1, 500):
            for m in range(n + 1, like.largest(n) + 1):
                common = {b for b, _ in like.bands(n)} & {b for b, _ in like.bands(m)}
                assert common, (n, m)
                high = dict(like.bands(m))[max(common)]
                assert like.apart(n + m) <= like.apart(2 * high)


@pytest.mark.parametrize("cluster", [1, 3, 512])
def test_groups_by_brute_force(spark, monkeypatch, cluster):
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", 2)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 5)
    monkeypatch.setattr(ngram_jaccard, "OFTEN", 3)
    rng = random.Random(cluster)
    texts = families(rng, 12, 9, (5, 60), 5) + families(rng, 1, 40, (90, 90), 6)
    texts += [None, "", " \n", "one", "ONE", "one two", "One  two", texts[3], texts[3].upper(), "é É", "É é", "straße a b", "x " * 500, "x " * 900]
    ids = list(range(len(texts) - 3)) + [None, 5, 5]
    got = jaccard_groups(spark.createDataFrame(list(zip(ids, texts, ["z"] * len(ids), strict=True)), f"{DOCS}, node string"), cluster=cluster).collect()
    sets = sets_of(texts, 3)
    want = components(ids, sets, 9, 10)
    rows = sorted(((i, len(s), c) for i, s, c in zip(ids, sets, want, strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == rows
    assert any(r[0] != r[2] for r in rows)


def test_groups_of_empty_tables(spark):
    assert jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0
    got = jaccard_groups(docs(spark, [None, "", "   "])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert target_resampling.gains([0], [0]) == [0]
