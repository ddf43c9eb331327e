"""Exact dedup, line dedup, mixing, token counts and pseudonyms: small cases and brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from breathmark.llm import mixing, pii, token_count
from breathmark.llm.exact_dedup import exact_dedup
from breathmark.llm.line_dedup import line_dedup
from breathmark.llm.token_count import token_counts

DOCS = "doc_id long, text string"


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


# exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_groups(spark, keep):
    texts = ["a", "b", "a", "", None, "a ", "x" * 200_000, "x" * 200_000, "b"]
    rows = {r["doc_id"]: r for r in exact_dedup(docs(spark, texts), keep=keep).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        stays = min(same) if keep == "min" else max(same)
        assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (stays, len(same), i == stays)
        assert rows[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_tells_collisions_apart(spark):
    texts = ["aa", "bb", "aa", "cc", "dddd", "dddd", "e"]
    one_hash = exact_dedup(docs(spark, texts), hash_of=lambda sha: F.unhex(F.lit("00")))
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in one_hash.collect()}
    assert rows == {0: (0, 2), 2: (0, 2), 1: (1, 1), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (6, 1)}


def test_exact_dedup_odd_rows(spark):
    same = spark.createDataFrame([(1, "t", 5), (1, "t", 6), (None, "t", 7), (None, "u", 8)], DOCS + ", _h int")
    rows = [tuple(r) for r in exact_dedup(same).select("doc_id", "keep_id", "group_size", "kept").collect()]
    want = [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, False)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert exact_dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(same, keep="any")


# line dedup


def cut(rows):
    """Brute force of line_dedup."""
    windows = {}
    full = {i: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")] for i, t in rows}
    for i, _ in sorted(rows):
        own = full[i]
        for j in range(len(own) - 2):
            windows.setdefault(tuple(x for _, x in own[j : j + 3]), []).append((i, [k for k, _ in own[j : j + 3]]))
    gone = {(i, k) for (first, *later) in windows.values() for i, ks in later for k in ks if i != first[0] or k not in first[1]}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", " ", "d e"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "a\na\na\na\na", "p\nq\nr\ns", "x\np\nq\nr\ny", "\n".join(f"line {i}" for i in range(3000))]
    got = {r["doc_id"]: r["text"] for r in line_dedup(docs(spark, texts)).collect()}
    assert got == cut(list(enumerate(texts)))


def test_line_dedup_cuts_a_passage_whose_neighbours_repeat_too(spark):
    passage = "p\nq\nr"
    texts = [f"a\nb\n{passage}\nc", f"d\ne\n{passage}\nf\ng", f"d\ne\n{passage}\nf\ng", f"{passage}\nh"]
    got = {r["doc_id"]: r["text"] for r in line_dedup(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "d\ne\nf\ng", 2: "", 3: "h"}


def test_line_dedup_odd_rows(spark):
    three = "a\nb\nc"
    rows = spark.createDataFrame([(1, three, 9), (1, three, 9), (2, three, 9), (None, three, 9)], DOCS + ", lines_removed int")
    out = line_dedup(rows)
    assert out.columns == ["doc_id", "text", "lines_removed"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("1", ""), ("1", ""), ("2", ""), ("None", three)]
    assert line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_id", "_k", "_text", "_lines", "_cut", "_cid", "_row", "_n", "at", "a.b"]
    df = spark.createDataFrame([(i, "x\ny\nz", *[f"{n}{i}" for n in names]) for i in range(2)], ["doc_id", "text", *names])
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", *names, "lines_removed"]
    assert sorted(map(tuple, out.collect())) == [(0, "x\ny\nz", *[f"{n}0" for n in names], 0), (1, "", *[f"{n}1" for n in names], 3)]


# mixing


def test_targets():
    assert mixing.targets({"b": 100, "a": 100, None: 100}, (1, 2, 3)) == {"a": 50, "b": 100, None: 150}
    got = mixing.targets({"a": 1000, "b": 10, "c": 0}, (1, 2, 3))
    assert got["b"] == 30 and got["c"] == 0 and got["a"] == pytest.approx(980)
    assert mixing.targets({}, (1,)) == {}
    many = mixing.targets({f"s{i:02}": 10**i for i in range(6)}, (1, 2, 3))
    assert sum(many.values()) == pytest.approx(111111) and all(many[f"s{i:02}"] <= 3 * 10**i + 1e-6 for i in range(6))


def test_split_quotas():
    parts = mixing.split_quotas([1000, 3, 0, 500], 7, seed=1)
    assert parts.sum(axis=0).tolist() == [1000, 3, 0, 500] and (parts >= 0).all()
    totals = parts.sum(axis=1)
    assert totals.max() - totals.min() <= 1
    assert (parts == mixing.split_quotas([1000, 3, 0, 500], 7, seed=1)).all()


def test_choose_comes_near():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(0, 300, 64)
        left = int(rng.integers(0, sizes.sum()))
        taken = mixing.choose(sizes, left)
        assert left - 5 <= sizes[taken].sum() <= left
    assert not mixing.choose(np.array([], int), 5).any() and not mixing.choose(np.array([9]), 5).any()


def test_mix_sources(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", None), (902, "  ", "empty"), (903, "w " * 30_000, "b")]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    mixed = mixing.mix_sources(df, shards=4)
    got = mixed.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7), shards=4).collect()))
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    goal = mixing.targets(dict(size), (1, 2, 3))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] and len(r["shards"]) == r["copies"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
    for s in size:
        assert abs(taken[s] - goal[s]) <= 3
    clashing = df.withColumn("shard", F.lit("x")).withColumn("_row", F.lit("y")).withColumn("_s", F.lit("z"))
    drawn = mixing.draw(clashing, shards=4, task_words=2000)
    assert drawn.columns == ["doc_id", "text", "source", "_row", "_s", "shard"]
    rows = drawn.collect()
    assert Counter((r["doc_id"], r["shard"]) for r in rows) == Counter((r["doc_id"], s) for r in got for s in r["shards"])
    assert {(r["doc_id"], r["text"], r["source"], r["_row"], r["_s"]) for r in rows} <= {(*r, "y", "z") for r in df.collect()}
    ids = [r["doc_id"] for r in rows]
    assert ids != sorted(ids)
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.draw(df.limit(0)).count() == 0


def test_zones_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ZONE", 20)
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "_permutation", lambda seed, source: (1, 0))
    rows = [(i, "w " * (1 + i % 50), "big" if i < 3000 else "other") for i in range(4000)] + [(7, "w", "big")] * 40
    df = spark.createDataFrame(rows, DOCS + ", source string")
    got = mixing.mix_sources(df, weights=(1, 3)).collect()
    size, taken = Counter(), Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    goal = mixing.targets(dict(size), (1, 3))
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 2 for s in size)


def test_mixture_stage(spark):
    import corpus_pipeline

    rows = [(i % 50, "same words" if i % 2 else f"text {i % 50} of some words", None, f"s{i % 3}" if i % 4 else None, None, "k") for i in range(200)]
    rows += [(None, None, None, None, None, "k")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    have, found = Counter(tuple(r)[:5] for r in rows), Counter(tuple(r) for r in out.collect())
    assert found and all(n <= 3 * have[k] for k, n in found.items())
    mixed = mixing.mix_sources(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.LIMIT, seed=corpus_pipeline.SEED)
    assert sum(found.values()) == mixed.agg(F.sum("copies")).first()[0]
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


# token counts


@pytest.fixture(scope="module")
def unigram():
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    # Special pieces keep their ids, since bytes are looked up by them, under names that no text of the tests has.
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    name = lambda i: model.id_to_piece(i) if model.is_byte(i) or not special(i) else f"\ue000{i}"
    pieces = [(name(i), 0.0 if special(i) else model.get_score(i)) for i in range(model.get_piece_size())]
    out = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    out.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return out


def test_token_counts_are_the_tokenizers(spark, unigram):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \tsthe梦🙂é<s>0x1▁\n\x00") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["the " * 40_000, "x" * 5000, None, "", " "]
    got = token_counts(docs(spark, texts).withColumn("n_tokens", F.lit("clash")), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "n_tokens", "best_score"]
    for r in got.collect():
        text = texts[r["doc_id"]] or ""
        if not re.search("<0x[0-9A-F]{2}>", text):  # the library takes these names of byte pieces for text
            assert r["n_tokens"] == len(unigram.encode(text, add_special_tokens=False).ids)


def test_special_pieces_match_no_text():
    model = token_count.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert [model.count(x)[0] for x in ("x</s>", "a<s>b", "a<0x41>b")] == [4, 5, 8]


def test_token_count_ties_and_unknowns():
    # "ab" + "c" and "a" + "bc" tie: the longest last piece stays, with two pieces either way; "abc" in one loses.
    model = token_count.Unigram([("▁", -1.0), ("a", -2.0), ("b", -9.0), ("c", -2.0), ("ab", -3.0), ("bc", -3.0), ("abc", -6.0)])
    assert model.best("abc") == (-5.0, 2)
    assert model.best("z") == (-19.0, 1) and model.best("é")[1] == 2
    tie = token_count.Unigram([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0)])
    assert tie.best("ab") == (-2.0, 1)
    assert model.count("") == (0, 0.0)


# pseudonyms


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "mail jo.34@mail7.example.com or JO.34@MAIL7.EXAMPLE.COM!! and bo.34@mail7.example.com",
        "tel +1 (017) 555-7713 or 017-555-7713",
        "ip 233.254.104.120 and 300.1.1.1",
        "cards 4111 1111 1111 1111, 4111111111111111, bad 4111111111111112",
        "days 2024-02-29 29.02.2024 02/29/2024 but 2024-02-30",
        "ssn 123-45-6789 but 666-12-1234",
        "iban DE89370400440532013000 but DE88370400440532013000",
        "plain text, version 2.0 and 1999", None, "", "no " * 50_000, "jo.34@mail7.example.com",
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, texts).withColumn("n_card", F.lit("clash")), "key").collect()}
    mail = got[0]["text"].split()
    assert mail[1] != "jo.34@mail7.example.com" and mail[1].upper() == mail[3].rstrip("!") and mail[5] != mail[1]
    assert got[11]["text"] == mail[1] and got[0]["n_email"] == 3
    assert got[1]["text"].split()[3] == got[1]["text"].split()[5][4:] and "555-7713" not in got[1]["text"]
    assert "233.254.104.120" not in got[2]["text"] and got[2]["text"].endswith("300.1.1.1") and got[2]["n_ip"] == 1
    first, rest = got[3]["text"][6:].split(",", 1)
    assert luhn(first) and first.replace(" ", "") in rest and got[3]["text"].endswith("bad 4111111111111112") and got[3]["n_card"] == 2
    iso, dotted, slashed = got[4]["text"].split()[1:4]
    y, m, d = iso.split("-")
    assert iso != "2024-02-29" and dotted == f"{d}.{m}.{y}" and slashed == f"{m}/{d}/{y}" and got[4]["n_date"] == 3
    assert got[5]["text"].endswith("666-12-1234") and "123-45-6789" not in got[5]["text"]
    new = got[6]["text"].split()[1]
    assert new.startswith("DE") and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1 and got[6]["n_iban"] == 1
    assert [got[i]["text"] for i in (7, 8, 9, 10)] == texts[7:11]
    assert pii.pseudonymise(docs(spark, []), "key").count() == 0


def test_wheels_are_a_permutation(spark):
    p = pii.Pseudonyms("k")
    rows = spark.range(17 * 30).select(p.number(F.col("id"), (17, 30), "t").alias("n")).collect()
    assert sorted(r["n"] for r in rows) == list(range(17 * 30))
    strings = spark.range(1000).select(p.string(F.lpad(F.col("id").cast("string"), 3, "0"), "t").alias("s")).collect()
    assert len({r["s"] for r in strings}) == 1000 and all(len(r["s"]) == 3 for r in strings)


@pytest.mark.parametrize(
    ("text", "private", "kinds"),
    [
        ("call +1 (826) 555-4081 190.137.223.204 du", ["555-4081", "190.137.223.204"], {"phone": 1, "ip": 1}),
        ("4111111111111111 97.51.17.173 here", ["4111111111111111", "97.51.17.173"], {"card": 1, "ip": 1}),
        ("4111111111111111 12 apples", ["4111111111111111"], {"card": 1}),
        ("4111 1111 1111 1111 123 times", ["4111 1111 1111 1111"], {"card": 1}),
        ("4111111111111111 4111111111111111", ["4111111111111111"], {"card": 2}),
        ("+33 1 23 45 67 89 le 2024-05-06", ["23 45 67 89", "2024-05-06"], {"phone": 1, "date": 1}),
        ("+44 20 7946 0958 2024", ["7946 0958"], {"phone": 1}),
        ("+1 826 555 4081 123-45-6789", ["555 4081", "123-45-6789"], {"phone": 1, "ssn": 1}),
        ("+1 826 555 4081 4111111111111111", ["555 4081", "4111111111111111"], {"phone": 1, "card": 1}),
        ("4111111111111111\n+1 826 555 4081", ["4111111111111111", "555 4081"], {"phone": 1, "card": 1}),
    ],
)
def test_neighbouring_private_values(spark, text, private, kinds):
    (row,) = pii.pseudonymise(docs(spark, [text]), "key").collect()
    assert not [x for x in private if x in row["text"]]
    assert {k: row[f"n_{k}"] for k in pii.PATTERNS if row[f"n_{k}"]} == kinds
    assert "ip" in kinds or [c.isdigit() for c in row["text"]] == [c.isdigit() for c in text]
