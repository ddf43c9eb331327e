"""SimHash, media, language identification, packing, pages and the pipeline: small cases and brute force."""

import os
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from breathmark.llm import html_extract, language_id, media, packing, simhash
from breathmark.llm.components import connected_components

DOCS = "doc_id long, text string"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


# SimHash


def plain_fingerprint(text, n=3):
    from xxhash import xxh64_intdigest

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, distance):
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= distance:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_simhash_by_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(rng.randint(80, 200))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(8):
            own = list(b)
            for _ in range(rng.randint(0, 1)):
                own[rng.randrange(len(own))] = "zz"
            texts.append(" ".join(own))
    texts += ["", None, " \n", "one", "One", "one two", "É a", "é a", "w " * 30_000]
    rng.shuffle(texts)
    df = docs(spark, texts).withColumn("_fp", F.lit(1)).withColumn("fingerprint", F.lit("clash"))
    got = {r["doc_id"]: r for r in simhash.simhash_groups(df).collect()}
    fps = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    want = plain_components(fps, 2)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["fingerprint"] == f"{fp:016x}" for i, fp in fps)
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_lose_no_pair(spark, distance):
    rng = random.Random(distance)
    made = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(10):
            made.add(x)
            for _ in range(rng.randint(1, distance)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(made)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "_fp long, _node long")
    want = plain_components(list(enumerate(fps)), distance)
    for most in (simhash.MATRIX, 3):  # blocks of more than so many fingerprints are dealt out once more
        found = connected_components(simhash.links(nodes, distance, most)).collect()
        assert {i: i for i in want} | {r["node"]: r["component"] for r in found} == want


def test_blocks_of_every_size_agree(monkeypatch):
    rng = np.random.default_rng(1)
    way = simhash.chains(2)[0]
    center = np.uint64(0x1234_5678_9ABC_DEF0)
    free = [b for b in range(64) if not way["key"] >> b & 1]
    fp = np.unique([center ^ np.uint64(sum(1 << int(b) for b in rng.choice(free, 3, replace=False))) for _ in range(300)])
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    want = simhash._forest(len(fp), a, b)
    for most in (10_000, 5):
        monkeypatch.setattr(simhash, "MATRIX", most)
        x, y = simhash._block_links(fp, way["key"], [(2**64 - 1, 2)], 2)
        assert (simhash._forest(len(fp), x, y) == want).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 0, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# media


@pytest.mark.parametrize("row_filter", [None, *range(5)])
@pytest.mark.parametrize("shape", [(1, 64), (7, 5), (9, 4, 3), (3, 6, 4), (5, 3, 2)])
def test_png_round_trip(row_filter, shape):
    rng = np.random.default_rng(row_filter)
    samples = rng.integers(0, 256, shape, np.uint8) if row_filter else rng.integers(0, 3, shape, np.uint8).cumsum(axis=0, dtype=np.uint8)
    back = media.decode_png(media.encode_png(samples, row_filter))
    assert (back.reshape(shape) == samples).all()


def test_png_with_mixed_filters_and_parts():
    rows = np.random.default_rng(9).integers(0, 256, (6, 8), np.uint8)
    kinds, lines, before = [2, 4, 1, 3, 0, 2], b"", np.zeros(8, int)
    for kind, row in zip(kinds, rows.astype(int), strict=True):
        left, corner = np.append(0, row[:-1]), np.append(0, before[:-1])
        pa, pb, pc = abs(before - corner), abs(left - corner), abs(left + before - 2 * corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][kind]
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    packed = zlib.compress(lines)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")
    assert (media.decode_png(png)[:, :, 0] == rows).all()
    for bad in (png[:-3], png[1:], png.replace(b"tEXt", b"tEXu"), png[:60]):
        with pytest.raises(media.MediaError):
            media.decode_png(bad)


def test_cosine_hash_is_of_low_frequencies():
    y, x = np.mgrid[0:128, 0:64]
    smooth = (128 + 60 * np.sin(x / 20) + 50 * np.cos(y / 25)).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + np.random.default_rng(0).integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda s: int.from_bytes(media.cosine_hash(s))
    assert (bits(smooth) ^ bits(noisy)).bit_count() < 24 and bits(smooth) != bits(smooth[:, ::-1])
    basis = media._cosines(8, 8)
    assert np.allclose(basis @ basis.T, np.eye(8))


def test_media_columns(spark):
    texts = ["hello", None, "", "é" * 32, "x" * 64, "y" * 65, "long " * 60_000, "hello"]
    rows = {r["doc_id"]: r for r in media.media_columns(docs(spark, texts).withColumn("media", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (64 if not data else 0))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-64:]))
        assert media.decode_png(bytes(r["media"])).tobytes() == padded and r["media_bytes"] == len(r["media"])
    raw = zlib.decompress(bytes(rows[6]["media"])[41:-16])  # the one data chunk
    assert {1, 2} & set(raw[::65])
    assert rows[0]["feature"] == rows[7]["feature"] and rows[0]["media_sha256"] == rows[7]["media_sha256"]
    assert media.media_columns(docs(spark, [])).count() == 0


# language identification


def invented(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


TONGUES = {"xa": ["ba", "ke", "lo", "mi", "th"], "xb": ["çu", "né", "ra", "ôs", "ti"], "xc": ["sch", "ung", "ver", "ßen", "ei"]}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    scores, move, begin = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.array([0, 1])  # a chain of one word and one of four
    likely = language_id.forward_backward(scores, move, begin, language_id.Chains.of(starts, 5))[0]
    total, want = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        s = begin[path[0]] + sum(scores[1 + t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))
        total += np.exp(s)
        for t, k in enumerate(path):
            want[t, k] += np.exp(s)
    assert np.allclose(likely[1:], want / total)
    assert np.allclose(likely[0], np.exp(begin + scores[0]) / np.exp(begin + scores[0]).sum())


def test_language_of_unseen_and_switched_text():
    rng = random.Random(8)
    texts, labels = zip(*[(invented(rng, s, 60), x) for x, s in TONGUES.items() for _ in range(30)], strict=True)
    model = language_id.fit(list(texts), list(labels))
    again = language_id.fit(list(texts), list(labels))
    assert (model.weights == again.weights).all() and (np.diag(model.move) > model.move - 1e-9).all()
    held = [(invented(rng, s, 40), x) for x, s in TONGUES.items() for _ in range(20)]
    sums, _ = model.label([t for t, _ in held])
    assert np.mean([model.languages[k] == x for k, (_, x) in zip(sums.argmax(axis=1), held, strict=True)]) > 0.95
    mixed, counts = model.label([invented(rng, TONGUES["xa"], 50) + " " + invented(rng, TONGUES["xb"], 50)])
    assert counts[0] == 100 and abs(mixed[0][0] - 50) < 12 and abs(mixed[0][1] - 50) < 12


def test_long_texts_are_labeled_whole(monkeypatch):
    rng = random.Random(1)
    model = language_id.fit([invented(rng, s, 200) for s in TONGUES.values()], list(TONGUES))
    text = invented(rng, TONGUES["xa"], 3000)
    whole = model.label([text])
    monkeypatch.setattr(language_id, "PART", 500)
    assert (model.label([text])[1] == whole[1]).all() and whole[1][0] == 3000


def test_identify_languages(spark):
    rng = random.Random(6)
    rows = [(i, invented(rng, TONGUES[x], 50), x) for i, x in enumerate(list(TONGUES) * 40)]
    rows += [(500, None, "xa"), (501, "", None), (502, "123 !", "xb"), (503, invented(rng, TONGUES["xc"], 40), None), (503, "ba ke " * 40_000, "xa")]
    df = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit_on(df, ~language_id.held_out("doc_id"), "doc_id", "text", "lang")
    out = language_id.identify_languages(df, model)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["lang"]) for r in out.collect()]
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert all(p == "und" and s == 0 for i, p, s, _ in got if i in (500, 501, 502))
    own = [(p, x) for i, p, _, x in got if i < 500]
    assert sum(p == x for p, x in own) / len(own) > 0.95 and all(0 <= s <= 1 for *_, s, _ in got)
    nothing = language_id.fit_on(df.limit(0), ~language_id.held_out("doc_id"), "doc_id", "text", "lang")
    assert nothing is None and {r["lang_pred"] for r in language_id.identify_languages(df, None).collect()} == {"und"}


# packing


def test_word_ids_are_the_tokenizers():
    rng, own = random.Random(2), packing.WordIds(WORDS)
    texts = ["".join(rng.choice("ab'LsÀß½²ªµ¨  \tthe梦🙂é<1▁\n\x00\x85\xa0\x1c") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["ΑΣ Σ ό e ́", "x<|endoftext|>y <|startoftext|>", "it's WE'LL i'd", "İI"]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == own.whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(n for n in os.listdir(os.path.dirname(WORDS)) if n.endswith(".json")))
def test_ids_of_any_tokenizer(name):
    own = packing.WordIds(public_tokenizers.path(name))
    assert own.by_words or name != os.path.basename(WORDS)
    for t in ("It's 12 Words\n and  more", "naïve ΑΣ 梦🙂", "", " "):
        assert np.frombuffer(own.ids(t), "<u4").tolist() == own.whole.encode(t, add_special_tokens=False).ids


def plain_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        g = min(fits) if fits else capacity
        if fits:
            gaps.remove(g)
        gaps.append(g - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_pack_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 333])
    sizes = [rng.randint(1, capacity) if seed % 2 else min(capacity, int(rng.expovariate(5 / capacity)) + 1) for _ in range(700)]
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    plan = packing.pack_plan(counts, capacity)
    bins, seen = defaultdict(list), defaultdict(list)
    for length, low, high, wide, first, offset in plan.tolist():
        for r in range(low, high):
            seen[length].append(r)
            bins[first + (r - low) % wide].append((offset + (r - low) // wide * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= capacity
    assert len(bins) == plain_best_fit(sizes, capacity) == max(bins) + 1
    assert len(packing.pack_plan({}, capacity)) == 0


def test_pack_documents(spark):
    rng = random.Random(3)
    texts = [invented(rng, TONGUES["xa"], rng.randint(0, 90)) for _ in range(150)] + [None, "", " ", "ba " * 3000] + ["same words"] * 60
    df = docs(spark, texts).withColumn("piece", F.lit("clash")).repartition(5)
    rows = packing.pack_documents(df, WORDS, capacity=256).collect()
    own, by_doc, by_seq = packing.WordIds(WORDS), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = own.ids(t or "") + struct.pack("<I", 1)
        cuts = [ids[a : a + 1024] for a in range(0, len(ids), 1024)]
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k, 256 * k, len(c) // 4, zlib.crc32(c)) for k, c in enumerate(cuts)]
    for own_rows in by_seq.values():
        own_rows.sort()
        assert own_rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own_rows, own_rows[1:], strict=False)) and sum(own_rows[-1]) <= 256
    assert len(by_seq) == plain_best_fit([r["length"] for r in rows], 256)
    assert packing.pack_documents(docs(spark, []), WORDS).count() == 0


# pages


def test_parse():
    main = lambda h: html_extract.parse(h).main
    assert main('<nav>a<p>x</nav><div class="ad">z<article><h1>T</h1><p>One &amp; two\n x<b>y</b></p><div class="comments"><article>c</article></div><form>f</form><p>end &lt;') == ["T", "One & two xy", "end <"]
    assert main("<article><p>a<!-- <p>no --><br>b<p>c<script>var t='</p>'</script></p><div hidden>h</div></article><footer>f</footer>") == ["a b", "c"]
    assert main("<main><section class='side-bar sidebar'>s</section><p>t &am") == ["t &am"]
    assert html_extract.parse("").blocks == [] and html_extract.parse("a < b <").settled(False) == ["a < b <"]
    assert html_extract.parse("<p>x</p").settled(False) == ["x"]
    assert len(html_extract.parse("<p>word</p>" * 50_000).blocks) == 50_000


def test_repeated_by_brute_force():
    rng = random.Random(7)
    for _ in range(30):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(5)]
        n = rng.choice([1, 2, 3, 5, 8])
        grams = defaultdict(set)
        for i, s in enumerate(streams):
            for j in range(len(s) - n + 1):
                grams[tuple(s[j : j + n])].add(i)
        for s, got in zip(streams, html_extract.repeated(streams, n), strict=True):
            want = [any(len(grams[tuple(s[j : j + n])]) > 1 for j in range(max(0, k - n + 1), min(k, len(s) - n) + 1)) for k in range(len(s))]
            assert got.tolist() == want


def test_extract_pages(spark):
    rng = random.Random(9)
    bar = "home news sport weather shop about us contact help legal"
    rows = [(i, f"http://h.example/{i}", f"<div>{bar}</div><div>{invented(rng, TONGUES['xa'], 30)}</div><div>{bar}</div>") for i in range(6)]
    rows += [(6, "http://h.example/6", f"<div>{bar}</div><article><p>only this</article>"), (7, None, None), (8, "odd", ""), (9, "http://alone.example", f"<div>{bar}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i]["text"] and "home news" not in got[i]["text"] and got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (6, 7, 8, 9)] == ["only this", "", "", bar]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# the pipeline


def test_pipeline_by_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    lines = lambda x, n: "\n".join(invented(rng, TONGUES[x], 12) for _ in range(n))
    rows = [(i, lines(x, 6), x, f"s{i % 3}", 0) for i, x in enumerate(list(TONGUES) * 20)]
    passage = lines("xa", 4)
    rows += [(100, lines("xa", 2) + "\n" + passage, "xa", "s0", 0), (101, passage + "\n" + lines("xa", 3), "xa", "s1", 0)]
    one = invented(rng, TONGUES["xb"], 400)
    rows += [(102, one, "xb", "s2", 0), (103, one, "xb", "s2", 0), (104, "12 34 !!", "xa", "s0", 0), (105, None, None, None, None), (106, "", "xa", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.toPandas())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept[0].doc_id) == set(range(60)) | {100, 101, 102, 103}
    cut = kept[1].set_index("doc_id").text
    assert cut[101] == "\n".join(rows[61][1].split("\n")[4:]) and cut[100] == rows[60][1]
    left = set(kept[2].doc_id)
    assert {102} <= left and 103 not in left and set(range(60)) <= left
    sizes = kept[2].assign(n=kept[2].text.str.split().str.len()).groupby("source").n.sum()
    taken = kept[3].assign(n=kept[3].text.str.split().str.len()).groupby("source").n.sum()
    goal = np.array([1, 2, 3]) / 6 * sizes.sum()
    assert (abs(taken.to_numpy() - goal) < 0.1 * goal).all()
    assert kept[4].groupby("sequence_id").length.sum().max() <= 4096
    assert kept[4][kept[4].piece == 0].shape[0] == len(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
