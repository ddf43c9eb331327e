"""Equal rows at a quota's end, bounds over labels, stored pictures by a plain reader, and stages of odd tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from breathmark.llm import language_id, media, mixing, token_count
from breathmark.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def goal(sizes, weights, limit):
    """Words each source should give, by repeated sharing of what capped sources leave."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: limit * sizes[s] for s in over}


def test_mixture_with_many_equal_rows(spark):
    rng = random.Random(1)
    rows = [(7, "two words", None, "a", 9)] * 40_000 + [(8, "three little words", None, "a", 9)] * 5000
    rows += [(100 + i, "w " * rng.randint(1, 40), None, rng.choice(["b", "c", None]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = mixing.mix_sources(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    want, taken = goal(sizes, (1, 2, 3), 3), Counter()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] in {c * r["size"] for c in range(4)}
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in want), (taken, want)
    # Some of the equal rows are taken once more than others, and another run takes as many.
    assert len({r["copies"] for r in got if r["doc_id"] == 7}) == 2
    again = mixing.mix_sources(df.repartition(3)).groupBy("doc_id", "copies").count().collect()
    assert sorted(map(tuple, again)) == sorted((*k, n) for k, n in Counter((r["doc_id"], r["copies"]) for r in got).items())
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    drawn = mixing.draw(df).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in drawn} == {k: n for k, n in copies.items() if n}


def test_choice_counts_equal_documents():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes, counts = rng.integers(0, 9, 6), rng.integers(1, 5, 6)
        left = int(rng.integers(0, 60))
        taken = mixing.choose(sizes, left, counts)
        one_by_one = mixing.choose(np.repeat(sizes, counts), left)
        assert (taken <= counts).all() and (taken >= 0).all() and (taken * sizes).sum() <= left
        assert (taken * sizes).sum() == (one_by_one * np.repeat(sizes, counts)).sum()


def test_sample_is_bounded_over_labels(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TOTAL", 12)
    monkeypatch.setattr(language_id, "LABELS", 4)
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda texts, labels: seen.append(Counter(labels)))
    rows = [(i, f"some words {i}", f"l{i % 9 if i < 90 else 8 - (i % 2)}", "s", 0) for i in range(200)]
    language_id.fit_on(spark.createDataFrame(rows, DOCS), F.lit(True), "doc_id", "text", "lang")
    assert len(seen[0]) == 4 and {"l8", "l7"} <= set(seen[0]) and max(seen[0].values()) <= 3


def plain_png(data):
    """Rows of an 8-bit grey picture by the format's definition."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts, width, height = 8, b"", 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            assert rest == [8, 0, 0, 0, 0]
        parts += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows = zlib.decompress(parts), []
    for y in range(height):
        kind, line = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)]
        row = bytearray()
        for x, v in enumerate(line):
            a, b = (row[x - 1] if x else 0), (rows[-1][x] if rows else 0)
            c = rows[-1][x - 1] if rows and x else 0
            near = min((a, b, c), key=lambda q: abs(a + b - c - q))
            row.append((v + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        rows.append(row)
    return rows


def plain_feature(rows, edge=media.THUMB, corner=media.CORNER):
    """64 bits of the cosine transform of area means, by the definition."""
    h, w = len(rows), len(rows[0])

    def cell(i, n):
        return range(i * n // edge, max(i * n // edge + 1, (i + 1) * n // edge)) if n >= edge else [i * n // edge]

    small = [[sum(rows[y][x] for y in cell(i, h) for x in cell(j, w)) / (len(cell(i, h)) * len(cell(j, w))) for j in range(edge)] for i in range(edge)]
    wave = lambda k, i: math.sqrt(2 / edge) * (math.sqrt(0.5) if k == 0 else 1) * math.cos(math.pi * (2 * i + 1) * k / (2 * edge))
    half = [[sum(wave(k, i) * small[i][j] for i in range(edge)) for j in range(edge)] for k in range(corner)]
    found = [round(sum(half[k][j] * wave(m, j) for j in range(edge)), 6) for k in range(corner) for m in range(corner)]
    found[0] = 0.0
    middle = float(np.median(found[1:]))
    return np.packbits([x > middle for x in found]).tobytes()


def test_media_by_a_plain_reader(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "".join(chr(rng.randrange(32, 500)) for _ in range(5000)), "same words " * 300, "ab\n" * 2000, *["twice"] * 2]
    got = {r["doc_id"]: r for r in media.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit(1))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        whole = data + bytes(-len(data) % 64 if data else 64)
        rows = plain_png(got[i]["media"])
        assert b"".join(map(bytes, rows)) == whole and all(len(r) == 64 for r in rows)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["media_bytes"]) == (len(data), len(whole), len(got[i]["media"]))
        assert got[i]["payload_sha256"] == hashlib.sha256(whole).hexdigest() and got[i]["media_sha256"] == hashlib.sha256(got[i]["media"]).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(whole[-64:])
        want, found = plain_feature(rows), got[i]["feature"]
        # Coefficients that are equal but for rounding may fall on either side of the median.
        assert bin(int.from_bytes(want, "big") ^ int.from_bytes(found, "big")).count("1") <= (2 if i in (6, 7, 8) else 64)


def test_predictions_of_whole_query_by_hand(spark):
    """The label is the largest mean of the words' probabilities, each chain gone through path by path."""
    rng = random.Random(4)
    tongues = {"xa": "ka lo mi", "xb": "zu ty rr"}
    rows = [(i, " ".join(rng.choice(tongues[x].split()) for _ in range(30)), x, "s", 0) for i, x in enumerate(["xa", "xb"] * 30)]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit_on(df, ~language_id.held_out("doc_id"), "doc_id", "text", "lang")
    texts = ["ka zu lo", "rr", "mi mi\nty", "12 !", None, "", "ka 5 zu"]
    found = language_id.identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(found, texts, strict=True):
        sums, n = model.label([t or ""])
        if not n[0]:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        means = sums[0] / n[0]
        assert r["lang_pred"] == model.languages[int(means.argmax())] and r["score"] == pytest.approx(means.max()) and sum(means) == pytest.approx(1)
    assert [r["lang_pred"] for r in found[1:6:2]] == ["xb", "und", "und"]


@pytest.mark.parametrize("stage", ["language", "lines", "packing"])
def test_stages_of_odd_tables(spark, stage):
    work = dict(corpus_pipeline.STAGES)[stage]
    names = "text string, row long, _id long, doc_id long, lang string, source string, n_chars long, lang_pred string, piece int"
    assert work(spark, spark.createDataFrame([], names), "").count() == 0
    line = "some words stand here\nand more of them there\nat last the third line\n"
    rows = [(t, 1, 2, i, x, "s", 0, "clash", 3) for i, (t, x) in enumerate([(line, "xa"), (line, "xa"), (None, None), ("", "xa"), ("zz ty uu rr " * 9, "xb"), (line * 2, None)])]
    rows += rows[:2]
    got = work(spark, spark.createDataFrame(rows, names), "")
    found = got.collect()
    if stage == "packing":
        assert Counter(r["doc_id"] for r in found) == Counter(r[3] for r in rows)
        return
    assert got.columns == corpus_pipeline.COLUMNS
    if stage == "language":
        assert Counter(r["doc_id"] for r in found) == Counter({0: 2, 1: 2, 4: 1, 5: 1})
    else:
        left = defaultdict(list)
        for r in found:
            left[r["doc_id"]].append(r["text"])
        assert left[0] == [line] * 2 and set(left) >= {0, 2, 3, 4} and 1 not in left and left[2] == [None] and left[3] == [""]


def test_counts_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens int")
    assert token_count.token_counts(empty, tokenizer("piece_bpe_32k.model")).count() == 0


def test_python_workers_of_the_pipeline_get_small_batches(spark, monkeypatch):
    """What a worker holds beside its executor's heap: batches by rows and bytes, and remembered words."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [(name, spark.conf.get(name)) for name in names]
    try:
        corpus_pipeline.small_batches(spark)
        for chars in (10, 20_000):
            rows = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("a"), chars).alias("text"))
            found = rows.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in found) == 1500
            assert max(r["rows"] for r in found) <= 500 and max(r["bytes"] for r in found) <= (2 << 20) + 2 * chars
    finally:
        for name, value in before:
            spark.conf.set(name, value)
    taken = []
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda docs, path, remembered: taken.append(remembered))
    corpus_pipeline.packing(spark, None, "")
    for name, value in before:
        spark.conf.set(name, value)
    assert taken[0] <= 50_000
