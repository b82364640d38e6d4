"""Columns that clash, repeated rows, very long texts and empty tables, for operators whose other tests have none of these."""

import random
import zlib

import pytest

pytest.importorskip("riskloom.llm")
import public_tokenizers as P  # noqa: E402

from riskloom.llm import bpe, eb_classifier, sharding  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


def test_bpe_keeps_other_columns(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, "naïve 🙂 s", "mine", "own", 5), (1, "naïve 🙂 s", "mine", "own", 5), (2, None, None, None, None), (3, "ab " * 40_000, "x", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, data string, `a.b``c` int")
    encoded = bpe.encode(df, path, P.PATTERN)
    assert encoded.columns == ["doc_id", "text", "spans", "data", "a.b`c", "ids"]
    got = sorted(map(tuple, encoded.collect()), key=str)
    assert [x[:5] for x in got] == sorted(rows, key=str) and got[0] == got[1]
    back = bpe.decode(encoded, path, P.PATTERN)
    assert back.columns == ["doc_id", "spans", "a.b`c", "ids", "data", "text"]
    assert sorted((r.doc_id, r.text, bytes(r.data).decode()) for r in back.collect()) == sorted((r[0], r[1] or "", r[1] or "") for r in rows)
    asked = bpe.encode(df, path, P.PATTERN, offsets=True)
    assert asked.columns == ["doc_id", "text", "data", "a.b`c", "ids", "spans"]
    spans = {r.doc_id: r.spans for r in asked.collect()}
    assert spans[2] == [] and (spans[1][0].start, spans[1][-1].end) == (0, 9)
    split = spark.createDataFrame([(bpe.load(path, P.PATTERN).encode(["字🙂"])[0][:1],), (None,)], "ids array<int>")
    assert [r.text for r in bpe.decode(split, path, P.PATTERN).collect()][1] == ""
    assert bpe.encode(df.limit(0), path, P.PATTERN, offsets=True).count() == 0 and bpe.decode(encoded.limit(0), path, P.PATTERN).count() == 0


def test_classifier_edges(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["sun", "moon", "tree", "river"]) for _ in range(n))
    rows = [(i, words(60) if i % 4 else words(60).upper().replace(" ", "!! "), "en", "s1", 9, "x", 0.5) for i in range(200)]
    rows += [(500, words(40_000), "en", "s1", 9, "x", 0.5), rows[0], rows[0], rows[1], (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, `row` string, p_toxic double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], LABELS)
    out = eb_classifier.classify(df, labels).collect()
    assert len(out) == len(rows) and len({tuple(r) for r in out if r.doc_id == 0}) == 1
    assert next(r.kept for r in out if r.doc_id == 500)
    kept = {r.doc_id for r in out if r.kept}
    good = eb_classifier.keep_good(df, labels)
    assert good.columns == df.columns
    assert sorted(map(tuple, good.collect()), key=str) == sorted((r for r in rows if r[0] in kept), key=str)
    assert eb_classifier.classify(df.limit(0), labels).count() == 0
    assert eb_classifier.classify(df.limit(0), labels.limit(0)).count() == 0


def test_sharding_edges(spark):
    rows = [(i, t, 1, 2, 3, 4) for i, t in [(1, "é" * 300_000), (2, None), (2, None), (2, None), (None, "a"), (None, "a"), (3, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int, block int, k int")
    out = sharding.shuffle_to_shards(df, shards=3).collect()
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(((i, len(b) + 1, zlib.crc32(b)) for i, b in raw), key=str)
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
