"""Each stage of the pipeline against a brute-force version, on one fixture with nulls, repeated rows, long texts and clashing columns."""

import base64
import collections
import random

import pytest

pytest.importorskip("riskloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, root long, __spans string"


def fixture():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghéß") for _ in range(rng.choice([3, 4, 6])))
    words = lambda n: [word() for _ in range(n)]
    texts = [None, "", " \n", "one", "x" * 300]
    base, passage = words(120), " ".join(words(51))
    for i in range(12):  # near copies
        w = list(base)
        w[rng.randrange(120)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(words(40)) + " " + passage + " " + " ".join(words(30 + i)) for i in range(10)]  # a passage of 51 words
    texts += [" ".join(words(rng.choice([8, 60, 150]))) for _ in range(20)]
    texts += ["\n".join(" ".join(words(12)) for _ in range(2500))]  # very long
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][i % 4], len(t or ""), "clash", 7, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[20], (None, texts[21], None, None, None, None, None, None), (None, "words of a text without an id " + " ".join(words(20)), None, None, None, None, None, None)], passage


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture()[0], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    labels, rows = [], []
    for i in range(200):
        bad = i % 4 == 0
        rows.append((1000 + i, " ".join(rng.choice(["grim", "vile", "foul"] if bad and j % 3 == 0 else ["plain", "calm", "clear", "open", "still"]) + str(rng.randrange(9)) for j in range(60)), "en", "a", 0))
        labels.append((1000 + i, 0 if bad else 1, int(bad)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality_drops_rows_whole(spark, docs, sf_dir):
    labelled = spark.read.parquet(sf_dir + "/documents.parquet")
    kept = pipeline.quality(spark, labelled, sf_dir)
    assert kept.columns == labelled.columns
    bad = {r.doc_id for r in labelled.collect() if (r.doc_id - 1000) % 4 == 0}
    left = {r.doc_id for r in kept.collect()}
    assert len(left & bad) <= 5 and len(left) >= 145
    assert set(rows_of(pipeline.quality(spark, docs, sf_dir))) <= set(rows_of(docs))


def test_near_duplicates_equals_brute_force(spark, docs, sf_dir):
    from tests.llm.test_jaccard_join import brute

    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    kept = pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = kept.collect()
    with_id = {c for i, n, c in want if n and c is not None} | {i for i, n, _ in want if not n and i is not None}
    assert collections.Counter(r.doc_id for r in got if r.doc_id is not None) == collections.Counter(with_id)
    assert [r.text[:5] for r in got if r.doc_id is None] == ["words"]  # the other row without an id has a copy with one
    assert {tuple(r) for r in got} <= set(rows)


def test_repeats_equals_brute_force(spark, docs, sf_dir):
    rows = [tuple(r) for r in docs.filter("doc_id is null or doc_id < 40").collect()]
    length, data = pipeline.REPEAT_BYTES, [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    want = []
    for r, d in zip(rows, data, strict=True):
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        text = None if r[1] is None else bytes(x for x, h in zip(d, hit, strict=True) if not h).decode("utf-8", "ignore")
        want.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    out = pipeline.repeats(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert out.columns == docs.columns
    assert rows_of(out) == sorted(want, key=str)
    assert not any(fixture()[1] in (r.text or "") for r in out.collect())


def test_mix_follows_the_query(spark, docs, sf_dir):
    from riskloom.llm import mixing

    taken, words = collections.Counter(), collections.Counter()
    for r in mixing.mixed_counts(docs).collect():
        taken[r.doc_id] += r.taken
    out = pipeline.mix(spark, docs, sf_dir)
    assert out.columns == docs.columns
    of = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
        assert r.doc_id is None or set((r.text or "").split()) <= set(of[r.doc_id].split())
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert +words == +taken


def test_tokens_equal_tiktoken(spark, docs, sf_dir):
    import hashlib

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = pipeline.tokens(spark, docs, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(got) == sorted(want, key=str)


def test_run_and_empty_tables(spark, docs, sf_dir, tmp_path):
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "n_tokens"} <= set(out.columns)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
