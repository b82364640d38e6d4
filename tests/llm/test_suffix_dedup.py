import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("riskloom.llm")
from riskloom.llm import suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, __spans string"


def brute(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for r, d in zip(rows, data, strict=True):
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(x for x, h in zip(d, hit, strict=True) if not h)
        runs = sum(1 for i in range(len(hit)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((r[0], len(d), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij éñ\n") for _ in range(n))
    passage, other = text(1500), text(450)
    texts = [None, "", "short", "x" * 399, "x" * 400, "y" * 401, "z" * 2000]
    for n in range(25):
        a = rng.randrange(900)
        texts.append(text(rng.randrange(600)) + passage[a : a + rng.choice([380, 399, 400, 401, 410, 500, 900])] + text(rng.randrange(500)))
    for n in range(12):
        texts.append(text(300) + other[n : n + 405] + text(rng.randrange(30)))
    own = text(430)
    texts += [own + "-" + own, own[5:420], texts[9], "ab" * 700, "ab" * 200 + "c" + "ab" * 250, text(9000)]
    rows = [(i, t, "en", "s", 0, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[8], None, None, None, None, None)]


@pytest.mark.parametrize("length,group", [(400, 1024), (400, 3), (200, 1024)])
def test_removal_equals_brute_force(spark, length, group):
    rows = fixture()
    out = suffix_dedup.removal_digests(spark.createDataFrame(rows, SCHEMA), length, group)
    got = out.collect()
    assert all(r.n_bytes == r.n_removed + r.kept_bytes for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, length)


@pytest.mark.parametrize("lie", [False, True])
def test_suffix_sort_equals_sorted_bytes(monkeypatch, lie):
    rng = random.Random(4)
    texts, before, g = [], [], []
    for group in range(40):
        core = bytes(rng.choice(b"ab") for _ in range(64))
        for _ in range(rng.choice([1, 2, 3, 9, 30])):
            a, b = rng.randrange(40), rng.randrange(40)
            texts.append(bytes(rng.choice(b"ab") for _ in range(a)) + core + bytes(rng.choice(b"ab") for _ in range(b)))
            before.append(a)
            g.append(group)
    g, before, length = np.array(g), np.array(before), 70
    if lie:  # hashes that collide: the sort is misled, and the bytes put it right
        monkeypatch.setattr(suffix_dedup.Suffixes, "extension", lambda self, x, y, step: np.minimum(self.size[step][x], self.size[step][y]))
    left, right = suffix_dedup.repeated_parts(g, np.minimum(before, 6), [t[max(0, n - 6) : n + 70] for t, n in zip(texts, before)], length)
    for i in range(len(g)):
        pairs = [(_shared(texts[i][max(0, before[i] - 6) : before[i]][::-1], texts[j][max(0, before[j] - 6) : before[j]][::-1]), _shared(texts[i][before[i] :][:70], texts[j][before[j] :][:70])) for j in range(len(g)) if j != i and g[j] == g[i]]
        pairs = [p for p in pairs if sum(p) >= length]
        assert (left[i], right[i]) == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else (0, 0))


def _shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_empty_and_columns(spark):
    assert suffix_dedup.removal_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    out = suffix_dedup.without_repeats(spark.createDataFrame(fixture(), SCHEMA).drop("__spans"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "k"]
    assert out.filter("n_chars <> char_length(text)").count() == 0
    kept = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()}
    assert kept == {(r[0], r[4]) for r in brute([x for x in fixture()], 400)}  # no character of the fixture is cut through


def test_passages_of_over_50_words_are_told(spark):
    """Repeats too short to be removed are counted beside the removal, which stays that of `length` bytes."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(5))
    own = lambda n: " ".join(word() for _ in range(n))
    passage = own(51)
    rows = [(i, f"{own(80)} {passage if i % 2 else own(51)} {own(80)}", "en", "s", 0, "x", "y") for i in range(20)] + fixture()
    for group in (1024, 3):
        out = suffix_dedup.removal_digests(spark.createDataFrame(rows, SCHEMA), group=group).collect()
        assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, 400)
        assert sorted((r.doc_id or -1, r.n_bytes, r.passage_bytes) for r in out) == sorted((r[0] or -1, r[1], r[2]) for r in brute(rows, 200))
    assert 200 < len(passage) < 400
