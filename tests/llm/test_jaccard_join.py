import itertools
import random

import pytest

pytest.importorskip("riskloom.llm")
from riskloom.llm import jaccard_join  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string"


def brute(rows):
    lower = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    up = list(range(len(rows)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n\t ", "one", "ONE", "one two three four", "a a a a a a a a a"]
    base = [word() for _ in range(90)]
    for n in range(60):  # copies that differ in a few words: some pairs link, many just miss
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(90)] = word()
        texts.append(" ".join(w))
    passage = [word() for _ in range(70)]
    for n in range(40):  # a passage that many share; some have little else
        texts.append(" ".join([word() for _ in range(rng.choice([3, 8, 20, 60]))] + passage + [word() for _ in range(rng.choice([2, 6]))]))
    for n in range(30):
        texts.append(" ".join(word() for _ in range(rng.choice([4, 5, 6, 40]))))
    texts += [texts[10], texts[10].upper(), " ".join(word() for _ in range(30_000))]
    rows = [(i * 3, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[12], (None, texts[20], None, None, None, None)]


@pytest.mark.parametrize("crowd", [1, 8, 1000])
def test_components_equal_brute_force(spark, crowd):
    rows = fixture()
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), crowd=crowd).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_empty_and_dedup(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = fixture()
    kept = jaccard_join.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    wordless = {r[0] for r in want if r[1] == 0}
    assert sorted(r.doc_id for r in kept) == sorted({r[2] for r in want if r[1]} | wordless)
    assert len(kept[0]) == 6


def test_dedup_groups_by_component_not_by_id(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(i, text(c), None, None, None, None) for i, c in [(None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "d"), (8, "d")]]
    kept = jaccard_join.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("7", "c"), ("7", "d"), ("None", "a"), ("None", "b")]
