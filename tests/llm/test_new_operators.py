"""Whitening, SentencePiece and collocations against plain versions."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("riskloom.llm")
import hashlib  # noqa: E402

import public_tokenizers as P  # noqa: E402

from riskloom.llm import collocations, piece_bpe, whitening  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("values", [np.linspace(1, 40, 40), np.r_[5 + np.arange(15) * 1e-7, 3 + np.arange(5) * 1e-10, np.linspace(1, 2, 20)], np.r_[np.full(20, 2.0), np.full(20, 1.0)], np.r_[np.linspace(1, 3, 10), np.zeros(30)], np.logspace(-6, 6, 40)])
def test_refined_eigenvectors(values):
    """Float32 vectors become right to double precision, also where eigenvalues lie in clusters or are equal."""
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(40, 40)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigenvectors(a)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * values.max()
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-13
    assert np.abs(a @ x - x * e).max() < 1e-13 * values.max()
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(rough.T @ rough - np.eye(40)).max() > 1e-8  # what was refined


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, i % 3 if i else None, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, component string, n double")


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [rows[5], (None, rows[7][1]), (900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [3e30] + [0.0] * 5)]
    got = whitening.whitened(embeddings(spark, rows)).collect()
    fit = [v for _, v in rows[:302]]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in fit]
    n, d = len(x), 6
    sums = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[float(sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in x) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * d and {r.component for r in got} == set(range(1, d + 1)) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-12 and r.identity_error < 1e-10
    exact = Counter((i, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for (i, _), r in zip(rows[:302], x, strict=True))
    for k, part in by.items():
        assert Counter((r.vec_id, r.deviation) for r in part) == exact
        want = {i: float((np.array(r, float) - np.array(sums) / n) @ u[:, k - 1] / math.sqrt(e[k - 1])) for (i, _), r in zip(rows[:302], x, strict=True)}
        sign = math.copysign(1, want[3]) * math.copysign(1, next(r.whitened for r in part if r.vec_id == 3))
        assert all(abs(r.whitened * sign - want[r.vec_id]) < 1e-8 for r in part)


def test_whitening_without_spread(spark):
    assert whitening.whitened(embeddings(spark, [])).count() == 0
    assert whitening.whitened(embeddings(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whitened(embeddings(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in got)
    got = whitening.whitened(embeddings(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()  # one direction only
    assert sorted((r.component, round(r.whitened, 9)) for r in got if r.whitened is not None) == [(1, -1.0), (1, 1.0)]
    assert all(r.whitened is None for r in got if r.component == 2)


def test_large_deviations():
    fit = whitening.Fit(10**6, [10**6 * 7 + 3])
    assert fit.deviation(np.array([[7], [8]])) == [9, (10**6 - 3) ** 2]
    assert fit.deviation(np.array([[10**9]])) == [(10**6 * 10**9 - 7 * 10**6 - 3) ** 2 if (10**6 * 10**9) ** 2 < 1 << 63 else None]


# ---------------------------------------------------------------- SentencePiece


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts():
    rng = random.Random(1)
    letters = "ab e▁ \n\t0中文éà🙂́​ '.,theonkK"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]


EDGES = ["", " ", "   ", "\n", "▁", "▁▁ a", " leading", "trailing ", "a  b   c", "x" * 5000, "中" * 3000, " " * 3000, "\0a", "naïve café 字符 🙂", "<s> </s> <unk> <0x0A>", "the " * 4000, "ab" * 4000 + " " + "🙂" * 300]


def test_agenda_equals_the_library():
    model, lib = piece_bpe.load(MODEL), library()
    texts = EDGES + random_texts()
    assert model.encode(texts) == lib.encode(texts)
    assert [model.merge(t) for t in lib.normalize(texts)] == lib.encode(texts)  # one agenda for a whole text
    words = ["▁hello", "x" * 200, "▁🙂中\n", "é"]
    assert model.merge_words(words) == [model.merge(w) for w in words] and model.merge_words([]) == []


def test_cache_of_bounded_size(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE", 50)
    model, lib, texts = piece_bpe.Pieces(MODEL), library(), random_texts()
    for at in range(0, len(texts), 100):
        assert model.encode(texts[at : at + 100]) == lib.encode(texts[at : at + 100])
        assert len(model.words) <= 50 + 100 * 60


def test_a_difference_is_an_error(monkeypatch):
    model = piece_bpe.Pieces(MODEL)
    model.rank = {p: r for p, r in model.rank.items() if p != "▁house"}
    model._tables()
    with pytest.raises(ArithmeticError):
        model.encode(["in the house"])
    monkeypatch.setattr(piece_bpe, "_MERGE_MODEL", 1)
    with pytest.raises(ValueError):
        piece_bpe.Pieces(MODEL)  # a model of another type is refused


def test_sentencepiece_over_spark(spark):
    lib = library()
    texts = [None, *EDGES, *random_texts()[:200]]
    rows = [(i if i % 7 else None, t, "k", [1]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, ids array<int>").toDF("doc_id", "text", "od`d.name", "ids")
    want = Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, piece_bpe.digests(df, MODEL).collect())) == want
    back = piece_bpe.decode(piece_bpe.encode(df, MODEL, pieces=True), MODEL).collect()
    assert sorted((r.text, "".join(r.pieces)) for r in back) == sorted((lib.decode(lib.encode(t or "")), "".join(lib.encode(t or "", out_type=str))) for t in texts) and back[0]["od`d.name"] == "k"
    assert piece_bpe.digests(df.limit(0), MODEL).count() == 0


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        total[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        counts[lang, tuple(w[i : i + k])] += 1
    found = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    kept = {}
    for (lang, p), a in found.items():
        inside = any(5 * c >= 4 * a for (g, q), c in found.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        score, _, l, r = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        if not inside:
            kept.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, ps in kept.items() for rank, (s, a, p, l, r) in enumerate(sorted(ps)[:top], 1)}


def phrase_rows():
    rng = random.Random(4)
    fixed = "Terms of the new service apply, to all users of it and to their heirs forever and a day"
    rows = [(None, None), ("en", ""), ("en", " \t "), ("und", "a b a b a b"), (None, "A B, a b! c"), ("en", "zz " * 400), ("de", "über alle maßen gut\x0büber alle maßen"), ("en", "x y z")]
    for i in range(150):
        words = [rng.choice(["the", "a", "of", "new", "york", "city", "San", "francisco", "bay", "é", "中", str(rng.randrange(40))]) for _ in range(rng.randrange(60))]
        for at in range(0, len(words), 9):
            words.insert(at, rng.choice([",", "new york city", "\n", "the", "same old story again", fixed if i % 3 == 0 else ".", "\t"]))
        rows.append((["en", "de", None][i % 3], " ".join(words)))
    return rows + rows[20:30]


@pytest.mark.parametrize("least,top", [(5, 2000), (30, 7), (2, 50)])
def test_collocations(spark, least, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(i // 2, t, g, 1, "x", 2) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, phrase string, c int").repartition(5)
    out = collocations.collocations(df, least, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in out.collect()} == plain_collocations(rows, least, top)


def test_paths(spark):
    """A repeated passage is one compacted path, however long; a texts' end within it parts it."""
    passage = " ".join(f"w{i}" for i in range(300))
    texts = [passage] * 6 + [" ".join(f"w{i}" for i in range(100, 140))] * 5 + ["a a a a a a a a"] * 6
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    got = {(r.phrase, r.n_words, r.a) for r in collocations.long_phrases(df, 5).collect()}
    span = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    assert got == {(span(0, 103), 103, 6), (span(100, 140), 40, 11), (span(137, 300), 163, 6), ("a a a a", 4, 30)}
    edges = Counter(" ".join(t.split()[i : i + 4]) for t in texts for i in range(len(t.split()) - 3))
    assert Counter({" ".join(p.split()[i : i + 4]): a for p, n, a in got for i in range(n - 3)}) == Counter({e: c for e, c in edges.items() if c >= 5})


def test_collocation_edges(spark, monkeypatch):
    schema = "text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], schema)).count() == 0
    long = "one two three four. " * 200 + "five six seven " * 500
    words = [w for _, part in _parts_of([long], 1000, monkeypatch) for w in part]
    assert words == re.findall(r"[^ .]+", long)


def _parts_of(texts, size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "PART", size)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], ["text", "lang"])
    for lang, w in collocations._parts([batch]):
        code, names = w.encoded()
        yield lang, [names[i].as_py() for i in code.tolist()]
