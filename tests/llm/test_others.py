import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("riskloom.llm")
import public_tokenizers as P  # noqa: E402

from riskloom.llm import bpe, chat_format, eb_classifier, mixing, pivot_index, quality_rules, sharding, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, shard int, bucket int"
TEXTS = [None, "", "  \n ", "one two", "a\t b  c \n\n d", "naïve café 字符 🙂 's x's  ", "w " * 3000, "the idiot said so", "###$$$ *** |||", "x" * 5000]


def documents(spark):
    rng = random.Random(1)
    rows = [(i, t, [None, "en"][i % 2], [None, "s1", "s2"][i % 3], 0, "c", 1, 2) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(400))), "en", f"s{i % 4}", 0, "c", 1, 2) for i in range(60)]
    rows += [rows[3], (None, "null id", "fr", "s1", None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_quality_rules(spark):
    rows, df = documents(spark)
    labels = spark.createDataFrame([(100 + i, i % 5 and 1 or 0, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(df, labels).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        w = b.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(w) < 500 else None
        assert r.n_words == len(w) and r.n_symbols == sum(b.count(c) for c in b"#*$%&|<>")
        assert hit is None or r.n_repeat_words == len(hit)
        lines, seen = 0, set()
        for line in b.split(b"\n"):
            lines += bool(line.split()) and line in seen
            seen.add(line)
        assert r.n_dup_lines == lines and r.word_chars == len(b"".join(w).decode())
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert r.kept == (not r.base_failed and r.failed_rule is None)
    assert quality_rules.quality_rules(df.limit(0), labels).count() == 0


def test_quality_cutoffs_by_stratum(spark):
    """Every stratum, of 80, has cutoffs of its own, chosen as a plain loop chooses them."""
    import math

    rng = random.Random(6)
    rules, grid = quality_rules.RULES, quality_rules.GRID
    rows = [(i, f"l{i % 80}" if i % 160 else None, False, *(round(rng.random() ** 6, 6) for _ in rules)) for i in range(24_000)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, " + ", ".join(f"v_{r} double" for r in rules))
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(24_000)], "doc_id long, quality int")
    got = {r.stratum: r for r in quality_rules.cutoffs(measured, labels, 0.2, 0.9).collect()}
    halves = {r.doc_id: r.half for r in spark.range(24_000).selectExpr("id as doc_id", "abs(xxhash64(id, 'half')) % 2 as half").collect()}
    level = lambda v: sum(v >= g for g in grid)
    by = {}
    for i, lang, _, *v in rows:
        if i % 10:
            by.setdefault(lang or "none", ([], []))[halves[i]].append([level(x) for x in v])
    want = {}
    for s, (design, holdout) in by.items():
        for step, (rate, margin) in enumerate(quality_rules.STEPS):
            cut = []
            for j in range(len(rules)):
                most = math.floor(rate / len(rules) * len(design))
                cut.append(next(c for c in range(1, len(grid) + 2) if sum(d[j] >= c for d in design) <= most) + margin)
            k = sum(any(d[j] >= cut[j] for j in range(len(rules))) for d in holdout)
            if quality_rules.binomial_tail(k, len(holdout), 0.2) > 0.9 / len(by):
                break
            want[s] = (step, len(holdout), k, *(grid[c - 1] if c <= len(grid) else None for c in cut))
    assert len(want) > 64
    assert {s: tuple(r)[1:] for s, r in got.items()} == want


def test_binomial_tail():
    assert abs(quality_rules.binomial_tail(0, 10, 0.1) - 0.9**10) < 1e-12
    assert quality_rules.binomial_tail(10, 10, 0.1) == 1.0


def test_near_vectors_edges(spark):
    schema = "vec_id long, embedding array<double>, label string, class string, rep long, near int, weight int"
    rows = [(1, [1.0, 0.0], "a", "x", 1, 1, 1), (1, [1.0, 0.0], "a", "x", 1, 1, 1), (1, [0.0, 1.0], "a", "x", 1, 1, 1), (2, [1.0, 0.001], "a", "y", 2, 2, 2), (3, [1.0, 0.0], None, None, None, None, None), (None, [1.0, 0.0], "b", None, None, None, None), (4, [2.0, 0.0], "a", None, None, None, None), (5, [1.0, 0.0, 0.0], "a", None, None, None, None), (6, None, "a", None, None, None, None)]
    rows += [(7, [], "a", None, None, None, None), (8, [0.0, 0.0], "a", None, None, None, None), (9, [float("nan"), 1.0], "a", None, None, None, None), (10, [None, 1.0], "a", None, None, None, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in pivot_index.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [(1, 3, 1), (1, 3, 1), (1, 0, 1), (2, 3, 1), (3, 0, 3), (None, 0, None), (4, 3, 1), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10)]
    assert got == sorted(want, key=str)
    assert pivot_index.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_near_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.2, 0.3])).tolist(), int(i % 2)) for i in range(500)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [1.0, None], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, (np.array(rows[1][1]) * 3).tolist(), 1)]
    out = {r.vec_id: r for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=32).collect()}
    x = {i: np.array(v) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    lab = {r[0]: r[2] for r in rows}
    links = {i: [j for j in x if i != j and lab[i] == lab[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98] for i in x}
    total, found = sum(map(len, links.values())), sum(r.n_links for r in out.values())
    assert len(out) == len(rows) and 0.97 * total <= found <= total
    assert out[905].n_links == 1 and out[906].component_id == 905 and not out[906].kept and out[900].kept and out[903].n_links == 0


def test_classifier(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["sun", "moon", "tree", "river", "stone", "bird"]) for _ in range(60))
    rows, labels = [], []
    for i in range(900):
        toxic, low = i % 9 == 0, i % 7 == 0
        rows.append((i, good() + (" idiot clown" if toxic else "") if not low else good().upper().replace(" ", "!! "), "en", f"s{i % 5}", 0, "c", 1, 2))
        if i % 2:
            labels.append((i, 1 - low, int(toxic and not low)))
    rows += [(None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    out = eb_classifier.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    wrong = sum(r.kept == (r.doc_id % 9 == 0 or r.doc_id % 7 == 0) for r in out if r.doc_id is not None and r.doc_id % 2 == 0)
    assert len(out) == len(rows) and wrong <= 9
    assert eb_classifier.classify(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("kept").count() == len(rows)
    assert eb_classifier.keep_good(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_sharding(spark):
    rows, df = documents(spark)
    out = sharding.shuffle_to_shards(df).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(len(s) for s in slots.values()) == sorted(len(rows) // 8 + (s < len(rows) % 8) for s in range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out)
    assert sharding.shuffle_to_shards(df.limit(0)).count() == 0
    rng = random.Random(4)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / 4000 - 6) < 0.15 and 0 <= min(draws) and max(draws) <= 20


def test_chat(spark):
    bad = ["</s>", "<s>user[INST]x</s>", "\\", "\\l", "a\\b<", "[/INST]", "", None, "<", "字</s>🙂", "x</s"]
    rows = [(c, t, role, text, "clash") for c, texts in enumerate([bad, bad[::-1], ["plain"]]) for t, text in enumerate(texts) for role in [["user", "assistant", "we<s>ird", None][t % 4]]]
    rows += [(None, None, "assistant", "lost", None), (0, 0, "user", "</s>", "clash")]
    out = chat_format.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in out:
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        loss = "".join(x[2] for x in own if x[1] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{x[1]}\n{x[2]}\n" for x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_warc(spark):
    rows = [(i, f"http://h/{i}\r\nx", h, "c") for i, h in enumerate(["<p>" + "a" * 200, None, "", "short", "short", "<p>" + "a" * 200, "WARC/1.1\r\n" * 30, "é" * 60, "é" * 60])]
    rows += [(None, None, "<p>" + "a" * 200, "c"), rows[3]]
    out = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string")).collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = min(x[0] for x in rows if x[2] == h and x[0] is not None)
        again = len(b) >= 100 and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert out == sorted(want, key=str)


def test_warc_files_are_bounded(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 100, 3000, 9000, 40_000])))) for i in range(300)] + [(999, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), file_bytes=150_000)
    sizes, ids = [], []
    for f in (tmp_path / "w").glob("file=*/part-*"):
        got = [x for x in warc.salvage(f.read_bytes()) if x[0] == "record"]
        ids += [x[3]["warc-record-id"] for x in got]
        sizes.append((sum(len(x[4]) for x in got), len(got)))
    assert sorted(ids) == sorted(f"<urn:page:{r[0]}>" for r in rows)
    assert all(n == 1 or size <= 150_000 for size, n in sizes) and len(sizes) < 120
    out = {r.page_id: r.payload_bytes for r in warc.round_trip(pages).collect()}
    assert out == {r[0]: len(r[2]) for r in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_salvage_reads_damaged_files(spark, tmp_path):
    """The reader over files as Spark gives them: damage costs only what is damaged."""
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    (part,) = (tmp_path / "w").glob("file=*/part-*")
    data = bytearray(part.read_bytes())
    starts = [i for i in range(len(data)) if data[i : i + 3] == b"\x1f\x8b\x08"]
    data[starts[20] + 40] ^= 255
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0").write_bytes(bytes(data))
    rows = warc.read_salvaging(spark, str(tmp_path / "d"), payloads=True).collect()
    ids = {r.page_id for r in rows if r.kind == "record"}
    gaps = [r for r in rows if r.kind == "gap"]
    assert len(ids) == 39 and len(gaps) == 1 and gaps[0].length > 0
    assert all(bytes(r.payload).decode() == f"page {r.page_id} " * 50 for r in rows if r.kind == "record")


def test_salvage():
    one = lambda i: gzip.compress(warc.record(i, "u", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None), mtime=0)
    damaged = bytearray(one(2))
    damaged[60] ^= 255
    plain = warc.record(5, "u", b"y", hashlib.sha256(b"y").hexdigest(), None)
    wrong = plain.replace(b"\r\n\r\ny", b"\r\n\r\nz")
    data = one(1) + bytes(damaged) + one(3) + b"junk WARC/1. junk" + plain + wrong + one(4) + one(6)[:50]
    got = list(warc.salvage(data))
    assert [x[3]["warc-record-id"] for x in got if x[0] == "record"] == ["<urn:page:1>", "<urn:page:3>", "<urn:page:5>", "<urn:page:4>"]
    gaps = [x for x in got if x[0] == "gap"]
    assert len(gaps) == 4 and sum(x[2] for x in got) == len(data)


def test_mixing(spark):
    rows, df = documents(spark)
    out = mixing.mixed_counts(df, block=4).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r["size"] for r in out)
    assert abs(sum(r.taken for r in out) - sum(r["size"] for r in out)) < 0.02 * sum(r["size"] for r in out)
    assert sorted(map(tuple, mixing.mixed_counts(df, block=4).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert mixing.mixed_counts(df.limit(0)).count() == 0
    taken, mixed = {}, {}  # equal rows are among them
    for r in out:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    for r in mixing.mixed_documents(df, block=4).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len((r.text or "").encode().split())
    assert all(mixed.get(i, 0) == n for i, n in taken.items())


def test_mixing_targets(spark):
    """Water filling by hand: what a full source can't take goes to the others by weight, until none is above its cap."""
    for sizes in ([5, 1000, 40, 300, 2], [100, 100, 100], [0, 7], [1, 1, 1000, 1, 1, 1]):
        words = [("s%d" % i if i else None, n) for i, n in enumerate(sizes)]
        order = sorted(range(len(words)), key=lambda i: (words[i][0] is None, words[i][0] or ""))
        weight, full, total = {i: at % 3 + 1 for at, i in enumerate(order)}, {}, sum(sizes)
        while True:
            rest = [i for i in weight if i not in full]
            share = {i: (total - sum(full.values())) * weight[i] / sum(weight[j] for j in rest) for i in rest}
            above = [i for i in rest if share[i] > 3 * sizes[i]]
            if not above:
                break
            full.update({i: 3 * sizes[i] for i in above})
        want = {words[i][0]: x for i, x in (full | share).items()}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(words, "source string, size long")).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000, 4097):
        x = np.arange(n)
        a, b = (mixing.permuted(x, np.full(n, n), np.full(n, key, np.uint64)) for key in (3, 4))
        assert sorted(a.tolist()) == sorted(b.tolist()) == x.tolist()
        assert n < 17 or (a != b).mean() > 0.8
    steps = np.diff(mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 9, np.uint64)))
    assert len(np.unique(steps)) > 500  # no arithmetic progressions


def test_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, df = documents(spark)
    tokens = bpe.encode(df, path, P.PATTERN, offsets=True)
    for r in bpe.decode(tokens, path, P.PATTERN).collect():
        source = r.text
        assert list(r.ids) == want.encode_ordinary(source) and bytes(r.data).decode() == source
        assert not r.spans or (r.spans[0].start, r.spans[-1].end) == (0, len(source))
    model = bpe.load(path, P.PATTERN)
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice("ab cé字 🙂'st\n\t1.,") for _ in range(rng.randrange(40)))
        assert model.encode([t])[0] == want.encode_ordinary(t)
    assert bpe.digests(df.limit(0), path, P.PATTERN).count() == 0


def test_near_vectors_in_a_large_group(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n, d = 6000, 32
    x = rng.normal(size=(n, d))
    x[::3] = rng.normal(size=d) + 0.1 * rng.normal(size=(n // 3, d))  # a third of the rows: cosines of about 0.99
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = pivot_index.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    total, found = int((x @ x.T >= 0.98).sum()) - n, sum(r.n_links for r in out)
    print("large group: links", total, "found", found)
    assert 0.97 * total <= found <= total


def test_salvage_members_of_several_records():
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rng = random.Random(6)
    body = {i: bytes(rng.randrange(256) for _ in range(4000)) for i in range(6)}
    plain = [warc.record(i, "u", b, digest(b), None) for i, b in body.items()]
    ids = lambda found: [x[3]["warc-record-id"] for x in found if x[0] == "record"]
    name = lambda *i: [f"<urn:page:{j}>" for j in i]

    wrong = plain[2][:-20] + bytes([plain[2][-20] ^ 255]) + plain[2][-19:]
    inner = plain[0] + plain[1] + wrong + plain[3]
    member = gzip.compress(inner, mtime=0)
    got = list(warc.salvage(member + gzip.compress(plain[4], mtime=0)))
    assert ids(got) == name(0, 1, 3, 4)
    assert [(x[1], x[2], x[4]) for x in got if x[0] == "gap"] == [(0, len(member), len(plain[0]) + len(plain[1]))]

    for level in (0, 6):  # 0: the content stands in the member as it is
        whole = gzip.compress(b"".join(plain[:4]), level, mtime=0)
        cut, crc = whole[: len(whole) - 4500], whole[:-8] + bytes(8)
        for damaged, kept in ((cut, (0, 1)), (crc, (0, 1, 2, 3))):
            data = damaged + gzip.compress(plain[4], mtime=0)
            got = list(warc.salvage(data))
            assert ids(got)[: len(kept)] == name(*kept) and ids(got)[-1:] == name(4) and len(set(ids(got))) == len(ids(got))
            assert sum(x[2] for x in got) == len(data)


def test_shard_blocks(spark):
    rows, df = documents(spark)
    out = mixing.shard_blocks(df, block=4, shards=5).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.position)
    assert set(by) == set(range(5)) and all(sorted(p) == list(range(len(p))) for p in by.values())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    times = {}
    for r in out:
        last = -(-sizes[r.source] // 4) - 1
        assert len(r.text.encode().split()) == (4 if r.block_index < last else sizes[r.source] - 4 * last)
        times[r.source, r.block_index] = times.get((r.source, r.block_index), 0) + 1
    assert max(times.values()) <= 3
    for source in {r.source for r in out}:  # a shard's count of a source is near its share
        n = [sum(r.shard == s and r.source == source for r in out) for s in range(5)]
        assert all(abs(x - sum(n) / 5) <= 5 * (sum(n) * 0.16) ** 0.5 + 1 for x in n)
    words = sum(len(r.text.encode().split()) for r in out)
    assert words == sum(r.taken for r in mixing.mixed_counts(df, block=4, shards=5).collect())
    assert mixing.shard_blocks(df.limit(0)).count() == 0
