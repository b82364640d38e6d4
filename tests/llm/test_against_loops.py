"""Rates of the classifier, SQL of the chat query, SQL of collocations: against plain versions on rows that part right from wrong."""

import math
import random
from collections import defaultdict

import pytest

pytest.importorskip("riskloom.llm")
from riskloom.llm import chat_format, collocations, eb_classifier, queries  # noqa: E402


def test_path_rates_equal_a_loop(spark):
    """Global, host and path rates with strengths by moments; null hosts and paths are groups of their own."""
    rng = random.Random(2)
    hosts = [None, *"abcdefg"]
    bias = {h: rng.uniform(-2, 2) for h in hosts}
    rows = [(h, rng.choice([None, "x", "y"]), bias[h] + rng.gauss(0, 1.5), rng.gauss(0, 1)) for h in hosts for _ in range(rng.choice([1, 3, 40, 200]))]
    model = {"toxic": {"rate": 0.2}, "low": {"rate": 0.0}}
    got = {(r["__host"], r["__path"]): (r["__r_toxic"], r["__r_low"]) for r in eb_classifier.path_rates(spark.createDataFrame(rows, "host string, path string, __e_toxic double, __e_low double").repartition(4), model).collect()}
    for k, head in enumerate(("toxic", "low")):
        base = min(1 - 1e-6, max(1e-6, model[head]["rate"]))
        post = [1 / (1 + math.exp(-(r[2 + k] + math.log(base / (1 - base))))) for r in rows]
        by_host, by_path = defaultdict(list), defaultdict(list)
        for r, p in zip(rows, post, strict=True):
            by_host[r[0]].append(p)
            by_path[r[0], r[1]].append(p)
        n, mean = len(rows), sum(post) / len(rows)
        ss = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in by_host.values())
        spread = (ss - (len(by_host) - 1) * mean * (1 - mean)) / (n - sum(len(v) ** 2 for v in by_host.values()) / n)
        strength = min(1e4, max(5.0, mean * (1 - mean) / spread - 1 if spread > 0 else 1e4))
        for (h, p), v in by_path.items():
            host = (sum(by_host[h]) + strength * mean) / (len(by_host[h]) + strength)
            assert abs(got[h, p][k] - (sum(v) + strength * host) / (len(v) + strength)) < 1e-12
    assert len(got) == len({(r[0], r[1]) for r in rows})


CHATS = [(1, 0, "user", "a\\b <s> x"), (1, 1, "assistant", "c:\\lib </s>"), (2, 0, "assistant", "\\"), (2, 0, "assistant", "\\"), (3, 0, None, None), (4, 1, "user", "plain [INST"), (4, 0, "assistant", "[/INST] é🙂 \\k"), (5, 0, "user", "\\bl\\k[INST]")]


def test_chat_sql_with_control_strings(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CHATS)
    out = con.execute(queries.ORACLES["op7_chat_format"])
    names = [d[0] for d in out.description]
    want = {r[names.index("conv_id")]: dict(zip(names, r, strict=True)) for r in out.fetchall()}
    got = {r.conv_id: r.asDict() for r in chat_format.chat_digests(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")).collect()}
    assert set(want) - {-7} == set(got) and all(got[k] == want[k] for k in got)
    assert got[1]["formatted_chars"] == 63


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.chat_digests(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>" if i % 50 == 1 else f"turn {i}") for i in range(1000)]
    got = chat_format.chat_digests(spark.createDataFrame(rows, schema)).first()
    assert got.n_turns == 1000 and got.loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_collocation_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(1)
    texts = [(["en", None, "de"][i % 3], " ".join(rng.choice(["New", "york", "city,", "bay\tarea", "a.b", "É", "x"]) for _ in range(rng.randrange(80)))) for i in range(300)] + [("en", None), (None, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = con.execute(queries.ORACLES["op13_collocations"]).fetchall()
    got = collocations.collocations(spark.createDataFrame(texts, "lang string, text string"))
    assert len(want) > 50 and {tuple(r) for r in got.collect()} == {tuple(r) for r in want}
