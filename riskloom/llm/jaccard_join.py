"""Exact Jaccard join of word shingles by multiple-global-order filtering, and the components it gives.

A text's set is its distinct 5-word shingles in lower case, as 64-bit hashes. Texts of equal sets are one class. Two sets of
Jaccard similarity t or more share a token among the first p = n - ceil(t n) + 1 of each, whatever order of tokens holds for both.
More: of a posted prefix of each set under one order, the shared tokens, and what the sets still have beyond the shorter reach, must
come to the overlap that the similarity needs. A pair must pass this under three orders before any set is moved.

1. Quick links. The sets' smallest hashes in 30 parts of the hash range form ten band keys. In each band the members meet its
   smallest member only, and are verified; the components found so far make most later work needless.
2. First order: tokens of crowded lists last, the rest by hash. Each set posts a prefix (p and a margin). Tokens that occur once drop
   out by a count with map-side combine, as do lists of one component. A list that holds more than `crowd` sets beside those of its
   largest component is crowded, and its token moves to the end of the order; others give pairs, at most `crowd` for each member.
   Shared tokens are counted for each pair. Sets that lose too many posted tokens post more of them.
3. Second and third order (multiplied hashes): prefixes of the sets in pairs that are left meet, and only the survivors' sets do.
4. Sets with too few uncrowded tokens. Two of them without a common uncrowded token are as similar as their crowded parts C and
   sizes say: they link when n1 + n2 <= 2.25 |C1 and C2| (at 80 percent). So the smallest set of each distinct crowded part stands for
   it: every other set of that part links, if at all, with the same or fewer. Distinct parts meet in blocks.

Candidates' sets are made again from the texts that a bounded membership filter lets through; whole sets are never all stored.

Null or wordless text: an empty set that links with nothing; its component is its own doc_id. Fewer than five words: one shingle.
Rows with a null doc_id take part; a component's id is its smallest doc_id that isn't null. Repeated rows are equal texts, so one
class. Very long texts are hashed in pieces of 1 MB; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, few_files, key_filter, release, row_key, small_batches, stash
from .textops import mix, shingles, text_bytes

PARTS, BAND = 30, 3
U = np.uint64
ORDERS = (U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93))
LONGS = pa.list_(pa.int64())


def prefix_length(n, percent: int):
    """Tokens that a set of n must post: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def posted_length(n: int, percent: int) -> int:
    """Tokens that a set of n posts: the prefix and a margin."""
    p = prefix_length(n, percent)
    return min(n, p + p // 4 + 4)


def _rows(batch):
    data, offsets, _ = text_bytes(batch.column("text"))
    return (shingles(data[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows))


def _describe(percent: int):
    def run(batches):
        edges = (np.arange(PARTS, dtype=np.float64) / PARTS * 2.0**64).astype(U)
        for b in batches:
            n, d1, d2, last, bands, posts = [], [], [], [], [], []
            for s in _rows(b):
                m = len(s)
                n.append(m)
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & (1 << 64) - 1) - (1 << 63))
                if m:
                    least = s[np.searchsorted(s, edges) % m]
                    key = mix(mix(mix(least[0::BAND]) + least[1::BAND]) + least[2::BAND] + np.arange(PARTS // BAND, dtype=U))
                    bands.append(key.view(np.int64))
                    posts.append(s[: posted_length(m, percent)].view(np.int64))
                    last.append(int(posts[-1][-1]) ^ -(1 << 63))  # signed, in the unsigned order
                else:
                    bands.append(np.zeros(0, np.int64))
                    posts.append(np.zeros(0, np.int64))
                    last.append(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), *(pa.array(x, pa.int64()) for x in (n, d1, d2, last)), pa.array(bands, LONGS), pa.array(posts, LONGS)], ["doc_id", "k", "n", "d1", "d2", "last", "bands", "posts"])

    return run


# ---------------------------------------------------------------- other orders and verification

def _prefix(s: np.ndarray, order: np.uint64, size: int) -> np.ndarray:
    """The upper halves of the `size` smallest permuted hashes, in order."""
    return np.sort(np.partition(mix(s * order), size - 1)[:size] >> U(32)).astype(np.uint32)


def may_link(n1: int, p1: np.ndarray, n2: int, p2: np.ndarray, percent: int) -> bool:
    """Whether the prefixes of two sets of n1 and n2 tokens under one order leave room for the similarity.

    Below the shorter reach both prefixes are whole: common tokens there are counted (halves of hashes can only add some); beyond it
    there are no more than the smaller rest."""
    reach = min(p1[-1], p2[-1])
    a, b = p1[: np.searchsorted(p1, reach)], p2[: np.searchsorted(p2, reach)]
    common = len(a) + len(b) - len(np.union1d(a, b)) if len(a) == len(np.unique(a)) and len(b) == len(np.unique(b)) else min(len(a), len(b))
    return (100 + percent) * (common + min(n1 - len(a), n2 - len(b))) >= percent * (n1 + n2)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact comparison of two sorted sets."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets_of(texts: DataFrame, ids: DataFrame, col: str, percent: int) -> DataFrame:
    """(k, n, prefixes of the other orders, set as bytes) of the texts whose key is in ids; others may come along."""
    wanted = key_filter(ids, col)

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(wanted.value.mask(b.column("k").to_numpy())))
            n, orders, sets = [], ([], []), []
            for s in _rows(b):
                n.append(len(s))
                for o, out in zip(ORDERS, orders, strict=True):
                    out.append(_prefix(s, o, posted_length(len(s), percent)).tobytes() if len(s) else b"")
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (*orders, sets))], ["k", "n", "o1", "o2", "s"])

    return texts.mapInArrow(run, "k long, n long, o1 binary, o2 binary, s binary")


def _beside(pairs: DataFrame, sets: DataFrame, cols: list[str]) -> DataFrame:
    """pairs with the columns of both sets; both joins are between plain shuffles, so a hub's rows can be split."""
    left, right = (sets.select(F.col("k").alias(e), *[F.col(c).alias(c + e) for c in cols]) for e in ("u", "v"))
    return pairs.hint("merge").join(left, "u").hint("merge").join(right, "v")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (u, v) that link: those that the other orders leave are decided on their whole sets."""
    spark = pairs.sparkSession
    pairs = stash(pairs, tag + "-pairs")
    with small_batches(spark, 128):
        sets = stash(_sets_of(texts, pairs.select(F.explode(F.array("u", "v")).alias("k")), "k", percent).dropDuplicates(["k"]), tag + "-sets")

    def filtered(batches):
        for b in batches:
            n1, n2 = b.column("nu").to_pylist(), b.column("nv").to_pylist()
            out = [100 * min(m, n) >= percent * max(m, n) for m, n in zip(n1, n2, strict=True)]
            for o in ("o1", "o2"):
                for i, (x, y) in enumerate(zip(b.column(o + "u"), b.column(o + "v"), strict=True)):
                    out[i] = out[i] and may_link(n1[i], np.frombuffer(x.as_buffer(), np.uint32), n2[i], np.frombuffer(y.as_buffer(), np.uint32), percent)
            yield b.select(["u", "v"]).filter(pa.array(out, pa.bool_()))

    def decided(batches):
        for b in batches:
            out = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(b.column("su"), b.column("sv"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(out, pa.bool_()))

    with small_batches(spark, 512):
        left = stash(_beside(pairs, sets, ["n", "o1", "o2"]).select("u", "v", "nu", "nv", "o1u", "o1v", "o2u", "o2v").mapInArrow(filtered, "u long, v long"), tag + "-left")
    with small_batches(spark, 64):
        links = stash(_beside(left, sets, ["s"]).select("u", "v", "su", "sv").mapInArrow(decided, "u long, v long"), tag + "-links")
    release(pairs, sets, left)
    return links


# ---------------------------------------------------------------- first order

def _listed(posts: DataFrame, found: DataFrame, crowd: int, tag: str) -> DataFrame:
    """Rows (token, k, n, ..., root, crowded, top) of the lists that hold several components; top: of the list's largest one.

    posts has no token that occurs once, or few. Counts are map-side combined; lists are written before they meet their rows."""
    rows = posts.hint("merge").join(found, "k", "left").withColumn("root", F.coalesce("root", "k"))
    rows = stash(rows, tag + "-rows")
    each = rows.groupBy("token", "root").agg(F.count("*").alias("c"))
    lists = each.groupBy("token").agg(F.sum("c").alias("c"), F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("most")).filter("roots > 1")
    lists = stash(lists.select("token", F.col("most.root").alias("top_root"), (F.col("c") - F.col("most.c") > crowd).alias("crowded")), tag + "-heads")
    out = stash(rows.hint("merge").join(lists, "token").withColumn("top", F.col("root") == F.col("top_root")).drop("top_root"), tag)
    release(rows, lists)
    return out


def _pairs(light: DataFrame, percent: int) -> DataFrame:
    """(u, v, m, further) of different components and fitting sizes that share m tokens of uncrowded lists."""
    a, b = (light.select("token", *[F.col(c).alias(c + e) for c in ("k", "root", "n", "top", "further")]) for e in "12")
    fit = (F.col("root1") != F.col("root2")) & (F.col("top2") | (F.col("k1") < F.col("k2"))) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    met = a.filter("not top1").hint("merge").join(b, "token").filter(fit)
    return met.groupBy(F.least("k1", "k2").alias("u"), F.greatest("k1", "k2").alias("v")).agg(F.count("*").alias("m"), F.max(F.col("further1") | F.col("further2")).alias("further"))


def _posts(reps: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, k, n) of the posted tokens that are in tokens, or few others."""
    wanted = key_filter(tokens, "token")

    def run(batches):
        for b in batches:
            posts = b.column("posts")
            token, size = posts.flatten().to_numpy(), np.diff(posts.offsets.to_numpy())
            hit = wanted.value.mask(token)
            k, n = (np.repeat(b.column(c).to_numpy(), size)[hit] for c in ("k", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(token[hit]), pa.array(k), pa.array(n)], ["token", "k", "n"])

    return reps.select("k", "n", "posts").mapInArrow(run, "token long, k long, n long")


def jaccard_components(docs: DataFrame, percent: int = 80, crowd: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; k (a hash of id and text) tells rows apart, root (a hash, never null) components."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row_key("doc_id", "text").alias("k"))
    with small_batches(spark, 128):
        described = stash(texts.select("doc_id", "k", "text").mapInArrow(_describe(percent), "doc_id long, k long, n long, d1 long, d2 long, last long, bands array<long>, posts array<long>"), "jac-sets")
    rows = stash(described.select("doc_id", "k", "n", "d1", "d2"), "jac-rows")
    size = rows.count()
    classes = stash(rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("k").alias("k"), F.min("doc_id").alias("min_id"), F.max("n").alias("n")), "jac-classes")
    reps = described.hint("merge").join(classes.select("k", "d1", "d2"), ["k", "d1", "d2"], "left_semi").dropDuplicates(["k"])
    reps = stash(reps.select("k", "n", "last", "bands", "posts"), "jac-reps")
    release(described)
    keyed = texts.select("k", "text")

    # quick links
    keys = reps.select("k", F.explode("bands").alias("band"))
    heads = stash(keys.groupBy("band").agg(F.min("k").alias("head"), F.count("*").alias("c")).filter("c > 1").drop("c"), "jac-heads")
    pairs = keys.hint("merge").join(heads, "band").filter("k <> head").select(F.col("head").alias("u"), F.col("k").alias("v")).distinct()
    links = _verify(pairs, keyed, percent, "jac-quick")
    found = stash(components(links, "jac-cc").withColumnRenamed("node", "k"), "jac-found")
    release(heads, links)

    # first order
    tokens = reps.select(F.explode("posts").alias("token")).groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    tokens = stash(tokens, "jac-repeated")
    with small_batches(spark, 1024):
        lists = _listed(_posts(reps, tokens).withColumn("further", F.lit(False)), found, crowd, "jac-lists")
    met = stash(_pairs(lists.filter("not crowded"), percent), "jac-shared")
    lost = lists.filter("crowded").groupBy("k").agg(F.count("*").alias("lost"))
    known = stash(reps.select("k", "n", "last").hint("merge").join(lost, "k", "left").withColumn("lost", F.coalesce("lost", F.lit(0))), "jac-known")
    both = _beside(met, known, ["n", "last", "lost"])
    stored = lambda e: _posted(F.col(f"n{e}"), percent)
    rest = F.when(F.col("lastu") <= F.col("lastv"), F.col("nu") - stored("u")).otherwise(F.col("nv") - stored("v"))
    room = (100 + percent) * (F.col("m") + F.least("lostu", "lostv") + rest) >= percent * (F.col("nu") + F.col("nv"))
    more, last, spent = _short_sets(reps, known, found, keyed, lists, percent, crowd, size)
    late = _verify(both.filter(room).select("u", "v").unionByName(more.select("u", "v")).distinct(), keyed, percent, "jac-late")
    release(reps, tokens, lists, met, known)
    edges = found.select(F.col("k").alias("u"), F.col("root").alias("v")).unionByName(late)
    if last is not None:
        edges = edges.unionByName(_crowd_links(last, percent))
    release(*spent)

    roots = components(edges, "jac-all").withColumnRenamed("node", "k")
    named = stash(few_files(classes.hint("merge").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")), size), "jac-named")
    least = stash(few_files(named.groupBy("root").agg(F.min("min_id").alias("component_id")), size), "jac-least")
    of_class = stash(few_files(named.hint("merge").join(least, "root").select("d1", "d2", "component_id", "root"), size), "jac-result")
    release(classes, named, least, found, late)
    full = rows.filter("n > 0").hint("merge").join(of_class, ["d1", "d2"])
    return full.select("doc_id", "k", F.col("n").alias("n_shingles"), "component_id", "root").unionByName(rows.filter("n = 0").select("doc_id", "k", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("k").alias("root")))


def _posted(n, percent: int):
    """posted_length as a column."""
    p = n - F.ceil(n * percent / 100) + 1
    return F.least(n, p + F.floor(p / 4) + 4)


def _short_sets(reps: DataFrame, known: DataFrame, found: DataFrame, keyed: DataFrame, lists: DataFrame, percent: int, crowd: int, size: int):
    """Of the sets that lost too many posted tokens to crowded lists: candidates by further tokens; the crowded tokens of those that
    only these can join, or None; tables to release at the end.

    Their further tokens may crowd other lists, and these make other sets short; so it goes round until no set becomes short.
    """
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    sized = known.select("k", "n", need.cast("long").alias("need"), _posted(F.col("n"), percent).cast("long").alias("stored"))
    gone = stash(lists.filter("crowded").select("token", "k"), "jac-crowded")
    more = reps.sparkSession.createDataFrame([], "u long, v long")
    count, spent, tokens = 0, [gone], None
    while True:
        lost = gone.groupBy("k").agg(F.count("*").alias("lost"))
        short = stash(few_files(sized.hint("merge").join(lost, "k").filter("stored - lost < need").drop("lost"), size), "jac-short")
        spent.append(short)
        now = short.count()
        if now == count:
            break
        count = now
        crowded = stash(gone.select("token").distinct(), "jac-tokens")
        with small_batches(reps.sparkSession, 128):
            tokens = stash(_all_tokens(keyed, short), "jac-all-tokens")
        spent += [crowded, tokens]
        further = tokens.filter("at >= stored").hint("merge").join(crowded, "token", "left_anti")
        further = further.select("token", "k", "n", F.lit(True).alias("further"))
        further = stash(further, "jac-further")
        others = _posts(reps, further).withColumn("further", F.lit(False))
        with small_batches(reps.sparkSession, 1024):
            met = _listed(others.unionByName(further), found, crowd, "jac-further-lists")
        more = stash(_pairs(met.filter("not crowded"), percent), "jac-more")
        gone = stash(gone.unionByName(met.filter("crowded").select("token", "k")).distinct(), "jac-crowded")
        release(further, met)
        spent += [more, gone]
    if not count:
        return more, None, spent
    # sets with fewer uncrowded tokens than they must post: all their crowded tokens
    crowded = stash(gone.select("token").distinct(), "jac-tokens")
    flagged = tokens.hint("merge").join(crowded.withColumn("c", F.lit(True)), "token", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    flagged = stash(flagged, "jac-flagged")
    free = flagged.groupBy("k").agg(F.sum(F.when(F.col("c"), 0).otherwise(1)).alias("free")).join(sized.select("k", "need"), "k").filter("free < need").select("k")
    free = stash(few_files(free, size), "jac-free")
    last = stash(flagged.filter("c").hint("merge").join(free, "k", "left_semi").select("token", "k", "n"), "jac-last")
    spent += [crowded, flagged, free, last]
    return more, last, spent


def _all_tokens(keyed: DataFrame, some: DataFrame) -> DataFrame:
    """(token, at, columns of some): every token of some's texts, at its place in hash order."""
    wanted = key_filter(some, "k")

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(wanted.value.mask(b.column("k").to_numpy())))
            for k, s in zip(b.column("k").to_pylist(), _rows(b), strict=True):
                for at in range(0, len(s), 50_000):
                    part = s[at : at + 50_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k), pa.int64()), pa.array(np.arange(at, at + len(part)), pa.int64()), pa.array(part)], ["k", "at", "token"])

    return keyed.mapInArrow(run, "k long, at long, token long").hint("merge").join(some, "k").distinct()


# ---------------------------------------------------------------- sets that only crowded tokens can join

def _crowd_links(last: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links among sets that share no uncrowded token; last has their crowded tokens (token, k, n).

    Sets of one crowded part are stood for by the smallest of them. The parts of a group (joined by prefix tokens) meet in blocks, which
    give a forest of links, and for each part the partner that leaves room for the largest other set; never the pairs."""
    parts = last.groupBy("k").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("token")).alias("c"))
    parts = stash(parts.withColumn("part", F.md5(F.array_join("c", ","))), "jac-parts")
    least = stash(parts.groupBy("part").agg(F.min(F.struct("n", "k")).alias("x")).select("part", "x.k"), "jac-least-of-part")
    some = stash(parts.hint("merge").join(least, ["part", "k"], "left_semi"), "jac-part-sets")

    prefix = F.slice("c", F.lit(1), (F.size("c") - F.ceil(F.size("c") * percent / 100) + 1).cast("int"))
    posts = some.select("k", F.explode(prefix).alias("token"))
    heads = stash(posts.groupBy("token").agg(F.min("k").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"), "jac-part-heads")
    group = components(posts.hint("merge").join(heads, "token").filter("k <> head").select(F.col("k").alias("u"), F.col("head").alias("v")), "jac-part-cc")
    group = stash(group.select(F.col("node").alias("k"), F.col("root").alias("g")), "jac-part-groups")
    chunks = stash(group.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")), "jac-part-chunks")
    dealt = stash(group.hint("merge").join(chunks, "g").hint("merge").join(some.select("k", "n", "c"), "k"), "jac-part-dealt")
    own = F.pmod(F.xxhash64("k", F.lit("block")), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("k", "n", "c", "own", "g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def meet(t: pa.Table) -> pa.Table:
        k, own, lo, hi, n = (t[c].to_numpy() for c in ("k", "own", "lo", "hi", "n"))
        c = t["c"].combine_chunks()
        token, size = c.flatten().to_numpy(), np.diff(c.offsets.to_numpy())
        at = np.concatenate(([0], np.cumsum(size)))
        b = np.flatnonzero(own == hi[0])
        tokens, of = np.concatenate([token[at[i] : at[i + 1]] for i in b] or [token[:0]]), np.repeat(b, size[b])
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        forest, out = Forest(len(k)), []
        best, partner = np.full(len(k), -1), np.zeros(len(k), np.int64)
        for i in np.flatnonzero(own == lo[0]).tolist():
            s = token[at[i] : at[i + 1]]
            left, right = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
            m = right - left
            hit = np.repeat(left - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            both = (100 + percent) * np.bincount(of[hit], minlength=len(k))
            for j in np.flatnonzero((both >= percent * (n[i] + n)) & (np.arange(len(k)) != i)).tolist():
                if both[j] - percent * n[j] > best[i]:
                    best[i], partner[i] = both[j] - percent * n[j], k[j]
                if both[j] - percent * n[i] > best[j]:
                    best[j], partner[j] = both[j] - percent * n[i], k[i]
                if forest.join(i, j):
                    out.append((k[i], k[j], None))
        out += [(k[i], partner[i], best[i]) for i in np.flatnonzero(best >= 0)]
        x, y, room = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"u": pa.array(x, pa.int64()), "v": pa.array(y, pa.int64()), "room": pa.array(room, pa.int64())})

    met = stash(dealt.groupBy("g", "lo", "hi").applyInArrow(meet, "u long, v long, room long"), "jac-part-met")
    own_room = some.select(F.col("k").alias("u"), F.col("k").alias("v"), ((100 + percent) * F.size("c") - percent * F.col("n")).cast("long").alias("room"))
    most = met.filter("room is not null").unionByName(own_room).groupBy("u").agg(F.max(F.struct("room", "v")).alias("x")).select(F.col("u").alias("k"), "x.room", "x.v")
    most = stash(most.hint("merge").join(least, "k").select("part", "room", "v"), "jac-part-room")
    members = parts.select("k", "n", "part").hint("merge").join(most, "part").filter(percent * F.col("n") <= F.col("room")).filter("k <> v")
    out = stash(members.select(F.col("k").alias("u"), "v").unionByName(met.filter("room is null").select("u", "v")), "jac-part-links")
    release(parts, least, some, heads, group, chunks, met, most)
    return out


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each component, with the columns of docs: that of the smallest doc_id, null ids last; equal rows count as one."""
    found = jaccard_components(docs, percent)
    found = stash(found.withColumn("wordless", F.col("n_shingles") == 0), "jac-groups")
    first = found.groupBy("wordless", "root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "k")).alias("x")).select(F.col("x.k").alias("__k"))
    keys = stash(few_files(first, found.count()), "jac-keep")
    release(found)
    kept = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("__k"))  # a struct: its names can't clash
    return kept.hint("merge").join(keys, "__k", "left_semi").dropDuplicates(["__k"]).select("row.*")
