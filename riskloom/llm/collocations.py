"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of three words, an edge is a run of four that leads from its first three words to its last three, and its weight is how
often it stands in the texts. Only these longest runs are counted. Where a run of four can't begin, as a piece ends before it, a shorter
one is counted in its place: the piece-end correction. So each word of the texts begins one counted run, and a shorter phrase's count is
the flow through it: the sum over all counted runs that begin with it.

A phrase that is found `least` times has only neighbouring pairs that are found as often, so a piece also ends, for runs that begin before
it, at a pair below that. Such pairs are told by counts of 64-bit pair hashes, kept as a filter of bounded size; hashes that meet, or a
full filter, only let more runs be counted. All counts that are returned come from the words themselves.

Paths: a node through which one edge brings all flow in and one edge takes all of it out is unary, and its edges are joined; paths
are compacted by pointer jumping, in as many rounds as the logarithm of the longest. (A closed circle of unary nodes can't be: some text
would have to begin in it.) A compacted path is a phrase of any length found as often as each of its edges, and stands for these
when it is asked what lies inside longer phrases.

Texts: A-Z go to lower case, pieces end at PIECE_ENDS, words at spaces and tabs. Null texts have no words; a null lang is `und`. Rows with
equal ids or texts count each. Empty tables have no phrases. Very long texts are read whole, in parts cut between pieces; a path is one
row, at most as long as a text. Ties end in the phrase's order of UTF-8 bytes. Further columns of docs are never read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_filter, release, stash
from .textops import LOWER, U, mix, prefix_hash, span_hash, text_bytes

PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
LEAST, TOP = 30, 2000
UNDEFINED = "und"
PART = 1 << 21  # bytes of text looked at at once; a longer piece is looked at whole
_ENDS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_GAPS[[*PIECE_ENDS, 0x20, 0x09]] = True


class Words:
    """The words of some bytes of one lang: where they stand, and whether the next word is of the same piece."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        """begins: offsets in data at which a new text begins."""
        self.data = LOWER[data]
        n = len(data)
        new = np.zeros(n + 1, bool)
        new[begins] = True
        word = ~_GAPS[self.data]
        before = np.concatenate(([False], word[:-1]))
        self.start = np.flatnonzero(word & (~before | new[:n]))
        last = word & np.concatenate((~word[1:] | new[1:n], [True])) if n else word
        self.end = np.flatnonzero(last) + 1
        breaks = np.cumsum(_ENDS[self.data].astype(np.int32) + new[:n])
        piece = breaks[self.start]
        self.paired = np.append(piece[:-1] == piece[1:], False)[: len(piece)]  # with the next word

    def hashes(self) -> np.ndarray:
        return mix(span_hash(prefix_hash(self.data), self.start, self.end) + (self.end - self.start).astype(U))

    def pair_hashes(self, salt: int) -> np.ndarray:
        """Of each word and the next, for those that are paired."""
        h = self.hashes()
        at = np.flatnonzero(self.paired)
        return mix(h[at] * U(0x9E3779B97F4A7C15) + mix(h[at + 1] ^ U(salt)))

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's place in the list of distinct words, and that list."""
        both = np.empty(2 * len(self.start) + 1, np.int32)  # words and the gaps between them take turns
        both[0:-1:2], both[1::2], both[-1] = self.start, self.end, len(self.data)
        strings = pa.Array.from_buffers(pa.utf8(), 2 * len(self.start), [None, pa.py_buffer(both), pa.py_buffer(np.ascontiguousarray(self.data))])
        found = strings.take(pa.array(np.arange(0, 2 * len(self.start), 2))).dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _parts(batches):
    """(lang, Words) of all texts of Arrow batches, texts of a lang together."""
    for b in batches:
        data, offsets, valid = text_bytes(b.column("text"))
        langs = b.column("lang").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        sizes = np.where(valid, np.diff(offsets), 0)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            held, size = [], 0
            for i in np.flatnonzero((code == k) & (sizes > 0)).tolist():
                text = data[offsets[i] : offsets[i] + sizes[i]]
                if size and size + len(text) > PART:
                    yield lang, _joined(held)
                    held, size = [], 0
                while len(text) > PART:
                    cut = np.flatnonzero(_ENDS[text[PART:]])
                    if not len(cut):
                        break
                    yield lang, _joined([text[: PART + int(cut[0])]])
                    text = text[PART + int(cut[0]) :]
                held.append(text)
                size += len(text)
            if held:
                yield lang, _joined(held)


def _joined(texts: list[np.ndarray]) -> Words:
    sizes = np.array([len(t) for t in texts], np.int64)
    return Words(np.concatenate(texts), np.cumsum(sizes) - sizes)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDEFINED)).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")


def frequent_pairs(docs: DataFrame, least: int) -> DataFrame:
    """(h): hashes of neighbouring pairs of a lang whose count, with those of equal hash, reaches least."""

    def run(batches):
        for lang, words in _parts(batches):
            h, c = np.unique(words.pair_hashes(_salt(lang)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return _texts(docs).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("h")


def runs(docs: DataFrame, frequent) -> DataFrame:
    """(lang, gram, c): counts of the run that each word begins, of four words or as many as stand before the piece's end or a pair that
    isn't among frequent (a broadcast filter); with a null gram the number of all words."""

    def run(batches):
        for lang, words in _parts(batches):
            n = len(words.start)
            grams, counts = [pa.nulls(1, pa.utf8())], [np.array([n])]
            if n:
                pair = np.zeros(n + 3, bool)
                at = np.flatnonzero(words.paired)
                pair[at] = frequent.value.mask(words.pair_hashes(_salt(lang)).view(np.int64))
                word, names = words.encoded()
                size = np.int64(len(names))
                alone, _, two = pair[:n], pair[1 : n + 1], np.flatnonzero(pair[:n])
                _, of_pair = np.unique(word[two] * size + word[two + 1], return_inverse=True)
                pair_at = np.full(n + 3, -1, np.int64)
                pair_at[two] = of_pair
                second, third = pair[:n] & pair[1 : n + 1], pair[:n] & pair[1 : n + 1] & pair[2 : n + 2]
                some = np.int64(len(two) + 1)
                for length, where, key in (
                    (1, np.flatnonzero(~alone), lambda i: word[i]),
                    (2, np.flatnonzero(alone & ~second), lambda i: pair_at[i]),
                    (3, np.flatnonzero(second & ~third), lambda i: pair_at[i] * size + word[i + 2]),
                    (4, np.flatnonzero(third), lambda i: pair_at[i] * some + pair_at[i + 2]),
                ):
                    if len(where):
                        _, first, count = np.unique(key(where), return_index=True, return_counts=True)
                        i = where[first]
                        parts = [names.take(pa.array(word[i + k])) for k in range(length)]
                        grams.append(pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0])
                        counts.append(count)
            for g, c in zip(grams, counts, strict=True):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(g)), g, pa.array(c.astype(np.int64))], ["lang", "gram", "c"])

    return _texts(docs).mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _first(gram, words: int):
    return F.substring_index(gram, " ", words)


def _last(gram, words: int):
    return F.substring_index(gram, " ", -words)


def flows(edges: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, a): phrases of one to four words that are found least times, by the flow of the counted runs through them."""
    grams = edges.filter("gram is not null").withColumn("size", F.size(F.split("gram", " ")))
    shorter = grams.select("lang", "c", F.explode(F.filter(F.array(*(F.when(F.col("size") >= k, F.struct(F.lit(k).alias("k"), _first("gram", k).alias("phrase"))) for k in (1, 2, 3))), lambda x: x.isNotNull())).alias("x"))
    shorter = shorter.groupBy("lang", "x.phrase", "x.k").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
    return shorter.select("lang", "phrase", "k", "a").unionByName(grams.filter((F.col("size") == 4) & (F.col("c") >= least)).select("lang", F.col("gram").alias("phrase"), F.lit(4).alias("k"), F.col("c").alias("a")))


def unary_paths(counts: DataFrame) -> DataFrame:
    """(lang, words, a): compacted paths of the edges (k = 4) in counts."""
    edges = counts.filter("k = 4").select("lang", F.col("phrase").alias("edge"), "a")
    nodes = counts.filter("k = 3").select("lang", F.col("phrase").alias("node"), "a")
    into = edges.select("lang", F.col("edge").alias("head"), _last("edge", 3).alias("node"), "a").join(nodes, ["lang", "node", "a"])
    out = edges.select("lang", "edge", _first("edge", 3).alias("node"), "a").join(nodes, ["lang", "node", "a"])
    at = stash(into.join(out, ["lang", "node"]).select("lang", "edge", "head", F.lit(1).cast("long").alias("steps")), "phrase-links")
    while True:  # each edge looks up what its head so far looks back to
        up = at.select("lang", F.col("edge").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        far = stash(at.join(up, ["lang", "head"], "left").select("lang", "edge", F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("more").isNotNull().alias("moved")), "phrase-links")
        release(at)
        at = far.drop("moved")
        at._stash_path = far._stash_path
        if not far.filter("moved").limit(1).count():
            break
    placed = edges.join(at, ["lang", "edge"], "left").select("lang", F.coalesce("head", "edge").alias("head"), F.struct(F.coalesce("steps", F.lit(0)).alias("steps"), _last("edge", 1).alias("word")).alias("x"), "a")
    paths = placed.groupBy("lang", "head").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.min("a").alias("a"))
    out = stash(paths.select("lang", F.concat(F.split(_first("head", 3), " "), F.transform("xs", lambda x: x["word"])).alias("words"), "a"), "phrase-paths")
    release(at)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of phrases of two words and more: their lowest-scoring cut, of equal scores the earliest."""
    found = counts.filter("k >= 2")
    cuts = found.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    count = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(19, 0)) * 2000000BD) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"))
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def inside_longer(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """(lang, phrase, most): for phrases of two and three words that lie in a longer one, the largest count of such a one."""

    def parts(k: int):
        return F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, F.lit(k)), " "))

    of_paths = paths.select("lang", "a", F.explode(F.concat(parts(2), parts(3))).alias("phrase"))
    of_threes = counts.filter("k = 3").select("lang", "a", F.explode(F.array(_first("phrase", 2), _last("phrase", 2))).alias("phrase"))
    return of_paths.unionByName(of_threes).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Written tables (lang, phrase, k, a) of all phrases up to four words found least times, and (lang, n) of all words."""
    pairs = stash(frequent_pairs(docs, least), "phrase-pairs")
    frequent = key_filter(pairs, "h")
    edges = stash(runs(docs, frequent), "phrase-edges")
    counts = stash(flows(edges, least), "phrase-counts")
    words = stash(edges.filter("gram is null").select("lang", F.col("c").alias("n")), "phrase-words")
    release(pairs, edges)
    return counts, words


def long_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n_words, a): the compacted paths, phrases of four words and more that are found alike throughout."""
    return unary_paths(phrase_counts(docs, least)[0]).select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("n_words"), "a")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases."""
    counts, words = phrase_counts(docs, least)
    longer = inside_longer(counts, unary_paths(counts))
    kept = scored(counts).join(longer, ["lang", "phrase"], "left").filter("most is null or 5 * most < 4 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
