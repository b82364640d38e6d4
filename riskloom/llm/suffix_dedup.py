"""Removal of byte strings of a given length that start anywhere else too, within a document or in another.

Equal strings of `length` bytes have their smallest 64-byte hash at the same place, the anchor, so only strings around equal
anchors need comparing. A document's strings with one anchor form a run; as each holds the anchor, a run's repeated strings cover
one span around it.

1. Each document gives its distinct runs: anchor hash, 128-bit digest of the run's bytes, places. Runs found twice or more, in one
   document or several, are repeated throughout. One of each class of equal runs goes on, if its anchor has other classes.
2. Suffix sort. The runs of an anchor, with their bytes, are put in order of what follows the anchor, and of what stands before it read
   backwards, by a mergesort. Prefix sums of a polynomial hash give the common extension of two suffixes by binary search, so that a
   comparison takes a logarithmic number of steps. Neighbours' common extensions L before and R from the anchor are then taken from
   the bytes themselves; where a collision of hashes has misled the sort, the group is sorted again by its bytes. Two runs share a
   string where L + R comes to `length` or more.
3. Anchors of more than `group` classes, such as the edges of a passage that very many documents share, are never gathered. Their runs
   are sorted over all tasks, by ranges of what follows the anchor and of what stands before it. No extension of a run to one side is
   longer than that with a neighbour in that order; what a run shares with near neighbours is repeated for certain. Strings between
   the two bounds are counted by a 128-bit digest, with those strings of other runs that a membership filter lets through.

Repeats of two lengths: a string of `length` bytes that is found again lies in a span of the shorter strings that are, in each of its places.
So the shorter ones are looked for in all texts, and the longer ones in those spans alone, each taken as a text.

Null text: no bytes. Matches never cross documents. Rows of equal id and text are two documents. Long texts are read in pieces of
1 MB. Empty tables give empty results; further columns of any name are carried or left out, never read. Ties need no rule: all
copies of a repeated string go. Strings counted in steps 1 and 3 are equal by 128-bit digest, all others by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, release, row_key, small_batches, stash
from .textops import mix, powers, prefix_hash, span_hash, text_bytes

GRAM, SEGMENT = 64, 1 << 20
GROUP = 1024
PASSAGE = 200  # bytes: a repeated passage of more than 50 words has them, at four bytes a word, space included
CHUNK = 2048  # runs sorted at once, or one group
U = np.uint64
LOW = U(0xFFFFFFFF)
SPANS = "k long, starts array<long>, n long"
LONGS = pa.list_(pa.int64())


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(text: np.ndarray, length: int):
    """For each piece of a text: (place, bytes, anchor hash, anchor, first start, last start), positions in the piece."""
    for at in range(0, max(1, len(text) - length + 1), SEGMENT):
        data = text[at : at + SEGMENT + length - 1]
        if len(data) < length:
            return
        i = np.arange(len(data) - GRAM + 1)
        h = mix(span_hash(prefix_hash(data), i, i + GRAM))
        anchor = (_window_min((h & ~LOW) | i.astype(U), length - GRAM + 1) & LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
        yield at, data, h[anchor[first]].view(np.int64), anchor[first], first, last


def _digests(data: np.ndarray, starts, ends) -> np.ndarray:
    """128-bit digests of spans, as rows of two 64-bit values."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _run_key(k: int, anchor: np.ndarray) -> np.ndarray:
    """A 64-bit key of a document's run."""
    return mix(U(k & (1 << 64) - 1) ^ mix(anchor.astype(U))).view(np.int64)


def _distinct_runs(length: int):
    names = ["k", "g", "d1", "d2", "r", "n", "starts"]

    def run(batches):
        for b in batches:
            data, offsets, _ = text_bytes(b.column("text"))
            cols: list[list] = [[] for _ in names]
            for k, lo, hi in zip(b.column("k").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for at, piece, g, q, s, e in runs(data[lo:hi], length):
                    d = _digests(piece, s, e + length)
                    _, first, inverse = np.unique(d[:, 0], return_index=True, return_inverse=True)
                    if (d[first[inverse], 1] != d[:, 1]).any():
                        _, first, inverse = np.unique(d, axis=0, return_index=True, return_inverse=True)
                    order = np.argsort(inverse.ravel(), kind="stable")
                    ends = np.cumsum(np.bincount(inverse.ravel()))
                    cols[0].append(np.full(len(first), k))
                    for col, x in zip(cols[1:6], (g[first], d[first, 0], d[first, 1], _run_key(k, q[first] + at), e[first] - s[first] + length), strict=True):
                        col.append(x)
                    cols[6].append((s[order] + at, ends))
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols[:6]]
            sizes = np.concatenate([np.diff(x[1], prepend=0) for x in cols[6]]) if cols[6] else np.zeros(0, np.int64)
            values = np.concatenate([x[0] for x in cols[6]]) if cols[6] else np.zeros(0, np.int64)
            starts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in flat), starts], names)

    return run


def _chosen(batch, length: int, wanted):
    """(k, g, q, piece, place of the piece, first and last start) of a batch's runs that are wanted."""
    data, offsets, _ = text_bytes(batch.column("text"))
    for k, lo, hi in zip(batch.column("k").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for at, piece, g, q, s, e in runs(data[lo:hi], length):
            pick = np.flatnonzero(wanted.value.mask(_run_key(k, q + at)))
            if len(pick):
                yield k, g[pick], q[pick], piece, at, s[pick], e[pick]


def _contexts(wanted, hot, length: int):
    """The wanted runs with their bytes, and whether their anchor is hot, in one pass over the texts."""

    def run(batches):
        for b in batches:
            for k, g, q, piece, at, s, e in _chosen(b, length, wanted):
                view = piece.tobytes()
                text = [view[x:y] for x, y in zip(s.tolist(), (e + length).tolist(), strict=True)]
                crowded = np.zeros(len(g), bool) if hot is None else hot.value.mask(g)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), k)), pa.array(q + at), pa.array(q - s), pa.array(text, pa.binary()), pa.array(crowded)], ["g", "k", "q", "before", "text", "hot"])

    return run


def _strings(length: int, some=None):
    """Strings of runs with their bytes: place and digest. Those that a filter of digests lets through, or those that start a bytes before
    the anchor for a in (sure_l, most_l] or length - a in (sure_r, most_r]."""

    def run(batches):
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            for i, (k, q, before, text) in enumerate(zip(*(cols[c] for c in ("k", "q", "before", "text")), strict=True)):
                start = np.arange(len(text) - length + 1)
                if some is None:
                    a = before - start
                    of = lambda x: cols[x][i]  # noqa: B023, E731
                    start = start[(a <= of("most_l")) & (length - a <= of("most_r")) & ((a > of("sure_l")) | (length - a > of("sure_r")))]
                d = _digests(np.frombuffer(text, np.uint8), start, start + length)
                if some is not None:
                    hit = some.value.mask(d[:, 0])
                    start, d = start[hit], d[hit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(start), k), np.full(len(start), q), q - before + start, d[:, 0], d[:, 1])], ["k", "q", "start", "d1", "d2"])

    return run


# ---------------------------------------------------------------- suffix sort of the runs of one anchor

class Suffixes:
    """Runs side by side, their anchors in one column; compares what follows the anchor (step 1) or stands before it (step -1)."""

    def __init__(self, texts: list[bytes], before: np.ndarray, length: int):
        size = np.array([len(t) for t in texts])
        self.at = length - GRAM
        self.bytes = np.zeros((len(texts), self.at + length), np.uint8)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at - before, size)
        self.bytes[np.repeat(np.arange(len(texts)), size), place] = np.frombuffer(b"".join(texts), np.uint8)
        self.sums = np.zeros((len(texts), self.bytes.shape[1] + 1), U)
        np.cumsum((self.bytes.astype(U) + U(1)) * powers(self.bytes.shape[1])[: self.bytes.shape[1]], axis=1, out=self.sums[:, 1:])
        self.size = {1: size - before, -1: before}

    def extension(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """Length of the common extension of runs x and y, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[step][x], self.size[step][y])
        hx, hy = self.sums[x, self.at], self.sums[y, self.at]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.sums[x, self.at + step * mid] - hx == self.sums[y, self.at + step * mid] - hy
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _next(self, x: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
        """The byte after n common ones; -1 at the end."""
        at = self.at + n if step > 0 else self.at - 1 - n
        return np.where(n < self.size[step][x], self.bytes[x, np.clip(at, 0, self.bytes.shape[1] - 1)].astype(np.int64), -1)

    def compare(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        n = self.extension(x, y, step)
        return self._next(x, n, step) - self._next(y, n, step)

    def sort(self, start: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
        """Runs in order within each group; start, size: of the group, for each run. A mergesort of all groups side by side: each
        element finds its rank in the run beside its own by binary search."""
        order = np.arange(len(start))
        place = order - start
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(size > width)
            me, run = order[at], place[at] // width
            base, other = start[at], run ^ 1
            low, high = np.zeros(len(at), np.int64), np.clip(size[at] - other * width, 0, width)
            while (low < high).any():
                go = np.flatnonzero(low < high)
                mid = (low[go] + high[go]) >> 1
                sign = self.compare(order[base[go] + other[go] * width + mid], me[go], step)
                after = np.where(run[go] & 1, sign <= 0, sign < 0)
                low[go], high[go] = np.where(after, mid + 1, low[go]), np.where(after, high[go], mid)
            order[base + (run & ~1) * width + (place[at] - run * width) + low] = me
            width *= 2
        return order

    def string(self, x: int, step: int) -> bytes:
        n = int(self.size[step][x])
        return self.bytes[x, self.at : self.at + n].tobytes() if step > 0 else self.bytes[x, self.at - n : self.at][::-1].tobytes()

    def common(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """As extension, by the bytes."""
        span = slice(self.at, None) if step > 0 else slice(None, self.at)
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 512):
            same = self.bytes[x[i : i + 512], span] == self.bytes[y[i : i + 512], span]
            same = np.concatenate((same if step > 0 else same[:, ::-1], np.zeros((len(same), 1), bool)), axis=1)
            out[i : i + 512] = same.argmin(axis=1)
        return np.minimum(out, np.minimum(self.size[step][x], self.size[step][y]))

    def neighbours(self, start: np.ndarray, size: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, common extension with the next run in it), by the bytes. A sort that a collision misled is done again by bytes."""
        order = self.sort(start, size, step)
        x, y = order[:-1], order[1:]
        common = self.common(x, y, step)
        inner = start[1:] == start[:-1]
        if (inner & (self._next(x, common, step) > self._next(y, common, step))).any():
            order = np.array(sorted(range(len(start)), key=lambda i: (start[i], self.string(i, step))))
            return order, np.array([len(_common(self.string(a, step), self.string(b, step))) for a, b in zip(order[:-1], order[1:], strict=True)], np.int64)
        return order, common


def _common(a: bytes, b: bytes) -> bytes:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def repeated_parts(g: np.ndarray, before: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run, how far before and from its anchor the strings reach that another run of its anchor has too; 0, 0: none.

    g: anchor hashes, equal ones side by side."""
    first = np.concatenate(([True], g[1:] != g[:-1]))
    begins = np.flatnonzero(first)
    sizes = np.diff(np.concatenate((begins, [len(g)])))
    start, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    s = Suffixes(texts, before, length)
    sorted_by = {step: s.neighbours(start, size, step) for step in (1, -1)}
    left, right = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
    two = begins[sizes == 2]
    ok = sorted_by[1][1][two] + sorted_by[-1][1][two] >= length
    for i in (0, 1):
        right[two[ok] + i], left[two[ok] + i] = sorted_by[1][1][two[ok]], sorted_by[-1][1][two[ok]]
    for b, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        of = {}
        for step, (order, common) in sorted_by.items():
            o, c = order[b : b + n] - b, common[b : b + n - 1]
            rank = np.empty(n, np.int64)
            rank[o] = np.arange(n)
            of[step] = o, c, rank
        shared = {step: np.empty(n, np.int64) for step in of}
        for i in range(n):
            for step, (o, c, rank) in of.items():  # a pair's common extension is the least of those between neighbours
                r, x = rank[i], shared[step]
                x[o[:r]] = np.minimum.accumulate(c[:r][::-1])[::-1]
                x[o[r + 1 :]] = np.minimum.accumulate(c[r:])
                x[i] = -length
            hit = shared[1] + shared[-1] >= length
            if hit.any():
                right[b + i], left[b + i] = shared[1][hit].max(), shared[-1][hit].max()
    return left, right


def _compare(length: int):
    def done(t):
        left, right = repeated_parts(t.column("g").to_numpy(), t.column("before").to_numpy(), t.column("text").to_pylist(), length)
        hit = np.flatnonzero(right)
        starts = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1), pa.int32()), pa.array(t.column("q").to_numpy()[hit] - left[hit], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(t.column("k").to_numpy()[hit]), starts, pa.array(left[hit] + right[hit])], ["k", "starts", "n"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            g = t.column("g").to_numpy()
            ends = np.flatnonzero(g[1:] != g[:-1]) + 1  # whole groups so far
            at = 0
            while len(ends) and ends[-1] - at >= CHUNK:
                cut = int(ends[min(np.searchsorted(ends, at + CHUNK), len(ends) - 1)])
                yield done(t.slice(at, cut - at))
                at = cut
            rest = t.slice(at)
        if rest is not None and rest.num_rows:
            yield done(rest)

    return run


# ---------------------------------------------------------------- runs of an anchor with very many classes

def _beside(length: int, step: int, near: int = 3):
    """For rows in order of the anchor and what is to one side of it: the longest extension to that side (most; all there is where a
    neighbour may be in another task), and how far to this and the other side a near row shares strings for certain."""
    names = ["k", "q", "most", "sure", "sure_other"]

    def out(t, start: int, stop: int, first: bool, last: bool):
        s = Suffixes(t.column("text").to_pylist(), t.column("before").to_numpy(), length)
        n, g = t.num_rows, t.column("g").to_numpy()
        most, sure, other = (np.zeros(n, np.int64) for _ in range(3))
        for d in range(1, min(near, n - 1) + 1):
            x = np.arange(n - d)
            same = g[x] == g[x + d]
            e, o = (np.where(same, s.common(x, x + d, z), 0) for z in (step, -step))
            fits = e + o >= length
            for at in (x, x + d):
                if d == 1:
                    most[at] = np.maximum(most[at], e)
                sure[at], other[at] = np.maximum(sure[at], e * fits), np.maximum(other[at], o * fits)
        if first:
            most[0] = s.size[step][0]
        if last:
            most[n - 1] = s.size[step][n - 1]
        return pa.RecordBatch.from_arrays([t.column("k").to_numpy()[start:stop], t.column("q").to_numpy()[start:stop], *(x[start:stop] for x in (most, sure, other))], names)

    def run(batches):
        held, start, first = None, 0, True  # start: the first row of held not given out; `near` rows before it are kept
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            stop = t.num_rows - near
            if stop > start:
                yield out(t, start, stop, first, False)
                start, first = stop, False
            keep = max(0, start - near)
            held, start = t.slice(keep), start - keep
        if held is not None and held.num_rows:
            yield out(held, start, held.num_rows, first, True)

    return run


def _crowded(hot: DataFrame, length: int) -> list[DataFrame]:
    """Spans of runs (g, k, q, before, text) whose anchors have very many classes."""
    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = F.reverse(F.substring(F.hex("text"), F.lit(1), 2 * F.col("before")))  # digits backwards: an order in which long extensions are near
    found = {}
    with small_batches(hot.sparkSession, CHUNK):
        keyed = hot.withColumns({"r": F.substring(F.hex("text"), 2 * F.col("before") + 1, F.lit(2 * length)), "l": side})
        for name, step, keys in (("r", 1, ["g", "r", "l"]), ("l", -1, ["g", "l", "r"])):  # no two runs are equal on both sides, so all can be parted
            rows = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("r", "l")
            found[name] = stash(rows.mapInArrow(_beside(length, step), "k long, q long, most long, sure long, sure_other long"), "suf-beside")
    r, l = (found[c].select("k", "q", *[F.col(x).alias(f"{x}_{c}") for x in ("most", "sure", "sure_other")]) for c in "rl")  # noqa: E741
    both = r.hint("merge").join(l, ["k", "q"]).select("k", "q", "most_l", "most_r", F.greatest("sure_l", "sure_other_r").alias("sure_l"), F.greatest("sure_r", "sure_other_l").alias("sure_r"))
    both = stash(both, "suf-both")
    spans = [both.filter("sure_r > 0").select("k", F.array(F.col("q") - F.col("sure_l")).alias("starts"), (F.col("sure_l") + F.col("sure_r")).alias("n"))]
    open_ = both.filter((F.col("most_l") + F.col("most_r") >= length) & ((F.col("sure_l") < F.col("most_l")) | (F.col("sure_r") < F.col("most_r"))))
    schema = "k long, q long, start long, d1 long, d2 long"
    asked = stash(hot.hint("merge").join(open_, ["k", "q"]).mapInArrow(_strings(length), schema), "suf-asked")
    if not asked.isEmpty():
        strings = stash(hot.mapInArrow(_strings(length, key_filter(asked, "d1")), schema), "suf-strings")
        again = stash(strings.groupBy("d1", "d2").agg(F.count("*").alias("c")).filter("c > 1").select("d1", "d2"), "suf-again")
        reach = asked.hint("merge").join(again, ["d1", "d2"], "left_semi").groupBy("k", "q").agg(F.min("start").alias("a"), F.max("start").alias("b"))
        spans.append(stash(reach.select("k", F.array("a").alias("starts"), (F.col("b") - F.col("a") + length).alias("n")), "suf-counted"))
        release(strings, again)
    release(asked, *found.values())
    return spans


def repeated_spans(texts: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """(k, spans): spans of bytes covered by strings that start elsewhere too, as array<struct<starts, n>>; texts has k and text."""
    spark = texts.sparkSession
    with small_batches(spark, 512):
        occ = stash(texts.mapInArrow(_distinct_runs(length), "k long, g long, d1 long, d2 long, r long, n long, starts array<long>"), "suf-runs")
    classes = occ.groupBy("g", "d1", "d2").agg(F.sum(F.size("starts")).alias("c"), F.min("r").alias("r"))
    classes = stash(classes, "suf-classes")
    twice = classes.filter("c > 1").select("d1", "d2")
    spans = [stash(occ.hint("merge").join(twice, ["d1", "d2"], "left_semi").select("k", "starts", "n"), "suf-whole")]

    anchors = stash(classes.groupBy("g").agg(F.count("*").alias("classes")).filter("classes > 1"), "suf-anchors")
    mixed = stash(classes.hint("merge").join(anchors, "g", "left_semi").select("r"), "suf-mixed")
    wanted = key_filter(mixed, "r")
    crowded = anchors.filter(F.col("classes") > group)
    hot = None if crowded.isEmpty() else key_filter(crowded, "g")
    release(occ, classes, anchors, mixed)
    with small_batches(spark, 512):
        found = texts.mapInArrow(_contexts(wanted, hot, length), "g long, k long, q long, before long, text binary, hot boolean")
        if hot is not None:
            found = stash(found, "suf-found")
        cool = found.filter("not hot").drop("hot").repartition("g").sortWithinPartitions("g")
        spans.append(stash(cool.mapInArrow(_compare(length), SPANS), "suf-sorted"))
        if hot is not None:  # rows of equal id and text are of a class found twice already
            crowd = stash(found.filter("hot").drop("hot").dropDuplicates(["k", "q"]), "suf-hot")
            release(found)
            spans += _crowded(crowd, length)
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    out = stash(every.groupBy("k").agg(F.collect_list(F.struct("starts", "n")).alias("spans")), "suf-spans")
    release(*(x for x in spans if hasattr(x, "_stash_path")))
    return out


def _pieces(length: int):
    """Spans of at least `length` bytes of each text, as texts of their own: key, the document's key, place, bytes."""

    def run(batches):
        for b in batches:
            data, offsets, _ = text_bytes(b.column("text"))
            rows = []
            for k, lo, hi, s in zip(b.column("k").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), b.column("spans").to_pylist(), strict=True):
                view = data[lo:hi]
                rows += [(k, x, view[x:y].tobytes()) for x, y in union_of(s) if y - x >= length]
            k, at, text = zip(*rows, strict=True) if rows else ((), (), ())
            k, at = np.array(k, np.int64), np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(k.view(U) ^ mix(at.astype(U))).view(np.int64)), pa.array(k), pa.array(at), pa.array(text, pa.binary())], ["p", "k", "at", "text"])

    return run


def nested_spans(texts: DataFrame, length: int, passage: int, group: int = GROUP) -> DataFrame:
    """(k, spans, passages): the repeated spans of `length` bytes and those of `passage` bytes, which are no longer."""
    outer = repeated_spans(texts, passage, group)
    if passage == length:
        return outer.withColumn("passages", F.col("spans"))
    with small_batches(texts.sparkSession, 512):
        pieces = stash(texts.hint("merge").join(outer, "k").mapInArrow(_pieces(length), "p long, k long, at long, text binary"), "suf-pieces")
    inner = repeated_spans(pieces.select(F.col("p").alias("k"), "text"), length, group).withColumnRenamed("k", "p")
    placed = F.transform("spans", lambda s: F.struct(F.transform(s["starts"], lambda x: x + F.col("at")).alias("starts"), s["n"].alias("n")))
    back = pieces.select("p", "k", "at").dropDuplicates(["p"]).hint("merge").join(inner, "p").groupBy("k").agg(F.flatten(F.collect_list(placed)).alias("spans"))
    out = stash(outer.withColumnRenamed("spans", "passages").hint("merge").join(back, "k", "left").select("k", "spans", "passages"), "suf-nested")
    release(outer, pieces)
    return out


def union_of(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((a, a + x["n"]) for x in spans or () for a in x["starts"]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _kept(data: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _joined(docs: DataFrame, find) -> DataFrame:
    """(row, spans, ...): each row of docs as a struct, so that no name of its columns can clash, and what find gives for texts (k, text)."""
    spans = find(docs.select(row_key("doc_id", "text").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    return docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("k")).hint("merge").join(spans, "k", "left").drop("k")


def removal_digests(docs: DataFrame, length: int = 400, group: int = GROUP, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the digest of what is left, and its bytes; and the bytes covered by strings of `passage` bytes,
    or `length` if that is less, that are found again. Those are counted, not removed."""
    passage = min(passage, length)

    def run(batches):
        for b in batches:
            rows = []
            for t, s, p in zip(b.column("text"), b.column("spans"), b.column("passages"), strict=True):
                data, spans = (t.as_py() or "").encode(), union_of(s.as_py())
                left = _kept(data, spans)
                rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), len(left), sum(y - x for x, y in union_of(p.as_py()))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "passage_bytes"])

    found = _joined(docs.select("doc_id", "text"), lambda texts: nested_spans(texts, length, passage, group))
    return found.select("row.doc_id", "row.text", "spans", "passages").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long, passage_bytes long")


def without_repeats(docs: DataFrame, length: int = 400, group: int = GROUP) -> DataFrame:
    """docs with the repeated bytes cut from text (bytes of characters that are cut through go too) and n_chars counted anew."""
    names = docs.columns

    def run(batches):
        for b in batches:
            of = dict(zip(names, b.column("row").flatten(), strict=True))
            text = [t if t is None or not s else _kept(t.encode(), union_of(s)).decode("utf-8", "ignore") for t, s in zip(of["text"].to_pylist(), b.column("spans").to_pylist(), strict=True)]
            own = {"text": pa.array(text, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in text], pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c].cast(of[c].type) if c in own else of[c] for c in names], names)

    return _joined(docs, lambda texts: repeated_spans(texts, length, group)).mapInArrow(run, docs.schema)
