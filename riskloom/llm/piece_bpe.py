"""SentencePiece encoding for merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs, checked against the library.

A text goes through the library's normalizer and becomes symbols, one a character. The agenda is a heap of adjacent pairs that are pieces
when joined; the best score leaves first, of equal scores the leftmost. A pair whose sides have changed since it was put in is stale and
dropped; a merge puts in the pairs with both neighbours. Short stretches have their agendas side by side as rows of a matrix, each round
taking every row's best pair, which is the same order. Characters that are no piece become byte pieces where the model has them, else
runs of them become one unknown id.

Two neighbouring characters that no piece has side by side can never be merged, whatever else happens, so the text is cut there and the
cuts' agendas don't depend on each other: what follows one word mark, and within it each stretch between such neighbours, is worked out
once per worker, words are kept in a cache of bounded size. In each Arrow batch the library encodes what the agenda worked out anew: every word
before it enters the cache, whole texts where they aren't cut, and one whole text at least. If a word differs, all whole texts are
compared; a text that differs is an error that shows it, never a silent repair.

Null and empty texts have no ids and decode to an empty text. Very long texts are encoded whole; a text without any cut is one agenda of
its length. Rows with equal ids or equal texts each get their own result; nulls in other columns pass through. An empty table gives an
empty result. Columns of docs called as an added column (ids, pieces, text of decode) are replaced; all others stay, whatever their names;
`digests` has doc_id and its digests alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

CACHE = 900_000  # words that a worker keeps; it starts anew when full
LETTERS = 1 << 20  # characters encoded at once
WIDE = 24  # characters of a stretch up to which many agendas go side by side
NEVER = np.int64(1) << 40
TOGETHER = 64  # words that the library checks as one text
MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5  # fixed values of the model file's piece types
_MERGE_MODEL = 2  # fixed value of the model file's type of merge models
_models: dict[str, Pieces] = {}
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes):
    """(number, value) of the fields of one message of the model file; a value is an int, four bytes or bytes."""

    def number(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ((4 if key & 7 == 5 else 8), at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """A merge-type model: scores and ids of its pieces, the agenda, and the library for its normalizer, decoder and check."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        kind = next((v for k, b in model if k == 2 for f, v in _fields(b) if f == 3), 1)
        if kind != _MERGE_MODEL:
            raise ValueError(f"{path} is no merge-type model")
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.name: list[str] = []
        score_of: dict[str, float] = {}
        for i, message in enumerate(b for k, b in model if k == 1):
            got = dict(_fields(message))
            piece, score, kind = got.get(1, b"").decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, _NORMAL)
            self.name.append(piece)
            if kind in (_USER, _UNUSED):
                raise ValueError(f"{path}: user-defined and unused pieces aren't built ({piece!r})")
            if kind == _NORMAL:
                self.id_of[piece], score_of[piece] = i, score
            elif kind == _BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
        place = {s: r for r, s in enumerate(sorted(set(score_of.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in score_of.items()}  # equal scores, equal ranks
        self.unknown = self.library.unk_id()
        self.meet = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}  # neighbours inside some piece
        self.splits = bool(self.byte_id) and not any(m[1] == MARK and m[0] != MARK for m in self.meet)
        self.prefixed = self.library.normalize("a") == MARK + "a"
        self.decimal = [str(i) for i in range(len(self.name))]
        self.words: dict[str, list[int]] = {}
        self._tables()

    def _tables(self) -> None:
        """Sorted arrays for work on many words at once: symbols of characters, neighbours, and the pairs of symbols that join."""
        inner = sorted({c for p in self.rank for c in p} - self.id_of.keys())  # characters of pieces that are no pieces themselves
        symbol = self.id_of | {c: len(self.name) + k for k, c in enumerate(inner)}
        single = {ord(c): i for c, i in symbol.items() if len(c) == 1}
        single |= {b: i for b, i in self.byte_id.items() if b < 128 and b not in single}  # one byte, one piece, never joined
        self.symbols = np.full(0x110000, -1, np.int64)
        self.symbols[list(single)] = list(single.values())
        place = {c: i for i, c in enumerate(sorted({c for m in self.meet for c in m}), 1)}
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in place]] = list(place.values())
        self.neighbours = np.zeros((len(place) + 1, len(place) + 1), bool)
        for m in self.meet:
            self.neighbours[place[m[0]], place[m[1]]] = True
        joins = {symbol[p[:k]] << 32 | symbol[p[k:]]: p for p in self.rank for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ids = np.array([self.id_of[joins[k]] for k in self.join_keys.tolist()], np.int64)
        self.join_ranks = np.array([self.rank[joins[k]] for k in self.join_keys.tolist()], np.int64)

    def agenda(self, text: str) -> list[int]:
        """Where the symbols of one text end. An entry of the agenda is one number: rank, first character and end of the joined pair."""
        get, n = self.rank.get, len(text)
        w = n.bit_length()
        mask = (1 << w) - 1
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts here; end 0: it starts here no more
        heap = []
        for i in range(n - 1):
            r = get(text[i : i + 2])
            if r is not None:
                heap.append((r << w | i) << w | i + 2)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            a, e = entry >> w & mask, entry & mask
            middle = end[a]
            if not middle or middle >= n or end[middle] != e:
                continue  # one side has changed since
            end[a], end[middle] = e, 0
            if e < n:
                before[e] = a
                r = get(text[a : end[e]])
                if r is not None:
                    heapq.heappush(heap, (r << w | a) << w | end[e])
            p = before[a]
            if p >= 0:
                r = get(text[p:e])
                if r is not None:
                    heapq.heappush(heap, (r << w | p) << w | e)
        out, at = [], 0
        while at < n:
            at = end[at]
            out.append(at)
        return out

    def merge(self, text: str) -> list[int]:
        """Ids of one text by the agenda."""
        out: list[int] = []
        at = 0
        for end in self.agenda(text):
            found = self.id_of.get(text[at:end])
            if found is not None:
                out.append(found)
            elif self.byte_id:
                out += [self.byte_id[x] for x in text[at:end].encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at = end
        return out

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what two symbols join to, the rank NEVER where that is no piece."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.join_ranks[at], NEVER), self.join_ids[at]

    def _agendas(self, symbol: np.ndarray, starts: np.ndarray, sizes: np.ndarray, alive: np.ndarray) -> None:
        """The agendas of many short stretches side by side: in each round every stretch joins its best pair, of equal ranks the leftmost."""
        width = int(sizes.max())
        place = starts[:, None] + np.arange(width)
        inside = np.arange(width) < sizes[:, None]
        s = np.full((len(starts), width + 1), -1, np.int64)
        s[:, :width][inside] = symbol[place[inside]]
        after = np.tile(np.arange(1, width + 2), (len(starts), 1))  # column `width` ends every row
        before = np.tile(np.arange(-1, width), (len(starts), 1))
        live = inside.copy()
        rank, joined = (x.reshape(len(starts), width) for x in self._joined(s[:, :-1].ravel(), s[:, 1:].ravel()))
        rows = np.arange(len(starts))
        while len(rows):
            a = rank[rows].argmin(1)
            go = rank[rows, a] < NEVER
            rows, a = rows[go], a[go]
            if not len(rows):
                break
            b = after[rows, a]
            c = np.minimum(after[rows, b], width)
            s[rows, a] = joined[rows, a]
            after[rows, a] = c
            before[rows, c] = a
            live[rows, b] = False
            rank[rows, b] = NEVER
            rank[rows, a], joined[rows, a] = self._joined(s[rows, a], s[rows, c])
            p = before[rows, a]
            has = p >= 0
            q, p = rows[has], p[has]
            rank[q, p], joined[q, p] = self._joined(s[q, p], s[q, a[has]])
        symbol[place[inside]] = s[:, :width][inside]
        alive[place[inside]] = live[inside]

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of many words, each cut between characters that are never neighbours in a piece."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        text = "".join(words)
        point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbol, place = self.symbols[point], self.place[point]
        begins = np.ones(len(point), bool)
        begins[1:] = ~self.neighbours[place[:-1], place[1:]]
        begins[first] = True
        starts = np.flatnonzero(begins)
        length = np.diff(np.append(starts, len(point)))
        alive = np.ones(len(point), bool)
        for low, high in ((2, 6), (7, 12), (13, WIDE)):
            those = (length >= low) & (length <= high)
            if those.any():
                self._agendas(symbol, starts[those], length[those], alive)
        for x, n in zip(*(v[length > WIDE].tolist() for v in (starts, length)), strict=True):
            alive[x : x + n], begin = False, 0
            for end in self.agenda(text[x : x + n]):
                alive[x + begin], symbol[x + begin] = True, self.id_of.get(text[x + begin : x + end], symbol[x + begin])
                begin = end
        odd = np.logical_or.reduceat(alive & ((symbol < 0) | (symbol >= len(self.name))), first)
        count = np.add.reduceat(alive, first, dtype=np.int64)
        ids, ends = symbol[alive].tolist(), np.cumsum(count).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.merge(words[k])  # characters of several byte pieces
        return out

    def _same(self, raw: list[str], mine: list[list[int]]) -> bool:
        return mine == self.library.encode(raw, out_type=int, add_bos=False, add_eos=False, enable_sampling=False, num_threads=1)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        normal = self.library.normalize(texts)
        words: list[list[str] | None] = []  # of a text, each without the mark that it begins with
        for t in normal:
            if not t or not self.splits or t[0] != MARK:
                words.append(None)
            else:
                words.append([w[1:] for w in _WORD.findall(t)] if MARK * 2 in t else t[1:].split(MARK))
        if len(self.words) > CACHE:
            self.words.clear()
        known = self.words
        new = list(set(chain.from_iterable(w for w in words if w)).difference(known))
        known.update(zip(new, self.merge_words([MARK + w for w in new]), strict=True))
        get = known.__getitem__
        out = [list(chain.from_iterable(map(get, w))) if w else self.merge(t) for t, w in zip(normal, words, strict=True)]
        raw, lead = [], "" if self.prefixed else " "
        for at in range(0, len(new), TOGETHER):  # words side by side are a text in which each is a word again
            raw.append(lead + " ".join(new[at : at + TOGETHER]).replace(MARK, " "))
        mine = [list(chain.from_iterable(map(get, new[at : at + TOGETHER]))) for at in range(0, len(new), TOGETHER)]
        whole = [i for i, w in enumerate(words) if not w] or [0]
        if not self._same(raw, mine) or not self._same([texts[i] for i in whole], [out[i] for i in whole]):
            for i, t in enumerate(texts):
                if not self._same([t], [out[i]]):
                    raise ArithmeticError(f"ids of a text of {len(t)} characters differ from the library's: {out[i][:50]} for {t[:100]!r}")
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text by the agenda, held against the library's."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < LETTERS):
                size += len(texts[end])
                end += 1
            out += self._batch(texts[at:end])
            at = end
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def load(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text", pieces: bool = False) -> DataFrame:
    """docs with `ids`, and their `pieces` if asked for."""

    def of(column):
        model = load(path)
        ids = model.encode([x.as_py() or "" for x in column])
        out = [pa.array(ids, pa.list_(pa.int32()))]
        return [*out, pa.array([[model.name[i] for i in x] for x in ids], pa.list_(pa.string()))] if pieces else out

    return with_columns(docs, text, {"ids": "array<int>"} | ({"pieces": "array<string>"} if pieces else {}), of)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with `text`, what the library's decoder makes of the ids; null ids are none."""
    return with_columns(tokens, ids, {"text": "string"}, lambda column: [pa.array(load(path).decode([x.as_py() or [] for x in column]), pa.string())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded, checked and decoded in one pass."""

    def run(batches):
        model = load(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            n, names, back = [], [], []
            for at in range(0, b.num_rows, 256):
                ids = model.encode([x.as_py() or "" for x in b.column("text").slice(at, 256)])
                n += map(len, ids)
                names += [sha(",".join([model.decimal[i] for i in x])) for x in ids]
                back += map(sha, model.decode(ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
